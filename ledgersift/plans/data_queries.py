"""Queries of the general data operators (problems 4 and 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.operators.history import vendor_ledger
from ledgersift.operators.rolling import one_per_key, trailing_totals
from ledgersift.session import table


def p4_trailing(spark: SparkSession, folder: str) -> DataFrame:
    """Each invoice once, as delivered last; then sums and averages over the last 7 and 30 days."""
    fields = ["vendor_id", "invoice_date", "total_amount"]
    # rows that differ in no field that counts fall together before the shuffle
    invoices = one_per_key(table(spark, folder, "invoices"), "invoice_id", fields, ["loaded_at", "line_item_id"])
    return trailing_totals(invoices, *fields)


P4_SQL = """
WITH one AS (
  SELECT invoice_id, vendor_id, invoice_date, total_amount FROM invoices WHERE invoice_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY loaded_at DESC NULLS LAST, line_item_id DESC NULLS LAST) = 1),
daily AS (
  SELECT vendor_id, invoice_date AS d, sum(total_amount) AS s, count(*) AS n FROM one
  WHERE vendor_id IS NOT NULL AND invoice_date IS NOT NULL AND total_amount IS NOT NULL GROUP BY 1, 2),
cal AS (
  SELECT vendor_id, unnest(generate_series(CAST(min(d) AS TIMESTAMP), CAST(max(d) AS TIMESTAMP), INTERVAL 1 DAY))::DATE AS d FROM daily GROUP BY 1),
joined AS (
  SELECT c.vendor_id, c.d, sum(CASE WHEN c.d - y.d < 7 THEN y.s END) s7, sum(CASE WHEN c.d - y.d < 7 THEN y.n END) n7, sum(y.s) s30, sum(y.n) n30
  FROM cal c LEFT JOIN daily y ON y.vendor_id = c.vendor_id AND y.d BETWEEN c.d - 29 AND c.d GROUP BY 1, 2)
SELECT vendor_id, d AS invoice_date,
  CAST(coalesce(s7, 0) AS DECIMAL(28,2)) AS total_7d, CAST(coalesce(n7, 0) AS BIGINT) AS count_7d,
  CASE WHEN n7 > 0 THEN CAST(s7 * 100 AS DOUBLE) / 100.0::DOUBLE / CAST(n7 AS DOUBLE) END AS average_7d,
  CAST(coalesce(s30, 0) AS DECIMAL(28,2)) AS total_30d, CAST(coalesce(n30, 0) AS BIGINT) AS count_30d,
  CASE WHEN n30 > 0 THEN CAST(s30 * 100 AS DOUBLE) / 100.0::DOUBLE / CAST(n30 AS DOUBLE) END AS average_30d
FROM joined
"""


def p6_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return vendor_ledger(table(spark, folder, "vendor_snapshots"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The versions believed now: ledger rows not superseded that differ from the period before."""
    now = p6_ledger(spark, folder).where("recorded_to is null and starts_version")
    return now.select("vendor_id", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"))


def p6_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Every version with the period in which it held; valid_to is exclusive and null while it holds."""
    now = p6_ledger(spark, folder).where("recorded_to is null and starts_version")
    from pyspark.sql import Window

    following = F.lead("valid_from").over(Window.partitionBy("vendor_id").orderBy("valid_from"))
    return now.select("vendor_id", "valid_from", following.alias("valid_to"), "address", "bank_account_last4", "contact_person")


_P6 = r"""
WITH last AS (
  SELECT vendor_id, snapshot_date,
    nullif(lower(trim(regexp_replace(address, '\s+', ' ', 'g'))), '') AS address,
    nullif(lower(trim(regexp_replace(bank_account_last4, '\s+', ' ', 'g'))), '') AS bank,
    nullif(lower(trim(regexp_replace(contact_person, '\s+', ' ', 'g'))), '') AS contact
  FROM vendor_snapshots WHERE vendor_id IS NOT NULL AND snapshot_date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY vendor_id, snapshot_date ORDER BY loaded_at DESC NULLS LAST, snapshot_id DESC) = 1),
filled AS (
  SELECT vendor_id, snapshot_date, last_value(address IGNORE NULLS) OVER w AS address,
    last_value(CASE WHEN length(bank) < 4 THEN lpad(bank, 4, '0') ELSE bank END IGNORE NULLS) OVER w AS bank, last_value(contact IGNORE NULLS) OVER w AS contact
  FROM last WINDOW w AS (PARTITION BY vendor_id ORDER BY snapshot_date ROWS UNBOUNDED PRECEDING)),
marked AS (
  SELECT *, row_number() OVER v = 1 OR address IS DISTINCT FROM lag(address) OVER v OR bank IS DISTINCT FROM lag(bank) OVER v
    OR contact IS DISTINCT FROM lag(contact) OVER v AS starts
  FROM filled WINDOW v AS (PARTITION BY vendor_id ORDER BY snapshot_date))
"""
P6_SQL = _P6 + "SELECT vendor_id, strftime(snapshot_date, '%Y-%m-%d') AS valid_from FROM marked WHERE starts"
P6_VERSIONS_SQL = (
    _P6
    + """SELECT vendor_id, snapshot_date AS valid_from, lead(snapshot_date) OVER (PARTITION BY vendor_id ORDER BY snapshot_date) AS valid_to,
  address, bank AS bank_account_last4, contact AS contact_person FROM marked WHERE starts"""
)

QUERIES = {f.__name__: f for f in (p4_trailing, p6_found, p6_versions, p6_ledger)}
SQL = {"p4_trailing": P4_SQL, "p6_found": P6_SQL, "p6_versions": P6_VERSIONS_SQL}

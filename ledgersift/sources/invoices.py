"""Typed views of the accounts-payable tables: lines and headers each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.operators.rolling import one_per_key
from ledgersift.session import table

HEADER = ["invoice_number", "vendor_id", "vendor_name", "vendor_address", "invoice_date", "total_amount", "po_number", "payment_date", "payment_status", "approved_by"]
LINE = ["invoice_id", *HEADER, "line_item_description", "quantity", "unit_price", "line_total"]


def blank_to_null(c: str) -> F.Column:
    return F.nullif(F.trim(c), F.lit(""))


def lines(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Each line_item_id once, as loaded last; only the columns asked for are read and shuffled."""
    return one_per_key(table(spark, folder, "invoices"), "line_item_id", list(columns or LINE), ["loaded_at"])


def headers(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Each invoice_id once: the header of the line loaded last, of equal times the one with the largest line_item_id."""
    return one_per_key(table(spark, folder, "invoices"), "invoice_id", list(columns or HEADER), ["loaded_at", "line_item_id"])


def vendors(spark: SparkSession, folder: str) -> DataFrame:
    """Each vendor once; repeated rows are equal."""
    return table(spark, folder, "vendors").where("vendor_id is not null").dropDuplicates(["vendor_id"])


def series(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as a price series: vendor, item, day, price, quantity, amount, approver."""
    li, o, p = (table(spark, folder, t) for t in ("lineitem", "orders", "part"))
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(p, li.l_partkey == p.p_partkey)
        .where("l_quantity > 0 and l_extendedprice > 0")
        .select(
            F.col("l_suppkey").alias("vendor"), F.col("p_name").alias("item"), F.to_date("o_orderdate").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"), F.col("o_orderpriority").alias("approver"), F.col("o_orderkey").alias("invoice"), F.col("p_retailprice").alias("list_price"),
        )
    )

"""Data quality in one pass: completeness, types, ranges, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each analysis needs; an analysis is ready as far as its columns are filled.
NEEDS = {
    "duplicate_detection": ["invoice_number", "vendor_id", "invoice_date", "total_amount"],
    "price_creep": ["vendor_id", "line_item_description", "unit_price", "invoice_date"],
    "phantom_services": ["vendor_id", "line_item_description", "total_amount", "invoice_date"],
    "vendor_collusion": ["vendor_id", "vendor_name", "total_amount", "invoice_date", "line_item_description"],
    "contract_compliance": ["vendor_id", "total_amount", "invoice_date", "line_item_description", "unit_price"],
    "vendor_behavior": ["vendor_id", "total_amount", "invoice_date"],
    "market_price": ["vendor_id", "line_item_description", "unit_price", "quantity", "invoice_date"],
    "split_invoicing": ["vendor_id", "total_amount", "invoice_date"],
}


def given(df: DataFrame, c: str) -> Column:
    text = dict(df.dtypes)[c] == "string"
    return F.col(c).isNotNull() & ((F.trim(c) != "") if text else F.lit(True))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, filled, share) of each column, in one pass over the data."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(given(df, c)).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns])).alias("r")
    return one.select("_n", rows).select("r.field", "r.filled", F.coalesce(F.try_divide("r.filled", "_n"), F.lit(0.0)).alias("share"))


def checks(df: DataFrame) -> DataFrame:
    """One row: rows, null and negative amounts, missing required values, dates and vendors, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("total_amount").isNull()).alias("amount_missing"), F.count_if(F.col("total_amount") < 0).alias("amount_negative"), F.count_if(F.col("invoice_date").isNull()).alias("date_missing"),
        F.count_if(~given(df, "invoice_number") | ~given(df, "vendor_name") | F.col("invoice_date").isNull() | F.col("total_amount").isNull()).alias("required_missing"),
        F.min("invoice_date").alias("first_date"), F.max("invoice_date").alias("last_date"), F.count_distinct("vendor_id").alias("vendors"),
    )


def readiness(filled: DataFrame) -> DataFrame:
    """(module, readiness, ready): the mean share filled of what each analysis needs; ready if none of it is empty."""
    needs = F.explode(F.array(*[F.struct(F.lit(m).alias("module"), F.lit(c).alias("field")) for m, cs in NEEDS.items() for c in cs])).alias("x")
    wanted = filled.limit(1).select(needs).select("x.*")
    return wanted.join(filled, "field", "left").groupBy("module").agg(F.avg(F.coalesce("share", F.lit(0.0))).alias("readiness"), F.min(F.coalesce("share", F.lit(0.0)) > 0).alias("ready"))


def reconcile(lines: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(invoice_id, total, line_sum, difference, matches): the sum of lines against the invoice total, within a percentage."""
    got = lines.where("invoice_id is not null and total_amount is not null").groupBy("invoice_id").agg(F.max("total_amount").alias("total"), F.sum("line_total").alias("line_sum"))
    diff = F.abs(F.col("total") - F.coalesce("line_sum", F.lit(0)))
    share = F.when(F.col("total") != 0, diff.cast("double") / F.abs("total").cast("double") * 100).otherwise(F.when(F.col("line_sum") == 0, 0.0).otherwise(100.0))
    return got.select("invoice_id", "total", F.coalesce("line_sum", F.lit(0).cast("decimal(28,2)")).alias("line_sum"), diff.alias("difference"), (share <= tolerance).alias("matches"))

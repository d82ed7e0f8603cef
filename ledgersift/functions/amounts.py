"""Money: parsing text, tax inside a total, credits, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
# Words of tax lines, usual tax rates in hundredths of a percent, words of credits, the largest plausible amount.
TAX_WORDS = ["tax", "gst", "vat", "hst", "pst", "qst", "sales tax", "excise", "duty", "levy"]
TAX_RATES = [500, 700, 750, 800, 875, 1000, 1300, 1800, 2000]
CREDIT = r"(?i)\b(?:cr|credit|credit\s*memo|refund)\b"
LARGEST = 10_000_000


def parse_amount(c: Column) -> Column:
    """Money of a text: currency signs, 1,234.56 and 1.234,56, parentheses and credit words as negative, two places HALF_UP; else null."""
    text = F.trim(c.cast("string"))
    credit = text.rlike(CREDIT)
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, CREDIT, "")), r"[$€£₹]", ""))
    inside = bare.rlike(r"^\(.*\)$")
    bare = F.when(inside, F.concat(F.lit("-"), F.regexp_replace(bare, r"^\(|\)$", ""))).otherwise(bare)
    european = bare.rlike(r"^-?\d{1,3}(?:\.\d{3})+,\d{1,2}$")
    number = F.when(european, F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit("")))
    money = F.trim(number).try_cast(MONEY)
    return F.when((credit | inside) & (money > 0), -money).otherwise(money)


def is_tax_line(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).rlike("|".join(TAX_WORDS))


def with_tax(df: DataFrame, amount: str, description: str | None = None) -> DataFrame:
    """df with gross_amount, tax_amount, net_amount.

    A tax line is all tax. If there is any tax line in the data set, the tax of all others is 0. Else the first usual rate counts
    that leaves a net amount, HALF_UP in whole cents, which ends in .00, .25, .50 or .75 and comes back to the gross
    within a cent. Null amounts stay null.
    """
    df = df.withColumn("gross_amount", F.col(amount).cast(MONEY)).withColumn("_cents", F.abs((F.col("gross_amount") * 100).cast("long")))
    steps = []
    for rate in TAX_RATES:
        whole = 10_000 + rate
        net = F.expr(f"(_cents * 20000 + {whole}) div {2 * whole}")
        back = F.expr(f"(((_cents * 20000 + {whole}) div {2 * whole}) * {2 * whole} + 10000) div 20000")
        steps.append(F.when((F.abs(back - F.col("_cents")) <= 1) & (F.pmod(net, F.lit(25)) == 0), F.col("_cents") - net))
    tax = F.coalesce(*steps, F.lit(0))
    if description:
        line = is_tax_line(F.col(description))
        explicit = df.agg(F.coalesce(F.max(line & (F.col("gross_amount") != 0)), F.lit(False)).alias("_explicit"))
        df = df.crossJoin(F.broadcast(explicit))  # one row
        tax = F.when(line, F.col("_cents")).when(F.col("_explicit"), 0).otherwise(tax)
    money = lambda c: (c.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast(MONEY)
    df = df.withColumn("_tax", tax)
    return df.withColumns({"tax_amount": money(F.col("_tax")), "net_amount": money(F.col("_cents") - F.col("_tax"))}).drop("_cents", "_tax", "_explicit")


def is_credit(gross: Column, *texts: Column) -> Column:
    found = F.coalesce(gross < 0, F.lit(False))
    for t in texts:
        found = found | F.coalesce(t.cast("string").rlike(CREDIT), F.lit(False))
    return found


def amount_issues(gross: Column) -> Column:
    return F.array_compact(F.array(F.when(gross.isNull(), F.lit("unreadable")), F.when(gross == 0, F.lit("zero")), F.when(F.abs(gross) > LARGEST, F.lit("very large"))))

import math
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgersift.functions import amounts, dates, stats, text


def one(spark, value, *columns, kind="string"):
    row = spark.createDataFrame([(value,)], f"x {kind}").select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("2025-01-15", date(2025, 1, 15)), ("2025/1/5", date(2025, 1, 5)), ("05/06/2025", date(2025, 5, 6)), ("25/06/2025", date(2025, 6, 25)), ("01/15/99", date(1999, 1, 15)),
        ("15-Jan-2025", date(2025, 1, 15)), ("January 15th, 2025", date(2025, 1, 15)), ("3 Mar 2025", date(2025, 3, 3)), ("2025-01-15T10:30:00", date(2025, 1, 15)), ("no date", None), ("", None), (None, None), ("2025-02-30", None),
    ],
)
def test_parse_date(spark, given, wanted):
    assert one(spark, given, dates.parse_date(F.col("x"))) == wanted


def test_periods(spark):
    d = F.to_date("x")
    assert one(spark, "2025-01-01", dates.period(d, "weekly"), dates.quarter_label(d), dates.period(d, "monthly"), dates.is_weekend(d)) == ("2025-W01", "2025-Q1", "2025-01", False)
    assert one(spark, "2021-01-02", dates.period(d, "weekly"), dates.is_weekend(d)) == ("2020-W53", True)
    assert one(spark, "2025-03-01", dates.months_between(F.lit(date(2025, 1, 31)), d), dates.days_between(d, F.lit(date(2025, 1, 31)))) == (2, 29)
    with pytest.raises(ValueError):
        dates.period(d, "hourly")


@pytest.mark.parametrize(
    "given, wanted",
    [("$1,234.56", "1234.56"), ("€1.234,56", "1234.56"), ("(100.00)", "-100.00"), ("1234.56 CR", "-1234.56"), ("₹ 5", "5.00"), ("2.675", "2.68"), ("abc", None), ("", None), (None, None), ("-3.004,50", "-3004.50"), ("refund 12", "-12.00")],
)
def test_parse_amount(spark, given, wanted):
    assert one(spark, given, amounts.parse_amount(F.col("x"))) == (Decimal(wanted) if wanted else None)


def test_tax(spark):
    df = spark.createDataFrame([("105.00", "a"), ("107.00", "b"), ("99.99", "c"), (None, "d")], "t string, d string").withColumn("t", F.col("t").cast("decimal(18,2)"))
    got = {r.d: (r.tax_amount, r.net_amount) for r in amounts.with_tax(df, "t", "d").collect()}
    assert got["a"] == (Decimal("5.00"), Decimal("100.00"))
    assert got["b"] == (Decimal("7.00"), Decimal("100.00"))
    assert got["c"] == (Decimal("0.00"), Decimal("99.99"))
    assert got["d"] == (None, None) or got["d"][1] is None
    taxed = df.union(spark.createDataFrame([(Decimal("7.00"), "Sales tax")], "t decimal(18,2), d string"))
    got = {r.d: r.tax_amount for r in amounts.with_tax(taxed, "t", "d").collect()}
    assert got["Sales tax"] == Decimal("7.00") and got["a"] == Decimal("0.00")


def test_text(spark):
    x = F.col("x")
    assert one(spark, "  Café—Münster  GmbH & Co. ", text.normalize_text(x)) == "cafe munster gmbh co"
    assert one(spark, "Acme Widgets, Inc. Co.", text.normalize_vendor_name(x)) == "acme widgets"
    assert one(spark, "Inc", text.normalize_vendor_name(x)) == "inc"
    assert one(spark, "123 Main St. Ste 400", text.normalize_address(x)) == "123 main street"
    assert one(spark, "+1 (555) 123-4567", text.normalize_phone(x)) == "5551234567"
    assert one(spark, None, text.normalize_text(x), text.normalize_phone(x), text.normalize_address(x)) == ("", "", "")
    assert one(spark, "of to IT steel beam large", text.category_key(x)) == "steel beam"


def test_vagueness(spark):
    assert one(spark, "Services", text.vagueness(F.col("x"))) == 0
    assert one(spark, None, text.vagueness(F.col("x"))) == 0
    assert one(spark, "Installation of 12 units steel shelving in Building Seven", text.vagueness(F.col("x"))) == 100


def test_terms_json_hash(spark):
    got = text.payment_terms(F.col("x"))
    assert one(spark, "2/10 Net 30", got["discount"], got["discount_days"], got["net_days"]) == (2.0, 10, 30)
    assert one(spark, "COD", got["discount"], got["net_days"]) == (0.0, 0)
    assert one(spark, 'so: {"k": 3} ok', text.salvage_json(F.col("x"), "k int")["k"]) == 3
    assert one(spark, "nothing", text.salvage_json(F.col("x"), "k int")["k"]) is None
    a = one(spark, None, text.pattern_hash(F.col("x"), F.lit("b")))
    assert len(a) == 16 and a != one(spark, "b", text.pattern_hash(F.col("x"), F.lit(None)))


def test_leading_digit_and_chi(spark):
    assert [one(spark, v, stats.leading_digit(F.col("x")), kind="double") for v in (123.4, 0.05, -9.0, 0.0)] == [1, 5, 9, None]
    assert one(spark, stats.CHI2_8_05, stats.chi2_p8(F.col("x")), kind="double") == pytest.approx(0.05, abs=1e-9)


@pytest.mark.parametrize("t, dof, p", [(12.706, 1, 0.05), (4.303, 2, 0.05), (3.182, 3, 0.05), (2.776, 4, 0.05), (2.571, 5, 0.05), (2.228, 10, 0.05), (2.042, 30, 0.05), (2.947, 15, 0.01)])
def test_t_tail(spark, t, dof, p):
    assert one(spark, t, stats.t_tail(F.col("x"), F.lit(dof)), kind="double") == pytest.approx(p, abs=2e-4)


def test_trend_and_pearson(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 3.0), ("a", 2.0, 5.0), ("b", 0.0, 1.0), ("b", 0.0, 2.0)], "k string, x double, y double")
    got = {r.k: r for r in stats.trend(df, ["k"], "x", "y").collect()}
    assert got["a"].slope == pytest.approx(2) and got["a"].p_value == 0 and "b" not in got
    r = df.groupBy("k").agg(stats.pearson("x", "y").alias("r")).orderBy("k").collect()
    assert r[0].r == pytest.approx(1) and r[1].r == 0


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(stats.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(1 / math.sqrt(2)), 0.0]

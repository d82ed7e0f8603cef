"""Price series and benchmarks: windows, trends, percentiles, blended references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.functions.dates import months_between
from ledgersift.functions.stats import percentiles, trend


def eligible(series: DataFrame, points: int = 4, months: int = 3) -> DataFrame:
    """The points of vendor-item series with enough points over enough months; price and day are given.

    series: vendor, item, day, price, quantity and a column `seq` that orders points of one day.
    """
    keys = ["vendor", "item"]
    ok = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))
    ok = ok.where((F.col("n") >= points) & (months_between(F.col("first"), F.col("last")) >= months)).select(*keys)
    return series.join(ok, keys, "left_semi")


def jumps(series: DataFrame) -> DataFrame:
    """(vendor, item, n, first_price, last_price, change_pct, max_jump_pct, max_jump_day, accelerating) of each series.

    A jump is the change from one point to the next; of equal largest jumps the earliest counts. A series accelerates if its last
    three jumps are positive and each larger than the one before.
    """
    keys = ["vendor", "item"]
    w = Window.partitionBy(*keys).orderBy("day", "seq")
    before = F.lag("price").over(w)
    stepped = series.withColumn("jump", F.round((F.col("price") - before) / before * 100, 6)).withColumn("k", F.row_number().over(w))
    stepped = stepped.withColumn("left", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("day").desc(), F.col("seq").desc())))
    at = F.struct("day", "seq")
    out = stepped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("price", at).alias("first_price"), F.max_by("price", at).alias("last_price"),
        F.max_by(F.struct("jump", "day"), F.when(F.col("jump").isNotNull(), F.struct(F.abs("jump").alias("size"), (-F.col("k")).alias("early")))).alias("top"),
        *[F.max(F.when(F.col("left") == i, F.col("jump"))).alias(f"_last{i}") for i in (1, 2, 3)],
    )
    rises = (F.col("n") > 3) & (F.col("_last3") > 0) & (F.col("_last2") > F.col("_last3")) & (F.col("_last1") > F.col("_last2"))
    return out.select(*keys, "n", "first_price", "last_price", ((F.col("last_price") - F.col("first_price")) / F.col("first_price") * 100).alias("change_pct"), F.col("top.jump").alias("max_jump_pct"), F.col("top.day").alias("max_jump_day"), F.coalesce(rises, F.lit(False)).alias("accelerating"))


def price_trends(series: DataFrame) -> DataFrame:
    """A straight line of price over days since the series began, with its p-value."""
    start = F.min("day").over(Window.partitionBy("vendor", "item"))
    return trend(series.withColumn("x", F.date_diff("day", start).cast("double")), ["vendor", "item"], "x", "price")


def quantity_shift(series: DataFrame, change: float = 30) -> DataFrame:
    """(vendor, item, first_half, second_half, shift_pct): mean quantity of the first n // 2 points and of the rest, if it
    changes by more than `change` percent."""
    keys = ["vendor", "item"]
    w = Window.partitionBy(*keys)
    halves = series.withColumn("k", F.row_number().over(w.orderBy("day", "seq"))).withColumn("mid", F.floor(F.count(F.lit(1)).over(w) / 2))
    out = halves.groupBy(*keys).agg(F.avg(F.when(F.col("k") <= F.col("mid"), F.col("quantity"))).alias("first_half"), F.avg(F.when(F.col("k") > F.col("mid"), F.col("quantity"))).alias("second_half"))
    shift = (F.col("second_half") - F.col("first_half")) / F.col("first_half") * 100
    return out.where(F.col("first_half") > 0).withColumn("shift_pct", shift).where(F.abs(F.col("shift_pct")) > change)


def benchmark(prices: DataFrame, category: str, vendor: str, price: str, least_vendors: int = 3) -> DataFrame:
    """(category, n, vendors, mean, std, p25, median, p75, p90) of unit prices, for categories with enough vendors.

    Percentiles are exact and interpolate linearly; a category may hold any share of the rows.
    """
    rows = prices.where((F.col(price) > 0) & F.col(category).isNotNull()).select(F.col(category).alias("category"), F.col(vendor).alias("_vendor"), F.col(price).alias("_price"))
    measures = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("_price").alias("mean"), F.stddev_pop("_price").alias("std"))
    several = rows.select("category", "_vendor").distinct().groupBy("category").agg(F.count("_vendor").alias("vendors")).where(F.col("vendors") >= least_vendors)
    ranks = percentiles(rows, "category", "_price", {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9})
    return several.join(measures, "category").join(ranks, "category").select("category", "n", "vendors", "mean", "std", "p25", "median", "p75", "p90")


def deviations(prices: DataFrame, reference: DataFrame, category: str, price: str, quantity: str, above: float = 10, each: float = 50, total: float = 500) -> DataFrame:
    """Rows priced more than `above` percent over their category's 90th percentile, unless both excesses are small."""
    # one row a category; Spark broadcasts it if its size allows, else it shuffles
    joined = prices.join(reference, prices[category] == reference["category"])
    excess = F.col(price) - F.col("p90")
    over = (F.col(price) > F.col("p90") * (1 + above / 100)) & ~((excess < each) & (excess * F.col(quantity) < total))
    return joined.where(over).withColumns({"deviation_pct": (F.col(price) - F.col("median")) / F.col("median") * 100, "excess": excess * F.col(quantity)})


def premium_index(prices: DataFrame, reference: DataFrame, category: str, vendor: str, price: str, amount: str) -> DataFrame:
    """(vendor, premium_pct, spend): deviations from the median, weighted by what was spent."""
    joined = prices.join(reference, prices[category] == reference["category"]).where((F.col("median") > 0) & (F.col(amount) > 0))
    d = (F.col(price) - F.col("median")) / F.col("median") * 100
    return joined.groupBy(F.col(vendor).alias("vendor")).agg((F.sum(d * F.col(amount)) / F.sum(amount)).alias("premium_pct"), F.sum(amount).alias("spend"))


def savings(prices: DataFrame, reference: DataFrame, category: str, vendor: str, price: str, quantity: str, least: float = 5000) -> DataFrame:
    """(vendor, category, saving): what buying at the median would have saved, where that is at least `least`.

    Each row's saving is held in millionths, so the sum is exact and does not depend on the order of rows."""
    joined = prices.join(reference, prices[category] == reference["category"]).where(F.col(price) > F.col("median"))
    out = joined.groupBy(F.col(vendor).alias("vendor"), "category").agg(F.sum(((F.col(price) - F.col("median")) * F.col(quantity)).cast("decimal(24,6)")).alias("saving"))
    return out.where(F.col("saving") >= least)


def blend(inside: DataFrame, outside: DataFrame) -> DataFrame:
    """(category, median, n, source) of two benchmarks (category, median, n), weighted by their sample sizes where both have it."""
    a, b = inside.alias("a"), outside.alias("b")
    j = a.join(b, F.col("a.category") == F.col("b.category"), "full_outer")
    n = lambda s: F.coalesce(F.col(f"{s}.n"), F.lit(0))
    m = lambda s: F.coalesce(F.col(f"{s}.median"), F.lit(0.0))
    source = F.when(F.col("b.category").isNull(), "inside").when(F.col("a.category").isNull(), "outside").otherwise("both")
    return j.select(F.coalesce("a.category", "b.category").alias("category"), ((m("a") * n("a") + m("b") * n("b")) / (n("a") + n("b"))).alias("median"), (n("a") + n("b")).alias("n"), source.alias("source"))


def rate_as_of(points: DataFrame, rates: DataFrame, escalation: float, tolerance: float) -> DataFrame:
    """Points priced above the rate that held on their day: rate * (1 + escalation) ** (months since its start / 12), plus tolerance.

    points: vendor, item, day, price. rates: vendor, item, start, rate; the latest start on or before the day counts.
    """
    keys = ["vendor", "item"]
    joined = points.join(rates, keys).where(F.col("start") <= F.col("day"))
    latest = Window.partitionBy(*keys, "day", "price", "invoice").orderBy(F.col("start").desc())
    held = joined.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank")
    allowed = F.col("rate") * F.pow(F.lit(1 + escalation), months_between(F.col("start"), F.col("day")) / 12) * (1 + tolerance)
    return held.withColumn("allowed", allowed).where(F.col("price") > F.col("allowed"))

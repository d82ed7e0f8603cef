"""Statistics as aggregate and column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.session import written

#: Critical values of chi-squared for 8 degrees of freedom at .05 and 1 degree at .05 and .01 (fixed values).
CHI2_8_05, CHI2_1_05, CHI2_1_01 = 15.507313055865453, 3.841458820694124, 6.634896601021213


def leading_digit(c: Column) -> Column:
    """First digit of a number that is not 0."""
    a = F.abs(c.cast("double"))
    return F.when(a > 0, F.substring(F.regexp_replace(F.format_string("%.2f", a), r"^[0.]+", ""), 1, 1).try_cast("int"))


def benford(df: DataFrame, group: str, amount: str, least: int = 50) -> DataFrame:
    """(group, n, chi2, p_value, mad) of the first digits against log10(1 + 1/d), for groups of `least` amounts or more.

    One count per group and digit before the shuffle; the p-value for 8 degrees of freedom has a closed form.
    """
    digit = leading_digit(F.col(amount))
    counts = df.where(F.col(group).isNotNull()).select(F.col(group), digit.alias("d")).where("d between 1 and 9").groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("d") == d).alias(f"d{d}") for d in range(1, 10)])
    share = {d: math.log10(1 + 1 / d) for d in range(1, 10)}
    n = F.col("n")
    chi2 = sum((F.col(f"d{d}") - n * share[d]) * (F.col(f"d{d}") - n * share[d]) / (n * share[d]) for d in share)
    mad = sum(F.abs(F.col(f"d{d}") / n - share[d]) for d in share) / 9
    out = counts.where(n >= least).select(group, "n", chi2.alias("chi2"), mad.alias("mad"))
    return out.withColumn("p_value", chi2_p8(F.col("chi2")))


def chi2_p8(x: Column) -> Column:
    """Upper tail of chi-squared with 8 degrees of freedom."""
    h = x / 2
    return F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """0 where the deviation is not positive."""
    return F.when(std > 0, (x - mean) / std).otherwise(0.0)


def pearson(x: str, y: str) -> Column:
    """Correlation of two columns as an aggregate; 0 for fewer than two rows or no variance."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    n = F.count(F.lit(1)).cast("double")
    cov = n * F.sum(a * b) - F.sum(a) * F.sum(b)
    var = (n * F.sum(a * a) - F.sum(a) * F.sum(a)) * (n * F.sum(b * b) - F.sum(b) * F.sum(b))
    return F.when((n >= 2) & (var > 1e-9), cov / F.sqrt(var)).otherwise(0.0)


def t_tail(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t, by the finite series in the angle atan(t / sqrt(dof))."""
    angle = F.atan(F.abs(t) / F.sqrt(dof))
    c, s = F.cos(angle), F.sin(angle)
    even = lambda k: F.aggregate(F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), lambda a, i: F.struct((a["term"] * c * c * (2 * i - 1) / (2 * i)).alias("term"), (a["sum"] + a["term"] * c * c * (2 * i - 1) / (2 * i)).alias("sum")))["sum"]
    odd = lambda k: F.aggregate(F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), lambda a, i: F.struct((a["term"] * c * c * (2 * i) / (2 * i + 1)).alias("term"), (a["sum"] + a["term"] * c * c * (2 * i) / (2 * i + 1)).alias("sum")))["sum"]
    within = F.when(dof == 1, 2 * angle / math.pi).when(dof % 2 == 1, 2 / math.pi * (angle + s * c * odd(F.floor((dof - 3) / 2)))).otherwise(s * even(F.floor(dof / 2) - 1))
    return F.greatest(F.lit(0.0), 1 - within)


def trend(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, slope, intercept, r2, p_value) of a straight line through each group; no line without variance of x."""
    fit = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), F.regr_r2(F.col(y), F.col(x)).alias("r2"))
    t = F.sqrt(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2")))
    p = F.when(F.col("n") <= 2, 1.0).when(F.col("r2") >= 1 - 1e-12, 0.0).when(F.col("r2").isNull() | (F.col("r2") <= 0), 1.0).otherwise(t_tail(t, F.col("n") - 2))
    return fit.where("slope is not null").withColumn("p_value", p)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def threshold_band(df: DataFrame, group: str, amount: str, limit: float, band: float = 0.1, least: int = 20) -> DataFrame:
    """(group, n, in_band, expected, chi2): amounts just below a limit against an even share of all amounts below it."""
    counts = df.where((F.col(amount) > 0) & F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col(amount) >= limit * (1 - band)) & (F.col(amount) < limit)).alias("in_band"))
    e = F.col("n") * band
    rest = F.col("n") - F.col("in_band")
    chi2 = (F.col("in_band") - e) * (F.col("in_band") - e) / e + (rest - (F.col("n") - e)) * (rest - (F.col("n") - e)) / (F.col("n") - e)
    return counts.where(F.col("n") >= least).select(group, "n", "in_band", e.alias("expected"), chi2.alias("chi2"))


def percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, one column for each name of shares): exact percentiles, interpolated linearly, of groups of any size.

    Equal values are counted first. The counts are placed by ranges of (group, value); a range knows how many values of its group come
    before it from the sums of the other ranges, so ranks are found inside ranges and no group is gathered into one task or buffer.
    Null groups and values are left out.
    """
    counts = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    ranged = written(counts.repartitionByRange("_g", "_v").withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_g", "_range").agg(F.sum("_k").alias("_c"))  # one row a group and range
    by_group = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_c").over(by_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(sums.select("_g", "_range", before.alias("_before"), F.sum("_c").over(by_group).alias("_n")), ["_g", "_range"])
    end = F.col("_before") + F.sum("_k").over(Window.partitionBy("_g", "_range").orderBy("_v"))
    ranked = placed.withColumn("_end", end)
    at = lambda i: F.max(F.when((F.col("_end") - F.col("_k") <= i) & (i < F.col("_end")), F.col("_v")))
    aggs = []
    for name, share in shares.items():
        low = F.floor((F.col("_n") - 1) * share)
        aggs += [at(low).alias(f"_l_{name}"), at(F.least(low + 1, F.col("_n") - 1)).alias(f"_h_{name}")]
    got = ranked.groupBy(F.col("_g").alias(group)).agg(F.max("_n").alias("_n"), *aggs)
    part = lambda share: (F.col("_n") - 1) * share - F.floor((F.col("_n") - 1) * share)
    return got.select(group, *[(F.col(f"_l_{n}") + (F.col(f"_h_{n}") - F.col(f"_l_{n}")) * part(x)).alias(n) for n, x in shares.items()])


def chi_squared(observed: DataFrame, expected: DataFrame, key: str, count: str) -> DataFrame:
    """One row (chi2, dof): counts of keys against expected counts scaled to the same total; keys of either side count, and one
    that is not expected at all is compared with nothing and left out."""
    a, b = observed.groupBy(key).agg(F.sum(count).alias("_o")), expected.groupBy(key).agg(F.sum(count).alias("_e"))
    both = a.join(b, key, "full_outer").select(F.coalesce("_o", F.lit(0)).alias("_o"), F.coalesce("_e", F.lit(0)).alias("_e"))
    sums = both.where("_e > 0").agg(F.sum("_o").alias("_os"), F.sum("_e").alias("_es"), F.sum(F.col("_o") * F.col("_o") / F.col("_e")).alias("_q"), F.count(F.lit(1)).alias("_n"))
    # sum (o - e s)^2 / (e s) with s = total of o / total of e, multiplied out, so that one pass does
    chi2 = F.col("_q") * F.col("_es") / F.col("_os") - F.col("_os")
    return sums.select(F.when(F.col("_os") > 0, F.greatest(F.lit(0.0), chi2)).otherwise(0.0).alias("chi2"), F.greatest(F.col("_n") - 1, F.lit(0)).alias("dof"))

"""Grouped measures of invoices: collapse, exact duplicates, recurrence, sliding clusters, quarters, baselines, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.functions.dates import quarter_label
from ledgersift.functions.stats import percentiles, zscore
from ledgersift.session import written


def collapse(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines as invoices: the descriptions joined in line order, quantities and prices as arrays in the same order.

    Null keys are kept as keys. lines: keys, line_item_id, line_item_description, quantity, unit_price.
    """
    item = F.struct("line_item_id", "line_item_description", "quantity", "unit_price")
    got = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    part = lambda f: F.transform("_items", lambda x: x[f])
    return got.select(*keys, F.concat_ws(" | ", part("line_item_description")).alias("descriptions"), part("quantity").alias("quantities"), part("unit_price").alias("unit_prices"), F.size("_items").alias("lines"))


def exact_duplicates(lines: DataFrame, number: str = "invoice_number") -> DataFrame:
    """(invoice_number, vendor_id, total_amount, invoices) entered under two invoice_ids or more."""
    keys = [number, "vendor_id", "total_amount"]
    return lines.where(F.col(number).isNotNull() & F.col("vendor_id").isNotNull() & F.col("total_amount").isNotNull()).groupBy(*keys).agg(F.count_distinct("invoice_id").alias("invoices")).where("invoices >= 2")


def recurring(invoices: DataFrame, least: int = 3, near: float = 0.02, gap_days: int = 20, tolerance: int = 5) -> DataFrame:
    """(vendor_id, bucket, n, mean_amount, mean_gap) of amounts that come back at a steady interval.

    Amounts are bucketed to hundreds (half to even); all must be within `near` of the mean, the mean gap at least `gap_days`, and
    every gap within `tolerance` days of it.
    """
    amount = F.col("total_amount").cast("double")
    rows = invoices.where("vendor_id is not null and invoice_date is not null and total_amount > 0").withColumn("bucket", F.bround(amount, -2))
    # by day first: however many rows a vendor has, the window below sees at most one a day
    daily = rows.groupBy("vendor_id", "bucket", "invoice_date").agg(F.count(F.lit(1)).alias("k"), F.sum((F.col("total_amount") * 100).cast("long")).alias("cents"), F.min(amount).alias("low"), F.max(amount).alias("high"))
    gap = F.date_diff("invoice_date", F.lag("invoice_date").over(Window.partitionBy("vendor_id", "bucket").orderBy("invoice_date")))
    out = daily.withColumn("gap", gap).groupBy("vendor_id", "bucket").agg(
        F.sum("k").alias("n"), (F.sum("cents") / 100.0 / F.sum("k")).alias("mean_amount"), F.min("low").alias("_low"), F.max("high").alias("_high"),
        F.date_diff(F.max("invoice_date"), F.min("invoice_date")).alias("_span"), F.least(F.min("gap"), F.min(F.when(F.col("k") > 1, 0))).alias("_short"), F.max("gap").alias("_long"),
    )
    out = out.where(F.col("n") >= F.greatest(F.lit(least), F.lit(2))).withColumn("mean_gap", F.col("_span") / (F.col("n") - 1))
    m, g = F.col("mean_amount"), F.col("mean_gap")
    steady = (F.col("_high") - m <= m * near) & (m - F.col("_low") <= m * near) & (g >= gap_days) & (F.col("_long") - g <= tolerance) & (g - F.col("_short") <= tolerance)
    return out.where(steady).select("vendor_id", "bucket", "n", "mean_amount", "mean_gap")


def sliding_clusters(invoices: DataFrame, limits: list[float], windows: tuple[int, ...] = (7, 14, 30), least: int = 4) -> DataFrame:
    """(vendor_id, invoice_id, window_days, n, total, limit_amount): from each invoice on, the invoices of the next days that all
    stay below a limit which their sum reaches; the lowest such limit.

    Windows run over daily sums, which are at most one row a day for a vendor, and are joined back to its invoices.
    """
    rows = invoices.where("vendor_id is not null and invoice_date is not null and total_amount > 0").withColumns({"day": F.unix_date("invoice_date"), "cents": (F.col("total_amount") * 100).cast("long")})
    daily = rows.groupBy("vendor_id", "day").agg(F.count(F.lit(1)).alias("k"), F.sum("cents").alias("cents"), F.max("cents").alias("top"))
    found = []
    for days in windows:
        w = Window.partitionBy("vendor_id").orderBy("day").rangeBetween(0, days)
        seen = daily.select("vendor_id", "day", F.lit(days).alias("window_days"), F.sum("k").over(w).alias("n"), F.sum("cents").over(w).alias("sum"), F.max("top").over(w).alias("most"))
        limit = F.coalesce(*[F.when((F.col("most") < x * 100) & (F.col("sum") >= x * 100), F.lit(float(x))) for x in sorted(limits)])
        found.append(seen.where(F.col("n") >= least).select("vendor_id", "day", "window_days", "n", (F.col("sum") / 100.0).alias("total"), limit.alias("limit_amount")).where("limit_amount is not null"))
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return rows.select("vendor_id", "invoice_id", "day").join(out, ["vendor_id", "day"]).drop("day")


def order_sums(invoices: DataFrame, limits: list[float]) -> DataFrame:
    """(vendor_id, po_number, n, total, limit_amount) of orders with two invoices or more, all below a limit their sum reaches."""
    amount = (F.col("total_amount") * 100).cast("long")
    got = invoices.where("vendor_id is not null and po_number is not null and total_amount > 0").groupBy("vendor_id", "po_number").agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("sum"), F.max(amount).alias("most"))
    limit = F.coalesce(*[F.when((F.col("most") < x * 100) & (F.col("sum") >= x * 100), F.lit(float(x))) for x in sorted(limits)])
    return got.where("n >= 2").select("vendor_id", "po_number", "n", (F.col("sum") / 100.0).alias("total"), limit.alias("limit_amount")).where("limit_amount is not null")


def quarter_change(invoices: DataFrame, drop: float = 0.4, keep: float = 0.8, more: float = 1.5, least: int = 8, quarters: int = 3) -> DataFrame:
    """(vendor_id, last_quarter, last_avg, prior_avg, last_n, prior_n, kind): vendors whose last quarter has much smaller
    invoices for nearly the spend of an average quarter (amount), or many more invoices for it (frequency)."""
    q = invoices.where("vendor_id is not null and invoice_date is not null and total_amount > 0").groupBy("vendor_id", quarter_label(F.col("invoice_date")).alias("quarter")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("total_amount") * 100).cast("long")).alias("cents"))
    w = Window.partitionBy("vendor_id")
    q = q.withColumns({"last": F.max("quarter").over(w), "quarters": F.count(F.lit(1)).over(w), "all": F.sum("n").over(w)}).where(f"quarters >= {quarters} and all >= {least}")
    now = F.col("quarter") == F.col("last")
    out = q.groupBy("vendor_id", F.col("last").alias("last_quarter")).agg(
        F.sum(F.when(now, F.col("n"))).alias("last_n"), F.sum(F.when(now, F.col("cents"))).alias("_last"), F.sum(F.when(~now, F.col("n"))).alias("_n"), F.sum(F.when(~now, F.col("cents"))).alias("_cents"), F.count_if(~now).alias("_q"),
    )
    out = out.withColumns({"last_avg": F.col("_last") / 100.0 / F.col("last_n"), "prior_avg": F.col("_cents") / 100.0 / F.col("_n"), "prior_n": F.col("_n") / F.col("_q")})
    share = F.col("_last") / (F.col("_cents") / F.col("_q"))
    kind = F.when((F.col("last_avg") <= F.col("prior_avg") * (1 - drop)) & (share >= keep), "amount").when((F.col("last_n") > F.col("prior_n") * more) & (share <= 1.2), "frequency")
    return out.withColumn("kind", kind).where("kind is not null").select("vendor_id", "last_quarter", "last_avg", "prior_avg", "last_n", "prior_n", "kind")


def split_history(invoices: DataFrame, share: float = 0.75, least: int = 6) -> DataFrame:
    """invoices with `recent`: the first part of each vendor's invoices in date order is history, the rest recent.

    The rank of an invoice is the number on earlier days, from daily counts, plus its rank on its day.
    """
    rows = invoices.where("vendor_id is not null and invoice_date is not null and total_amount > 0")
    daily = rows.groupBy("vendor_id", "invoice_date").agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy("vendor_id")
    before = F.coalesce(F.sum("_k").over(w.orderBy("invoice_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    daily = daily.withColumns({"_before": before, "_n": F.sum("_k").over(w)}).where(f"_n > {least}").drop("_k")
    rank = F.row_number().over(Window.partitionBy("vendor_id", "invoice_date").orderBy("invoice_id"))
    cut = F.least(F.greatest(F.floor(F.col("_n") * share), F.lit(least)), F.col("_n") - 1)
    ranked = rows.withColumn("_rank", rank).join(daily, ["vendor_id", "invoice_date"])
    return ranked.withColumn("recent", F.col("_before") + F.col("_rank") > cut).drop("_rank", "_before", "_n")


def baseline(invoices: DataFrame) -> DataFrame:
    """(vendor_id, n, cents, mean_amount, std_amount, max_amount, mean_gap, std_gap) of (vendor_id, invoice_date, total_amount); cents is the exact sum.

    Without enough rows the deviation is a fifth of the mean, the gap 30 days and its deviation .3 of it. Gaps come from daily
    sums; invoices of one day have gaps of 0. Sums and squares are of whole cents, so nothing cancels and the order of rows does not count.
    """
    exact, money = "decimal(38,0)", F.col("total_amount").cast("decimal(18,2)")
    cents = (money * 100).cast("decimal(18,0)")
    daily = invoices.groupBy("vendor_id", "invoice_date").agg(F.count(F.lit(1)).alias("k"), F.sum(cents).alias("s"), F.sum((cents * cents).cast(exact)).cast(exact).alias("q"), F.max(money).alias("m"))
    gap = F.date_diff("invoice_date", F.lag("invoice_date").over(Window.partitionBy("vendor_id").orderBy("invoice_date")))
    got = daily.withColumn("gap", gap).groupBy("vendor_id").agg(F.sum("k").alias("n"), F.sum("s").cast("decimal(28,0)").alias("s"), F.sum("q").cast(exact).alias("q"), F.max("m").cast("double").alias("max_amount"), F.sum("gap").alias("gs"), F.sum(F.col("gap") * F.col("gap")).alias("gq"))
    n = F.col("n")
    mean = F.col("s").cast("double") / 100.0 / n
    # n q - s s, divided at last; where that has more than 38 digits, in doubles
    square = F.coalesce(F.expr("try_subtract(try_multiply(q, cast(n as decimal(10,0))), try_multiply(s, s))").cast("double"), F.col("q").cast("double") * n - F.col("s").cast("double") * F.col("s").cast("double"))
    std = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), square) / n / (n - 1)) / 100.0)
    spread = lambda total, squares, k: F.when(k > 1, F.sqrt(F.greatest(F.lit(0.0), (squares - total * total / k) / (k - 1))))
    mean_gap = F.when(n > 1, F.coalesce("gs", F.lit(0)) / (n - 1)).otherwise(30.0)
    return got.select(
        "vendor_id", "n", F.col("s").cast("long").alias("cents"), mean.alias("mean_amount"), F.coalesce(std, mean * 0.2).alias("std_amount"), "max_amount",
        mean_gap.alias("mean_gap"), F.coalesce(spread(F.coalesce("gs", F.lit(0)), F.coalesce("gq", F.lit(0)), n - 1), mean_gap * 0.3).alias("std_gap"),
    )


def unusual_amounts(invoices: DataFrame, warn: float = 2.5, severe: float = 3.0) -> DataFrame:
    """(invoice_id, vendor_id, zscore, level): recent invoices far from their vendor's history."""
    rows = split_history(invoices)
    known = baseline(rows.where("not recent"))
    z = rows.where("recent").join(known, "vendor_id").select("invoice_id", "vendor_id", zscore(F.col("total_amount").cast("double"), F.col("mean_amount"), F.col("std_amount")).alias("zscore"))
    return z.where(F.abs("zscore") >= warn).withColumn("level", F.when(F.abs("zscore") >= severe, "severe").otherwise("warning"))


def drift(now: DataFrame, before: DataFrame) -> DataFrame:
    """(vendor_id, amount_change, gap_change, signs) where a baseline moved from the one before in amount (30 %) and interval (40 %)."""
    a, b = now.alias("a"), before.alias("b")
    j = a.join(b, F.col("a.vendor_id") == F.col("b.vendor_id"))
    amount = (F.col("a.mean_amount") - F.col("b.mean_amount")) / F.col("b.mean_amount")
    gap = (F.col("a.mean_gap") - F.col("b.mean_gap")) / F.nullif(F.col("b.mean_gap"), F.lit(0.0))
    signs = (F.abs(amount) > 0.3).cast("int") + F.coalesce((F.abs(gap) > 0.4).cast("int"), F.lit(0))
    return j.select(F.col("a.vendor_id").alias("vendor_id"), amount.alias("amount_change"), gap.alias("gap_change"), signs.alias("signs")).where("signs >= 2")


def top_share(rows: DataFrame, group: str, value: str, least: int = 3, share: float = 0.7) -> DataFrame:
    """(group, value, n, share): groups of which one value has at least `share` of `least` rows or more. Ties: the smallest value."""
    counts = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    by = counts.groupBy(group).agg(F.sum("n").alias("_all"), F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("_top"))
    out = by.select(group, F.col("_top.v").alias(value), (-F.col("_top.n")).alias("n"), (-F.col("_top.n") / F.col("_all")).alias("share"), "_all")
    return out.where((F.col("_all") >= least) & (F.col("share") >= share)).drop("_all")


def overbilling(invoices: DataFrame, share: float = 0.75, margin: float = 0.15) -> DataFrame:
    """(vendor_id, n, cents, mean_amount, reference): vendors whose mean exceeds the percentile of all vendors' means by the margin; cents is the exact sum."""
    cents = (F.col("total_amount").cast("decimal(18,2)") * 100).cast("long")
    sums = invoices.where("vendor_id is not null and total_amount > 0").groupBy("vendor_id").agg(F.count(F.lit(1)).alias("n"), F.sum(cents).alias("cents"))
    means = written(sums.withColumn("mean_amount", F.col("cents") / 100.0 / F.col("n")), "means").withColumn("_all", F.lit(1))
    reference = percentiles(means, "_all", "mean_amount", {"reference": share}).join(means.groupBy("_all").agg(F.count(F.lit(1)).alias("_n")), "_all")  # one row
    return means.join(F.broadcast(reference), "_all").where((F.col("_n") >= 3) & (F.col("mean_amount") > F.col("reference") * (1 + margin))).select("vendor_id", "n", "cents", "mean_amount", "reference")


def monthly_correlation(invoices: DataFrame, pairs: DataFrame, days: int = 30) -> DataFrame:
    """(vendor_a, vendor_b, buckets, correlation) of how many invoices two vendors send in each `days` days from their first.

    A grid without gaps: buckets without invoices count as 0; the last bucket takes the rest of days.
    """
    from ledgersift.functions.stats import pearson

    daily = invoices.where("vendor_id is not null and invoice_date is not null").groupBy("vendor_id", "invoice_date").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.select("vendor_a", "vendor_b", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("vendor_a").alias("vendor_id")), F.struct(F.lit("b").alias("side"), F.col("vendor_b").alias("vendor_id")))).alias("v")).select("vendor_a", "vendor_b", "v.*")
    rows = both.join(daily, "vendor_id")
    w = Window.partitionBy("vendor_a", "vendor_b")
    rows = rows.withColumns({"_first": F.min("invoice_date").over(w), "_last": F.max("invoice_date").over(w)})
    buckets = F.greatest(F.floor(F.date_diff("_last", "_first") / days), F.lit(2))
    rows = rows.withColumn("_buckets", buckets).withColumn("_b", F.least(F.floor(F.date_diff("invoice_date", "_first") / days), F.col("_buckets") - 1))
    counted = rows.groupBy("vendor_a", "vendor_b", "_buckets", "_b").agg(F.sum(F.when(F.col("side") == "a", F.col("n")).otherwise(0)).alias("x"), F.sum(F.when(F.col("side") == "b", F.col("n")).otherwise(0)).alias("y"))
    grid = rows.select("vendor_a", "vendor_b", "_buckets").distinct().withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_buckets") - 1)))
    full = grid.join(counted, ["vendor_a", "vendor_b", "_buckets", "_b"], "left").fillna(0, ["x", "y"])
    return full.groupBy("vendor_a", "vendor_b").agg(F.count(F.lit(1)).alias("buckets"), pearson("x", "y").alias("correlation"))


def enrich(used: DataFrame, master: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """used full outer joined with master: blank values of used are filled from master, and master's other rows are added."""
    a, b = used.alias("a"), master.alias("b")
    j = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return j.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[F.coalesce(F.nullif(F.trim(F.col(f"a.{c}")), F.lit("")), F.nullif(F.trim(F.col(f"b.{c}")), F.lit(""))).alias(c) for c in columns])


def usual_name(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name, times): the most frequent name of each key; of equally frequent ones the smallest."""
    pick = rows.where(F.col(key).isNotNull() & (F.trim(name) != "")).select(F.col(key).alias("_key"), F.trim(name).alias("_name"))
    counts = pick.groupBy("_key", "_name").agg(F.count(F.lit(1)).alias("_count"))
    best = counts.groupBy("_key").agg(F.min(F.struct((-F.col("_count")).alias("m"), "_name")).alias("_top"))
    return best.select(F.col("_key").alias(key), F.col("_top._name").alias(name), (-F.col("_top.m")).alias("times"))


def without_receipt(invoices: DataFrame, receipts: DataFrame, coverage: float = 0.5) -> DataFrame:
    """Invoices without a receipt, if at least `coverage` of all invoices have one, else none."""
    known = receipts.where("invoice_id is not null").select("invoice_id").distinct()
    share = invoices.select("invoice_id").distinct().join(known.withColumn("_has", F.lit(1)), "invoice_id", "left").agg((F.count("_has") / F.count(F.lit(1))).alias("_share"))
    return invoices.join(known, "invoice_id", "left_anti").crossJoin(F.broadcast(share)).where(F.col("_share") >= coverage).drop("_share")  # one row


def rare_categories(lines: DataFrame, key: str, vendor: str = "vendor_id", least: int = 5, share: float = 0.01, once: bool = False) -> DataFrame:
    """(vendor_id, key, n, share): kinds of item a vendor with `least` lines or more bills at most `share` of the time, or once."""
    counts = lines.where(F.col(vendor).isNotNull() & F.col(key).isNotNull()).groupBy(vendor, key).agg(F.count(F.lit(1)).alias("n"))
    all_ = counts.groupBy(vendor).agg(F.sum("n").alias("_all")).where(F.col("_all") >= least)
    out = counts.join(all_, vendor).withColumn("share", F.col("n") / F.col("_all"))
    return out.where(F.col("n") == 1 if once else F.col("share") < share).select(vendor, key, "n", "share")


def outside_scope(lines: DataFrame, scope: DataFrame, least: float = 0.7) -> DataFrame:
    """(key, description, similarity): descriptions of (key, description) whose best word similarity to any entry of the same key in
    scope (key, entry) stays below `least`. Keys without a scope are left out; each distinct description is compared once."""
    from ledgersift.functions.text import jaccard, normalize_text, words_of

    words = lambda c: words_of(normalize_text(F.col(c)))
    said = lines.where("key is not null and description is not null").select("key", "description").distinct().withColumn("_w", words("description"))
    agreed = scope.where("key is not null and entry is not null").select("key", words("entry").alias("_s")).distinct()
    best = said.join(agreed, "key").groupBy("key", "description").agg(F.max(jaccard(F.col("_w"), F.col("_s"))).alias("similarity"))
    return best.where(F.col("similarity") < least)

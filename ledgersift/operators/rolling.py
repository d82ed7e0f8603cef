"""Trailing totals by entity and calendar day (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.session import spread


def trailing_totals(rows: DataFrame, entity: str, day: str, amount: str, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Sum, count and average of amount over the last w days of each entity, for every day from its first to its last.

    Result: entity, day, then total_{w}d decimal(28,2), count_{w}d and average_{w}d double (null without rows) for each w.
    Rows with a null entity, day or amount are left out; ties and repeated rows all count (deduplicate before, if
    they mean one thing); other columns are ignored; an empty input gives an empty result.

    Rows are first summed by entity and day, with map-side combine, so that however many rows an entity has, it has at most one
    daily total per calendar day; only these are placed by entity. Exploding each onto the days it influences and summing by day keep
    that placement; the join with the calendar places both sides once more, by entity and day, so a busy entity is spread by its days.
    Amounts are held as whole cents, so sums are exact and do not depend on the order of rows.
    """
    longest = max(windows)
    daily = (
        rows.where(F.col(entity).isNotNull() & F.col(day).isNotNull() & F.col(amount).isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.col(day).cast("date").alias("d"))
        .agg(F.sum((F.col(amount).cast("decimal(18,2)") * 100).cast("long")).alias("cents"), F.count(F.lit(1)).alias("n"))
    )
    # the sums are small, what they are exploded into is not: they keep the number of partitions they are given
    daily = spread(daily, "entity")
    # the last column keeps this branch on the same columns as the other, so that both read one exchange
    ends = daily.groupBy("entity").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.sum(F.col("cents") + F.col("n")).alias("_all")).where("_all is not null")
    offset = F.explode(F.sequence(F.lit(0), F.lit(longest - 1))).alias("lag")
    influenced = daily.select("entity", F.col("d").alias("from"), "cents", "n", offset).withColumn("d", F.date_add("from", F.col("lag")))
    sums = influenced.groupBy("entity", "d").agg(
        *[F.sum(F.when(F.col("lag") < w, F.col("cents"))).alias(f"c{w}") for w in windows],
        *[F.sum(F.when(F.col("lag") < w, F.col("n"))).alias(f"n{w}") for w in windows],
    )
    calendar = ends.select("entity", F.explode(F.sequence("first", "last")).alias("d"))
    out = calendar.join(sums, ["entity", "d"], "left")
    cols = [F.col("entity").alias(entity), F.col("d").alias(day)]
    for w in windows:
        cents, n = F.coalesce(f"c{w}", F.lit(0)), F.coalesce(f"n{w}", F.lit(0))
        cols += [
            (cents.cast("decimal(26,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(28,2)").alias(f"total_{w}d"),
            n.alias(f"count_{w}d"),
            F.when(n > 0, cents / 100.0 / n).alias(f"average_{w}d"),
        ]
    return out.select(*cols)


def one_per_key(rows: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """One row per key: of the rows of a key the last in `order` (nulls first). Combines before the shuffle."""
    picked = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return picked.select(key, *[F.col("_row")[c].alias(c) for c in columns])

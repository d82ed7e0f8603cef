"""Connected components by randomised contraction (problem 7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.session import discard, written


def contract_components(edges: DataFrame, a: str = "a", b: str = "b", seed: int = 17, max_rounds: int = 200) -> DataFrame:
    """(id, group_id) for every id of an undirected edge list; group_id is the smallest id of the component.

    Each round gives every vertex a fresh pseudo-random order, hooks it to the first vertex of its closed neighbourhood
    in that order, relabels the edges and drops loops and repeats. The number of vertices falls by a constant factor a
    round in expectation, whatever the shape of the graph, so long chains take logarithmically many rounds. The round
    maps are then composed from the smallest to the largest, which costs as much as the first two joins together.

    Rows with a null side and loops are ignored; repeated edges and either direction count once; an empty input gives an
    empty result. Other columns of edges are not read. Hot vertices are pre-aggregated before the shuffle; their edges
    are spread by the adaptive skew join. Every round is written to the shared folder, so an executor may be lost.
    """
    u, v = F.col(a), F.col(b)
    now = written(
        edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct(), "edges"
    )
    maps: list[DataFrame] = []
    for turn in range(max_rounds):
        if now.isEmpty():
            break
        order = lambda c: F.struct(F.xxhash64(F.lit(seed * 1009 + turn), c).alias("h"), c.alias("x"))  # noqa: B023, E731
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked = both.groupBy("u").agg(F.min(order(F.col("v"))).alias("best")).select(F.col("u").alias("id"), F.least(F.col("best"), order(F.col("u")))["x"].alias("rep"))
        maps.append(hooked := written(hooked, "hooks"))
        left, right = (hooked.select(F.col("id").alias(side), F.col("rep").alias(f"r{side}")) for side in "uv")
        moved = now.join(left, "u").join(right, "v").where("ru != rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        after = written(moved, "edges")
        discard(now)
        now = after
    else:
        raise RuntimeError(f"components were not contracted in {max_rounds} rounds")
    if not maps:
        return now.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    discard(now)

    def expand(label: DataFrame, hooked: DataFrame) -> DataFrame:
        after = label.select(F.col("id").alias("rep"), F.col("rep").alias("top"))
        return hooked.join(after, "rep", "left").select("id", F.coalesce("top", "rep").alias("rep"))

    label = written(reduce(expand, reversed(maps)), "labels")
    for x in maps:
        discard(x)
    least = label.groupBy("rep").agg(F.min("id").alias("group_id"))
    return label.join(least, "rep").select("id", "group_id")


def current_links(matches: DataFrame, accepted: str = "accepted") -> DataFrame:
    """(a, b): unordered pairs whose latest decision is `accepted`.

    The latest decided_at counts; a null time is the earliest, and of equal times the larger match_id. Pairs with a null
    side or twice the same id are left out; the decision is compared without case and outer blanks.
    """
    a, b = F.col("vendor_id_a"), F.col("vendor_id_b")
    latest = (
        matches.where(a.isNotNull() & b.isNotNull() & (a != b))
        .groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .agg(F.max_by(F.lower(F.trim("decision")), F.struct("decided_at", "match_id")).alias("decision"))
    )
    return latest.where(F.col("decision") == accepted).select("a", "b")

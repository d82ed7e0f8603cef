"""Filling containers of fixed capacity with texts (problem 8)."""

from __future__ import annotations

import base64
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.arrow import batch
from ledgersift.session import written

#: Rank file of a public byte-level tokenizer; read on the driver and sent with the task, so executors need no copy.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of that rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that one packing task holds at most, about; groups are made by hash, so none is much larger.
GROUP = 200_000


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of whole texts. A null or empty text has no tokens."""
    ranks = Path(vocabulary).read_bytes()

    def run(batches):
        import tiktoken

        mergeable = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=mergeable, special_tokens={})
        for x in batches:
            schema = pa.schema([x.schema[0].with_name("doc_id"), ("tokens", pa.int64())])
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in x.column(1).to_pylist()]
            yield batch({"doc_id": x.column(0), "tokens": counts}, schema)

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, tokens bigint")


def bucket_bounds(histogram: dict[int, int], capacity: int, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` length buckets with the least total padding of items up to their bounds.

    Exact dynamic programming over the distinct lengths: cost[j][i] is the least padded total of the i smallest lengths in j
    buckets. For each j one vectorised minimum over the last bucket's first length.
    """
    sizes = np.array(sorted(s for s, n in histogram.items() if n and 0 < s <= capacity), np.int64)
    if not len(sizes):
        return []
    many = np.concatenate(([0], np.cumsum([histogram[int(s)] for s in sizes]))).astype(np.float64)
    n, buckets = len(sizes), min(buckets, len(sizes))
    # last[i, k]: padded total of the lengths k .. i-1 in one bucket whose bound is the largest of them
    last = np.full((n + 1, n + 1), np.inf)
    for i in range(1, n + 1):
        last[i, :i] = (many[i] - many[:i]) * sizes[i - 1]
    cost = np.full(n + 1, np.inf)
    cost[0] = 0
    cut = np.zeros((buckets + 1, n + 1), np.int64)
    for j in range(1, buckets + 1):
        total = last + cost[None, :]
        cut[j] = np.argmin(total, axis=1)
        cost = total[np.arange(n + 1), cut[j]]
        cost[0] = 0
    bounds, i, j = [], n, buckets
    while i and j:
        bounds.append(int(sizes[i - 1]))
        i, j = int(cut[j][i]), j - 1
    return bounds[::-1]


def fill(slots: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Containers for counts of items by padded size, as (times, {size: items}) patterns: the largest item first, then
    always the largest that still fits; a pattern is repeated as often as the counts allow."""
    left = {s: n for s, n in slots.items() if n}
    patterns = []
    while left:
        room, pattern = capacity, {}
        for s in sorted(left, reverse=True):
            if k := min(left[s], room // s):
                pattern[s] = k
                room -= k * s
        times = min(left[s] // k for s, k in pattern.items())
        patterns.append((times, pattern))
        for s, k in pattern.items():
            left[s] -= times * k
            if not left[s]:
                del left[s]
    return patterns


def pack(sized: DataFrame, capacity: int = 2048, buckets: int = 256, group: int = GROUP, mixed: bool = True) -> DataFrame:
    """(container, doc_id, part, first_token, tokens, bucket): every document of (doc_id, tokens) in containers of `capacity` tokens.

    A document that alone is larger is split into full parts and a rest; all others stay whole. A document without tokens takes
    no room and goes with the first container of its group. Null ids and sizes have no row; repeated rows of an id are packed each.

    A global histogram of at most `capacity` sizes goes to the driver, where dynamic programming chooses the length buckets with the
    least padding; bucket is the bound of a document's. mixed=False forms batches inside each bucket alone, as many documents as their bucket's bound
    allows in `capacity` tokens. That leaves nearly half of a container empty after each item just over half its size, so by default
    a batch also takes documents of smaller buckets where room is left: the largest bucket first, then always the
    largest that still fits. Documents are spread into groups of about `group` by a hash of id and size, each group is packed by one task on
    (id, size) pairs alone, and takes the documents of a bucket in order of their id; only a group's last containers can stay emptier
    than the rest.
    """
    whole = sized.where(F.col("doc_id").isNotNull() & (F.col("tokens") >= 0))
    part = F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / capacity).cast("int"))).alias("part")
    parts = whole.select("doc_id", "tokens", part).select("doc_id", "part", F.least(F.col("tokens") - F.col("part") * capacity, F.lit(capacity)).cast("int").alias("n"))
    histogram = {r.n: r.k for r in parts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).toLocalIterator()}  # at most `capacity` rows
    bounds = np.array(bucket_bounds(histogram, capacity, buckets), np.int64)
    groups = max(1, round(sum(histogram.values()) / group))
    kind = dict(sized.dtypes)["doc_id"]

    def run(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].combine_chunks()
        part_of, sizes = table["part"].to_numpy(), table["n"].to_numpy()
        padded = np.where(sizes > 0, bounds[np.searchsorted(bounds, sizes)], 0) if len(bounds) else np.zeros(len(sizes), np.int64)
        where = defaultdict(list)
        for i in np.lexsort((part_of, pc.rank(ids).to_numpy())):
            if sizes[i]:
                where[int(padded[i])].append(i)
        taken, n = dict.fromkeys(where, 0), np.int64(table["g"][0].as_py()) << np.int64(32)
        container = np.full(len(sizes), n)
        if not mixed:
            for s, x in sorted(where.items()):
                container[x] = n + np.arange(len(x)) // (capacity // s)
                n += -(-len(x) // (capacity // s))
        for times, pattern in fill({s: len(x) for s, x in where.items()}, capacity) if mixed else ():
            for _ in range(times):
                for s, k in pattern.items():
                    container[where[s][taken[s] : taken[s] + k]] = n
                    taken[s] += k
                n += 1
        return pa.table({"container": container, "doc_id": ids, "part": part_of, "first_token": part_of.astype(np.int64) * capacity, "tokens": sizes, "bucket": padded.astype(np.int32)})

    grouped = parts.withColumn("g", F.pmod(F.xxhash64("doc_id", "n"), F.lit(groups)).cast("bigint"))
    return grouped.groupBy("g").applyInArrow(run, f"container bigint, doc_id {kind}, part int, first_token bigint, tokens int, bucket int")


def pack_documents(docs: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY, mixed: bool = True) -> DataFrame:
    """pack() of the texts of (doc_id, text). Token counts are written once, as two passes read them."""
    return pack(written(count_tokens(docs, vocabulary=vocabulary), "tokens"), capacity, mixed=mixed)


def container_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, pieces, tokens, and the share of all containers' room that stays unused."""
    by = packed.groupBy("container").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    return by.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("n").alias("pieces"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        (1 - F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("unused_share"),
    )

"""Exact nearest vectors of a stated set of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.functions.stats import cosine

#: Query vectors sent to the tasks at once.
BLOCK = 2_000


def nearest(vectors: DataFrame, key: str, vector: str, is_query: Column, k: int) -> DataFrame:
    """(query_id, key, similarity): the k rows nearest by cosine to each query row, itself left out; ties by the smaller key.

    All rows are compared with the queries, which are sent to the tasks in blocks of bounded size; each block reduces the rows of a
    partition to k a query before anything is shuffled. Null keys and vectors are left out.
    """
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector)
    queries = rows.where(is_query).select(F.col(key).alias("query_id"), F.col(vector).alias("_q"))
    blocks = max(1, -(-queries.count() // BLOCK))
    found = []
    for b in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        near = rows.join(F.broadcast(block), F.col(key) != F.col("query_id")).select("query_id", key, F.round(cosine(F.col("_q"), F.col(vector)), 6).alias("similarity"))
        local = near.withColumn("_part", F.spark_partition_id())
        order = [F.col("similarity").desc(), F.col(key)]
        best = local.withColumn("_rank", F.row_number().over(Window.partitionBy("query_id", "_part").orderBy(*order))).where(F.col("_rank") <= k)
        found.append(best.withColumn("_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("_rank") <= k).select("query_id", key, "similarity"))
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out

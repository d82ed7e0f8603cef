"""Trie join: all words of a dictionary within a bounded edit distance of each probe (part of problem 2)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.arrow import batch
from ledgersift.llm.strings import slips
from ledgersift.session import spread

#: Dictionary words of one trie, about; shards are made by length and hash.
SHARD_WORDS = 40_000
#: Probes that walk one trie in one task, about.
BLOCK_PROBES = 5_000
_END = ""


def build(words) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[_END] = w
    return root


def neighbours(root: dict, word: str, most: int) -> list[tuple[str, int]]:
    """(dictionary word, edits) within `most` edits of word: a character wrong, missing or added, or two neighbours swapped.

    The automaton of word is run along the trie: bit i of state[e] says that i characters are read with e edits; swap[e] holds the
    states half-way through a swap. A branch is left as soon as no state is alive.
    """
    n = len(word)
    accept = 1 << n
    mask: dict[str, int] = {}
    for i, c in enumerate(word):
        mask[c] = mask.get(c, 0) | (2 << i)
    full = (2 << n) - 1
    found = []
    stack = [(root, tuple((2 << e) - 1 for e in range(most + 1)), (0,) * (most + 1))]
    while stack:
        node, state, swap = stack.pop()
        for c, child in node.items():
            if c == _END:
                for e, s in enumerate(state):
                    if s & accept:
                        found.append((child, e))
                        break
                continue
            b = mask.get(c, 0)
            now = [(state[0] << 1) & b]
            half = [0]
            for e in range(1, most + 1):
                less = state[e - 1]
                now.append((((state[e] << 1) & b) | less | (less << 1) | (now[e - 1] << 1) | ((swap[e] & b) << 1)) & full)
                half.append((less << 1) & (b >> 1))
            if any(now) or any(half):
                stack.append((child, tuple(now), tuple(half)))
    return found


def trie_join(probes: DataFrame, dictionary: DataFrame, shard_words: int = SHARD_WORDS, block_probes: int = BLOCK_PROBES) -> DataFrame:
    """(token, word, edits) for probes (token) and dictionary (word), both distinct strings, within slips(length of word) edits.

    The dictionary is split by length and, within a length, by hash into shards of at most about shard_words words; the probes are
    split by hash into blocks of about block_probes. A task makes a trie of one shard and walks it with one block; a probe visits
    only shards of lengths it can reach. So neither side is ever held whole by a task, whatever its size, and no
    key holds more than a shard and a block. Null and empty strings are left out; an empty side gives an empty result.
    """
    words = dictionary.select(F.col(dictionary.columns[0]).alias("word")).where("word <> ''").distinct()
    asked = probes.select(F.col(probes.columns[0]).alias("token")).where("token <> ''").distinct()
    # one row a length, and the number of probes
    counted = words.groupBy(F.length("word").alias("n")).agg(F.count(F.lit(1)).alias("k")).unionAll(asked.select(F.lit(0).alias("n"), F.lit(1).alias("x")).groupBy("n").agg(F.count("x").alias("k")))
    sizes = {r.n: r.k for r in counted.collect()}
    blocks = max(1, -(-sizes.pop(0, 0) // block_probes))
    # for each length of a probe the shards (length, number) it can reach
    reach = {n: [(m, k) for m, count in sizes.items() if abs(n - m) <= slips(m) for k in range(-(-count // shard_words))] for n in {m + d for m in sizes for d in range(-2, 3)} if n > 0}
    of_length = F.create_map(*[x for m, k in sizes.items() for x in (F.lit(m), F.lit(-(-k // shard_words)))]) if sizes else F.lit(None).cast("map<int,int>")
    visited = F.create_map(*[x for n, at in reach.items() if at for x in (F.lit(n), F.array(*[F.struct(F.lit(m).alias("length"), F.lit(k).alias("shard")) for m, k in at]))]) if sizes else F.lit(None).cast("map<int,array<struct<length:int,shard:int>>>")
    own = F.pmod(F.xxhash64("word"), of_length[F.length("word")].cast("bigint")).cast("int")
    placed = words.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.length("word").alias("length"), own.alias("shard"), "word")
    block = F.pmod(F.xxhash64("token"), F.lit(blocks)).cast("int").alias("block")
    sent = asked.select(block, "token", F.explode(visited[F.length("token")]).alias("at")).select("block", "at.length", "at.shard", "token")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("token", pa.string()), ("word", pa.string()), ("edits", pa.int32())])
        rows = []
        if left.num_rows and right.num_rows:
            root, most = build(left["word"].to_pylist()), slips(left["length"][0].as_py())
            rows = [(t, w, e) for t in right["token"].to_pylist() for w, e in neighbours(root, t, most)]
        return pa.Table.from_batches([batch(dict(zip(schema.names, zip(*rows), strict=True)) if rows else dict.fromkeys(schema.names, []), schema)])

    keys = ["length", "shard", "block"]
    # small rows, dear walks: both sides keep the number of partitions they are given
    placed, sent = spread(placed, *keys), spread(sent, *keys)
    return placed.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(run, "token string, word string, edits int")

"""Evaluation passages inside training documents, by suffix arrays over shards (problem 9)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.arrow import batch, pieces

WORD = re.compile(r"[^\W_]+")
#: Characters of text whose suffixes form one array; a longer document is cut into several.
SHARD_CHARS = 2_000_000
#: Words that the sorted keys of one array hold together, at most.
SHARD_KEYS = 8_000_000


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return WORD.findall(text.lower()) if text else []


def _keys(matrix: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort as the rows do."""
    return np.ascontiguousarray(matrix.astype(">u4")).view(f"S{4 * matrix.shape[1]}").ravel()


def _searcher(items: list[tuple[int, list[str]]], span: int):
    """A function that searches the items' passages in Arrow batches of (id, text)."""
    number: dict[str, int] = {}
    coded = [(i, np.array([number.setdefault(w, len(number) + 1) for w in ws], np.uint32)) for i, ws in items if ws]
    needs = [min(span, len(c)) for _, c in coded]
    least, deepest = min(needs, default=1), max((len(c) for _, c in coded), default=1)
    # suffixes are sorted by as many words as any passage must share; longer matches are found by comparison
    width = max(needs, default=1)
    # every suffix of an item that is long enough, by the words it must share
    tests: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for (item, code), need in zip(coded, needs, strict=True):
        for at in range(len(code) - need + 1):
            tests.setdefault(need, []).append((item, at, code[at:]))
    probes = {}
    for need, found in tests.items():
        low = np.array([c[:need] for _, _, c in found], np.uint32)
        high = low.copy()
        high[:, -1] += 1
        probes[need] = (found, _keys(low), _keys(high))

    def cut(text: str | None) -> Iterator[tuple[int, list[str]]]:
        """(number of the first word, words) of parts of a text; the parts overlap by a whole item less one word."""
        if not text or len(text) <= SHARD_CHARS:
            yield 0, words(text)
            return
        at = first = 0
        kept: list[str] = []
        while at < len(text):
            end = min(len(text), at + SHARD_CHARS)
            while end < len(text) and WORD.match(text[end]):
                end += 1
            part = kept + words(text[at:end])
            yield first, part
            kept = part[len(part) - deepest + 1 :] if deepest > 1 else []
            first += len(part) - len(kept)
            at = end

    def search(ids: list, texts: list) -> Iterator[tuple]:
        parts = [(i, offset, ws) for i, t in zip(ids, texts, strict=True) for offset, ws in cut(t)]
        for first, end in pieces([len(ws) + 1 for _, _, ws in parts], max(1, min(SHARD_CHARS // 4, SHARD_KEYS // width))):
            yield from search_parts(parts[first:end])

    def search_parts(parts: list) -> Iterator[tuple]:
        per_doc = [list(map(number.get, ws)) for _, _, ws in parts]
        lengths = np.array([len(x) + 1 for x in per_doc])
        codes = np.fromiter((c or 0 for c in chain.from_iterable(x + [0] for x in per_doc)), np.uint32, lengths.sum())
        starts = np.cumsum(lengths) - lengths
        # suffixes that leave the test vocabulary before `least` words match no test suffix and are not sorted
        known = np.flatnonzero(np.diff(np.concatenate(([0], (codes > 0).view(np.int8), [0]))))
        runs = known.reshape(-1, 2)
        runs = runs[runs[:, 1] - runs[:, 0] >= least]
        if not len(runs):
            return
        at = np.concatenate([np.arange(a, b - least + 1) for a, b in runs])
        ends = np.repeat(runs[:, 1], runs[:, 1] - runs[:, 0] - least + 1)
        matrix = np.zeros((len(at), width), np.uint32)
        for k in range(width):
            inside = at + k < ends
            matrix[inside, k] = codes[at[inside] + k]
        keys = _keys(matrix)
        del matrix
        order = np.argsort(keys, kind="stable")
        keys, at, ends = keys[order], at[order], ends[order]
        for need, (found, low, high) in probes.items():
            first, last = np.searchsorted(keys, low), np.searchsorted(keys, high)
            for k in np.flatnonzero(first < last):
                item, begins, code = found[k]
                for j in range(first[k], last[k]):
                    m = min(len(code), int(ends[j] - at[j]))
                    same = codes[at[j] : at[j] + m] == code[:m]
                    n = m if same.all() else int(np.argmin(same))
                    d = int(np.searchsorted(starts, at[j], "right")) - 1
                    doc, offset, _ = parts[d]
                    yield item, doc, n, begins, int(at[j] - starts[d]) + offset

    return search


def find_passages(docs: DataFrame, items: DataFrame, span: int = 13, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = 50_000) -> DataFrame:
    """(item_id, doc_id, words, item_word, doc_word): every verbatim match of `span` or more words of an item in a document.

    Words are runs of letters and digits compared without case. An item of fewer than `span` words must match whole.
    words is the longest match from item word item_word at document word doc_word on; matches that start later inside a
    longer one are listed too, one for each suffix of the item.

    The documents are read once a block of items, in shards: each shard's word suffixes are sorted into an array, in which every test
    suffix is looked up by binary search by its first `span` words; how far a match goes on is found by comparison, so memory does not grow with
    the length of items. Suffixes that leave the items' vocabulary before the shortest passage ends
    cannot match and are left out of the array. The items, the side that does not grow, are sent to the
    tasks in blocks of at most `block` items; documents are never shuffled.

    Null and empty texts and texts without words hold and are held by nothing; rows with equal ids or texts are each searched; null
    ids are kept as ids; other columns are ignored; an empty input gives an empty result.
    """
    given = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    n = given.count()
    blocks = max(1, -(-n // block))
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"item_id {kinds[1]}, doc_id {kinds[0]}, words int, item_word int, doc_word bigint"
    parts = []
    for b in range(blocks):
        one = given if blocks == 1 else given.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b)
        coded = [(r.i, words(r.t)) for r in one.toLocalIterator()]

        def run(batches, coded=coded):
            search = out = None
            for x in batches:
                if search is None:
                    search = _searcher(coded, span)
                    out = pa.schema([("item_id", pa.string() if kinds[1] == "string" else pa.int64()), ("doc_id", x.schema[0].type), ("words", pa.int32()), ("item_word", pa.int32()), ("doc_word", pa.int64())])
                ids, texts = x.column(0).to_pylist(), x.column(1).to_pylist()
                for first, end in pieces([len(t or "") + 1 for t in texts], SHARD_CHARS):
                    # a match in the overlap of two parts is found in both
                    if rows := list(dict.fromkeys(search(ids[first:end], texts[first:end]))):
                        yield batch(dict(zip(out.names, zip(*rows), strict=True)), out)

        parts.append(docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    return found


def without_leaks(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents in which no passage was found, with all their columns. Documents with a null id stay."""
    return docs.join(found.select(F.col("doc_id").alias("_leaked")).distinct(), F.col(doc_id) == F.col("_leaked"), "left_anti")

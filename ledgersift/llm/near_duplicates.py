"""Near-duplicate records with small edits, by min-max hashing (problem 3)."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.llm.arrow import batch, pieces
from ledgersift.llm.names import SHORT, name_tokens
from ledgersift.llm.strings import fold, osa
from ledgersift.session import written

#: Amounts that count as equal differ by at most this share of the larger one.
TOLERANCE = 0.02
#: Slips allowed in an invoice number.
SLIPS = 2
#: Permutations of the features; each gives two bands, by its least and by its largest value.
PERMUTATIONS = 8
#: Permutations for pairs with a record whose vendor is not known, which cannot be kept to one vendor.
OPEN_PERMUTATIONS = 4
#: Numbers up to this length are also joined without a value of their own: two slips leave too little of them.
SHORT_NUMBER = 5
#: Bigrams that two lines must share (Dice) to be one line with small edits.
SAME_LINE = 0.7
#: Width of an amount bucket, in tolerances; only amounts next to a bound are put into two.
WIDTH = 4

# What is added to a line that is entered again.
ADDED = re.compile(r"\s*(?:\(copy\)|-\s+resent|,\s*as agreed|p\.quote|\.)\s*$")
_ENDS = re.compile(r"^[^0-9]+|[^0-9]+$")
_MARKS = re.compile(r"[\W_]+")


def plain_number(text: str | None) -> str:
    """An invoice number without letters and marks around it, separators, blanks, case and leading zeros.

    Where nothing is left of it (no digit but zeros), the text itself without marks and case.
    """
    if not text:
        return ""
    bare = _MARKS.sub("", fold(text))
    return _MARKS.sub("", _ENDS.sub("", fold(text))).lstrip("0") or bare.lstrip("0") or bare


def plain_line(text: str) -> str:
    return ADDED.sub("", " ".join(fold(text).split())).strip()


def _bigrams(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i in range(len(text) - 1):
        g = text[i : i + 2]
        out[g] = out.get(g, 0) + 1
    return out


def dice(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = _bigrams(a), _bigrams(b)
    return 2 * sum(min(n, y.get(g, 0)) for g, n in x.items()) / max(1, sum(x.values()) + sum(y.values()))


def same_lines(a: list[str], b: list[str]) -> bool:
    """Whether two sets of lines agree but for small edits, order and at most one line that only one of them has."""
    x, y = {plain_line(t) for t in a} - {""}, {plain_line(t) for t in b} - {""}
    left, right = sorted(x - y), sorted(y - x)
    if abs(len(left) - len(right)) > 1:
        return False
    ranked = sorted(((s, i, j) for i, t in enumerate(left) for j, u in enumerate(right) if (s := dice(t, u)) >= SAME_LINE), reverse=True)
    used_i, used_j = set(), set()
    for _, i, j in ranked:
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
    return len(left) + len(right) - len(used_i) - len(used_j) <= 1


def same_name(a: str | None, b: str | None) -> bool:
    """Whether two typed names share a word, with slips, also in short form or written together; unknown names may be the same."""
    x, y = (name_tokens(t) if t else [] for t in (a, b))
    if not x or not y:
        return True
    return any(t == u or len(t) > 4 and len(u) > 4 and (osa(t, u, 2) <= 2 or t in u or u in t) or u in SHORT.get(t, ()) or t in SHORT.get(u, ()) for t in x for u in y)


def amounts_agree(a: int, b: int) -> bool:
    return a == b or (a > 0) == (b > 0) and abs(a - b) <= TOLERANCE * max(abs(a), abs(b))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def min_max(texts: list[str], n: int, permutations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) value of the character n-grams of each text under each permutation, as arrays [permutation, text].

    Both ends of one permutation are kept: each agrees for two texts with a probability of the Jaccard similarity of their n-gram
    sets, so half the hash evaluations give the same number of values. n-grams over a line break are left out, so the
    order of lines does not count; a text without n-grams has neutral values.
    """
    lengths = np.array([len(t) + n for t in texts])
    ends = np.cumsum(lengths)
    chars = np.frombuffer("".join(t + "\n" * n for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    code = np.zeros(len(chars) - n + 1, np.uint64)
    broken = np.zeros(len(code), bool)
    for k in range(n):
        part = chars[k : len(chars) - n + 1 + k]
        code = code * np.uint64(1_000_003) + part
        broken |= part == 10
    code = np.concatenate((code, np.zeros(n - 1, np.uint64)))
    broken = np.concatenate((broken, np.ones(n - 1, bool)))
    starts = ends - lengths
    least, largest = np.empty((permutations, len(texts)), np.uint64), np.empty((permutations, len(texts)), np.uint64)
    for p in range(permutations):
        h = _mix(code ^ _mix(np.full(1, seed * 7919 + p + 1, np.uint64)))
        least[p] = np.minimum.reduceat(np.where(broken, np.uint64(2**64 - 1), h), starts)
        largest[p] = np.maximum.reduceat(np.where(broken, np.uint64(0), h), starts)
    return least, largest


def _describe(batches):
    """Records with their plain number, its lines in plain form, and a class: equal classes are copies in all that counts."""
    from hashlib import blake2b

    schema = pa.schema([("id", pa.string()), ("class", pa.int64()), ("number", pa.string()), ("vendor", pa.string()), ("name", pa.string()), ("cents", pa.int64()), ("lines", pa.list_(pa.string()))])
    for x in batches:
        rows = []
        for id_, number, vendor, name, cents, lines in zip(*(c.to_pylist() for c in x.columns), strict=True):
            if not (number := plain_number(number)):
                continue
            lines = sorted({plain_line(t) for t in lines} - {""})
            known = vendor if vendor else f"?{name or ''}"
            digest = blake2b("\0".join((number, known, str(cents), *lines)).encode("utf-8", "surrogatepass"), digest_size=8).digest()
            rows.append((id_, int.from_bytes(digest, "little", signed=True), number, vendor, None if vendor else name, cents, lines))
        if rows:
            yield batch(dict(zip(schema.names, zip(*rows), strict=True)), schema)


def _buckets(cents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(record, bucket) rows: the amount buckets of each amount, such that two amounts that agree share one."""
    size = np.abs(cents)
    at = np.log(np.maximum(size, 1)) / -math.log(1 - TOLERANCE)
    first = np.floor(at / WIDTH).astype(np.int64)
    twice = np.flatnonzero((at - first * WIDTH >= WIDTH - 1.001) & (size > 0))
    record = np.concatenate((np.arange(len(cents)), twice))
    bucket = np.concatenate((first, first[twice] + 1))
    return record, np.where(size[record] == 0, 0, 2 * bucket + (cents[record] > 0) + 2)


def _bands(permutations: int, how: str):
    """Band keys of records (class, number, vendor, cents, lines), within their amount buckets.

    how: `vendor`, of the number, the lines and the vendor, and for short numbers of the lines and the vendor alone; `open`, of
    the number and the lines; `number`, of the number alone.
    """

    def run(batches):
        schema = pa.schema([("key", pa.int64()), ("class", pa.int64()), ("number", pa.string())])
        for x in batches:
            numbers, vendors, all_cents, lines = (x.column(i).to_pylist() for i in range(1, 5))
            for first, end in pieces([sum(map(len, t)) + 1 for t in lines], 2_000_000):
                part = range(first, end)
                numbered = min_max([f"^{numbers[i]}$" for i in part], 2, permutations, 1)
                if how == "number":
                    keys = [_mix(n + np.uint64(977 + k)) for k, n in enumerate(np.concatenate(numbered))]
                else:  # a band takes one value of the number and one of the lines
                    lined = min_max(["\n".join(lines[i]) for i in part], 3, permutations, 2)
                    said = [_mix(d + np.uint64(2 * p + top)) for top in (0, 1) for p, d in enumerate(lined[top])]
                    keys = [_mix(n * np.uint64(31) + d) for n, d in zip(np.concatenate(numbered), said, strict=True)]
                record, bucket = _buckets(np.array(all_cents[first:end], np.int64))
                salt = _mix(bucket.astype(np.uint64) + np.uint64(11))
                if how == "vendor":
                    salt ^= _mix(np.array(vendors[first:end], np.int64).view(np.uint64) + np.uint64(5))[record]
                # rows of one record stand side by side, which compresses far better in the shuffle
                key, at = np.stack([k[record] ^ salt for k in keys], axis=1).ravel(), np.repeat(record, len(keys))
                if how == "vendor":
                    long = np.array([len(numbers[i]) >= SHORT_NUMBER - 1 for i in part])
                    short = np.flatnonzero(np.array([len(numbers[i]) <= SHORT_NUMBER for i in part])[record])
                    key, at = key[long[at]], at[long[at]]
                    key = np.concatenate((key, np.stack([_mix(d[record[short]] + np.uint64(3)) ^ salt[short] for d in said], axis=1).ravel()))
                    at = np.concatenate((at, np.repeat(record[short], len(said))))
                at = pa.array(at + first)
                yield batch({"key": key.view(np.int64), "class": x.column(0).take(at), "number": x.column(1).take(at)}, schema)

    return run


def _verify(batches):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for x in batches:
        rows = []
        for a, b, na, nb, va, vb, ta, tb, ca, cb, la, lb in zip(*(c.to_pylist() for c in x.columns), strict=True):
            if osa(na, nb, SLIPS) <= SLIPS and amounts_agree(ca, cb) and (va == vb if va and vb else same_name(ta, tb)) and same_lines(la, lb):
                rows.append((a, b))
        if rows:
            yield batch(dict(zip(schema.names, zip(*rows), strict=True)), schema)


def invoice_records(lines: DataFrame) -> DataFrame:
    """(id, number, vendor, name, cents, lines) of invoice lines: the header of each invoice_id once, with its distinct descriptions."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    return (
        lines.where("invoice_id is not null")
        .groupBy(F.col("invoice_id").alias("id"))
        .agg(
            F.max("invoice_number").alias("number"), F.max(text("vendor_id")).alias("vendor"), F.max(text("vendor_name")).alias("name"),
            F.max((F.col("total_amount").cast("decimal(18,2)") * 100).cast("long")).alias("cents"), F.collect_set("line_item_description").alias("lines"),
        )
    )


def entered_again(records: DataFrame, permutations: int = PERMUTATIONS, open_permutations: int = OPEN_PERMUTATIONS) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, class) puts exact copies into one class; links (a, b) are pairs of classes that are near.

    Records (id, number, vendor, name, cents, lines) are near if their vendor is the same, their numbers differ by at most SLIPS
    slips once letters and marks around, separators and leading zeros are taken off, their amounts by at most TOLERANCE, and their
    lines by small edits and at most one line.

    Features are the bigrams of the number and the trigrams of the lines. Each permutation gives two bands, from the least and the
    largest value; a band joins one value of the number with one of the lines, within a vendor and a bucket of amounts. Records that
    share a band are candidates, thinned out inside the join by a bound on the edits of the numbers, and then compared exactly. Near
    records are found with a probability of 1 - (1 - s t) ** (2 * permutations) for the similarities s and t of
    their numbers and lines. Numbers of up to SHORT_NUMBER characters, of which two slips leave little, are also joined by vendor,
    amount and lines alone, with 1 - (1 - t) ** (2 * permutations).

    A record without a vendor may be any vendor's; two such are compared by name, and an unknown name may be any. Only these, the
    smaller part, are joined with all records across vendors, by bands from open_permutations.

    Exact copies are one class before anything is paired, so a group of copies of any size costs one record. A record
    without a number or an amount is near nothing; a number without a digit but zeros counts as it is written.
    Null ids are left out, repeated rows count once, other columns are ignored, empty tables give empty results.
    """
    given = records.where("id is not null and cents is not null and trim(number) <> ''").select("id", "number", "vendor", "name", "cents", "lines")
    described = given.mapInArrow(_describe, "id string, class bigint, number string, vendor string, name string, cents bigint, lines array<string>")
    by_class = Window.partitionBy("class").orderBy("id")
    described = written(described.withColumn("first", F.row_number().over(by_class) == 1), "records")
    rows = described.where("first").select("class", "number", F.when(F.col("vendor").isNull(), 0).otherwise(F.xxhash64("vendor")).alias("vendor"), "cents", "lines")
    unknown = rows.where("vendor = 0")
    bands = lambda df, how, n: df.mapInArrow(_bands(n, how), "key bigint, class bigint, number string")
    side = lambda df, s: df.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("class", "number")])
    near = F.levenshtein("number_a", "number_b", 2 * SLIPS) >= 0  # a swap counts as two edits there
    pair = [F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b")]
    known = bands(rows.where("vendor <> 0"), "vendor", permutations)
    found = side(known, "a").join(side(known, "b"), "key").where((F.col("class_a") < F.col("class_b")) & near).select(*pair)
    free = [side(bands(df, "open", open_permutations), s) for df, s in ((unknown, "a"), (rows, "b"))]
    # a record without lines is near one with a single line, of which it has no feature: their numbers alone must do
    bare = [side(bands(rows.where(f"size(lines) < {n}"), "number", 3), s) for n, s in ((1, "a"), (2, "b"))]
    for a, b in (free, bare):
        found = found.unionAll(a.join(b, "key").where((F.col("class_a") != F.col("class_b")) & near).select(*pair))
    candidates = written(found.distinct(), "candidates")
    involved = written(candidates.select(F.col("class_a").alias("class")).unionAll(candidates.select("class_b")).distinct(), "involved")
    full = written(described.where("first").join(involved, "class").select("class", "number", "vendor", "name", "cents", "lines"), "full")
    parts = ["number", "vendor", "name", "cents", "lines"]
    a, b = (full.select(F.col("class").alias(f"class_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in parts]) for s in "ab")
    pairs = candidates.join(a, "class_a").join(b, "class_b").select("class_a", "class_b", *[f"{c}_{s}" for c in parts for s in "ab"])
    return described.select("id", "class"), pairs.mapInArrow(_verify, "a bigint, b bigint")


def duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b) of all records of one class, and of linked classes; the smaller id first."""
    links = written(links, "links")
    x, y = (members.select(F.col("id").alias(f"id_{s}"), F.col("class").alias(f"class_{s}")) for s in "xy")
    inside = x.join(y, F.col("class_x") == F.col("class_y")).where("id_x < id_y").select(F.col("id_x").alias("id_a"), F.col("id_y").alias("id_b"))
    between = links.join(x, F.col("a") == F.col("class_x")).join(y, F.col("b") == F.col("class_y"))
    return inside.unionAll(between.select(F.least("id_x", "id_y"), F.greatest("id_x", "id_y"))).distinct()

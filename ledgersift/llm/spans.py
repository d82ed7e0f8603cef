"""Long exact spans shared between records (problem 10)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.llm.arrow import batch, pieces
from ledgersift.session import written

#: Characters whose spans are hashed together.
SHARD_CHARS = 1_000_000
#: Sentences of a run, at least.
RUN = 2
#: A sentence with the blanks after it.
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?=\s|$)|[.!?](?=\S)|\n|$)\s*")
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i : i + w] for each i; the windows at the end are shorter."""
    n = len(x)
    fill = np.iinfo(x.dtype).max if pick is np.minimum else 0
    pad = np.full(-(-n // w) * w + w, fill, x.dtype)
    pad[:n] = x
    rows = pad.reshape(-1, w)
    ahead = pick.accumulate(rows, axis=1).ravel()
    back = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], ahead[w - 1 : w - 1 + n])


def _anchors(chars: np.ndarray, width: int) -> np.ndarray:
    """Positions chosen by their own next few characters, at least one start of a word in any `width` characters.

    Starts of words compete by a hash of their next eight characters, and the least of each window wins. In a window with no start
    of a word every character competes.
    """
    n = len(chars)
    code = _mix(chars.astype(np.uint64) + np.uint64(1))
    h = np.zeros(n, np.uint64)
    for k in range(8):
        h[: n - k] += code[k:] * np.uint64(2 * k * k + 3 * k + 1)
    h = _mix(h) >> np.uint64(1)
    space = (chars == 32) | ((chars >= 9) & (chars <= 13)) | (chars == 0) | (chars == 160)
    starts = ~space
    starts[1:] &= space[:-1]
    rank = np.where(starts, h >> np.uint64(1), (h >> np.uint64(1)) | np.uint64(1 << 62))
    least = _sliding(rank, width, np.minimum)
    # a position wins if it is the least of any window that covers it
    most = _sliding(least[::-1], width, np.maximum)[::-1]
    return np.flatnonzero(most == rank)


def _span_hashes(chars: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of chars[i : i + length] for each i of at."""
    n = len(chars)
    base = np.uint64(0x9E3779B97F4A7C15)
    powers = np.cumprod(np.full(n, base, np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(chars.astype(np.uint64) + np.uint64(7)) * powers, dtype=np.uint64)))
    # the base is odd, so it has an inverse: equal spans get equal hashes wherever they stand
    inverse = np.cumprod(np.full(n, pow(int(base), -1, 1 << 64), np.uint64))
    return _mix((sums[at + length] - sums[at]) * inverse[at])


def sentence_runs(text: str, length: int) -> list[tuple[int, int]]:
    """(from, to) of the shortest run of RUN sentences or more with at least `length` characters from each sentence on.

    Runs that are ten times as long, as of one endless sentence, are left out.
    """
    cut = sentences(text)
    out, j = [], 0
    for i, (start, _) in enumerate(cut):
        j = max(j, i + RUN - 1)
        while j < len(cut) and cut[j][1] - start < length:
            j += 1
        if j == len(cut):
            break
        if cut[j][1] - start <= 10 * length:
            out.append((start, cut[j][1]))
    return out


def _emit(length: int, width: int):
    core = length - width

    def run(batches):
        from hashlib import blake2b

        for x in batches:
            schema = pa.schema([("h", pa.int64()), ("doc", x.schema[0].type), ("pos", pa.int32()), ("n", pa.int32())])
            ids, texts = x.column(0), x.column(1).to_pylist()
            for first, end in pieces([len(t or "") + 1 for t in texts], SHARD_CHARS):
                runs = [(i, s, e) for i in range(first, end) if texts[i] and len(texts[i]) >= length for s, e in sentence_runs(texts[i], length)]
                if runs:
                    h = [int.from_bytes(blake2b(texts[i][s:e].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for i, s, e in runs]
                    yield batch({"h": h, "doc": ids.take(pa.array([i for i, _, _ in runs])), "pos": [s for _, s, _ in runs], "n": [e - s for _, s, e in runs]}, schema)
            # a very long text is cut into parts that overlap by more than a span and a window, so that none is lost at a cut
            cuts = [(i, s, min(len(t), s + SHARD_CHARS + core + 2 * width)) for i, t in enumerate(texts) if t and len(t) >= core for s in range(0, max(1, len(t) - core - 2 * width), SHARD_CHARS)]
            for first, end in pieces([e - s + 1 for _, s, e in cuts], SHARD_CHARS):
                part = cuts[first:end]
                lengths = np.array([e - s for _, s, e in part])
                begins = np.cumsum(lengths + 1) - lengths - 1
                chars = np.frombuffer("".join(texts[i][s:e] + "\0" for i, s, e in part).encode("utf-32-le", "surrogatepass"), np.uint32)
                at = _anchors(chars, width)
                cut = np.searchsorted(begins, at, "right") - 1
                fits = at + core <= begins[cut] + lengths[cut]
                at, cut = at[fits], cut[fits]
                if len(at):
                    h = _span_hashes(chars, at, core).view(np.int64)
                    doc, start = np.array([i for i, _, _ in part])[cut], np.array([s for _, s, _ in part])[cut]
                    yield batch({"h": h, "doc": ids.take(pa.array(doc)), "pos": (at - begins[cut] + start).astype(np.int32), "n": np.full(len(at), core, np.int32)}, schema)

    return run


def _contexts(length: int):
    """For documents with their repeated spans: the texts left and right of each, as far as a run of `length` with it can reach,
    and a digest of the span."""

    def run(batches):
        from hashlib import md5

        for x in batches:
            schema = pa.schema([("h", pa.int64()), ("doc", x.schema[0].type), ("pos", pa.int32()), ("n", pa.int32()), ("digest", pa.binary()), ("left", pa.string()), ("right", pa.string())])
            docs, texts, spots = (x.column(i).to_pylist() for i in range(3))
            rows = []
            for doc, t, found in zip(docs, texts, spots, strict=True):
                for s in found:
                    p, n = s["pos"], s["n"]
                    e, side = p + n, max(0, length - n)
                    rows.append((s["h"], doc, p, n, md5(t[p:e].encode("utf-8", "surrogatepass")).digest(), t[max(0, p - side) : p], t[e : e + side]))
            if rows:
                yield batch(dict(zip(schema.names, zip(*rows), strict=True)), schema)

    return run


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _extend(length: int):
    def run(batches):
        for x in batches:
            schema = pa.schema([("doc_id_a", x.schema[0].type), ("doc_id_b", x.schema[1].type)])
            rows = set()
            for a, b, n, la, lb, ra, rb in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if (a, b) not in rows and _common(la[::-1], lb[::-1]) + n + _common(ra, rb) >= length:
                    rows.add((a, b))
            if rows:
                yield batch(dict(zip(schema.names, zip(*rows), strict=True)), schema)

    return run


def repeated_spans(docs: DataFrame, length: int = 300, doc_id: str = "doc_id", text: str = "text", window: int | None = None) -> DataFrame:
    """(h, doc, pos, n, digest, left, right): spans of n characters that stand in two documents or more, with what is left and right
    of them, as far as a common run of `length` characters with them can reach.

    From each sentence on, the shortest run of RUN sentences or more with at least `length` characters is hashed, and all runs are joined
    globally. A common run of `length` characters need not hold whole sentences, so spans of length - window characters are hashed
    and joined as well, from words on that win a window of `window` characters by their own content: every common run of `length` has such a start
    within its first `window` characters, in both documents alike, so none is missed. The least and largest document of each hash,
    combined before the shuffle, tell which repeat; only these spans are kept, and only their documents are read again.

    Null texts and texts shorter than `length` share nothing; empty tables give an empty result; other columns are ignored; rows
    with the same id count as one document, so a text delivered twice under one id shares nothing with itself.
    """
    window = window or max(8, length // 3)
    kind = dict(docs.dtypes)[doc_id]
    given = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("t")).where(F.col("doc").isNotNull() & (F.char_length("t") >= length))
    spans = written(given.mapInArrow(_emit(length, window), f"h bigint, doc {kind}, pos int, n int"), "spans")
    # few spans repeat; written, their number is known, and all spans are placed by hash a second time only if they are many
    several = written(spans.groupBy("h").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x < y").select("h"), "several")
    spots = spans.join(several, "h").groupBy("doc").agg(F.collect_set(F.struct("h", "pos", "n")).alias("spots"))  # at most the spans of one document
    context = given.join(spots, "doc").select("doc", "t", "spots").mapInArrow(_contexts(length), f"h bigint, doc {kind}, pos int, n int, digest binary, left string, right string")
    return written(context, "context")


def shared_pairs(spans: DataFrame, length: int = 300) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first: the documents of repeated_spans that have `length` characters in a row in common."""
    one, two = (spans.select("h", "digest", "n", *[F.col(c).alias(f"{c}_{s}") for c in ("doc", "left", "right")]) for s in "ab")
    pairs = one.join(two, ["h", "digest", "n"]).where("doc_a < doc_b").select("doc_a", "doc_b", "n", "left_a", "left_b", "right_a", "right_b")
    kind = dict(spans.dtypes)["doc"]
    return pairs.mapInArrow(_extend(length), f"doc_id_a {kind}, doc_id_b {kind}").distinct()


def shared_intervals(spans: DataFrame, length: int = 300, later_only: bool = False) -> DataFrame:
    """(doc_id, from, to): the maximal runs of characters of each document that stand in spans of `length` that others have too.

    later_only: only those that stand in a document with a smaller id too, so that the first copy of a span is none.

    No pairs are made. Spans with the same text and the same surroundings are one class, however many documents have them. A class takes part in one
    run of `length` characters for each way to share the rest between left and right; the least and largest document of each such run tell
    whether another document has it. Classes that are alone with their span need no such look.
    """
    key = ["h", "digest", "c"]
    rows = spans.withColumn("c", F.xxhash64("left", "right"))
    need = F.greatest(F.lit(length) - F.col("n"), F.lit(0))
    classes = rows.groupBy(*key).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.max("left").alias("left"), F.max("right").alias("right"), F.max(need).alias("need"))
    # b characters of the run are left of the span, need - b right of it
    classes = classes.withColumns({"most": F.least(F.length("left"), "need"), "least": F.greatest(F.col("need") - F.length("right"), F.lit(0))}).where("least <= most")
    classes = written(classes, "classes")
    crowded = classes.groupBy("h", "digest").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h", "digest")
    run = F.xxhash64(F.expr("right(`left`, b)"), F.expr("left(`right`, `need` - b)"))
    runs = classes.join(crowded, ["h", "digest"]).withColumn("b", F.explode(F.sequence("least", "most"))).select(*key, "lo", "hi", "b", run.alias("run"))
    ends = runs.groupBy("h", "digest", "b", "run").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    other = runs.join(ends, ["h", "digest", "b", "run"])
    before = F.col("first") < F.col("lo")
    seen = before if later_only else before | (F.col("last") > F.col("hi"))
    other = other.where(seen).groupBy(*key).agg(F.max("b").alias("b_most"), F.min("b").alias("b_least"))
    known = classes.join(other, key, "left").select(*key, "lo", "hi", "most", "least", "need", "b_most", "b_least")
    # all documents of a class but the first have each of its runs in another document, and so has the first if order does not count
    full = F.col("doc") > F.col("lo") if later_only else F.col("lo") < F.col("hi")
    found = rows.select("doc", "pos", "n", *key).join(known, key)
    found = found.withColumns({"x": F.when(full, F.col("most")).otherwise(F.col("b_most")), "y": F.col("need") - F.when(full, F.col("least")).otherwise(F.col("b_least"))})
    spots = found.where("x is not null").select(F.col("doc").alias("doc_id"), (F.col("pos") - F.col("x")).alias("from"), (F.col("pos") + F.col("n") + F.col("y")).alias("to")).distinct()
    by_doc = Window.partitionBy("doc_id").orderBy("from", "to")
    reach = F.max("to").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    merged = spots.withColumn("opens", (reach.isNull() | (F.col("from") > reach)).cast("int")).withColumn("run", F.sum("opens").over(by_doc))
    return merged.groupBy("doc_id", "run").agg(F.min("from").alias("from"), F.max("to").alias("to")).drop("run")


def shared_characters(spans: DataFrame, docs: DataFrame, length: int = 300, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, shared_chars, n_chars, shared_ratio) for each document with a shared span."""
    shared = shared_intervals(spans, length).groupBy("doc_id").agg(F.sum(F.col("to") - F.col("from")).alias("shared_chars"))
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.char_length(text).alias("n_chars")).groupBy("doc_id").agg(F.max("n_chars").alias("n_chars"))
    return shared.join(sizes, "doc_id").select("doc_id", "shared_chars", "n_chars", (F.col("shared_chars") / F.col("n_chars")).alias("shared_ratio"))


def sentences(text: str) -> list[tuple[int, int]]:
    """(from, to) of the sentences of a text; together they are the text."""
    return [m.span() for m in SENTENCE.finditer(text) if m.end() > m.start()]


def _cut_sentences(batches):
    for x in batches:
        schema = pa.schema([("doc_id", x.schema[0].type), ("text", pa.string()), ("removed", pa.int32())])
        docs, texts, runs = (x.column(i).to_pylist() for i in range(3))
        kept_texts, removed = [], []
        for t, found in zip(texts, runs, strict=True):
            found = sorted((r["from"], r["to"]) for r in found or ())
            kept, k = [], 0
            for s, e in sentences(t or ""):
                while k < len(found) and found[k][1] < e:
                    k += 1
                end = s + len(t[s:e].rstrip())
                if not (k < len(found) and found[k][0] <= s and end <= found[k][1]) and not (k and found[k - 1][0] <= s and end <= found[k - 1][1]):
                    kept.append(t[s:e])
            kept_texts.append(None if t is None else "".join(kept))
            removed.append(len(sentences(t or "")) - len(kept))
        yield batch({"doc_id": x.column(0), "text": kept_texts, "removed": removed}, schema)


def without_repeats(docs: DataFrame, spans: DataFrame, length: int = 300, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, removed): every document without the sentences that a repeated span covers, but for the span's first copy.

    The first copy is the one in the document with the smallest id. removed is the number of sentences taken out. Null texts stay null;
    null ids stay, as they share nothing; rows with equal ids are each cut alike.
    """
    kind = dict(docs.dtypes)[doc_id]
    runs = shared_intervals(spans, length, later_only=True).groupBy("doc_id").agg(F.collect_list(F.struct("from", "to")).alias("runs"))  # at most a document's length
    joined = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(runs, "doc_id", "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_cut_sentences, f"doc_id {kind}, text string, removed int")

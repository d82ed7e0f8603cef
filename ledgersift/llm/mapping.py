"""Mapping free-entered values to a canonical list (problem 5)."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgersift.llm import trie
from ledgersift.llm.arrow import batch, literal_rows
from ledgersift.llm.strings import abbreviates, deletions, fold, slips
from ledgersift.llm.trie import build, neighbours
from ledgersift.session import spread, written

UNMATCHED = -1
#: Numbers and fractions, two letters with a stroke between them, words, inch marks.
TOKEN = re.compile(r"\d+/\d+|(?<![^\W_])[^\W\d_]/[^\W\d_](?![^\W_])|[^\W_]+|\"")
#: Words that carry no meaning in a category or item.
FILLERS = {"and", "of", "the", "a", "und"}
#: Usual short forms of measures and goods, the table that map_items uses if it is given no other.
SHORT_FORMS = {'"': "inch", "in": "inch", "ft": "foot", "lb": "pound", "lbs": "pound", "cu": "copper", "o/n": "overnight"}
#: A word without likeness to the list is a surrounding if it stands beside the full names of that many entries.
CONTEXT_ENTRIES = 3
#: Another name of an entry is learned from that many rows, if that share of them has the entry by their description.
LEARN_ROWS, LEARN_SHARE = 5, 0.6

#: What a token may stand for, and the words of an entry, go to Python as text of these separators: there are few different ones, so each is read
#: once a task, and rows stay small.
_FIELD, _ITEM = "\x1f", "\x1e"
_KEPT = 200_000
#: Tokens that are like words of the list, up to which they are looked up in the tasks' memory; more are joined.
LOOKUP = 200_000


def _packed(*columns):
    return F.concat_ws(_ITEM, F.sort_array(F.collect_set(F.concat_ws(_FIELD, *columns))))


class _Unpacked(dict):
    """Texts of _packed with what they hold, read once."""

    def __init__(self, read) -> None:
        self.read = read

    def __missing__(self, text):
        if len(self) > _KEPT:
            self.clear()
        self[text] = found = self.read([item.split(_FIELD) for item in text.split(_ITEM)] if text else [])
        return found


# the same where there is no stroke, and where all letters are plain
_NO_STROKE, _ASCII = re.compile(r"[^\W_]+|\""), re.compile(r"[a-z0-9]+|\"")


def tokens(text: str) -> list[str]:
    text = fold(text)
    found = (TOKEN if "/" in text else _ASCII if text.isascii() else _NO_STROKE).findall(text)
    return [t for t in found if t not in FILLERS]


def _tokenise(batches):
    schema = pa.schema([("core", pa.string()), ("tokens", pa.list_(pa.string()))])
    for x in batches:
        yield batch({"core": x.column(0), "tokens": [tokens(t) for t in x.column(0).to_pylist()]}, schema)


def _shapes_of(known: set[str], words: set[str], whole: bool):
    """(core, shape) of (core, tokens); as the joins in _mapped say it."""

    def run(batches):
        schema = pa.schema([("core", pa.string()), ("shape", pa.string())])
        for x in batches:
            shapes: list[str | None] = []
            for said in x.column(1).to_pylist():
                out, i, gap = [], 0, 0
                while i < len(said):
                    t, width, token = said[i], 1, None
                    if (t not in known or len(t) < 3) and i + 1 < len(said) and said[i + 1] not in known and t + said[i + 1] in words and not any(c.isdigit() for c in t + said[i + 1]):
                        width, token = 2, t + said[i + 1]
                    elif whole or t in known:
                        token = t
                    if token is None:
                        gap += 1
                    else:
                        out += ["-"] * (gap if out else 0) + [token]
                        gap = 0
                    i += width
                shapes.append(" ".join(out) or None)
            yield batch({"core": x.column(0), "shape": shapes}, schema)

    return run


def _likenesses(words: list[str], tokens_: list[str], more: set[str]):
    """(token, word, likeness, step) of tokens and words without digits: step 0 by edits and as abbreviations; without a word that is not of `more`, step 1
    without the s of a plural, and without any such, step 2 as abbreviations with a letter too many."""
    root = build(words)
    starts: dict[str, list[str]] = {}
    for w in words:
        starts.setdefault(w[0], []).append(w)

    def look(token: str) -> dict[str, float]:
        found = {w: 1 - 0.8 * e / max(len(w), 5) for w, e in neighbours(root, token, min(2, max(1, len(token) - 2))) if e <= slips(len(w))}
        last = token[-1]
        for w in starts.get(token[0], ()):
            if last in w and abbreviates(token, w):
                found[w] = max(found.get(w, 0.0), 0.92 if w.startswith(token) else 0.85)
        return found

    for t in tokens_:
        found = look(t)
        yield from ((t, w, x, 0) for w, x in found.items())
        if len(t) < 4 or any(w not in more for w in found):
            continue
        found = {w: x for w, x in look(t[:-1]).items() if w not in more} if t[-1] == "s" else {}
        yield from ((t, w, x, 1) for w, x in found.items())
        if not found:
            slipped = {w for d in deletions(t, 1) - {t} for w in starts.get(d[0], ()) if d[-1] in w and w not in more and abbreviates(d, w)}
            yield from ((t, w, 0.75, 2) for w in slipped)


def repair(asked: DataFrame, words: DataFrame, more: DataFrame) -> DataFrame:
    """(token, word, likeness) of distinct tokens (token) and the words of a list (word), and more words, that they may stand for.

    Tokens with digits must be equal; others are joined by edit distance through tries, and as abbreviations; where no word of the list is found so, without
    the s of a plural, else as abbreviations with a slip. The words are split by hash into shards of about trie.SHARD_WORDS, the tokens into blocks of about
    trie.BLOCK_PROBES; a task holds one of each.
    """
    listed = words.select("word", F.lit(False).alias("more")).unionAll(more.select("word", F.lit(True))).groupBy("word").agg(F.min("more").alias("more"))
    plain = lambda df, c: df.where(~F.col(c).rlike(r"\d"))
    counts = {r[0]: r[1] for r in listed.select(F.lit("words").alias("k")).unionAll(asked.select(F.lit("tokens"))).groupBy("k").count().collect()}
    shards, blocks = max(1, -(-counts.get("words", 0) // trie.SHARD_WORDS)), max(1, -(-counts.get("tokens", 0) // trie.BLOCK_PROBES))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    filed = spread(plain(listed, "word").select(part("word", shards).alias("shard"), every(blocks).alias("block"), "word", "more"), "shard", "block")
    sent = spread(plain(asked, "token").select(every(shards).alias("shard"), part("token", blocks).alias("block"), "token"), "shard", "block")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("token", pa.string()), ("word", pa.string()), ("likeness", pa.float64()), ("step", pa.int32())])
        all_ = left["word"].to_pylist()
        rows = list(_likenesses(all_, right["token"].to_pylist(), {w for w, m in zip(all_, left["more"].to_pylist(), strict=True) if m})) if all_ else []
        return pa.Table.from_batches([batch(dict(zip(schema.names, zip(*rows), strict=True)) if rows else dict.fromkeys(schema.names, []), schema)])

    near = filed.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInArrow(run, "token string, word string, likeness double, step int")
    equal = asked.where(F.col("token").rlike(r"\d")).join(words, F.col("token") == F.col("word")).select("token", "word", F.lit(1.0).alias("likeness"), F.lit(0).alias("step"))
    near = near.unionAll(equal)
    if shards > 1:  # a shard may have taken a later step than another
        near = written(near.join(listed, "word"), "steps")
        first = near.where("not more").groupBy("token").agg(F.min("step").alias("first"))
        near = near.join(first, "token", "left").where("step <= coalesce(first, step)")
    return near.select("token", "word", "likeness")


def _score(cover: list, entry: list, whole: bool, least: float) -> tuple[float, float]:
    """(cosine, weight in common) of repaired tokens (weight if unmatched, {word: likeness}) with an entry's words {word: weight}."""
    found = [(len(hit), i, hit) for i, (_, near, _) in enumerate(cover) if (hit := sorted(((s, w) for w, s in near.items() if w in entry), reverse=True))]
    used: dict[str, tuple[int, float]] = {}
    # tokens that fit few words of the entry choose first; one token may hold two words written together
    for _, i, hit in sorted(found, key=lambda x: x[:2]):
        if first := next(((s, w) for s, w in hit if w not in used), None):
            used[first[1]] = i, first[0]
        if cover[i][2]:
            used.update({w: (i, s) for s, w in hit if w not in used and s == hit[0][0]})
    digits = [w for w in entry if w[0].isdigit()]
    if any(w not in used for w in digits):
        return 0.0, 0.0
    size = sum(w * w for w in entry.values())
    spots = sorted({i for i, _ in used.values()})
    best = 0.0, 0.0
    for a in range(len(spots)) if not whole else (0,):
        for b in range(len(spots) - 1, a - 1, -1) if not whole else (len(spots) - 1,):
            low, high = (0, len(cover) - 1) if whole else (spots[a], spots[b])
            inside = {w: s for w, (i, s) in used.items() if low <= i <= high}
            weight = sum(entry[w] ** 2 for w in inside)
            if math.sqrt(weight / size) < max(least, best[0]) - 1e-9:
                break
            if any(w not in inside for w in digits):
                continue
            took = {used[w][0] for w in inside}
            other = sum(cover[i][0] ** 2 for i in range(low, high + 1) if i not in took and not any(w in inside for w in cover[i][1]))
            dot = sum(s * entry[w] ** 2 for w, s in inside.items())
            best = max(best, (round(dot / math.sqrt(size * (weight + other)), 9), round(dot, 9)))
    return best


def _rank(whole: bool, least: float, rare: float, matched_only: bool = False):
    """The best entry of each text; matched_only: as if the tokens without likeness to the list were not there."""

    def run(batches):
        schema = pa.schema([("shape", pa.string()), ("entry_id", pa.int32()), ("score", pa.float64())])
        near_of = _Unpacked(lambda items: (max((float(w) for _, _, w in items), default=rare), {word: float(s) for word, s, _ in items}))
        entry_of = _Unpacked(lambda items: (int(items[0][0]), {word: float(w) for word, w in items[1:]}, sum(float(w) ** 2 for _, w in items[1:])))
        for x in batches:
            ids, scores = [], []
            for said, candidates in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True):
                cover = []
                for s in said:
                    kind, text = s[0], s[1:]
                    weight, near = near_of[text]
                    if kind == "c" or not near and matched_only:
                        continue
                    cover.append((weight, near, kind == "j"))
                best, winners = (least, 0.0), set()
                meant = set().union(*(near for _, near, _ in cover))
                for c in candidates or ():
                    entry_id, words, size = entry_of[c]
                    # no text does better than by the share of the entry it has
                    if sum(w * w for word, w in words.items() if word in meant) < best[0] * best[0] * size - 1e-6:
                        continue
                    got = _score(cover, words, whole, least)
                    if got > best:
                        best, winners = got, set()
                    if got == best:
                        winners.add(entry_id)
                ids.append(winners.pop() if len(winners) == 1 else UNMATCHED)
                scores.append(best[0])
            yield batch({"shape": x.column(0), "entry_id": ids, "score": scores}, schema)

    return run


def _mapped(cores: DataFrame, reference: DataFrame, synonyms: DataFrame | None, whole: bool, least: float, context: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(core, entry_id) of distinct texts (core) and, of whole texts, the surroundings (token), unless they are known; reference is entry_id, entry_text."""
    typed = written(cores.mapInArrow(_tokenise, "core string, tokens array<string>").withColumn("id", F.monotonically_increasing_id()), "typed")
    listed = reference.where("entry_id is not null and entry_text is not null").distinct()
    named = listed.select(F.col("entry_text").alias("core")).distinct().mapInArrow(_tokenise, "core string, tokens array<string>")
    entries = written(listed.join(named, F.col("entry_text") == F.col("core")).where("size(tokens) > 0").select("entry_id", "entry_text", "tokens"), "entries")
    n = entries.count()
    counts = entries.select("entry_id", "entry_text", F.explode(F.array_distinct("tokens")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("k"))
    weights = written(counts.select("word", F.log1p(F.lit(float(n)) / F.col("k")).alias("weight")), "weights")
    # two words of an entry may be written as one, and one as two
    at = F.explode(F.sequence(F.lit(0), F.size("tokens") - 2)).alias("i")
    two = entries.where("size(tokens) > 1").select("tokens", at).select(F.col("tokens")[F.col("i")].alias("x"), F.get("tokens", F.col("i") + 1).alias("y")).where(~F.concat("x", "y").rlike(r"\d")).distinct()
    together = two.select(F.concat("x", "y").alias("word"), "x", "y")
    asked = typed.select(F.explode("tokens").alias("token")).distinct()
    near = written(repair(asked, weights.select("word"), together.select("word")), "near")
    if synonyms is not None:
        pairs = synonyms.where("short is not null and long is not null").select(F.lower("short").alias("token"), F.lower("long").alias("word")).distinct()
        near = near.join(pairs.select("token"), "token", "left_anti").unionAll(asked.join(pairs, "token").select("token", "word", F.lit(1.0).alias("likeness")))
    single = near.join(weights, "word").select("token", "word", "likeness", "weight")
    parts = near.where("length(token) >= greatest(4, 0.35 * length(word))").join(together, "word").select("token", F.explode(F.array("x", "y")).alias("word"), "likeness")
    parts = parts.join(weights, "word").select("token", "word", "likeness", "weight").join(single, "token", "left_anti")
    bag = lambda df, joined: df.groupBy("token", "word").agg(F.max("likeness").alias("likeness"), F.max("weight").alias("weight")).groupBy("token").agg(_packed("word", "likeness", "weight").alias("found"), F.collect_set("word").alias("words")).withColumn("joined", F.lit(joined))
    found = written(bag(single, False).unionAll(bag(parts, True)), "found")
    # texts that differ in their surroundings alone have one shape: the tokens that are like words of the list, and where others stand between
    # them; a word written as two is one token, if its second half, and its first unless it is very short, are like nothing
    look = [{r[0] for r in df.limit(LOOKUP + 1).collect()} for df in (found.select("token"), weights.select("word"))]
    if max(map(len, look)) <= LOOKUP:
        shaped = typed.select("core", "tokens").mapInArrow(_shapes_of(*look, whole), "core string, shape string").where("shape is not null")
    else:
        spoken = typed.select("id", F.posexplode("tokens").alias("pos", "token"))
        meant = spoken.join(found.select("token"), "token", "left_semi").select("id", "pos", F.lit(1).alias("width"), "token")
        at = F.explode(F.sequence(F.lit(0), F.size("tokens") - 2)).alias("pos")
        halves = typed.where("size(tokens) > 1").select("id", "tokens", at).select("id", "pos", F.col("tokens")[F.col("pos")].alias("x"), F.get("tokens", F.col("pos") + 1).alias("y"))
        halves = halves.join(weights, F.concat("x", "y") == F.col("word")).where(~F.col("word").rlike(r"\d"))
        known = lambda c: found.select(F.col("token").alias(c))
        halves = halves.join(known("y"), "y", "left_anti").select("id", "pos", "x", "word")
        halves = halves.join(known("x").where("length(x) > 2"), "x", "left_anti").select("id", "pos", F.lit(2).alias("width"), F.col("word").alias("token"))
        halves = halves.dropDuplicates(["id", "pos"])
        if whole:  # every token counts, wherever it stands
            meant = spoken.select("id", "pos", F.lit(1).alias("width"), "token")
            meant = meant.join(halves.select("id", (F.col("pos") + 1).alias("pos")), ["id", "pos"], "left_anti")
        meant = meant.join(halves, ["id", "pos"], "left_anti").select("id", "pos", "width", "token").unionAll(halves)
        # a dash for each token between them that is like nothing
        shape = F.expr("array_join(transform(spots, (s, i) -> concat(if(i > 0, repeat('- ', s.pos - spots[i - 1].pos - spots[i - 1].width), ''), s.token)), ' ')")
        shaped = meant.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "width", "token"))).alias("spots")).select("id", shape.alias("shape"))
        shaped = typed.select("id", "core").join(shaped, "id").select("core", "shape")
    shaped = written(shaped, "shapes")
    said = shaped.select("shape").distinct().select("shape", F.posexplode(F.split("shape", " ")).alias("pos", "token"))
    itself = weights.select(F.col("word").alias("token"), F.concat_ws(_FIELD, "word", F.lit("1.0"), "weight").alias("itself"), F.array("word").alias("itself_words"))
    said = said.join(found, "token", "left").join(itself, "token", "left")
    said = said.select("shape", "pos", "token", F.coalesce("found", "itself", F.lit("")).alias("found"), F.coalesce("words", "itself_words").alias("words"), F.coalesce("joined", F.lit(False)).alias("joined"))
    cover = said.groupBy("shape").agg(F.sort_array(F.collect_list(F.struct("pos", "token", "found", "joined"))).alias("said"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))

    # an entry needs that share of its squared weight in common: it is filed under its rarest words, until less is left
    full = entries.select("entry_id", "entry_text", F.explode(F.array_distinct("tokens")).alias("word")).join(weights, "word")
    entry = full.groupBy("entry_id", "entry_text").agg(F.concat_ws(_ITEM, F.col("entry_id"), _packed("word", "weight")).alias("words"))
    by_entry = Window.partitionBy("entry_id", "entry_text")
    square = F.col("weight") * F.col("weight")
    before = F.sum(square).over(by_entry.orderBy(F.col("weight").desc(), "word").rowsBetween(Window.unboundedPreceding, -1))
    filed = full.withColumns({"left": F.sum(square).over(by_entry) - F.coalesce(before, F.lit(0.0)), "all": F.sum(square).over(by_entry)})
    filed = filed.where(F.col("left") >= F.col("all") * (least * least - 1e-6)).select("word", "entry_id", "entry_text").join(entry, ["entry_id", "entry_text"]).select("word", "entry_id", "words")
    candidates = cover.select("shape", F.explode("words").alias("word")).join(filed, "word").groupBy("shape").agg(F.collect_set("words").alias("candidates"))
    full_cover = cover.select("shape", "said").join(candidates, "shape")

    rare = math.log(1 + n) if n else 1.0
    coded = lambda context: F.transform("said", lambda s: F.concat(F.when(context(s), "c").when(s["joined"], "j").otherwise("-"), s["found"]))
    rank = lambda df, context, *how: spread(df.select("shape", coded(context).alias("said"), "candidates"), "shape").mapInArrow(_rank(*how), "shape string, entry_id int, score double")
    none = lambda s: F.lit(False)
    of_core = lambda ranked: shaped.join(ranked, "shape", "left").select("core", F.coalesce("entry_id", F.lit(UNMATCHED)).alias("entry_id"))
    if not whole:
        return of_core(rank(full_cover, none, False, least, rare)), None
    if context is None:
        full_cover = written(full_cover, "covers")
        sure = rank(full_cover, none, True, 0.9, rare, True).where(F.col("entry_id") != UNMATCHED)
        beside = full_cover.select("shape", F.explode("said").alias("s")).where("s.found = ''").select("shape", "s.token").join(sure, "shape")
        context = written(beside.select("token", "entry_id").distinct().groupBy("token").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= CONTEXT_ENTRIES).select("token"), "context")
    marked = full_cover.select("shape", F.explode("said").alias("s")).select("shape", "s.token").join(context, "token").groupBy("shape").agg(F.collect_set("token").alias("around"))
    full_cover = full_cover.join(marked, "shape", "left").withColumn("around", F.coalesce("around", F.array().cast("array<string>")))
    return of_core(rank(full_cover, lambda s: F.array_contains(F.col("around"), s["token"]), True, least, rare)), context


def _lines(values: DataFrame) -> DataFrame:
    """(record_source, record_key, core) of values that are not blank."""
    return values.where(F.col("record_key").isNotNull() & F.col("value").rlike(r"(?U)\S")).select("record_source", "record_key", F.col("value").alias("core"))


def map_values(values: DataFrame, reference: DataFrame, synonyms: DataFrame | None = None, whole: bool = False, least: float = 0.72) -> DataFrame:
    """(record_source, record_key, entry_id) for values (record_source, record_key, value) and a list (entry_id, entry_text); entry_id is -1 without an entry.

    Every distinct text is reduced to its shape, the tokens, without case, that are like words of the list and where others stand between them; each distinct shape is mapped once and joined back. The distinct tokens are
    joined to the words of the list by edit distance, through tries, and as abbreviations; tokens with digits must be equal; synonyms (short, long) are
    words that stand for another. The repaired tokens are combined by soft TF-IDF cosine. Entries are looked up by their rarest words only, as many as are needed
    for any text that reaches `least`. The best entry wins if it reaches `least` and all its tokens with digits are present; of equal cosines that with the
    larger weight in common; equals among those leave the text unmatched.

    Unless `whole`, what stands before the first and after the last word of the entry is taken as surroundings and does not count, while words between them
    that the entry does not have count against it. With `whole` every word counts, but for words that are like nothing in the list and stand beside the names of
    CONTEXT_ENTRIES entries or more.

    Null values, blank ones and null keys have no row; equal rows give one row; other columns are ignored. An empty reference leaves
    everything unmatched. The list may have any length: of more than LOOKUP words or tokens like them nothing is sent to the tasks.
    """
    lines = _lines(values)
    mapped, _ = _mapped(lines.select("core").distinct(), reference.select("entry_id", "entry_text"), synonyms, whole, least)
    return lines.join(mapped, "core", "left").select("record_source", "record_key", F.coalesce("entry_id", F.lit(UNMATCHED)).alias("entry_id")).distinct()


def short_forms(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, list(SHORT_FORMS.items()), "short", "long")


def map_items(lines: DataFrame, items: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Typed item texts (record_source, record_key, value) to item_list (item_id, item_name)."""
    listed = items.select(F.col("item_id").cast("int").alias("entry_id"), F.col("item_name").alias("entry_text"))
    return map_values(lines, listed, short_forms(lines.sparkSession) if synonyms is None else synonyms)


def map_categories(rows: DataFrame, categories: DataFrame, hints: DataFrame | None = None, least: float = 0.6) -> DataFrame:
    """Typed categories (record_source, record_key, value) to category_list (category_id, category).

    hints (record_key, entry_id): the entry that a row has by what it describes, which may be wrong for some. Other names are learned from them: a text without an
    entry that has at least LEARN_ROWS rows, of which LEARN_SHARE or more have one entry by their hints, is another name of that entry; texts without an
    entry are then mapped again, to the list and the learned names. The entry of a text depends on the text alone.
    """
    lines = _lines(rows)
    listed = categories.select(F.col("category_id").cast("int").alias("entry_id"), F.col("category").alias("entry_text"))
    mapped, context = _mapped(lines.select("core").distinct(), listed, None, True, least)
    first = written(lines.join(mapped, "core", "left").select("record_source", "record_key", "core", F.coalesce("entry_id", F.lit(UNMATCHED)).alias("entry_id")), "first")
    if hints is None:
        return first.select("record_source", "record_key", "entry_id").distinct()
    open_ = first.where(F.col("entry_id") == UNMATCHED)
    cores = open_.select("core").distinct()
    words = cores.mapInArrow(_tokenise, "core string, tokens array<string>").select("core", F.posexplode("tokens").alias("pos", "token")).join(context, "token", "left_anti")
    names = words.groupBy("core").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"])).alias("name"))
    known = hints.where("record_key is not null").join(listed.where("entry_text is not null").select("entry_id").distinct(), "entry_id", "left_semi").groupBy("record_key").agg(F.max("entry_id").alias("hint"))
    votes = open_.join(names, "core").join(known, "record_key", "left").groupBy("name", F.coalesce("hint", F.lit(UNMATCHED)).alias("hint")).agg(F.count(F.lit(1)).alias("k"))
    top = votes.groupBy("name").agg(F.sum("k").alias("n"), F.max(F.struct("k", "hint")).alias("top"))
    learned = top.where((F.col("top.hint") != UNMATCHED) & (F.col("n") >= LEARN_ROWS) & (F.col("top.k") >= F.col("n") * LEARN_SHARE)).select(F.col("top.hint").cast("int").alias("entry_id"), F.col("name").alias("entry_text"))
    again, _ = _mapped(cores, listed.unionAll(written(learned, "learned")), None, True, least, context)
    second = open_.join(again, "core", "left").select("record_source", "record_key", again["entry_id"])
    both = first.where(F.col("entry_id") != UNMATCHED).select("record_source", "record_key", "entry_id").unionAll(second.select("record_source", "record_key", F.coalesce("entry_id", F.lit(UNMATCHED))))
    return both.distinct()

"""Variant spellings of names (problem 2)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgersift.llm.arrow import batch, literal_rows
from ledgersift.llm.strings import abbreviates, deletions, fold, osa, slips
from ledgersift.llm.trie import trie_join
from ledgersift.session import written

#: Legal forms and other words that name nobody.
NOISE = set("llc lp inc co corp ltd limited company corporation incorporated pllc plc gmbh the and und y et dba of new remit".split())
#: What is written after a name.
TAILS = re.compile(r"\s*(?:[-/]\s*main acct|[-/]\s*remit|\(ap\)|\*new\*|#\s*\d+)\s*$")
# Given names and their short forms, the table that is used where resolve_names is given no other.
NICKNAMES = {
    "Abigail": "abby gail", "Albert": "al bert", "Alexander": "sandy alex alec xander", "Andrew": "andy drew", "Anthony": "tony", "Barbara": "barb babs", "Benjamin": "ben benny", "Catherine": "cathy kate cat",
    "Charles": "charlie chuck", "Christine": "chris tina chrissy", "Christopher": "chris kit", "Daniel": "dan danny", "David": "dave", "Deborah": "deb debbie debra", "Dorothy": "dot dottie", "Edward": "ed ned ted eddie",
    "Eleanor": "nell ellie nora", "Elizabeth": "beth betty liz lizzie eliza", "Frances": "fran fanny", "Francisco": "frank paco pancho", "Frederick": "fred freddie", "George": "georgie", "Gregory": "greg", "Harold": "harry hal",
    "Henry": "hank harry", "Isabella": "bella izzy", "Jacob": "jake", "James": "jim jimmy jamie", "Jennifer": "jen jenny", "Jessica": "jess jessie", "John": "jack johnny", "Jonathan": "jon", "Joseph": "joe joey",
    "Josephine": "jo josie", "Katherine": "kate katie kathy kay", "Kenneth": "ken kenny", "Lawrence": "laurie larry", "Leonard": "leo lenny", "Margaret": "peggy meg maggie marge", "Matthew": "matt", "Michael": "mike mick",
    "Nathaniel": "nat nate", "Nicholas": "nick", "Pamela": "pam", "Patricia": "trish pat patty", "Peter": "pete", "Philip": "phil", "Raymond": "ray", "Rebecca": "becky", "Richard": "rich rick dick", "Robert": "bobby rob bob",
    "Ronald": "ron", "Samuel": "sam", "Stephen": "steve", "Susannah": "sue susie susan", "Theodore": "ted theo teddy", "Thomas": "tom", "Timothy": "tim", "Victoria": "vicky", "Vincent": "vince", "William": "bill billy will",
}
SHORT: dict[str, list[str]] = {}
for _long, _short in NICKNAMES.items():
    for _s in _short.split():
        SHORT.setdefault(_s, []).append(_long.lower())

_CAMEL = re.compile(r"(?<=[a-zà-öø-ÿćčšž])(?=[A-ZÀ-ÖØ-Þ])")
_INITIALS = re.compile(r"\b([a-z])\.\s?([a-z])\.(?:\s?([a-z])\b\.?)?")
_TOKEN = re.compile(r"[^\W_]+")


def name_tokens(text: str) -> list[str]:
    """The words of a typed name that can name somebody, in order: folded, without legal forms, initials and repeats."""
    text = fold(_CAMEL.sub(" ", text))
    text = TAILS.sub("", _INITIALS.sub(lambda m: "".join(x for x in m.groups() if x) + " ", text).strip())
    out = []
    for t in _TOKEN.findall(text):
        if not t.isdigit():
            t = t.replace("0", "o").replace("1", "l")
        if (len(t) > 1 or t.isdigit()) and t not in NOISE and t not in out:
            out.append(t)
    return out


def read_again(token: str) -> str:
    """The word as it may have stood on paper before a scanner took m for rn."""
    return token.replace("rn", "m")


def _edits(typed: str, owner: str, most: int, short: dict[str, set[str]]) -> int:
    if typed == owner or owner in short.get(typed, ()):
        return 0
    n = osa(typed, owner, most)
    if n and "rn" in typed and "rn" not in owner:
        n = min(n, osa(read_again(typed), owner, most))
    return n


def _fits(typed: str, word: str) -> bool:
    """Whether a typed word can be a word of the line of business."""
    if typed == word or osa(typed, word, slips(len(word))) <= slips(len(word)) or abbreviates(typed, word):
        return True
    if len(typed) > 3 and typed.endswith("s") and abbreviates(typed[:-1], word):
        return True
    return len(typed) > 3 and any(len(d) > 2 and abbreviates(d, word) for d in deletions(typed, 1))


FULL, PART, LEFT_OUT, OTHER = 0, 1, 2, 9


def compare(typed: list[str], owner: list[str], business: list[str], trade: bool, short: dict[str, set[str]]) -> tuple[int, int]:
    """(edits in the owner words, how the line of business fits): the typed words are taken in any order.

    short: the long forms that a typed word may be short for.
    """
    far = 9
    best, rest = far, typed
    spots = []
    for o in owner:
        most = slips(len(o))
        spots.append([(n, i) for i, t in enumerate(typed) if (n := _edits(t, o, most, short)) <= most])
    if len(owner) == 1:
        for n, i in spots[0]:
            if n < best:
                best, rest = n, typed[:i] + typed[i + 1 :]
    else:
        for n, i in spots[0]:
            for m, j in spots[1]:
                if i != j and n + m < best:
                    best, rest = n + m, [t for k, t in enumerate(typed) if k not in (i, j)]
        whole = owner[0] + owner[1], owner[1] + owner[0]
        most = slips(len(whole[0]))
        for i, t in enumerate(typed):  # both owner words written together
            n = min(_edits(t, w, most, short) for w in whole)
            if n <= most and n < best:
                best, rest = n, typed[:i] + typed[i + 1 :]
    for i in range(len(typed) - 1):  # a blank inside an owner word
        t = typed[i] + typed[i + 1]
        for o, x in zip(owner, owner[::-1], strict=True):
            if t == o and len(owner) == 1 and best:
                best, rest = 0, typed[:i] + typed[i + 2 :]
            elif t == o:
                for k, y in enumerate(typed):
                    if k not in (i, i + 1) and (n := _edits(y, x, slips(len(x)), short)) <= slips(len(x)) and n < best:
                        best, rest = n, [z for j, z in enumerate(typed) if j not in (i, i + 1, k)]
    if best == far:
        return far, OTHER
    rest = [t for t in rest if not any(osa(t, o, 2) <= 2 for o in owner if len(o) > 6) and not any(o in short.get(t, ()) for o in owner)]
    if not trade:
        rest = [t for t in rest if not t.isdigit()]
    covered, i = set(), 0
    while i < len(rest):
        hit = [k for k, b in enumerate(business) if _fits(rest[i], b)]
        if not hit:
            pair = [k for k in range(len(business) - 1) if osa(rest[i], business[k] + business[k + 1], 2) <= 2]
            if pair:
                covered |= {pair[0], pair[0] + 1}
            elif i + 1 < len(rest) and (hit := [k for k, b in enumerate(business) if osa(rest[i] + rest[i + 1], b, 1) <= 1]):
                covered.add(hit[0])
                i += 1
            elif not (trade and rest[i].startswith("co") and len(rest[i]) < 6):
                return best, OTHER
        else:
            covered.add(next((k for k in hit if k not in covered), hit[0]))
        i += 1
    if not rest:
        return best, LEFT_OUT if any(len(b) > 2 for b in business) else FULL
    return best, FULL if all(k in covered or trade and len(b) < 3 for k, b in enumerate(business)) else PART


def _tokenise(batches):
    """(name, tokens, probes, joined): the words of names, the words to look up, and neighbours written as one word."""
    schema = pa.schema([("name", pa.string()), ("tokens", pa.list_(pa.string())), ("probes", pa.list_(pa.string())), ("joined", pa.list_(pa.string()))])
    for x in batches:
        names = x.column(0).to_pylist()
        tokens = [name_tokens(n) for n in names]
        probes = [sorted({*ts, *map(read_again, ts)}) for ts in tokens]
        joined = [sorted({a + b for a, b in zip(ts, ts[1:])}) for ts in tokens]
        yield batch({"name": names, "tokens": tokens, "probes": probes, "joined": joined}, schema)


def _forms(short) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for s in short or ():
        out.setdefault(s["short"], set()).add(s["long"])
    return out


def _references(batches):
    """(vendor_id, owner, business, trade) of reference names (vendor_id, name, canonical, short).

    The owner is the first two words, or the only one.
    """
    schema = pa.schema([("vendor_id", pa.string()), ("owner", pa.list_(pa.string())), ("business", pa.list_(pa.string())), ("trade", pa.bool_())])
    for x in batches:
        rows = []
        for vendor, name, canonical, short in zip(*(c.to_pylist() for c in x.columns), strict=True):
            if not (ts := name_tokens(name)):
                continue
            if canonical is not None:  # an alias adds something only if it is another name altogether
                own = name_tokens(canonical)
                if own and (compare(ts, own[:2], own[2:], False, _forms(short))[0] < 9 or any(_fits(t, b) for t in ts for b in own[2:])):
                    continue
            rows.append((vendor, ts[:2], ts[2:], canonical is not None))
        if rows:
            yield batch(dict(zip(schema.names, zip(*rows), strict=True)), schema)


def _verify(batches):
    schema = pa.schema([("name", pa.string()), ("vendor_id", pa.string()), ("edits", pa.int32()), ("fit", pa.int32())])
    for x in batches:
        rows = []
        for name, tokens, short, vendor, owner, business, trade in zip(*(c.to_pylist() for c in x.columns), strict=True):
            edits, fit = compare(tokens, owner, business, trade, _forms(short))
            # more words than a name of one word has are no line of business of it
            if edits < 9 and not (len(owner) == 1 and fit == OTHER):
                rows.append((name, vendor, edits, OTHER if trade and fit != FULL else fit))
        if rows:
            yield batch(dict(zip(schema.names, zip(*rows), strict=True)), schema)


def short_forms(spark: SparkSession) -> DataFrame:
    """(short, long): the built-in table of given names."""
    return literal_rows(spark, [(s, x) for s, longs in SHORT.items() for x in longs], "short", "long")


def resolve_names(names: DataFrame, vendors: DataFrame, aliases: DataFrame, short: DataFrame | None = None) -> DataFrame:
    """(name, vendor_id): which vendor each typed name (name) means, of vendors (vendor_id, vendor_name) and aliases
    (alias_text, canonical_vendor_id, canonical_name); short (short, long) are words that stand for others, by default given names.

    The first two words of a reference name are its owner, the rest its line of business; a name of one word is an owner alone.
    The words of typed names are joined to the owner words, and to both owner words written as one, by a trie join within bounded edits.
    Each reference is looked up by the rarer of its owner words and kept if the name has the other one too. The words are then
    compared in any order: given names also by their short forms, the line of business by edits and abbreviations. Of the vendors with
    the fewest edits in the owner the one whose line of business fits best is meant; a name that leaves it out, or fits several
    equally, means one only if there is no other. An alias that is another name altogether must fit whole. A typed word that is an
    owner word itself is not read as a misspelling of another one.

    Null and blank names and names of nobody in vendors have no row; aliases of ids that are not in vendors mean nobody;
    repeated rows count once; other columns are ignored; empty tables give an empty result.
    """
    known = vendors.where("vendor_id is not null and vendor_name is not null").select("vendor_id", "vendor_name").distinct()
    live = known.select("vendor_id").distinct()
    texts = aliases.where("alias_text is not null").select(F.col("canonical_vendor_id").alias("vendor_id"), F.col("alias_text").alias("name"), F.coalesce("canonical_name", F.lit("")).alias("canonical")).distinct()
    official = aliases.where("canonical_name is not null").select(F.col("canonical_vendor_id").alias("vendor_id"), F.col("canonical_name").alias("name"), F.lit(None).cast("string").alias("canonical"))
    named = known.select("vendor_id", F.col("vendor_name").alias("name"), F.lit(None).cast("string").alias("canonical")).unionAll(official).unionAll(texts).join(live, "vendor_id", "left_semi").distinct()
    forms = (short_forms(names.sparkSession) if short is None else short).where("short is not null and long is not null").select(F.lower("short").alias("short"), F.lower("long").alias("long")).distinct()
    pieces = lambda df: df.mapInArrow(_tokenise, "name string, tokens array<string>, probes array<string>, joined array<string>")
    said_short = lambda df: df.select("name", F.explode("tokens").alias("short")).join(forms, "short").groupBy("name").agg(F.collect_set(F.struct("short", "long")).alias("short"))

    typed = pieces(names.select("name").where("trim(name) <> ''").distinct())
    typed = written(typed, "names")
    typed = written(typed.join(said_short(typed), "name", "left"), "names")
    aliased = written(pieces(named.where("canonical is not null").select("name").distinct()).select("name", "tokens"), "aliases")
    named = named.join(said_short(aliased), "name", "left").select("vendor_id", "name", "canonical", "short")
    refs = written(named.mapInArrow(_references, "vendor_id string, owner array<string>, business array<string>, trade boolean").distinct(), "references")

    # what a typed word may mean: an owner word, or both owner words of a reference written together
    words = refs.select(F.explode("owner").alias("owner_word"))
    counts = written(words.groupBy("owner_word").agg(F.count(F.lit(1)).alias("times")), "owner-words")
    two = refs.where("size(owner) = 2").select(F.col("owner")[0].alias("x"), F.col("owner")[1].alias("y")).distinct()
    together = two.select(F.concat("x", "y").alias("word"), "x", "y").unionAll(two.select(F.concat("y", "x"), "x", "y"))
    meant = counts.select(F.col("owner_word").alias("word"), "owner_word").unionAll(together.select("word", F.explode(F.array("x", "y")).alias("owner_word"))).distinct()
    meant = written(meant, "meant")
    tokens = typed.select("name", F.explode("probes").alias("token")).distinct()
    # a typed word that is an owner word itself stands for that word, not for a misspelling of its neighbour: two owner words of
    # different references side by side are mostly somebody else's name
    unknown = tokens.join(counts, F.col("token") == F.col("owner_word"), "left_anti").select("token").where("not token rlike '^[0-9]+$'").distinct()
    near = trie_join(unknown, meant.select("word")).select("token", "word")
    exact = typed.select("name", F.explode(F.concat("probes", "joined", F.coalesce(F.transform("short", lambda s: s["long"]), F.array().cast("array<string>")))).alias("word"))
    hits = tokens.join(near, "token").select("name", "word").unionAll(exact).join(meant, "word").select("name", "owner_word").distinct()
    hits = hits.groupBy("name").agg(F.collect_set("owner_word").alias("hits"))

    # a reference is filed under the rarer of its owner words
    x, y = (counts.select(F.col("owner_word").alias(f"w{i}"), F.col("times").alias(f"t{i}")) for i in "xy")
    filed = refs.withColumns({"wx": F.col("owner")[0], "wy": F.get("owner", F.lit(1))}).join(x, "wx").join(y, "wy", "left")
    first = F.col("ty").isNull() | (F.struct("tx", "wx") <= F.struct("ty", "wy"))
    filed = filed.select(F.when(first, F.col("wx")).otherwise(F.col("wy")).alias("key"), F.when(first, F.col("wy")).otherwise(F.col("wx")).alias("other"), "vendor_id", "owner", "business", "trade")
    looked = typed.select("name", "tokens", "short").join(hits, "name").select("name", "tokens", "short", "hits", F.explode("hits").alias("key"))
    both = looked.join(filed, "key").where(F.col("other").isNull() | F.array_contains("hits", F.col("other")))
    found = both.select("name", "tokens", "short", "vendor_id", "owner", "business", "trade").mapInArrow(_verify, "name string, vendor_id string, edits int, fit int")
    by_vendor = found.groupBy("name", "vendor_id").agg(F.min(F.struct("edits", "fit")).alias("rank"))
    best = by_vendor.withColumn("best", F.min("rank").over(Window.partitionBy("name"))).where("rank = best and rank.fit < 9")
    return best.groupBy("name").agg(F.min("vendor_id").alias("vendor_id"), F.count(F.lit(1)).alias("n")).where("n = 1").select("name", "vendor_id")

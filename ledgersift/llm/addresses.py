"""The same postal address written differently (problem 1)."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersift.llm.arrow import batch
from ledgersift.llm.strings import deletions, fold, osa
from ledgersift.session import spread, written

# Types of streets and their short forms.
STREET_TYPES = {
    "street": "st str", "avenue": "ave av", "boulevard": "blvd boul", "drive": "dr drv", "road": "rd", "lane": "ln", "court": "ct crt", "place": "pl plc",
    "square": "sq sqr", "terrace": "ter terr", "parkway": "pkwy pky", "highway": "hwy hiway", "plaza": "plz", "circle": "cir", "trail": "trl", "way": "wy",
}
DIRECTIONS = {"north": "n no", "south": "s so", "east": "e", "west": "w"}
UNITS = {"unit": "unt u", "suite": "ste", "floor": "flr fl", "building": "bldg bld", "apartment": "apt", "room": "rm"}
STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware", "dc": "district of columbia",
    "fl": "florida", "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana",
    "me": "maine", "md": "maryland", "ma": "massachusetts", "mi": "michigan", "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska",
    "nv": "nevada", "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma",
    "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont",
    "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming",
}


def _forms(table: dict[str, str]) -> dict[str, str]:
    return {f: full for full, short in table.items() for f in [full, *short.split()]}


_TYPE, _DIRECTION, _UNIT = _forms(STREET_TYPES), _forms(DIRECTIONS), _forms(UNITS)
_STATE = {name: code for code, name in STATES.items()}
_LONG_STATE = {name.replace(" ", ""): code for code, name in STATES.items()}

_LEAD = re.compile(r"^\s*(?:attn\b[^|]*\||c/o\b[^|]*\||remit\s+to\s*:?|usa\b\s*-?)\s*")
_CUT = re.compile(r"[\n\r;,|]+|\s/\s|\s/|/\s")
_BOX = re.compile(r"(?:\bpost\s*office\s*|\bp\s*\.?\s*o\s*\.?\s*)?\bb(?:ox|x)\b\.?\s*(?:no\.?\s*|#\s*)?(\d+)|\bp\.?o\.?b\.?\s*(\d+)|\bp\s*\.?\s*o\s*\.?\s*box\s*(\d+)")
_UNIT_AT = re.compile(r"(?:(?<![a-z0-9])(" + "|".join(sorted(_UNIT, key=len, reverse=True)) + r")\b\.?\s*#?\s*|#\s*)(\d{1,4}[a-z]?|[a-z])(?![a-z0-9])")
_ZIP4 = re.compile(r"\b(\d{5})-\d{4}\b")
_PART = re.compile(r"\||\d+[a-z]?\b|[a-z]+")


class Place(NamedTuple):
    """An address in parts; a part that is not given is empty. street_city holds both where they cannot be told apart."""

    house: str
    box: str
    direction: str
    street: str
    kind: str
    unit: str
    city: str
    state: str
    zip: str
    street_city: str


def _by_deletion(names) -> dict[str, list[str]]:
    index: dict[str, list[str]] = {}
    for n in names:
        for d in deletions(n, 1):
            index.setdefault(d, []).append(n)
    return index


_STATE_SLIPS = _by_deletion(n for n in _LONG_STATE if len(n) > 5)
_TYPE_SLIPS = _by_deletion(n for n in STREET_TYPES if len(n) > 3)


def _misspelt(word: str, index: dict[str, list[str]]) -> str:
    """The name of the index within one edit of word, or an empty string."""
    for d in deletions(word, 1):
        for n in index.get(d, ()):
            if osa(word, n, 1) <= 1:
                return n
    return ""


def _state_at(words: list[str], end: int) -> tuple[str, int]:
    """(code, first word) of a state whose last word is words[end - 1]; code is empty if there is none."""
    for n in (3, 2, 1):
        if end >= n:
            name = " ".join(words[end - n : end])
            if name in _STATE:
                return _STATE[name], end - n
    if words[end - 1] in STATES:
        return words[end - 1], end - 1
    if len(words[end - 1]) > 6 and (code := _misspelt(words[end - 1], _STATE_SLIPS)):
        return _LONG_STATE[code], end - 1
    return "", end


def parse(text: str | None) -> Place | None:
    """The parts of an address, or None if there is neither a house number with a street nor a post office box."""
    if not text:
        return None
    t = _CUT.sub(" | ", fold(text))
    for _ in range(2):
        t = _LEAD.sub("", t)
    box = ""
    if m := _BOX.search(t):
        box = next(g for g in m.groups() if g).lstrip("0") or "0"
        t = t[: m.start()] + " | " + t[m.end() :]
    unit = ""
    if not box and (m := _UNIT_AT.search(t)):
        unit = m.group(2).lstrip("0") or "0"
        t = t[: m.start()] + " | " + t[m.end() :]
    zip_ = ""
    if m := _ZIP4.search(t):
        zip_ = m.group(1)
        t = t[: m.start()] + " | " + t[m.end() :]
    parts = _PART.findall(t)
    house_at = -1
    for i, p in enumerate(parts):
        if not p[0].isdigit():
            continue
        after = parts[i + 1] if i + 1 < len(parts) else "|"
        if after[0].isalpha() and not box:
            if house_at < 0 or len(p) < 5:
                house_at = i
        elif len(p) == 5 and p.isdigit() and not zip_:
            zip_ = p
            parts[i] = "|"
    if house_at < 0 and not box:
        return None
    house = "" if box else parts[house_at].lstrip("0")
    # words after the house number up to a break are the street; the others are the city and the state
    street_words: list[str] = []
    other: list[list[str]] = [[]]
    where = other[-1]
    for i, p in enumerate(parts):
        if i == house_at:
            where = street_words
        elif p == "|":
            other.append([])
            where = other[-1]
        elif p[0].isalpha():
            where.append(p)
    direction = kind = street = city = state = street_city = ""
    given = [w for w in other if w]
    if street_words:
        if len(street_words) > 1 and street_words[0] in _DIRECTION:
            direction, street_words = _DIRECTION[street_words[0]], street_words[1:]
        at = next((i for i, w in enumerate(street_words) if i and w in _TYPE), 0)
        if not at:
            at = next((i for i, w in enumerate(street_words) if i and len(w) > 4 and _misspelt(w, _TYPE_SLIPS)), 0)
            if at:
                street_words[at] = _misspelt(street_words[at], _TYPE_SLIPS)
        if at:
            kind, street, rest = _TYPE[street_words[at]], "".join(street_words[:at]), street_words[at + 1 :]
            if rest and rest[0] in _DIRECTION and not direction and not (len(rest) > 1 and _state_at(rest, 2)[0] and _state_at(rest, 2)[1] == 0):
                direction, rest = _DIRECTION[rest[0]], rest[1:]
            if rest:
                given.append(rest)
        else:
            rest = street_words
            found, first = _state_at(rest, len(rest)) if len(rest) > 1 else ("", len(rest))
            if found:
                state, rest = found, rest[:first]
            if len(rest) > 1 and rest[-1] in _DIRECTION and not direction:
                direction, rest = _DIRECTION[rest[-1]], rest[:-1]
            if len(rest) > 1 and not any(len(w) > 2 or len(w) == 2 and w not in STATES for ws in given for w in ws):
                street_city = "".join(rest)
            else:
                street = "".join(rest)
    for words in given:
        while words and words[-1] in ("usa", "us"):
            words = words[:-1]
        if not words:
            continue
        found, first = _state_at(words, len(words))
        if found and not state:
            state, words = found, words[:first]
        city += "".join(words)
    return Place(house, box, direction, street, kind, unit, city, state, zip_, street_city)


def _near(a: str, b: str) -> bool:
    n = min(len(a), len(b))
    return a == b or osa(a, b, 2) <= (2 if n > 7 else 1 if n > 3 else 0)


def _near_city(a: str, b: str) -> bool:
    """Cities differ from each other in few letters, and mostly in their first ones, so less is forgiven there."""
    if a == b:
        return True
    n = osa(a, b, 2)
    return n <= 1 if min(len(a), len(b)) < 9 else n <= 1 or n == 2 and a[:3] == b[:3]


def same_place(a: Place, b: Place) -> bool:
    """Whether two addresses can be one place: no part contradicts the other's, parts left out contradict nothing."""
    if a.house != b.house or a.box != b.box:
        return False
    for x, y in ((a.direction, b.direction), (a.kind, b.kind), (a.unit, b.unit), (a.state, b.state)):
        if x and y and x != y:
            return False
    city_known = bool(a.city and b.city)
    if not a.box:
        if a.street and b.street:
            if not _near(a.street, b.street):
                return False
        elif a.street_city and b.street_city:
            x, y = sorted((a.street_city, b.street_city), key=len)
            if not _near(x, y) and not _near(x, y[: len(x)]):
                return False
            city_known = _near(x, y)
        else:
            whole, parts = (a, b) if a.street_city else (b, a)
            if parts.city and _near(whole.street_city, parts.street + parts.city):
                city_known = True
            elif not parts.city and _near(whole.street_city[: len(parts.street)], parts.street):
                pass
            elif not _near(whole.street_city, parts.street):
                return False
    if a.city and b.city and not _near_city(a.city, b.city):
        return False
    if not city_known:
        if a.zip and b.zip and a.zip != b.zip:
            return False
        if not (a.zip or a.city or a.street_city or a.state) or not (b.zip or b.city or b.street_city or b.state):
            return not a.box
        if a.box and not (a.zip and b.zip):
            return bool(a.state and b.state)
    return True


def _text(p: Place) -> str:
    """What is compared by its n-grams: the street, with the city where they cannot be told apart. Cities are compared as parts: their n-grams would
    bring together all of a large city."""
    return "box" if p.box else p.street_city or p.street


def grams(p: Place, n: int = 3) -> dict[str, int]:
    """Character n-grams of the street, counted."""
    t = f"^{_text(p)}$"
    out: dict[str, int] = {}
    for i in range(max(1, len(t) - n + 1)):
        g = t[i : i + n]
        out[g] = out.get(g, 0) + 1
    return out


_FORM = "form string, " + ", ".join(f"{f} string" for f in Place._fields)


def _parse_batches(batches):
    schema = pa.schema([("address", pa.string()), ("form", pa.string()), *[(f, pa.string()) for f in Place._fields]])
    for x in batches:
        rows = []
        for text in x.column(0).to_pylist():
            if (p := parse(text)) and _text(p):
                rows.append((text, "|".join(p), *p))
        if rows:
            yield batch(dict(zip(schema.names, zip(*rows), strict=True)), schema)


def _count_grams(batches):
    schema = pa.schema([("gram", pa.string()), ("n", pa.int64())])
    counts: dict[str, int] = {}
    for x in batches:
        for row in zip(*(c.to_pylist() for c in x.columns), strict=True):
            for g in grams(Place(*row[1:])):
                counts[g] = counts.get(g, 0) + 1
    yield batch({"gram": list(counts), "n": list(counts.values())}, schema)


def weigh(p: Place, idf: dict[str, float], rare: float) -> list[tuple[float, str]]:
    """(weight, gram) as a vector of length one, the rarest gram of all forms first: one order for all vectors, whatever their own weights."""
    counted = grams(p)
    norm = math.sqrt(sum((n * idf.get(g, rare)) ** 2 for g, n in counted.items())) or 1.0
    return [(counted[g] * idf.get(g, rare) / norm, g) for g in sorted(counted, key=lambda g: (-idf.get(g, rare), g))]


def prefix(vector: list[tuple[float, str]], least: float) -> list[str]:
    """The grams of a vector up to where the rest of it is shorter than `least`.

    Two vectors whose prefixes have no gram in common have a cosine below `least`: their first common gram in the order of all is behind the prefix of one of
    them, so all common grams are, and their product is at most the length of that one's rest.
    """
    out, left = [], 1.0
    for w, g in vector:
        if left < least * least - 1e-9:
            break
        out.append(g)
        left -= w * w
    return out


def _prefixes(idf: dict[str, float], rare: float, least: float):
    def run(batches):
        schema = pa.schema([("key", pa.string()), ("form", pa.string())])
        for x in batches:
            keys, forms = [], []
            for row in zip(*(c.to_pylist() for c in x.columns), strict=True):
                p = Place(*row[1:])
                found = prefix(weigh(p, idf, rare), least)
                keys += [f"{p.house}/{p.box}/{g}" for g in found]
                forms += [row[0]] * len(found)
            if keys:
                yield batch({"key": keys, "form": forms}, schema)

    return run


def _verify(idf: dict[str, float], rare: float, least: float):
    def run(batches):
        schema = pa.schema([("anchor", pa.string()), ("form", pa.string())])
        known: dict[str, tuple[Place, dict[str, float]]] = {}

        def look(form: str):
            if (found := known.get(form)) is None:
                if len(known) > 50_000:
                    known.clear()
                p = Place(*form.split("|"))
                known[form] = found = p, {g: w for w, g in weigh(p, idf, rare)}
            return found

        for x in batches:
            rows = []
            for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                (p, v), (q, w) = look(a), look(b)
                dot = sum(s * w[g] for g, s in v.items() if g in w)
                if dot >= least and same_place(p, q):
                    rows.append((a, b))
            if rows:
                yield batch(dict(zip(schema.names, zip(*rows), strict=True)), schema)

    return run


def _contradicts(batches):
    """(anchor, n): how many records have a form that fits the anchor, but stands at another place than its usual form."""
    schema = pa.schema([("anchor", pa.string()), ("n", pa.int64())])
    for x in batches:
        anchors, counts = [], []
        for anchor, form, n, usual in zip(*(c.to_pylist() for c in x.columns), strict=True):
            p, q = Place(*form.split("|")), Place(*usual.split("|"))
            if any(u and v and u != v for u, v in ((p.direction, q.direction), (p.kind, q.kind), (p.unit, q.unit))) or p.city and q.city and not _near_city(p.city, q.city):
                anchors.append(anchor)
                counts.append(n)
        if anchors:
            yield batch({"anchor": anchors, "n": counts}, schema)


def _one_place(batches):
    """Of (form, usual forms it fits): those of forms that fit one place only."""
    schema = pa.schema([("usual", pa.string()), ("form", pa.string())])
    for x in batches:
        rows = []
        for form, usual in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
            places = [Place(*a.split("|")) for a in usual]
            if all(same_place(places[0], q) for q in places[1:]) or form in usual:
                rows += [(a, form) for i, a in enumerate(usual) if form not in usual or same_place(places[i], Place(*form.split("|")))]
        if rows:
            yield batch(dict(zip(schema.names, zip(*rows), strict=True)), schema)


def match_addresses(records: DataFrame, anchors: DataFrame, least: float = 0.3) -> DataFrame:
    """(anchor, record): which records (record, address) stand at the place of which anchors (record, address).

    Addresses are parsed into parts, and each distinct set of parts, a form, is handled once. A form is a vector of the character
    3-grams of its street (and city, where they cannot be told apart), weighted by their rarity among all forms. The rarest grams of the indexed forms, together
    with their house or box number, make an inverted index; the rarest of each form are looked up in it. The prefix leaves
    out only what cannot reach the cosine `least` (see prefix). Candidates are verified by cosine, equal house or box number and
    parts that do not contradict each other.

    Anchors are indexed twice: first as they are written, then in the form most records at their place have, as an anchor with
    slips or parts left out is a poor measure. An anchor whose fitting records are split between places, with less than twice as many at
    its usual form as at another, is ambiguous and has no row; so has a form that fits the usual forms of two places.

    Null, blank and unreadable addresses (no house number with a street, no box) and null records have no row; a record with several
    addresses stands at each; repeated rows count once; other columns are ignored; empty tables give an empty result.
    The gram table that goes to the driver and the tasks holds at most 39**3 rows, whatever the input.
    """
    records, anchors = records.select("record", "address"), anchors.select("record", "address")
    parsed = written(spread(records.select("address").unionAll(anchors.select("address")).where("trim(address) <> ''").distinct()).mapInArrow(_parse_batches, f"address string, {_FORM}"), "addresses")
    at = lambda df: df.where("record is not null").join(parsed.select("address", "form"), "address").select("record", "form").distinct()
    of_record, of_anchor = written(at(records), "record-forms"), written(at(anchors), "anchor-forms")
    used = of_record.groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    forms = written(parsed.select("form", *Place._fields).distinct().join(used, "form", "left"), "forms")
    plain = forms.drop("n")
    counts = {r.gram: r.n for r in plain.mapInArrow(_count_grams, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator()}
    total = sum(counts.values())
    # a gram that slips made is the rarest of all: below one in a thousand, rarity says nothing more
    idf = {g: math.log(1 + total / (n + total / 1000)) for g, n in counts.items()}
    rare = math.log(1001)
    probe = plain.mapInArrow(_prefixes(idf, rare, least), "key string, form string")

    def fitting(indexed: DataFrame) -> DataFrame:
        index = plain.join(indexed, "form", "left_semi").mapInArrow(_prefixes(idf, rare, least), "key string, form string").withColumnRenamed("form", "anchor")
        return spread(probe.join(index, "key").select("anchor", "form").distinct()).mapInArrow(_verify(idf, rare, least), "anchor string, form string")

    fits = written(fitting(of_anchor.select("form").distinct()).join(forms, "form").select("anchor", "form", F.coalesce("n", F.lit(0)).alias("n"), *Place._fields), "fits")
    filled = lambda names: sum((F.col(c) != "").cast("int") for c in names)
    order = F.struct(F.greatest("n", F.lit(1)).alias("n"), filled(["kind", "city", "zip"]).alias("main"), (F.col("form") == F.col("anchor")).alias("own"), filled(Place._fields).alias("parts"), "form")
    usual = fits.groupBy("anchor").agg(F.max(order).alias("top")).select("anchor", F.col("top.form").alias("usual"), F.col("top.n").alias("usual_n"))
    against = fits.join(usual, "anchor").select("anchor", "form", "n", "usual").mapInArrow(_contradicts, "anchor string, n bigint").groupBy("anchor").agg(F.max("n").alias("against"))
    usual = written(usual.join(against, "anchor", "left").where("against is null or usual_n >= 2 * against").select("anchor", "usual"), "usual")
    sure = fitting(usual.select(F.col("usual").alias("form")).distinct()).groupBy("form").agg(F.collect_set("anchor").alias("usual")).mapInArrow(_one_place, "usual string, form string")
    anchored = written(of_anchor.withColumnRenamed("form", "anchor").join(usual, "anchor").select("record", "usual"), "anchored")
    # an anchor stands where its usual form does, not where its own letters may also fit
    standing = of_record.join(of_anchor.select("record").distinct(), "record", "left_anti").unionAll(anchored.withColumnRenamed("usual", "form"))
    pairs = anchored.withColumnRenamed("record", "anchor").join(sure, "usual").join(standing, "form")
    return pairs.select("anchor", "record").distinct()

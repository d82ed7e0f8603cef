"""Text normalisation and similarity as column expressions; everything here stays in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms at the end of a company name.
LEGAL_FORMS = ["incorporated", "corporation", "company", "limited", "inc", "llc", "ltd", "corp", "co", "lp", "llp", "plc", "gmbh", "sa", "ag"]
# Short forms in street addresses.
STREET_SHORT = {
    "st": "street", "ave": "avenue", "rd": "road", "ste": "suite", "blvd": "boulevard", "dr": "drive", "ln": "lane", "ct": "court",
    "pl": "place", "hwy": "highway", "pkwy": "parkway",
}
# Words that say nothing about what was bought, units of measure, and kinds of work with a result.
GENERIC_TERMS = [
    "services", "service", "support", "consulting", "miscellaneous", "other", "fees", "fee", "charges", "charge", "expenses", "expense", "general", "various", "sundry", "professional",
]
UNIT_WORDS = [
    "hours", "hour", "hrs", "hr", "units", "unit", "sqft", "lbs", "lb", "kg", "tons", "ton", "gallons", "gal", "liters", "metres", "meters", "feet", "ft", "yards", "yd", "each", "ea", "pieces", "pcs",
    "boxes", "pallets", "rolls", "sheets", "bags",
]
DELIVERABLE_WORDS = [
    "report", "reports", "installation", "install", "delivery", "delivered", "repair", "repairs", "inspection", "audit", "assessment", "training", "maintenance", "deployment", "commissioning",
    "fabrication", "testing", "survey",
]


@cache
def _marked_letters() -> tuple[str, str]:
    """Letters with marks and their plain letters, from the Unicode tables; letters that become several are left alone."""
    marked, plain = [], []
    for i in range(128, min(sys.maxunicode, 0x2000)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(i):
            marked.append(chr(i))
            plain.append(base)
    return "".join(marked), "".join(plain)


def plain_letters(c: Column) -> Column:
    """Without marks on letters; combining marks are dropped."""
    marked, plain = _marked_letters()
    return F.regexp_replace(F.translate(c, marked, plain), r"\p{M}+", "")


def normalize_text(c: Column) -> Column:
    """Lower case, no marks, punctuation as blanks, runs of blanks as one. Null gives an empty text."""
    c = F.lower(plain_letters(F.coalesce(c, F.lit(""))))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def exact_match(a: Column, b: Column) -> Column:
    """Whether two texts are equal once normalised; nulls are empty texts."""
    return normalize_text(a) == normalize_text(b)


def normalize_vendor_name(c: Column) -> Column:
    """normalize_text without legal forms at the end, however many follow each other; a name is never only a legal form."""
    return F.trim(F.regexp_replace(normalize_text(c), r"(?:\s+(?:" + "|".join(LEGAL_FORMS) + r"))+$", ""))


def normalize_address(c: Column) -> Column:
    """Lower case without suite, apartment and unit numbers, short forms of streets written out."""
    c = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"(?:\b(?:suite|ste\.?|apt\.?|unit)|#)\s*\w+", "")
    table = F.create_map(*[F.lit(x) for short, full in STREET_SHORT.items() for x in (short, full, short + ".", full)])
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    return F.concat_ws(" ", F.transform(words, lambda w: F.coalesce(table[w], w)))


def normalize_phone(c: Column) -> Column:
    """Digits only, without the country code of eleven."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    return F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)


def words_of(c: Column) -> Column:
    """The distinct words of a normalised text."""
    return F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def category_key(c: Column) -> Column:
    """The first two words of three or more letters of the normalised text, or the whole of it."""
    norm = normalize_text(c)
    key = F.concat_ws(" ", F.slice(F.filter(F.split(norm, " "), lambda w: F.length(w) >= 3), 1, 2))
    return F.when(key != "", key).otherwise(norm)


def vagueness(c: Column) -> Column:
    """0 (vague) to 100 (specific) from the number of words, generic words, quantities, dates, names, units and results."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    low, words = F.lower(text), F.split(text, " ")
    bare = F.transform(F.split(low, " "), lambda w: F.regexp_replace(w, r"^[.,;:]+|[.,;:]+$", ""))
    n = F.size(words)
    units = "|".join([*UNIT_WORDS, "sq ft"])
    score = (
        F.lit(50)
        + F.when(n < 3, -30).when(n < 5, -15).otherwise(0)
        + F.when(F.size(F.array_except(bare, F.array(*map(F.lit, GENERIC_TERMS)))) == 0, -40).otherwise(0)
        + F.when(low.rlike(rf"\d+\s*(?:{units})\b"), 20).otherwise(0)
        + F.when(text.rlike(r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"), 15).otherwise(0)
        + F.when(text.rlike(r"(?U)\s\p{Lu}"), 10).otherwise(0)
        + F.when(F.arrays_overlap(F.split(low, " "), F.array(*map(F.lit, UNIT_WORDS))), 15).otherwise(0)
        + F.when(low.rlike("|".join(DELIVERABLE_WORDS)), 15).otherwise(0)
    )
    return F.when(text == "", 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score)))


def payment_terms(c: Column) -> dict[str, Column]:
    """discount (percent), discount_days and net_days of terms such as '2/10 Net 30'; 0 where not given."""
    low = F.lower(F.coalesce(c, F.lit("")))
    early = r"(\d+(?:\.\d+)?)\s*%?\s*/\s*(\d+)"
    number = lambda pattern, group, kind: F.coalesce(F.regexp_extract(low, pattern, group).try_cast(kind), F.lit(0).cast(kind))
    return {"discount": number(early, 1, "double"), "discount_days": number(early, 2, "int"), "net_days": number(r"net\s*(\d+)", 1, "int")}


def pattern_hash(*parts: Column) -> Column:
    """Sixteen hex digits of SHA-256 over the parts, nulls as empty texts."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def salvage_json(c: Column, schema: str) -> Column:
    """The JSON object in a text: the whole text, or what stands between its first { and last }; null if neither parses."""
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.from_json(F.when(inner != "", inner), schema)

"""Self-joins of invoices within blocks: duplicate pairs, pairs across orders, credits and their rebills, related vendors."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgersift.functions.fuzzy import ratio, token_sort_ratio
from ledgersift.functions.text import jaccard, normalize_address, normalize_phone, normalize_vendor_name, words_of
from ledgersift.session import written


def bucketed(df: DataFrame, amount: str, share: float, day: str | None = None, days: int = 0) -> DataFrame:
    """df with equi-join keys for a range self-join: rows whose amounts differ by at most `share` of the larger and whose
    days differ by at most `days` have a key in common.

    Buckets are as wide as the tolerance, so a row goes to its own and the next one in each dimension: four copies at most, and a
    join within a busy vendor stays small.
    """
    width = -math.log(1 - share)
    b = F.floor(F.ln(F.abs(F.col(amount).cast("double"))) / width)
    df = df.where(F.col(amount) != 0).withColumn("_amount_bucket", F.explode(F.array(b, b + 1)))
    if day:
        d = F.floor(F.unix_date(F.col(day)) / (days + 1))
        df = df.where(F.col(day).isNotNull()).withColumn("_day_bucket", F.explode(F.array(d, d + 1)))
    return df


def _sides(df: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    return tuple(df.select(*[F.col(c) if c in ("vendor_id", "_amount_bucket", "_day_bucket") else F.col(c).alias(f"{c}_{s}") for c in (*names, "vendor_id", "_amount_bucket", *[x for x in ("_day_bucket",) if x in df.columns])]) for s in "ab")


def step(x: Column, *bounds: tuple[float, float]) -> Column:
    """The score of the first bound that x does not exceed, else 0."""
    out = F.lit(0.0)
    for limit, score in reversed(bounds):
        out = F.when(x <= limit, score).otherwise(out)
    return out


def duplicate_pairs(invoices: DataFrame, days: int = 90, share: float = 0.2, least: float = 0.85) -> DataFrame:
    """(invoice_id_a, invoice_id_b, vendor_id, score) of invoices of one vendor that are probably one.

    invoices: invoice_id, vendor_id, invoice_date, total_amount, po_number, words and quantities (arrays). The earlier invoice is a. The
    score weighs how near amount, day, text, quantities and order number are; a missing text or order number counts half.
    """
    keyed = bucketed(invoices.where("total_amount > 0 and vendor_id is not null"), "total_amount", share, "invoice_date", days)
    a, b = _sides(keyed, "invoice_id", "invoice_date", "total_amount", "po_number", "words", "quantities")
    keys = ["vendor_id", "_amount_bucket", "_day_bucket"]
    gap = F.date_diff("invoice_date_b", "invoice_date_a")
    diff = F.abs(F.col("total_amount_a") - F.col("total_amount_b")).cast("double") / F.greatest("total_amount_a", "total_amount_b").cast("double")
    first = (F.col("invoice_date_a") < F.col("invoice_date_b")) | (F.col("invoice_date_a") == F.col("invoice_date_b")) & (F.col("invoice_id_a") < F.col("invoice_id_b"))
    near = a.join(b, keys).where(first & (gap <= days) & (diff <= share))
    text = F.when((F.size("words_a") == 0) | (F.size("words_b") == 0), 0.5).otherwise(jaccard(F.col("words_a"), F.col("words_b")))
    order = F.when(F.col("po_number_a").isNull() | F.col("po_number_b").isNull(), 0.5).otherwise((F.col("po_number_a") == F.col("po_number_b")).cast("double"))
    score = (
        step(diff, (0.01, 1.0), (0.05, 0.8), (0.10, 0.5)) * 0.30 + step(gap, (0, 1.0), (7, 0.8), (30, 0.5), (90, 0.2)) * 0.15 + text * 0.30
        + jaccard(F.col("quantities_a"), F.col("quantities_b")) * 0.10 + order * 0.15
    )
    found = near.withColumn("score", F.round(score, 6)).where(F.col("score") >= least)
    # a pair can share several buckets
    return found.groupBy("invoice_id_a", "invoice_id_b", "vendor_id").agg(F.max("score").alias("score"))


def cross_order_pairs(invoices: DataFrame, flagged: DataFrame, days: int = 30, share: float = 0.1, least: float = 0.85) -> DataFrame:
    """Pairs of one vendor with different order numbers, near in day, amount and text, that are not flagged yet."""
    keyed = bucketed(invoices.where("total_amount > 0 and vendor_id is not null and po_number is not null"), "total_amount", share, "invoice_date", days)
    a, b = _sides(keyed, "invoice_id", "invoice_date", "total_amount", "po_number", "words")
    diff = F.abs(F.col("total_amount_a") - F.col("total_amount_b")).cast("double") / F.greatest("total_amount_a", "total_amount_b").cast("double")
    near = a.join(b, ["vendor_id", "_amount_bucket", "_day_bucket"]).where((F.col("invoice_id_a") < F.col("invoice_id_b")) & (F.col("po_number_a") != F.col("po_number_b")) & (F.abs(F.date_diff("invoice_date_b", "invoice_date_a")) <= days) & (diff <= share))
    alike = near.where(jaccard(F.col("words_a"), F.col("words_b")) >= least).select("vendor_id", "invoice_id_a", "invoice_id_b").distinct()
    known = flagged.select(F.least("invoice_id_a", "invoice_id_b").alias("invoice_id_a"), F.greatest("invoice_id_a", "invoice_id_b").alias("invoice_id_b"))
    return alike.join(known, ["invoice_id_a", "invoice_id_b"], "left_anti")


def _described(found: DataFrame, invoices: DataFrame) -> DataFrame:
    """Pairs with the descriptions of both sides, which do not go through the join of the buckets."""
    x, y = (invoices.select(F.col("invoice_id").alias(f"invoice_id_{s}"), F.col("description").alias(f"description_{s}")) for s in "ab")
    return found.join(x, "invoice_id_a").join(y, "invoice_id_b")


def similar_invoices(invoices: DataFrame, days: int = 90, share: float = 0.2, least: float = 0.85) -> DataFrame:
    """(invoice_id_a, invoice_id_b, vendor_id, score): duplicate_pairs with the ratios of the texts, so that a slip costs its letters, not its word.

    invoices: invoice_id, vendor_id, invoice_date, total_amount, po_number, description and quantities (array). Order numbers count as equal from
    a ratio of 90. Missing text, quantities or order numbers count half. Texts are compared only where the rest can still reach `least`.
    """
    size = F.length(F.trim(F.coalesce("description", F.lit(""))))
    kept = invoices.where("total_amount > 0 and vendor_id is not null").withColumn("size", size)
    a, b = _sides(bucketed(kept, "total_amount", share, "invoice_date", days), "invoice_id", "invoice_date", "total_amount", "po_number", "size", "quantities")
    gap = F.date_diff("invoice_date_b", "invoice_date_a")
    diff = F.abs(F.col("total_amount_a") - F.col("total_amount_b")).cast("double") / F.greatest("total_amount_a", "total_amount_b").cast("double")
    first = (F.col("invoice_date_a") < F.col("invoice_date_b")) | (F.col("invoice_date_a") == F.col("invoice_date_b")) & (F.col("invoice_id_a") < F.col("invoice_id_b"))
    counts = F.when((F.size("quantities_a") == 0) | (F.size("quantities_b") == 0), 0.5).otherwise(jaccard(F.col("quantities_a"), F.col("quantities_b")))
    rest = step(diff, (0.01, 1.0), (0.05, 0.8), (0.10, 0.5)) * 0.30 + step(gap, (0, 1.0), (7, 0.8), (30, 0.5), (90, 0.2)) * 0.15 + counts * 0.10
    no_text, no_order = (F.col("size_a") == 0) | (F.col("size_b") == 0), F.col("po_number_a").isNull() | F.col("po_number_b").isNull()
    most = F.when(no_text, 0.15).otherwise(0.30) + F.when(no_order, 0.075).otherwise(0.15)
    near = a.join(b, ["vendor_id", "_amount_bucket", "_day_bucket"]).where(first & (gap <= days) & (diff <= share)).withColumns({"rest": rest, "no_text": no_text, "no_order": no_order})
    near = near.where(F.col("rest") + most >= least - 1e-6).select("invoice_id_a", "invoice_id_b", "vendor_id", "po_number_a", "po_number_b", "rest", "no_text", "no_order")
    # a pair can share several buckets
    near = _described(near.dropDuplicates(["invoice_id_a", "invoice_id_b"]), invoices)
    near = near.withColumns({"alike": token_sort_ratio("description_a", "description_b") / 100, "order": ratio("po_number_a", "po_number_b")})
    score = F.col("rest") + F.when(F.col("no_text"), 0.5).otherwise(F.col("alike")) * 0.30 + F.when(F.col("no_order"), 0.5).otherwise((F.col("order") >= 90).cast("double")) * 0.15
    return near.select("invoice_id_a", "invoice_id_b", "vendor_id", F.round(score, 6).alias("score")).where(F.col("score") >= least)


def similar_across_orders(invoices: DataFrame, flagged: DataFrame, days: int = 30, share: float = 0.1, least: float = 0.85) -> DataFrame:
    """cross_order_pairs with the token sort ratio of the texts."""
    kept = invoices.where("total_amount > 0 and vendor_id is not null and po_number is not null and trim(description) <> ''")
    words = F.array_sort(F.filter(F.split("description", r"\s+"), lambda w: w != ""))
    keyed = bucketed(kept.withColumn("size", F.length(F.array_join(words, " "))), "total_amount", share, "invoice_date", days)
    a, b = _sides(keyed, "invoice_id", "invoice_date", "total_amount", "po_number", "size")
    diff = F.abs(F.col("total_amount_a") - F.col("total_amount_b")).cast("double") / F.greatest("total_amount_a", "total_amount_b").cast("double")
    near = a.join(b, ["vendor_id", "_amount_bucket", "_day_bucket"]).where((F.col("invoice_id_a") < F.col("invoice_id_b")) & (F.col("po_number_a") != F.col("po_number_b")) & (F.abs(F.date_diff("invoice_date_b", "invoice_date_a")) <= days) & (diff <= share))
    # the common part is at most the shorter text
    near = near.where(F.least("size_a", "size_b") * 2 >= (F.col("size_a") + F.col("size_b")) * (least - 1e-9)).select("vendor_id", "invoice_id_a", "invoice_id_b").distinct()
    known = flagged.select(F.least("invoice_id_a", "invoice_id_b").alias("invoice_id_a"), F.greatest("invoice_id_a", "invoice_id_b").alias("invoice_id_b"))
    near = _described(near.join(known, ["invoice_id_a", "invoice_id_b"], "left_anti"), invoices)
    return near.withColumn("alike", token_sort_ratio("description_a", "description_b") / 100).where(F.col("alike") >= least).select("vendor_id", "invoice_id_a", "invoice_id_b")


def credits_and_rebills(invoices: DataFrame, share: float = 0.01) -> DataFrame:
    """(invoice_id, side): credits with an invoice of the same vendor of nearly the amount, and those invoices: two semi-joins."""
    keyed = bucketed(invoices.where("total_amount <> 0 and vendor_id is not null").select("invoice_id", "vendor_id", "total_amount"), "total_amount", share)
    keys = ["vendor_id", "_amount_bucket"]
    neg = keyed.where("total_amount < 0").select("invoice_id", *keys, F.abs("total_amount").alias("amount"))
    pos = keyed.where("total_amount > 0").select("invoice_id", *keys, F.col("total_amount").alias("amount"))
    x, y = neg.alias("x"), pos.alias("y")
    on = (F.col("x.vendor_id") == F.col("y.vendor_id")) & (F.col("x._amount_bucket") == F.col("y._amount_bucket")) & (F.abs(F.col("x.amount") - F.col("y.amount")) < share * F.col("y.amount"))
    credits = x.join(y, on, "left_semi").select("invoice_id", F.lit("credit").alias("side"))
    billed = y.join(x, on, "left_semi").select("invoice_id", F.lit("invoice").alias("side"))
    return credits.unionAll(billed).distinct()


def near_texts(texts: DataFrame, column: str, least: float = 90, q: int = 3) -> DataFrame:
    """(text_a, text_b, ratio), text_a < text_b: different texts whose token sort ratio is at least `least` (above 80), none left out.

    Texts with that ratio are few insertions and deletions apart. A deletion takes at most q of a text's q-grams away and an insertion
    q - 1, so if each text is filed under one gram more than can be lost, its rarest, the rarest that a pair keeps is in both files, and
    moved by no more places than there are deletions or insertions. One of these changes at most one of the 128 bits that stand for a
    text's characters, counted.
    """
    r = least / 100
    t = texts.select(F.col(column).alias("text")).where("text <> ''").distinct().withColumn("id", F.monotonically_increasing_id())
    t = written(t.withColumn("sorted", F.array_join(F.array_sort(F.filter(F.split("text", r"\s+"), lambda w: w != "")), " ")).withColumn("n", F.length("sorted")), "texts")
    each = F.expr("transform(sequence(1, n), i -> pmod(xxhash64(substring(sorted, i, 1), i - length(replace(substring(sorted, 1, i), substring(sorted, i, 1), ''))), 128))")
    bits = [F.expr(f"aggregate(filter(each, h -> h div 64 = {k}), 0L, (x, h) -> x | shiftleft(1L, cast(h % 64 as int)))").alias(f"bits{k}") for k in (0, 1)]
    grams = t.where(F.col("n") >= q).withColumn("each", each).select("id", "n", *bits, F.posexplode(F.expr(f"transform(sequence(1, n - {q - 1}), i -> substring(sorted, i, {q}))")).alias("at", "gram"))
    filed = written(grams, "grams")
    rarity = filed.groupBy("gram").agg(F.count(F.lit(1)).alias("times"))
    lost = F.floor(F.col("n") * (q - (q - 0.5) * r + (q - 1 - (q - 0.5) * r) * r / (2 - r)) + 1e-6)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("times", "gram", "at"))
    first = filed.join(rarity, "gram").withColumn("rank", rank).where((F.col("rank") <= lost + 1) & (F.col("times") > 1))
    a, b = (first.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "at", "bits0", "bits1")]) for s in "ab")
    kept = (F.col("n_a") + F.col("n_b")) * (r / 2) - 1e-6
    moved = F.col("at_a") - F.col("at_b")
    near = (F.col("id_a") < F.col("id_b")) & (F.least("n_a", "n_b") >= kept) & (moved <= F.col("n_a") - kept) & (-moved <= F.col("n_b") - kept)
    changed = F.bit_count(F.col("bits0_a").bitwiseXOR(F.col("bits0_b"))) + F.bit_count(F.col("bits1_a").bitwiseXOR(F.col("bits1_b")))
    near = near & (changed <= (F.col("n_a") + F.col("n_b")) * (1 - r) + 1e-6)
    found = a.join(b, "gram").where(near).select("id_a", "id_b").distinct()
    x, y = (t.select(F.col("id").alias(f"id_{s}"), F.col("text").alias(f"x_{s}")) for s in "ab")
    scored = found.join(x, "id_a").join(y, "id_b").withColumn("ratio", token_sort_ratio("x_a", "x_b")).where(F.col("ratio") >= least)
    return scored.select(F.least("x_a", "x_b").alias("text_a"), F.greatest("x_a", "x_b").alias("text_b"), "ratio")


def similar_names(vendors: DataFrame, least: float = 85, merge: float = 90) -> DataFrame:
    """(vendor_a, vendor_b, ratio, decision) of different vendors whose normalised names have a token sort ratio of at least `least`: `merge` from that
    ratio on, below it `pending`, for a reviewer.

    Equal names are pairs too (ratio 100). Null and blank names are in no pair; repeated rows count once; other columns are ignored.
    """
    v = written(vendors.where("vendor_id is not null").select("vendor_id", normalize_vendor_name(F.col("vendor_name")).alias("name")).where("name <> ''").distinct(), "names")
    a, b = (v.select(F.col("vendor_id").alias(f"vendor_{s}"), F.col("name").alias(f"name_{s}")) for s in "ab")
    equal = a.join(b, (F.col("name_a") == F.col("name_b")) & (F.col("vendor_a") < F.col("vendor_b"))).select("vendor_a", "vendor_b", F.lit(100.0).alias("ratio"))
    near = near_texts(v, "name", least).join(a, F.col("text_a") == F.col("name_a")).join(b, F.col("text_b") == F.col("name_b")).where(F.col("vendor_a") != F.col("vendor_b"))
    near = near.select(F.least("vendor_a", "vendor_b").alias("vendor_a"), F.greatest("vendor_a", "vendor_b").alias("vendor_b"), "ratio")
    both = equal.unionAll(near).groupBy("vendor_a", "vendor_b").agg(F.round(F.max("ratio"), 6).alias("ratio"))
    return both.withColumn("decision", F.when(F.col("ratio") >= merge, "merge").otherwise("pending"))


def _master(vendors: DataFrame) -> DataFrame:
    """The signals of each vendor; fillers (empty, none, n/a, unknown, zeros) are no value."""
    clean = lambda c: F.when(~F.lower(F.trim(c)).isin("", "none", "n/a", "na", "unknown", "tbd", "0000", "-") & ~F.trim(c).rlike(r"^[0-]+$"), F.lower(F.trim(c)))
    return vendors.select(
        "vendor_id", clean("bank_account_last4").alias("bank"), normalize_address(F.col("address")).alias("address"), F.nullif(normalize_phone(F.col("phone")), F.lit("")).alias("phone"),
        clean("tax_id").alias("tax"), normalize_vendor_name(F.col("vendor_name")).alias("name"), clean("contact_person").alias("contact"),
    )


def related_vendors(vendors: DataFrame, least: float = 0.6) -> DataFrame:
    """(vendor_a, vendor_b, score) of vendors that share master data.

    An equal bank number is worth .65, an address .65 from a token sort ratio of 90 and .35 times the ratio from 75, an equal phone or tax
    number .15 each, a similar name up to .15, an equal contact .10. Without an equal bank number or an address from 90, a pair reaches `least`
    (.6 or more) only with an equal phone or tax number, so those four are joined on keys, never all against all, and none is lost.
    """
    v = written(_master(vendors), "vendors")
    full = ["bank", "address", "phone", "tax", "name", "contact"]
    a, b = (v.select(*[F.col(c).alias(f"{c}_{s}") for c in ("vendor_id", *full)]) for s in "ab")
    ordered = F.col("vendor_id_a") < F.col("vendor_id_b")
    long = F.length("address_a") >= 5
    ids = ["vendor_id_a", "vendor_id_b"]
    on = lambda c: (F.col(f"{c}_a") == F.col(f"{c}_b")) & ordered
    near = near_texts(v, "address").drop("ratio")
    near = near.unionAll(near.select("text_b", "text_a"))
    by_address = a.join(near, F.col("address_a") == F.col("text_a")).join(b, (F.col("address_b") == F.col("text_b")) & ordered).where(long)
    fits = long & (F.least(F.length("address_a"), F.length("address_b")) * 200 >= (F.length("address_a") + F.length("address_b")) * 75)
    keyed = [a.join(b, on("bank")), a.join(b, on("address")).where(long), by_address, a.join(b, on("phone")).where(fits), a.join(b, on("tax")).where(fits)]
    pairs = reduce(DataFrame.unionAll, [x.select(*ids) for x in keyed]).distinct()
    equal = lambda c: F.coalesce(F.col(f"{c}_a") == F.col(f"{c}_b"), F.lit(False))
    ratios = pairs.join(a, "vendor_id_a").join(b, "vendor_id_b").withColumns({"at": token_sort_ratio("address_a", "address_b") / 100, "named": token_sort_ratio("name_a", "name_b") / 100})
    score = (
        F.when(long & (F.col("at") >= 0.9), 0.65).when(long & (F.col("at") >= 0.75), F.col("at") * 0.35).otherwise(0.0) + F.when(equal("bank"), 0.65).otherwise(0.0) + F.when(equal("phone"), 0.15).otherwise(0.0)
        + F.when(equal("tax"), 0.15).otherwise(0.0) + F.when(equal("contact"), 0.10).otherwise(0.0) + F.when(F.col("named") >= 0.5, F.col("named") * 0.15).otherwise(0.0)
    )
    return ratios.select(F.col("vendor_id_a").alias("vendor_a"), F.col("vendor_id_b").alias("vendor_b"), F.round(score, 6).alias("score")).where(F.col("score") >= least)


def related_by_equality(vendors: DataFrame, least: float = 0.6) -> DataFrame:
    """(vendor_a, vendor_b, score) as the SQL of vendor_relationships has it; related_vendors has the whole rule.

    An equal bank number or equal address is worth .65, an equal phone or tax number .15 each, a similar name up to .15, an
    equal contact .10. All other signals together stay below `least`, so every pair has an equal bank number or shares an
    address: only those are joined, on keys, never all against all. Fillers (empty, none, n/a, unknown, zeros) are no value.
    """
    v = _master(vendors).withColumn("name", words_of(F.col("name")))
    full = ["bank", "address", "phone", "tax", "name", "contact"]
    a, b = (v.select(*[F.col(c).alias(f"{c}_{s}") for c in ("vendor_id", *full)]) for s in "ab")
    equal = lambda c: F.coalesce(F.col(f"{c}_a") == F.col(f"{c}_b"), F.lit(False))
    ordered = F.col("vendor_id_a") < F.col("vendor_id_b")
    by_address = a.join(b, (F.col("address_a") == F.col("address_b")) & (F.col("address_a") != "") & ordered)
    # four digits of a bank number repeat by chance, so they only count beside another sign, which is part of the key
    sign = lambda kind, c: F.when(c.isNotNull(), F.concat(F.lit(kind), c))
    signs = F.array_compact(F.concat(F.array(*[sign(k, F.col(c)) for k, c in (("p", "phone"), ("t", "tax"), ("c", "contact"), ("a", "address"))]), F.transform("name", lambda w: F.concat(F.lit("n"), w))))
    keyed = v.where("bank is not null").select("vendor_id", "bank", F.explode(signs).alias("sign"))
    x, y = (keyed.select("bank", "sign", F.col("vendor_id").alias(f"vendor_id_{s}")) for s in "ab")
    same = x.join(y, ["bank", "sign"]).where(ordered).select("vendor_id_a", "vendor_id_b").distinct()
    by_bank = same.join(a, "vendor_id_a").join(b, "vendor_id_b")
    pairs = by_address.unionByName(by_bank)
    name = jaccard(F.col("name_a"), F.col("name_b"))
    score = (
        F.when(equal("address") & (F.col("address_a") != ""), 0.65).otherwise(0.0) + F.when(equal("bank"), 0.65).otherwise(0.0) + F.when(equal("phone"), 0.15).otherwise(0.0)
        + F.when(equal("tax"), 0.15).otherwise(0.0) + F.when(equal("contact"), 0.10).otherwise(0.0) + F.when(name >= 0.5, name * 0.15).otherwise(0.0)
    )
    scored = pairs.withColumn("score", F.round(score, 6)).where(F.col("score") >= least)
    return scored.groupBy(F.col("vendor_id_a").alias("vendor_a"), F.col("vendor_id_b").alias("vendor_b")).agg(F.max("score").alias("score"))

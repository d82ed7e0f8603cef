"""The queries of this subpackage: problems 1-3, 5, 7-10. Each takes (session, folder of tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.llm import addresses, components, leakage, mapping, names, near_duplicates, packing, spans
from ledgersift.operators.pairs import related_vendors
from ledgersift.session import table, written
from ledgersift.sources.invoices import vendors

SPAN = 300


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of an invoice and a vendor, or of two vendors, at one place; the vendors' addresses are the anchors."""
    vendors = table(spark, folder, "vendors").select(F.col("vendor_id").alias("record"), "address")
    invoices = table(spark, folder, "invoices").select(F.col("invoice_id").alias("record"), F.col("vendor_address").alias("address"))
    found = addresses.match_addresses(invoices.unionAll(vendors).distinct(), vendors)
    return found.where("anchor <> record").select(F.least("anchor", "record").alias("record_a"), F.greatest("anchor", "record").alias("record_b")).distinct()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    typed = table(spark, folder, "invoices").where("vendor_id is null and invoice_id is not null").select("invoice_id", F.col("vendor_name").alias("name")).distinct()
    typed = written(typed, "typed")
    means = names.resolve_names(typed, table(spark, folder, "vendors"), table(spark, folder, "vendor_aliases"))
    return typed.join(means, "name").select("invoice_id", "vendor_id").distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    members, links = near_duplicates.entered_again(near_duplicates.invoice_records(table(spark, folder, "invoices")))
    pairs = near_duplicates.duplicate_pairs(members, links)
    return pairs.select(F.col("id_a").alias("invoice_id_a"), F.col("id_b").alias("invoice_id_b"))


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every invoice with a number and an amount, the class of its exact copies and how many classes are linked to it."""
    members, links = near_duplicates.entered_again(near_duplicates.invoice_records(table(spark, folder, "invoices")))
    degree = links.select("a").unionAll(links.select("b")).groupBy(F.col("a").alias("class")).agg(F.count(F.lit(1)).alias("links"))
    return members.join(degree, "class", "left").select(F.col("id").alias("invoice_id"), F.col("class").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items of invoice lines, and categories of classifications; the descriptions of these tell which other names the categories have."""
    items, classified = table(spark, folder, "item_list"), table(spark, folder, "item_classifications")
    typed = table(spark, folder, "invoices").select(F.lit("invoices").alias("record_source"), F.col("line_item_id").alias("record_key"), F.col("line_item_description").alias("value"))
    described = classified.select(F.lit("described").alias("record_source"), F.col("description_hash").alias("record_key"), F.col("original_description").alias("value"))
    found = written(mapping.map_items(typed.unionAll(described), items), "items")
    sorted_as = items.select(F.col("item_id").alias("entry_id"), F.col("category_id").cast("int").alias("category_id")).distinct()
    hints = found.where("record_source = 'described'").join(sorted_as, "entry_id").select("record_key", F.col("category_id").alias("entry_id"))
    rows = classified.select(F.lit("item_classifications").alias("record_source"), F.col("description_hash").alias("record_key"), F.col("category").alias("value"))
    return found.where("record_source = 'invoices'").unionAll(mapping.map_categories(rows, table(spark, folder, "category_list"), hints))


def p5_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """How many keys of each source have an entry, and how many have none."""
    return p5_found(spark, folder).groupBy("record_source").agg(F.count_if(F.col("entry_id") >= 0).alias("matched"), F.count_if(F.col("entry_id") < 0).alias("unmatched"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    links = components.current_links(table(spark, folder, "vendor_matches"))
    return components.contract_components(links).select(F.col("id").alias("vendor_id"), "group_id")


def p7_usage(spark: SparkSession, folder: str) -> DataFrame:
    """How often the ids of each group are used by invoices (one per invoice_id) and aliases."""
    groups = written(p7_found(spark, folder), "groups")
    invoices = table(spark, folder, "invoices").where("vendor_id is not null").groupBy("vendor_id").agg(F.count_distinct("invoice_id").alias("invoices"))
    aliases = table(spark, folder, "vendor_aliases").where("canonical_vendor_id is not null").groupBy(F.col("canonical_vendor_id").alias("vendor_id")).agg(F.count_distinct("alias_text").alias("aliases"))
    used = groups.join(invoices, "vendor_id", "left").join(aliases, "vendor_id", "left")
    return used.groupBy("group_id").agg(F.count(F.lit(1)).alias("ids"), F.coalesce(F.sum("invoices"), F.lit(0)).alias("invoices"), F.coalesce(F.sum("aliases"), F.lit(0)).alias("aliases"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """What stays unused if batches form inside each length bucket alone, and if they also take smaller documents."""
    sized = written(packing.count_tokens(table(spark, folder, "documents")), "tokens")
    forms = [packing.container_report(packing.pack(sized, mixed=mixed)).withColumn("form", F.lit(form)) for form, mixed in (("inside buckets", False), ("filled up", True))]
    return forms[0].unionAll(forms[1]).withColumn("unused_share", F.round("unused_share", 6))


def p9_passages(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_passages(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_passages(spark, folder).select("item_id", "doc_id").distinct()


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", "text")
    return leakage.without_leaks(docs, p9_passages(spark, folder)).select("doc_id", "n_chars")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_pairs(spans.repeated_spans(table(spark, folder, "documents"), SPAN), SPAN)


def p10_shared(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return spans.shared_characters(spans.repeated_spans(docs, SPAN), docs, SPAN).withColumn("shared_ratio", F.round("shared_ratio", 6))


def p10_without_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What each document loses if only the first copy of a shared span is kept."""
    docs = table(spark, folder, "documents")
    cut = spans.without_repeats(docs, spans.repeated_spans(docs, SPAN), SPAN)
    return cut.select("doc_id", "removed", F.char_length("text").alias("kept_chars"))


def vendor_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Vendors joined directly or through others by shared master data."""
    related = related_vendors(vendors(spark, folder))
    return components.contract_components(related, "vendor_a", "vendor_b").select(F.col("id").alias("vendor_id"), "group_id")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_classes, p5_found, p5_unmatched, p7_found, p7_usage, p8_containers, p8_report, p9_found, p9_passages, p9_clean, p10_found, p10_shared, p10_without_repeats, vendor_clusters)}
_LINKS = """last AS (SELECT least(vendor_id_a, vendor_id_b) AS a, greatest(vendor_id_a, vendor_id_b) AS b, lower(trim(decision)) AS decision FROM vendor_matches
  WHERE vendor_id_a <> vendor_id_b QUALIFY row_number() OVER (PARTITION BY least(vendor_id_a, vendor_id_b), greatest(vendor_id_a, vendor_id_b) ORDER BY decided_at DESC NULLS LAST, match_id DESC) = 1),
  e AS (SELECT a, b FROM last WHERE decision = 'accepted' UNION SELECT b, a FROM last WHERE decision = 'accepted'),
  reach(vendor_id, other) AS (SELECT a, a FROM e UNION SELECT r.vendor_id, e.b FROM reach r JOIN e ON r.other = e.a)"""
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

SQL: dict[str, str] = {
    "p7_found": f"WITH RECURSIVE {_LINKS} SELECT vendor_id, min(other) AS group_id FROM reach GROUP BY 1",
    "p9_found": f"""WITH i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL), n AS (SELECT *, least(13, len(w)) AS n FROM i WHERE len(w) > 0),
      g AS (SELECT item_id, n, w[k:k + n - 1] AS gram FROM n, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS k)),
      sizes AS (SELECT DISTINCT n FROM n), d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
      h AS (SELECT doc_id, n, w[k:k + n - 1] AS gram FROM d, sizes, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS k))
      SELECT DISTINCT item_id, doc_id FROM g JOIN h USING (n, gram)""",
    "p10_found": """WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 300),
      w AS (SELECT DISTINCT doc_id, hash(substr(text, i, 300)) AS h FROM t, LATERAL (SELECT unnest(generate_series(1, length(text) - 299)) AS i)),
      r AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1)
      SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM (SELECT * FROM w SEMI JOIN r USING (h)) a JOIN (SELECT * FROM w SEMI JOIN r USING (h)) b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p10_shared": """WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 300),
      w AS (SELECT doc_id, i, hash(substr(text, i, 300)) AS h FROM t, LATERAL (SELECT unnest(generate_series(1, length(text) - 299)) AS i)),
      r AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
      s AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM (SELECT DISTINCT doc_id, i FROM w SEMI JOIN r USING (h))),
      c AS (SELECT doc_id, sum(least(300, coalesce(j - i, 300)))::BIGINT AS shared_chars FROM s GROUP BY 1), n AS (SELECT doc_id, max(length(text)) AS n_chars FROM documents GROUP BY 1)
      SELECT doc_id, shared_chars, n_chars, round(shared_chars::DOUBLE / n_chars, 6) AS shared_ratio FROM c JOIN n USING (doc_id)""",
    "p7_usage": f"""WITH RECURSIVE {_LINKS}, g AS (SELECT vendor_id, min(other) AS group_id FROM reach GROUP BY 1),
      i AS (SELECT vendor_id, count(DISTINCT invoice_id) AS n FROM invoices WHERE vendor_id IS NOT NULL GROUP BY 1), a AS (SELECT canonical_vendor_id AS vendor_id, count(DISTINCT alias_text) AS n FROM vendor_aliases WHERE canonical_vendor_id IS NOT NULL GROUP BY 1)
      SELECT group_id, count(*) AS ids, coalesce(sum(i.n), 0)::BIGINT AS invoices, coalesce(sum(a.n), 0)::BIGINT AS aliases FROM g LEFT JOIN i USING (vendor_id) LEFT JOIN a USING (vendor_id) GROUP BY 1""",
}
SQL["p9_clean"] = f"WITH found AS ({SQL['p9_found']}) SELECT doc_id, n_chars FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM found)"

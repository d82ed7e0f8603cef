"""Queries of the audit operators over whole tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgersift.functions import amounts, dates, stats, text
from ledgersift.functions.taxonomy import classify, keywords
from ledgersift.operators import adjudication as adj
from ledgersift.operators import groups, pairs, prices, quality, search
from ledgersift.session import table, written
from ledgersift.sources.invoices import blank_to_null, headers, lines, series, vendors

QUERIES: dict = {}
SQL: dict[str, str] = {}
LIMITS = [5000, 25000, 100000]

_LINES = "lines AS (SELECT * FROM invoices WHERE line_item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY line_item_id ORDER BY loaded_at DESC NULLS LAST) = 1)"
_HEADERS = "headers AS (SELECT *, nullif(trim(po_number), '') AS po FROM invoices WHERE invoice_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY loaded_at DESC NULLS LAST, line_item_id DESC NULLS LAST) = 1)"
_SERIES = """series AS (SELECT l_suppkey AS vendor, p_name AS item, CAST(o_orderdate AS DATE) AS day, l_extendedprice / l_quantity AS price, l_quantity AS quantity,
  l_extendedprice AS amount, o_orderpriority AS approver, o_orderkey AS invoice, p_retailprice AS list_price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 AND l_extendedprice > 0)"""
_BENCH = """bench AS (SELECT item AS category, count(*) AS n, count(DISTINCT vendor) AS vendors, avg(price) AS mean, stddev_pop(price) AS std,
  quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) AS p75, quantile_cont(price, 0.9) AS p90
  FROM series WHERE price > 0 GROUP BY 1 HAVING count(DISTINCT vendor) >= 3)"""


# the mean of an exact sum, half a cent up, in whole numbers: no double comes near a tie
_CENTS = "((2 * {cents} + n) // (2 * n)) / 100.0::DOUBLE"


def _whole_cents() -> F.Column:
    return F.expr("(2 * cents + n) div (2 * n)") / 100.0


def _norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def query(sql: str | None = None):
    """Register a query under its function's name; doubles are rounded to six places, as the SQL does."""

    def take(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = f(spark, folder)
            return df.withColumns({c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"})

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return take


def _series(spark, folder):
    return series(spark, folder).withColumn("seq", F.struct("invoice", "price", "quantity"))


# --- prices -------------------------------------------------------------------------------------------------------------


@query(f"""WITH {_SERIES}, {_BENCH} SELECT vendor, item, invoice, day, round(price, 6) AS price, round((price - median) / median * 100, 6) AS deviation_pct,
  round((price - p90) * quantity, 6) AS excess FROM series JOIN bench ON item = category
  WHERE price > p90 * 1.1 AND NOT (price - p90 < 50 AND (price - p90) * quantity < 500)""")
def market_price_deviation(spark, folder):
    # the three-way join is made once and written: the benchmark reads three of its columns, the comparison five
    s = written(series(spark, folder).select("vendor", "item", "invoice", "day", "price", "quantity"), "series")
    found = prices.deviations(s, prices.benchmark(s, "item", "vendor", "price"), "item", "price", "quantity")
    return found.select("vendor", "item", "invoice", "day", "price", "deviation_pct", "excess")


@query(f"WITH {_SERIES}, {_BENCH} SELECT category, n, vendors, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean", "std", "p25", "median", "p75", "p90")) + " FROM bench")
def category_benchmark(spark, folder):
    return prices.benchmark(series(spark, folder), "item", "vendor", "price")


@query(f"WITH {_SERIES}, {_BENCH} SELECT vendor, round(sum((price - median) / median * 100 * amount) / sum(amount), 6) AS premium_pct, round(sum(amount), 6) AS spend FROM series JOIN bench ON item = category WHERE median > 0 AND amount > 0 GROUP BY 1")
def vendor_premium_index(spark, folder):
    s = series(spark, folder)
    return prices.premium_index(s, prices.benchmark(s, "item", "vendor", "price"), "item", "vendor", "price", "amount")


@query(f"WITH {_SERIES}, {_BENCH} SELECT vendor, category, CAST(sum(CAST((price - median) * quantity AS DECIMAL(24,6))) AS DECIMAL(18,2)) AS saving FROM series JOIN bench ON item = category WHERE price > median GROUP BY 1, 2 HAVING sum(CAST((price - median) * quantity AS DECIMAL(24,6))) >= 5000")
def renegotiation_savings(spark, folder):
    s = series(spark, folder)
    return prices.savings(s, prices.benchmark(s, "item", "vendor", "price"), "item", "vendor", "price", "quantity").withColumn("saving", F.col("saving").cast("decimal(18,2)"))


@query(f"""WITH {_SERIES}, a AS (SELECT item AS category, quantile_cont(price, 0.5) AS median, count(*) AS n FROM series GROUP BY 1),
  b AS (SELECT p_type AS category, quantile_cont(p_retailprice, 0.5) AS median, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT p_name, quantile_cont(p_retailprice, 0.5), count(*) FROM part GROUP BY 1)
  SELECT coalesce(a.category, b.category) AS category, round((coalesce(a.median, 0) * coalesce(a.n, 0) + coalesce(b.median, 0) * coalesce(b.n, 0)) / (coalesce(a.n, 0) + coalesce(b.n, 0)), 6) AS median,
  coalesce(a.n, 0) + coalesce(b.n, 0) AS n, CASE WHEN b.category IS NULL THEN 'inside' WHEN a.category IS NULL THEN 'outside' ELSE 'both' END AS source FROM a FULL JOIN b ON a.category = b.category""")
def benchmark_blend(spark, folder):
    mid = lambda df, c, p: df.groupBy(F.col(c).alias("category")).agg(F.percentile(p, 0.5).alias("median"), F.count(F.lit(1)).alias("n"))
    part = table(spark, folder, "part")
    outside = mid(part, "p_type", "p_retailprice").unionByName(mid(part, "p_name", "p_retailprice"))
    return prices.blend(mid(series(spark, folder), "item", "price"), outside)


_ELIGIBLE = """ok AS (SELECT vendor, item FROM series GROUP BY 1, 2 HAVING count(*) >= 4 AND (year(max(day)) - year(min(day))) * 12 + month(max(day)) - month(min(day)) >= 3),
  pts AS (SELECT s.* FROM series s SEMI JOIN ok USING (vendor, item))"""


@query(f"""WITH {_SERIES}, {_ELIGIBLE}, x AS (SELECT *, CAST(day - min(day) OVER (PARTITION BY vendor, item) AS DOUBLE) AS x FROM pts)
  SELECT vendor, item, count(*) AS n, round(regr_slope(price, x), 6) AS slope, round(regr_r2(price, x), 6) AS r2 FROM x GROUP BY 1, 2 HAVING regr_slope(price, x) IS NOT NULL""")
def price_creep_trend(spark, folder):
    return prices.price_trends(prices.eligible(_series(spark, folder))).select("vendor", "item", "n", "slope", "r2")


@query()
def price_trend_significance(spark, folder):
    """Series whose slope is significant, by the two-sided p-value of Student's t."""
    return prices.price_trends(prices.eligible(_series(spark, folder))).where("p_value <= 0.05").select("vendor", "item", "n", "slope", "p_value")


_JUMPS = f"""WITH {_SERIES}, {_ELIGIBLE}, st AS (SELECT *, round((price - lag(price) OVER w) / lag(price) OVER w * 100, 6) AS jump, row_number() OVER w AS k FROM pts WINDOW w AS (PARTITION BY vendor, item ORDER BY day, invoice, price, quantity)),
  g AS (SELECT vendor, item, count(*) AS n, arg_min(price, k) AS first_price, arg_max(price, k) AS last_price, list(jump ORDER BY k) FILTER (jump IS NOT NULL) AS steps FROM st GROUP BY 1, 2),
  t AS (SELECT vendor, item, jump AS max_jump_pct, day AS max_jump_day FROM st WHERE jump IS NOT NULL QUALIFY row_number() OVER (PARTITION BY vendor, item ORDER BY abs(jump) DESC, k) = 1),
  j AS (SELECT vendor, item, n, round(first_price, 6) AS first_price, round(last_price, 6) AS last_price, round((last_price - first_price) / first_price * 100, 6) AS change_pct, max_jump_pct, max_jump_day,
    coalesce(len(steps) >= 3 AND steps[-3] > 0 AND steps[-2] > steps[-3] AND steps[-1] > steps[-2], false) AS accelerating FROM g LEFT JOIN t USING (vendor, item))"""


@query(_JUMPS + " SELECT * FROM j WHERE abs(max_jump_pct) >= 5")
def price_single_jump(spark, folder):
    return prices.jumps(prices.eligible(_series(spark, folder))).where("abs(max_jump_pct) >= 5")


@query(_JUMPS + " SELECT vendor, item, n, change_pct FROM j WHERE accelerating")
def price_acceleration(spark, folder):
    return prices.jumps(prices.eligible(_series(spark, folder))).where("accelerating").select("vendor", "item", "n", "change_pct")


@query(f"""WITH {_SERIES}, {_ELIGIBLE}, h AS (SELECT *, row_number() OVER (PARTITION BY vendor, item ORDER BY day, invoice, price, quantity) AS k, count(*) OVER (PARTITION BY vendor, item) // 2 AS mid FROM pts),
  g AS (SELECT vendor, item, avg(quantity) FILTER (k <= mid) AS a, avg(quantity) FILTER (k > mid) AS b FROM h GROUP BY 1, 2)
  SELECT vendor, item, round(a, 6) AS first_half, round(b, 6) AS second_half, round((b - a) / a * 100, 6) AS shift_pct FROM g WHERE a > 0 AND abs((b - a) / a * 100) > 30""")
def volume_shift(spark, folder):
    return prices.quantity_shift(prices.eligible(_series(spark, folder)))


@query(f"""WITH {_SERIES}, pts AS (SELECT DISTINCT vendor, item, day, price, invoice FROM series),
  rates AS (SELECT vendor, item, min(day) AS start, arg_min(price, (day, invoice, price, quantity)) AS rate FROM series GROUP BY vendor, item, year(day)),
  held AS (SELECT p.*, start, rate, rate * pow(1.03, ((year(day) - year(start)) * 12 + month(day) - month(start)) / 12.0) * 1.05 AS allowed FROM pts p JOIN rates r ON p.vendor = r.vendor AND p.item = r.item AND start <= day
    QUALIFY row_number() OVER (PARTITION BY p.vendor, p.item, day, price, invoice ORDER BY start DESC) = 1)
  SELECT vendor, item, invoice, day, round(price, 6) AS price, round(allowed, 6) AS allowed FROM held WHERE price > allowed""")
def contract_rate_breach(spark, folder):
    s = _series(spark, folder)
    rates = s.groupBy("vendor", "item", F.year("day").alias("y")).agg(F.min("day").alias("start"), F.min_by("price", F.struct("day", "seq")).alias("rate")).drop("y")
    return prices.rate_as_of(s.select("vendor", "item", "day", "price", "invoice").distinct(), rates, 0.03, 0.05).select("vendor", "item", "invoice", "day", "price", "allowed")


@query(f"WITH {_SERIES} SELECT vendor, tier, round(sum(quantity), 6) AS quantity FROM series, (VALUES (10000.0::DOUBLE), (14000.0::DOUBLE), (15000.0::DOUBLE)) t(tier) GROUP BY 1, 2 HAVING sum(quantity) >= tier")
def volume_commitment(spark, folder):
    """Every volume tier that a vendor's quantity reaches: one row for each."""
    total = series(spark, folder).groupBy("vendor").agg(F.sum("quantity").alias("quantity"))
    tiers = F.explode(F.array(*[F.lit(float(x)) for x in (10000, 14000, 15000)])).alias("tier")
    return total.select("vendor", "quantity", tiers).where("quantity >= tier")


@query(f"""WITH {_SERIES}, ends AS (SELECT vendor, DATE '1998-01-01' AS ends FROM series GROUP BY 1)
  SELECT vendor, max(day - ends) AS days_past, count(*) AS n, round(sum(amount), 6) AS amount, list(DISTINCT invoice ORDER BY invoice)[1:10] AS first_invoices FROM series JOIN ends USING (vendor) WHERE day > ends GROUP BY 1""")
def contract_expiry(spark, folder):
    """What was billed after an agreement ended, with the ten smallest invoice numbers."""
    s = series(spark, folder).withColumn("ends", F.lit("1998-01-01").cast("date")).where("day > ends")
    ids = s.select("vendor", "invoice").distinct()
    from pyspark.sql import Window

    first = ids.withColumn("k", F.row_number().over(Window.partitionBy("vendor").orderBy("invoice"))).where("k <= 10").groupBy("vendor").agg(F.array_sort(F.collect_list("invoice")).alias("first_invoices"))
    rest = s.groupBy("vendor").agg(F.max(F.date_diff("day", "ends")).cast("long").alias("days_past"), F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return rest.join(first, "vendor")


# --- statistics -----------------------------------------------------------------------------------------------------------

_DIGITS = "CAST(substr(regexp_replace(printf('%.2f', abs(amount)), '^[0.]+', ''), 1, 1) AS INTEGER)"
_BENFORD = "".join(f", count(*) FILTER (d = {d}) AS d{d}" for d in range(1, 10))
_CHI2 = " + ".join(f"pow(d{d} - n * log10(1 + 1.0 / {d}), 2) / (n * log10(1 + 1.0 / {d}))" for d in range(1, 10))
_MAD = "(" + " + ".join(f"abs(d{d}::DOUBLE / n - log10(1 + 1.0 / {d}))" for d in range(1, 10)) + ") / 9"


@query(f"""WITH {_SERIES}, c AS (SELECT vendor, count(*) AS n{_BENFORD} FROM (SELECT vendor, {_DIGITS} AS d FROM series WHERE abs(amount) > 0) WHERE d BETWEEN 1 AND 9 GROUP BY 1 HAVING count(*) >= 50),
  x AS (SELECT vendor, n, {_CHI2} AS chi2, {_MAD} AS mad FROM c)
  SELECT vendor, n, round(chi2, 6) AS chi2, round(mad, 6) AS mad, round(exp(-chi2 / 2) * (1 + chi2 / 2 + pow(chi2 / 2, 2) / 2 + pow(chi2 / 2, 3) / 6), 6) AS p_value FROM x""")
def benford_by_vendor(spark, folder):
    return stats.benford(series(spark, folder), "vendor", "amount")


@query(f"""WITH {_HEADERS}, c AS (SELECT vendor_id, count(*) AS n, count(*) FILTER (total_amount >= 4500 AND total_amount < 5000) AS in_band FROM headers WHERE total_amount > 0 AND vendor_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 20)
  SELECT vendor_id, n, in_band, round(n * 0.1::DOUBLE, 6) AS expected, round(pow(in_band - n * 0.1, 2) / (n * 0.1) + pow(n - in_band - n * 0.9, 2) / (n * 0.9), 6) AS chi2 FROM c""")
def threshold_clustering(spark, folder):
    h = headers(spark, folder, "vendor_id", "total_amount").withColumn("total_amount", F.col("total_amount").cast("double"))
    return stats.threshold_band(h, "vendor_id", "total_amount", 5000)


@query("SELECT user_id, count(*) AS n, round(CASE WHEN count(*) >= 2 AND var_pop(value) > 1e-9 AND var_pop(CAST(hour(ts) AS DOUBLE)) > 0 THEN corr(value, CAST(hour(ts) AS DOUBLE)) ELSE 0 END, 6) AS correlation FROM events GROUP BY 1")
def pearson_by_user(spark, folder):
    e = table(spark, folder, "events").withColumn("h", F.hour("ts").cast("double"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), stats.pearson("value", "h").alias("correlation"))


@query("""WITH o AS (SELECT o_orderpriority AS k, count(*) FILTER (o_orderstatus = 'F') AS o, count(*) AS e FROM orders GROUP BY 1), s AS (SELECT sum(o)::DOUBLE / sum(e) AS r FROM o)
  SELECT round(sum(pow(o - e * r, 2) / (e * r)), 6) AS chi2, count(*) - 1 AS dof FROM o, s""")
def priority_chi_squared(spark, folder):
    """Whether finished orders have other priorities than all orders."""
    o = table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("o"), F.count(F.lit(1)).alias("e"))
    return stats.chi_squared(o.select("o_orderpriority", F.col("o").alias("n")), o.select("o_orderpriority", F.col("e").alias("n")), "o_orderpriority", "n")


@query("""WITH q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
  s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q, e), 6) AS similarity FROM q, v WHERE query_id <> vec_id)
  SELECT query_id, vec_id, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= 10""")
def cosine_topk(spark, folder):
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    return search.nearest(table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 10)


# --- scalar functions -----------------------------------------------------------------------------------------------------


@query(rf"""WITH v AS (SELECT DISTINCT vendor_id, vendor_name, address, phone FROM vendors)
  SELECT vendor_id, {_norm('vendor_name')} AS text, trim(regexp_replace({_norm('vendor_name')}, '(\s+({"|".join(text.LEGAL_FORMS)}))+$', '')) AS name,
  CASE WHEN length(regexp_replace(coalesce(phone, ''), '\D', '', 'g')) = 11 AND regexp_replace(coalesce(phone, ''), '\D', '', 'g') LIKE '1%' THEN substr(regexp_replace(coalesce(phone, ''), '\D', '', 'g'), 2) ELSE regexp_replace(coalesce(phone, ''), '\D', '', 'g') END AS phone
  FROM v""")
def text_normalise(spark, folder):
    v = table(spark, folder, "vendors").select("vendor_id", "vendor_name", "address", "phone").distinct()
    return v.select("vendor_id", text.normalize_text(F.col("vendor_name")).alias("text"), text.normalize_vendor_name(F.col("vendor_name")).alias("name"), text.normalize_phone(F.col("phone")).alias("phone"))


@query(f"SELECT DISTINCT alias_text, canonical_name, {_norm('alias_text')} = {_norm('canonical_name')} AS same FROM vendor_aliases")
def alias_exact_match(spark, folder):
    a = table(spark, folder, "vendor_aliases").select("alias_text", "canonical_name").distinct()
    return a.withColumn("same", text.exact_match(F.col("alias_text"), F.col("canonical_name")))


_EXPAND = "list_transform(list_filter(string_split(regexp_replace(regexp_replace(trim(lower(coalesce(address, ''))), '(\\b(suite|ste\\.?|apt\\.?|unit)|#)\\s*\\w+', '', 'g'), '\\s+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: CASE " + " ".join(f"WHEN w IN ('{s}', '{s}.') THEN '{f}'" for s, f in text.STREET_SHORT.items()) + " ELSE w END)"


@query(f"SELECT DISTINCT vendor_id, array_to_string({_EXPAND}, ' ') AS address FROM vendors")
def address_normalise(spark, folder):
    return table(spark, folder, "vendors").select("vendor_id", text.normalize_address(F.col("address")).alias("address")).distinct()


@query(rf"""WITH {_HEADERS} SELECT invoice_id, abs(payment_date - invoice_date) AS days, abs((year(payment_date) - year(invoice_date)) * 12 + month(payment_date) - month(invoice_date)) AS months,
  isodow(invoice_date) >= 6 AS weekend, isodow(invoice_date) < 6 AS business_day, CAST(year(invoice_date) AS VARCHAR) || '-Q' || quarter(invoice_date) AS quarter, isoyear(invoice_date) || '-W' || lpad(CAST(week(invoice_date) AS VARCHAR), 2, '0') AS week, strftime(invoice_date, '%Y-%m') AS month FROM headers WHERE invoice_date IS NOT NULL""")
def date_periods(spark, folder):
    h = headers(spark, folder, "invoice_date", "payment_date").where("invoice_date is not null")
    a, b = F.col("invoice_date"), F.col("payment_date")
    return h.select("invoice_id", dates.days_between(a, b).cast("long").alias("days"), dates.months_between(a, b).cast("long").alias("months"), dates.is_weekend(a).alias("weekend"), dates.is_business_day(a).alias("business_day"), dates.quarter_label(a).alias("quarter"), dates.period(a, "weekly").alias("week"), dates.period(a, "monthly").alias("month"))


@query("SELECT DISTINCT o_orderkey, CAST(o_orderdate AS DATE) AS parsed FROM orders")
def date_parse(spark, folder):
    """A round trip: order dates written in five formats, by day, and read again."""
    o = table(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d")).distinct()
    forms = ["yyyy-MM-dd", "MM/dd/yyyy", "dd-MMM-yyyy", "MMMM d, yyyy", "d MMM yyyy"]
    written = F.coalesce(*[F.when(F.day("d") % len(forms) == i, F.date_format("d", f)) for i, f in enumerate(forms)])
    return o.select("o_orderkey", dates.parse_date(written).alias("parsed"))


@query(f"WITH {_HEADERS} SELECT invoice_id, total_amount AS parsed FROM headers WHERE total_amount IS NOT NULL")
def amount_parse(spark, folder):
    """A round trip: totals written with signs, separators, parentheses and credit words, and read again."""
    h = headers(spark, folder, "total_amount").where("total_amount is not null")
    c, size = F.col("total_amount"), F.abs("total_amount")
    us = F.format_number(size, 2)
    eu = F.translate(us, ",.", ".,")
    k = F.pmod(F.xxhash64("invoice_id"), F.lit(3))
    plus = F.when(k == 0, F.concat(F.lit("$"), us)).when((k == 1) & (size >= 1000), F.concat(eu, F.lit(" €"))).otherwise(us)
    minus = F.when(k == 0, F.concat(F.lit("("), us, F.lit(")"))).when(k == 1, F.concat(us, F.lit(" CR"))).otherwise(F.concat(F.lit("-"), us))
    return h.select("invoice_id", amounts.parse_amount(F.when(c < 0, minus).otherwise(plus)).alias("parsed"))


def _tax_case() -> str:
    whens = []
    for rate in amounts.TAX_RATES:
        w = 10_000 + rate
        net = f"((c * 20000 + {w}) // {2 * w})"
        whens.append(f"WHEN abs(({net} * {2 * w} + 10000) // 20000 - c) <= 1 AND {net} % 25 = 0 THEN c - {net}")
    return "CASE " + " ".join(whens) + " ELSE 0 END"


@query(f"""WITH {_HEADERS}, c AS (SELECT invoice_id, total_amount, payment_status, CAST(abs(total_amount * 100) AS BIGINT) AS c FROM headers),
  t AS (SELECT *, {_tax_case()} AS tax FROM c)
  SELECT invoice_id, total_amount AS gross_amount, CAST(CASE WHEN total_amount IS NULL THEN NULL ELSE tax END / 100.0 AS DECIMAL(18,2)) AS tax_amount, CAST((c - tax) / 100.0 AS DECIMAL(18,2)) AS net_amount,
  coalesce(total_amount < 0, false) AS credit, CASE WHEN total_amount IS NULL THEN 'unreadable' WHEN total_amount = 0 THEN 'zero' WHEN abs(total_amount) > 10000000 THEN 'very large' ELSE '' END AS issues FROM t""")
def amount_normalise(spark, folder):
    h = amounts.with_tax(headers(spark, folder, "total_amount", "payment_status"), "total_amount")
    tax = F.when(F.col("gross_amount").isNotNull(), F.col("tax_amount"))
    return h.select("invoice_id", "gross_amount", tax.alias("tax_amount"), "net_amount", amounts.is_credit(F.col("gross_amount"), F.col("payment_status")).alias("credit"), F.array_join(amounts.amount_issues(F.col("gross_amount")), ", ").alias("issues"))


@query("""SELECT DISTINCT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 1.5 ELSE 0.0 END::DOUBLE AS discount, CAST(CASE c_custkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 15 ELSE 0 END AS INTEGER) AS discount_days,
  CAST(CASE c_custkey % 4 WHEN 0 THEN 30 WHEN 1 THEN 45 WHEN 2 THEN 60 ELSE 0 END AS INTEGER) AS net_days FROM customer""")
def payment_terms(spark, folder):
    """Terms written for each customer, read into numbers."""
    k = F.col("c_custkey") % 4
    terms = F.when(k == 0, "2/10 Net 30").when(k == 1, "1.5% / 15, net 45").when(k == 2, "NET 60").otherwise("Due on receipt")
    got = text.payment_terms(terms)
    return table(spark, folder, "customer").select("c_custkey", *[c.alias(n) for n, c in got.items()]).distinct()


def _vague_sql(x: str) -> str:
    t = rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"
    words = f"string_split({t}, ' ')"
    q = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    units = "|".join([*text.UNIT_WORDS, "sq ft"])
    return rf"""CASE WHEN {t} = '' THEN 0 ELSE greatest(0, least(100, 50 + CASE WHEN len({words}) < 3 THEN -30 WHEN len({words}) < 5 THEN -15 ELSE 0 END
      + CASE WHEN len(list_filter(list_transform(string_split(lower({t}), ' '), lambda w: trim(w, '.,;:')), lambda w: NOT list_contains({q(text.GENERIC_TERMS)}, w))) = 0 THEN -40 ELSE 0 END
      + CASE WHEN regexp_matches(lower({t}), '\d+\s*({units})\b') THEN 20 ELSE 0 END + CASE WHEN regexp_matches({t}, '\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}') THEN 15 ELSE 0 END
      + CASE WHEN regexp_matches({t}, '\s\p{{Lu}}') THEN 10 ELSE 0 END + CASE WHEN list_has_any(string_split(lower({t}), ' '), {q(text.UNIT_WORDS)}) THEN 15 ELSE 0 END
      + CASE WHEN regexp_matches(lower({t}), '{"|".join(text.DELIVERABLE_WORDS)}') THEN 15 ELSE 0 END)) END"""


@query(f"SELECT line_item_description, CAST({_vague_sql('line_item_description')} AS INTEGER) AS score FROM (SELECT DISTINCT line_item_description FROM invoices)")
def vagueness_score(spark, folder):
    d = table(spark, folder, "invoices").select("line_item_description").distinct()
    return d.select("line_item_description", text.vagueness(F.col("line_item_description")).alias("score"))


def _keyword_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({q(k)}, {q(v)}, {i})" for i, (k, v) in enumerate(keywords().items()))
    return f"""WITH d AS (SELECT DISTINCT item_id, item_name FROM item_list), k(word, path, pos) AS (VALUES {rows})
      SELECT item_id, item_name, (SELECT arg_min(path, (-length(word), pos)) FROM k WHERE contains(lower(item_name), word)) AS category FROM d"""


@query(_keyword_sql())
def keyword_classify(spark, folder):
    d = table(spark, folder, "item_list").select("item_id", "item_name").distinct()
    return d.select("item_id", "item_name", classify(F.col("item_name")).alias("category"))


@query("SELECT DISTINCT vendor_id, substr(sha256(concat_ws('|', coalesce(vendor_name, ''), coalesce(category, ''))), 1, 16) AS hash FROM vendors")
def pattern_hash(spark, folder):
    return table(spark, folder, "vendors").select("vendor_id", text.pattern_hash(F.col("vendor_name"), F.col("category")).alias("hash")).distinct()


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_salvage(spark, folder):
    """JSON objects read from inside other text."""
    e = table(spark, folder, "events")
    return e.select("event_id", text.salvage_json(F.concat(F.lit("answer: "), "props", F.lit(" end")), "k int")["k"].alias("k"))


# --- duplicates and relations ---------------------------------------------------------------------------------------------


@query(f"WITH {_LINES} SELECT invoice_number, vendor_id, total_amount, count(DISTINCT invoice_id) AS invoices FROM lines WHERE invoice_number IS NOT NULL AND vendor_id IS NOT NULL AND total_amount IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT invoice_id) >= 2")
def exact_duplicates(spark, folder):
    return groups.exact_duplicates(table(spark, folder, "invoices").select("invoice_id", "invoice_number", "vendor_id", "total_amount"))


def _documents(spark, folder):
    """Invoices with the words and quantities of their lines."""
    ls = lines(spark, folder, "invoice_id", "line_item_description", "quantity")
    words = text.words_of(text.normalize_text(F.col("line_item_description")))
    parts = ls.groupBy("invoice_id").agg(F.array_distinct(F.flatten(F.collect_set(words))).alias("words"), F.collect_set("quantity").alias("quantities"))
    h = headers(spark, folder, "vendor_id", "invoice_date", "total_amount", "po_number").withColumn("po_number", blank_to_null("po_number"))
    # both sides of the self-joins read it
    return written(h.join(parts, "invoice_id"), "documents")


_DOCS = f"""{_LINES}, {_HEADERS}, parts AS (SELECT invoice_id, list_distinct(flatten(list(list_filter(string_split({_norm('line_item_description')}, ' '), lambda w: w <> '')))) AS words,
  coalesce(list(DISTINCT quantity) FILTER (quantity IS NOT NULL), []) AS quantities FROM lines GROUP BY 1),
  docs AS (SELECT h.invoice_id, vendor_id, invoice_date, total_amount, po, words, quantities FROM headers h JOIN parts USING (invoice_id) WHERE total_amount > 0 AND vendor_id IS NOT NULL)"""
_JACCARD = "CASE WHEN len(list_distinct(list_concat({x}, {y}))) = 0 THEN 0 ELSE len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) END"
_DIFF = "abs(a.total_amount - b.total_amount)::DOUBLE / greatest(a.total_amount, b.total_amount)::DOUBLE"
_SCORE = f"""round(CASE WHEN {_DIFF} <= 0.01 THEN 1.0 WHEN {_DIFF} <= 0.05 THEN 0.8 WHEN {_DIFF} <= 0.1 THEN 0.5 ELSE 0 END::DOUBLE * 0.3::DOUBLE
  + CASE WHEN b.invoice_date - a.invoice_date <= 0 THEN 1.0 WHEN b.invoice_date - a.invoice_date <= 7 THEN 0.8 WHEN b.invoice_date - a.invoice_date <= 30 THEN 0.5 WHEN b.invoice_date - a.invoice_date <= 90 THEN 0.2 ELSE 0 END::DOUBLE * 0.15::DOUBLE
  + CASE WHEN len(a.words) = 0 OR len(b.words) = 0 THEN 0.5 ELSE {_JACCARD.format(x='a.words', y='b.words')} END::DOUBLE * 0.3::DOUBLE
  + {_JACCARD.format(x='a.quantities', y='b.quantities')} * 0.1::DOUBLE
  + CASE WHEN a.po IS NULL OR b.po IS NULL THEN 0.5 WHEN a.po = b.po THEN 1.0 ELSE 0 END::DOUBLE * 0.15::DOUBLE, 6)"""
_PAIRS = f"""fuzzy AS (SELECT a.invoice_id AS invoice_id_a, b.invoice_id AS invoice_id_b, a.vendor_id, {_SCORE} AS score FROM docs a JOIN docs b ON a.vendor_id = b.vendor_id AND (a.invoice_date, a.invoice_id) < (b.invoice_date, b.invoice_id)
  AND b.invoice_date - a.invoice_date <= 90 WHERE {_DIFF} <= 0.2)"""


@query(f"WITH {_DOCS}, {_PAIRS} SELECT * FROM fuzzy WHERE score >= 0.85")
def fuzzy_duplicate_pairs(spark, folder):
    return pairs.duplicate_pairs(_documents(spark, folder))


@query(f"""WITH {_DOCS}, {_PAIRS}, known AS (SELECT least(invoice_id_a, invoice_id_b) AS a, greatest(invoice_id_a, invoice_id_b) AS b FROM fuzzy WHERE score >= 0.85)
  SELECT a.vendor_id, a.invoice_id AS invoice_id_a, b.invoice_id AS invoice_id_b FROM docs a JOIN docs b ON a.vendor_id = b.vendor_id AND a.invoice_id < b.invoice_id AND a.po <> b.po AND abs(a.invoice_date - b.invoice_date) <= 30
  WHERE {_DIFF} <= 0.1 AND {_JACCARD.format(x='a.words', y='b.words')} >= 0.5 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.a = a.invoice_id AND k.b = b.invoice_id)""")
def cross_po_duplicates(spark, folder):
    docs = _documents(spark, folder)
    return pairs.cross_order_pairs(docs, pairs.duplicate_pairs(docs), least=0.5)


def _described(spark, folder):
    """Invoices with the text of their lines, in line order, and their quantities."""
    ls = lines(spark, folder, "invoice_id", "line_item_description", "quantity").withColumn("unit_price", F.lit(None).cast("double"))
    parts = groups.collapse(ls.withColumn("line_item_description", blank_to_null("line_item_description")), ["invoice_id"])
    parts = parts.select("invoice_id", F.col("descriptions").alias("description"), F.array_distinct(F.array_compact("quantities")).alias("quantities"))
    h = headers(spark, folder, "vendor_id", "invoice_date", "total_amount", "po_number").withColumn("po_number", blank_to_null("po_number"))
    return written(h.join(parts, "invoice_id"), "described")


@query()
def similar_invoice_pairs(spark, folder):
    """Probable duplicates by the survey's text and order ratios; fuzzy_duplicate_pairs counts whole words, as its SQL does."""
    return pairs.similar_invoices(_described(spark, folder))


@query()
def similar_cross_po_pairs(spark, folder):
    """Like work under two order numbers by the survey's text ratio; cross_po_duplicates counts whole words, as its SQL does."""
    docs = _described(spark, folder)
    return pairs.similar_across_orders(docs, pairs.similar_invoices(docs))


@query(f"""WITH {_HEADERS}, h AS (SELECT *, CAST(total_amount AS DOUBLE) AS amount, round_even(CAST(total_amount AS DOUBLE), -2) AS bucket FROM headers WHERE vendor_id IS NOT NULL AND invoice_date IS NOT NULL AND total_amount > 0),
  g AS (SELECT *, invoice_date - lag(invoice_date) OVER (PARTITION BY vendor_id, bucket ORDER BY invoice_date, invoice_id) AS gap FROM h),
  x AS (SELECT vendor_id, bucket, count(*) AS n, CAST(sum(total_amount) AS DOUBLE) / count(*) AS m, avg(gap) AS gm, min(amount) AS lo, max(amount) AS hi, min(gap) AS gs, max(gap) AS gl FROM g GROUP BY 1, 2)
  SELECT vendor_id, bucket, n, round(m, 6) AS mean_amount, round(gm, 6) AS mean_gap FROM x WHERE n >= 3 AND hi - m <= m * 0.02 AND m - lo <= m * 0.02 AND gm >= 20 AND gl - gm <= 5 AND gm - gs <= 5""")
def recurring_invoices(spark, folder):
    return groups.recurring(headers(spark, folder, "vendor_id", "invoice_date", "total_amount"))


@query(f"""WITH {_HEADERS}, n AS (SELECT invoice_id, vendor_id, -total_amount AS amount FROM headers WHERE total_amount < 0 AND vendor_id IS NOT NULL), p AS (SELECT invoice_id, vendor_id, total_amount AS amount FROM headers WHERE total_amount > 0 AND vendor_id IS NOT NULL)
  SELECT invoice_id, 'credit' AS side FROM n WHERE EXISTS (SELECT 1 FROM p WHERE p.vendor_id = n.vendor_id AND abs(p.amount - n.amount) < 0.01 * p.amount)
  UNION ALL SELECT invoice_id, 'invoice' FROM p WHERE EXISTS (SELECT 1 FROM n WHERE p.vendor_id = n.vendor_id AND abs(p.amount - n.amount) < 0.01 * p.amount)""")
def credit_rebill(spark, folder):
    return pairs.credits_and_rebills(headers(spark, folder, "vendor_id", "total_amount"))


def _related_sql() -> str:
    clean = lambda c: f"CASE WHEN lower(trim({c})) NOT IN ('', 'none', 'n/a', 'na', 'unknown', 'tbd', '0000', '-') AND NOT regexp_full_match(trim({c}), '[0-]+') THEN lower(trim({c})) END"
    name = rf"list_distinct(list_filter(string_split(trim(regexp_replace({_norm('vendor_name')}, '(\s+({'|'.join(text.LEGAL_FORMS)}))+$', '')), ' '), lambda w: w <> ''))"
    j = _JACCARD.format(x="a.name", y="b.name")
    return rf"""WITH v AS (SELECT DISTINCT vendor_id, {clean('bank_account_last4')} AS bank, array_to_string({_EXPAND}, ' ') AS address, nullif(regexp_replace(coalesce(phone, ''), '\D', '', 'g'), '') AS phone, {clean('tax_id')} AS tax, {name} AS name, {clean('contact_person')} AS contact FROM vendors WHERE vendor_id IS NOT NULL),
      s AS (SELECT a.vendor_id AS vendor_a, b.vendor_id AS vendor_b, round(CASE WHEN a.address = b.address AND a.address <> '' THEN 0.65 ELSE 0 END::DOUBLE + CASE WHEN a.bank = b.bank THEN 0.65 ELSE 0 END::DOUBLE + CASE WHEN a.phone = b.phone THEN 0.15 ELSE 0 END::DOUBLE
        + CASE WHEN a.tax = b.tax THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN a.contact = b.contact THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN {j} >= 0.5 THEN ({j}) * 0.15::DOUBLE ELSE 0 END::DOUBLE, 6) AS score
      FROM v a JOIN v b ON a.vendor_id < b.vendor_id AND ((a.address = b.address AND a.address <> '') OR (a.bank = b.bank AND (a.phone = b.phone OR a.tax = b.tax OR a.contact = b.contact OR a.address = b.address OR len(list_intersect(a.name, b.name)) > 0))))
      SELECT vendor_a, vendor_b, max(score) AS score FROM s WHERE score >= 0.6 GROUP BY 1, 2"""


@query(_related_sql())
def vendor_relationships(spark, folder):
    """What its SQL says: equal values only, an equal bank number only beside another sign. related_vendor_pairs has the whole rule."""
    return pairs.related_by_equality(vendors(spark, folder))


@query()
def vendor_name_pairs(spark, folder):
    """Vendors entered twice under similar names, to be merged or to be looked at."""
    return pairs.similar_names(vendors(spark, folder))


@query()
def related_vendor_pairs(spark, folder):
    """Related vendors by the survey's whole rule, with near addresses and names."""
    return pairs.related_vendors(vendors(spark, folder))


@query()
def coordinated_invoicing(spark, folder):
    """How the monthly numbers of invoices of related vendors move together."""
    found = pairs.related_vendors(vendors(spark, folder))
    return groups.monthly_correlation(headers(spark, folder, "vendor_id", "invoice_date"), found)


@query(f"""WITH {_HEADERS}, u AS (SELECT vendor_id, arg_min(nm, (-n, nm)) AS vendor_name FROM (SELECT vendor_id, trim(vendor_name) AS nm, count(*) AS n FROM headers WHERE vendor_id IS NOT NULL AND trim(vendor_name) <> '' GROUP BY 1, 2) GROUP BY 1),
  m AS (SELECT DISTINCT vendor_id, vendor_name FROM vendors WHERE vendor_id IS NOT NULL)
  SELECT coalesce(u.vendor_id, m.vendor_id) AS vendor_id, coalesce(nullif(trim(u.vendor_name), ''), nullif(trim(m.vendor_name), '')) AS vendor_name FROM u FULL JOIN m ON u.vendor_id = m.vendor_id""")
def vendor_enrichment(spark, folder):
    used = groups.usual_name(headers(spark, folder, "vendor_id", "vendor_name"), "vendor_id", "vendor_name").drop("times")
    return groups.enrich(used, vendors(spark, folder), "vendor_id", ["vendor_name"])


# --- grouped measures -----------------------------------------------------------------------------------------------------


@query(f"""WITH {_LINES} SELECT invoice_id, vendor_id, coalesce(string_agg(line_item_description, ' | ' ORDER BY line_item_id), '') AS descriptions, round(sum(quantity), 6) AS quantity, count(*) AS lines FROM lines GROUP BY 1, 2""")
def line_collapse(spark, folder):
    ls = table(spark, folder, "invoices").where("line_item_id is not null").select("line_item_id", "invoice_id", "vendor_id", "line_item_description", "quantity", "unit_price").distinct()
    got = groups.collapse(ls, ["invoice_id", "vendor_id"])
    total = F.aggregate(F.filter("quantities", lambda q: q.isNotNull()), F.lit(0.0), lambda s, q: s + q)
    some = F.exists("quantities", lambda q: q.isNotNull())
    return got.select("invoice_id", "vendor_id", "descriptions", F.when(some, total).alias("quantity"), F.col("lines").cast("long").alias("lines"))


@query(f"""WITH {_LINES}, g AS (SELECT invoice_id, max(total_amount) AS total, sum(line_total) AS s FROM lines WHERE invoice_id IS NOT NULL AND total_amount IS NOT NULL GROUP BY 1)
  SELECT invoice_id, total, CAST(coalesce(s, 0) AS DECIMAL(28,2)) AS line_sum, CAST(abs(total - coalesce(s, 0)) AS DECIMAL(28,2)) AS difference, CASE WHEN total <> 0 THEN CAST(abs(total - coalesce(s, 0)) AS DOUBLE) / CAST(abs(total) AS DOUBLE) * 100 WHEN s = 0 THEN 0 ELSE 100 END <= 1 AS matches FROM g""")
def line_reconciliation(spark, folder):
    got = quality.reconcile(lines(spark, folder, "invoice_id", "total_amount", "line_total"))
    return got.withColumns({"line_sum": F.col("line_sum").cast("decimal(28,2)"), "difference": F.col("difference").cast("decimal(28,2)")})


def _sliding_sql() -> str:
    one = []
    for days in (7, 14, 30):
        w = f"OVER (PARTITION BY vendor_id ORDER BY invoice_date RANGE BETWEEN CURRENT ROW AND INTERVAL {days} DAYS FOLLOWING)"
        limit = "CASE " + " ".join(f"WHEN max(total_amount) {w} < {x} AND sum(total_amount) {w} >= {x} THEN {x}.0::DOUBLE" for x in LIMITS) + " END"
        one.append(f"SELECT vendor_id, invoice_id, {days} AS window_days, count(*) {w} AS n, round(CAST(sum(total_amount) {w} AS DOUBLE), 6) AS total, {limit} AS limit_amount FROM h")
    return f"WITH {_HEADERS}, h AS (SELECT * FROM headers WHERE vendor_id IS NOT NULL AND invoice_date IS NOT NULL AND total_amount > 0) SELECT * FROM (" + " UNION ALL ".join(one) + ") WHERE n >= 4 AND limit_amount IS NOT NULL"


@query(_sliding_sql())
def temporal_split_windows(spark, folder):
    return groups.sliding_clusters(headers(spark, folder, "vendor_id", "invoice_date", "total_amount"), LIMITS)


_LIMIT = "CASE " + " ".join(f"WHEN max(total_amount) < {x} AND sum(total_amount) >= {x} THEN {x}.0::DOUBLE" for x in LIMITS) + " END"


@query(f"WITH {_HEADERS} SELECT vendor_id, po AS po_number, count(*) AS n, round(CAST(sum(total_amount) AS DOUBLE), 6) AS total, {_LIMIT} AS limit_amount FROM headers WHERE vendor_id IS NOT NULL AND po IS NOT NULL AND total_amount > 0 GROUP BY 1, 2 HAVING count(*) >= 2 AND {_LIMIT} IS NOT NULL")
def po_linked_split(spark, folder):
    return groups.order_sums(headers(spark, folder, "vendor_id", "total_amount", "po_number").withColumn("po_number", blank_to_null("po_number")), LIMITS)


@query(f"""WITH {_HEADERS}, q AS (SELECT vendor_id, CAST(year(invoice_date) AS VARCHAR) || '-Q' || quarter(invoice_date) AS quarter, count(*) AS n, CAST(sum(total_amount) * 100 AS BIGINT) AS cents FROM headers WHERE vendor_id IS NOT NULL AND invoice_date IS NOT NULL AND total_amount > 0 GROUP BY 1, 2),
  m AS (SELECT *, max(quarter) OVER w AS l, count(*) OVER w AS nq, sum(n) OVER w AS na FROM q WINDOW w AS (PARTITION BY vendor_id)),
  g AS (SELECT vendor_id, l AS last_quarter, CAST(sum(n) FILTER (quarter = l) AS BIGINT) AS last_n, sum(cents) FILTER (quarter = l)::DOUBLE AS lc, sum(n) FILTER (quarter <> l)::DOUBLE AS pn, sum(cents) FILTER (quarter <> l)::DOUBLE AS pc, count(*) FILTER (quarter <> l)::DOUBLE AS pq FROM m WHERE nq >= 3 AND na >= 8 GROUP BY 1, 2),
  k AS (SELECT vendor_id, last_quarter, round(lc / 100.0::DOUBLE / last_n, 6) AS last_avg, round(pc / 100.0::DOUBLE / pn, 6) AS prior_avg, last_n, round(pn / pq, 6) AS prior_n,
    CASE WHEN lc / 100.0::DOUBLE / last_n <= pc / 100.0::DOUBLE / pn * 0.6::DOUBLE AND lc / (pc / pq) >= 0.8 THEN 'amount' WHEN last_n > pn / pq * 1.5 AND lc / (pc / pq) <= 1.2 THEN 'frequency' END AS kind FROM g)
  SELECT * FROM k WHERE kind IS NOT NULL""")
def quarter_pattern_change(spark, folder):
    return groups.quarter_change(headers(spark, folder, "vendor_id", "invoice_date", "total_amount"))


_SPLIT = f"""{_HEADERS}, r AS (SELECT *, count(*) OVER (PARTITION BY vendor_id) AS nv, row_number() OVER (PARTITION BY vendor_id ORDER BY invoice_date, invoice_id) AS k FROM headers WHERE vendor_id IS NOT NULL AND invoice_date IS NOT NULL AND total_amount > 0),
  s AS (SELECT *, k > least(greatest(CAST(floor(nv * 0.75) AS BIGINT), 6), nv - 1) AS recent, CAST(total_amount AS DOUBLE) AS amount FROM r WHERE nv > 6),
  gaps AS (SELECT *, invoice_date - lag(invoice_date) OVER (PARTITION BY vendor_id, recent ORDER BY invoice_date, invoice_id) AS gap FROM s),
  base AS (SELECT vendor_id, recent, count(*) AS n, CAST(sum(total_amount) * 100 AS BIGINT) AS cents, avg(amount) AS m, coalesce(stddev_samp(amount), avg(amount) * 0.2) AS sd, max(amount) AS mx, coalesce(avg(gap), 30.0) AS g, coalesce(stddev_samp(gap), coalesce(avg(gap), 30.0) * 0.3) AS gsd FROM gaps GROUP BY 1, 2)"""


@query(f"WITH {_SPLIT} SELECT vendor_id, n, {_CENTS.format(cents='cents')} AS mean_amount, round(sd, 4) AS std_amount, mx AS max_amount, round(g, 6) AS mean_gap, round(gsd, 4) AS std_gap FROM base WHERE NOT recent")
def vendor_baseline(spark, folder):
    h = groups.split_history(headers(spark, folder, "vendor_id", "invoice_date", "total_amount"))
    b = groups.baseline(h.where("not recent"))
    return b.withColumns({"mean_amount": _whole_cents(), "std_amount": F.round("std_amount", 4), "std_gap": F.round("std_gap", 4)}).drop("cents")


@query(f"WITH {_SPLIT}, z AS (SELECT invoice_id, s.vendor_id, CASE WHEN sd > 0 THEN (amount - m) / sd ELSE 0 END AS zscore FROM s JOIN base b ON s.vendor_id = b.vendor_id AND NOT b.recent WHERE s.recent) SELECT invoice_id, vendor_id, round(zscore, 6) AS zscore, CASE WHEN abs(zscore) >= 3 THEN 'severe' ELSE 'warning' END AS level FROM z WHERE abs(zscore) >= 2.5")
def amount_zscore(spark, folder):
    return groups.unusual_amounts(headers(spark, folder, "vendor_id", "invoice_date", "total_amount"))


@query(f"""WITH {_SPLIT}, d AS (SELECT a.vendor_id, (a.m - b.m) / b.m AS amount_change, (a.g - b.g) / nullif(b.g, 0) AS gap_change FROM base a JOIN base b ON a.vendor_id = b.vendor_id AND a.recent AND NOT b.recent)
  SELECT vendor_id, round(amount_change, 6) AS amount_change, round(gap_change, 6) AS gap_change, 2 AS signs FROM d WHERE abs(amount_change) > 0.3 AND abs(gap_change) > 0.4""")
def baseline_drift(spark, folder):
    h = groups.split_history(headers(spark, folder, "vendor_id", "invoice_date", "total_amount"))
    return groups.drift(groups.baseline(h.where("recent")), groups.baseline(h.where("not recent")))


def _key_sql(x: str) -> str:
    n = _norm(x)
    k = f"array_to_string(list_filter(string_split({n}, ' '), lambda w: length(w) >= 3)[1:2], ' ')"
    return f"CASE WHEN {k} <> '' THEN {k} ELSE {n} END"


_KEYS = f"{_LINES}, c AS (SELECT vendor_id, {_key_sql('line_item_description')} AS kind, count(*) AS n FROM lines WHERE vendor_id IS NOT NULL AND line_item_description IS NOT NULL GROUP BY 1, 2), a AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY vendor_id) AS share, sum(n) OVER (PARTITION BY vendor_id) AS nv FROM c)"


def _kinds(spark, folder):
    ls = lines(spark, folder, "vendor_id", "line_item_description").where("line_item_description is not null")
    return ls.select("vendor_id", text.category_key(F.col("line_item_description")).alias("kind"))


@query(f"WITH {_KEYS} SELECT vendor_id, kind, n, round(share, 6) AS share FROM a WHERE nv >= 5 AND share < 0.01")
def category_mismatch(spark, folder):
    return groups.rare_categories(_kinds(spark, folder), "kind")


@query(f"WITH {_KEYS} SELECT vendor_id, kind, n, round(share, 6) AS share FROM a WHERE nv >= 5 AND n = 1")
def one_off_charges(spark, folder):
    return groups.rare_categories(_kinds(spark, folder), "kind", once=True)


@query(f"""WITH {_HEADERS}, v AS (SELECT vendor_id, count(*) AS n, count(*) FILTER (po IS NULL) AS blank FROM headers WHERE vendor_id IS NOT NULL GROUP BY 1)
  SELECT invoice_id, h.vendor_id, total_amount FROM headers h JOIN v USING (vendor_id) WHERE po IS NULL AND total_amount >= 1000 AND NOT (n >= 10 AND blank >= 0.8 * n)""")
def po_gap(spark, folder):
    """Invoices without an order of vendors that usually have one."""
    return _without_order(headers(spark, folder, "vendor_id", "total_amount", "po_number").withColumn("po_number", blank_to_null("po_number")))


def _without_order(h: DataFrame) -> DataFrame:
    v = h.where("vendor_id is not null").groupBy("vendor_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("po_number").isNull()).alias("blank"))
    return h.where("po_number is null and total_amount >= 1000").join(v, "vendor_id").where("not (n >= 10 and blank >= 0.8 * n)").select("invoice_id", "vendor_id", "total_amount")


@query(f"""WITH {_HEADERS}, k AS (SELECT DISTINCT invoice_id FROM goods_receipts WHERE invoice_id IS NOT NULL), c AS (SELECT count(k.invoice_id)::DOUBLE / count(*) AS share FROM headers h LEFT JOIN k ON h.invoice_id = k.invoice_id)
  SELECT invoice_id, vendor_id FROM headers h, c WHERE share >= 0.2 AND NOT EXISTS (SELECT 1 FROM k WHERE k.invoice_id = h.invoice_id)""")
def receipt_gap(spark, folder):
    return groups.without_receipt(headers(spark, folder, "vendor_id"), table(spark, folder, "goods_receipts"), 0.2).select("invoice_id", "vendor_id")


@query(f"""WITH {_HEADERS}, c AS (SELECT vendor_id, approved_by, count(*) AS n FROM headers WHERE vendor_id IS NOT NULL AND approved_by IS NOT NULL GROUP BY 1, 2),
  t AS (SELECT vendor_id, sum(n) AS a, max(n) AS m, arg_min(approved_by, (-n, approved_by)) AS who FROM c GROUP BY 1) SELECT vendor_id, who AS approved_by, CAST(m AS BIGINT) AS n, round(m::DOUBLE / a, 6) AS share FROM t WHERE a >= 3 AND m::DOUBLE / a >= 0.2""")
def approval_concentration(spark, folder):
    return groups.top_share(headers(spark, folder, "vendor_id", "approved_by"), "vendor_id", "approved_by", share=0.2).withColumn("n", F.col("n").cast("long"))


@query(f"""WITH {_HEADERS}, m AS (SELECT vendor_id, count(*) AS n, CAST(sum(total_amount) * 100 AS BIGINT) AS cents, sum(total_amount)::DOUBLE / count(*) AS mean_amount FROM headers WHERE vendor_id IS NOT NULL AND total_amount > 0 GROUP BY 1), r AS (SELECT quantile_cont(mean_amount, 0.75) AS reference FROM m)
  SELECT vendor_id, {_CENTS.format(cents='cents')} AS mean_amount, round(reference, 4) AS reference FROM m, r WHERE mean_amount > reference * 1.15""")
def overbilling_benchmark(spark, folder):
    got = groups.overbilling(headers(spark, folder, "vendor_id", "total_amount"))
    return got.select("vendor_id", _whole_cents().alias("mean_amount"), F.round("reference", 4).alias("reference"))


# --- data quality ---------------------------------------------------------------------------------------------------------

_FIELDS = ["invoice_number", "vendor_id", "vendor_name", "invoice_date", "total_amount", "po_number", "payment_date", "payment_status", "line_item_description", "quantity", "unit_price"]
_GIVEN = {c: f"count(*) FILTER ({c} IS NOT NULL" + ("" if c in ("invoice_date", "total_amount", "payment_date", "quantity", "unit_price") else f" AND trim({c}) <> ''") + ")" for c in _FIELDS}
_FILLED = "filled AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, {e} AS filled, {e}::DOUBLE / count(*) AS share FROM invoices" for c, e in _GIVEN.items()) + ")"


@query(f"WITH {_FILLED} SELECT field, filled, round(share, 6) AS share FROM filled")
def dq_completeness(spark, folder):
    return quality.completeness(table(spark, folder, "invoices"), _FIELDS)


@query("""SELECT count(*) AS rows, count(*) FILTER (total_amount IS NULL) AS amount_missing, count(*) FILTER (total_amount < 0) AS amount_negative, count(*) FILTER (invoice_date IS NULL) AS date_missing,
  count(*) FILTER (coalesce(trim(invoice_number), '') = '' OR coalesce(trim(vendor_name), '') = '' OR invoice_date IS NULL OR total_amount IS NULL) AS required_missing, min(invoice_date) AS first_date, max(invoice_date) AS last_date, count(DISTINCT vendor_id) AS vendors FROM invoices""")
def dq_types(spark, folder):
    return quality.checks(table(spark, folder, "invoices"))


@query(f"WITH {_FILLED}, need(module, field) AS (VALUES " + ", ".join(f"('{m}', '{c}')" for m, cs in quality.NEEDS.items() for c in cs) + ") SELECT module, round(avg(coalesce(share, 0)), 6) AS readiness, min(coalesce(share, 0)) > 0 AS ready FROM need LEFT JOIN filled USING (field) GROUP BY 1")
def dq_readiness(spark, folder):
    return quality.readiness(quality.completeness(table(spark, folder, "invoices"), _FIELDS))


# --- findings -------------------------------------------------------------------------------------------------------------


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """The findings of five analyses on the invoices, in the common form."""
    h = headers(spark, folder, "invoice_number", "vendor_id", "invoice_date", "total_amount", "po_number")
    # five analyses read the headers: they are found once and written, each analysis then reads the columns it needs
    h = written(h.withColumn("po_number", blank_to_null("po_number")), "headers")
    dup = groups.exact_duplicates(h)
    dup = h.join(dup, ["invoice_number", "vendor_id", "total_amount"])
    level = lambda x: F.lit(x)
    odd = groups.unusual_amounts(h).join(h.select("invoice_id", "total_amount"), "invoice_id")
    gap = _without_order(h)
    none = groups.without_receipt(h.where("total_amount >= 1000 and vendor_id is not null"), table(spark, folder, "goods_receipts"), 0.2)
    split = h.join(groups.order_sums(h, LIMITS).select("vendor_id", "po_number"), ["vendor_id", "po_number"]).where("total_amount > 0")
    amount = F.abs("total_amount")
    return adj.union_findings(
        [
            adj.finding(dup, "duplicate_detection", "exact", level("critical"), F.lit(0.99), amount),
            adj.finding(odd, "vendor_behavior", "amount", F.when(F.col("level") == "severe", "critical").otherwise("review"), F.when(F.col("level") == "severe", 0.85).otherwise(0.65), amount),
            adj.finding(gap, "phantom_services", "no order", level("review"), F.lit(0.75), amount),
            adj.finding(none, "phantom_services", "no receipt", level("review"), F.lit(0.80), amount),
            adj.finding(split, "split_invoicing", "order", level("review"), F.lit(0.75), amount),
        ]
    )


def _f(module: str, method: str, severity: str, confidence: str, source: str) -> str:
    return f"SELECT 'F-' || substr(sha256('{module}|{method}|' || coalesce(vendor_id, '') || '|' || coalesce(invoice_id, '')), 1, 12) AS finding_id, '{module}' AS module, '{method}' AS method, {severity} AS severity, {confidence}::DOUBLE AS confidence, vendor_id, invoice_id, CAST(abs(total_amount) AS DOUBLE) AS amount FROM ({source})"


_FINDINGS = (
    f"""{_SPLIT}, dup AS (SELECT invoice_number, vendor_id, total_amount FROM headers WHERE invoice_number IS NOT NULL AND vendor_id IS NOT NULL AND total_amount IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT invoice_id) >= 2),
  z AS (SELECT invoice_id, s.vendor_id, total_amount, CASE WHEN sd > 0 THEN (amount - m) / sd ELSE 0 END AS zscore FROM s JOIN base b ON s.vendor_id = b.vendor_id AND NOT b.recent WHERE s.recent),
  pv AS (SELECT vendor_id, count(*) AS n, count(*) FILTER (po IS NULL) AS blank FROM headers WHERE vendor_id IS NOT NULL GROUP BY 1), kr AS (SELECT DISTINCT invoice_id FROM goods_receipts WHERE invoice_id IS NOT NULL),
  big AS (SELECT * FROM headers WHERE total_amount >= 1000 AND vendor_id IS NOT NULL), cr AS (SELECT count(kr.invoice_id)::DOUBLE / count(*) AS share FROM big LEFT JOIN kr ON big.invoice_id = kr.invoice_id),
  os AS (SELECT vendor_id, po FROM headers WHERE vendor_id IS NOT NULL AND po IS NOT NULL AND total_amount > 0 GROUP BY 1, 2 HAVING count(*) >= 2 AND {_LIMIT} IS NOT NULL), findings AS ("""
    + " UNION ALL ".join(
        [
            _f("duplicate_detection", "exact", "'critical'", "0.99", "SELECT headers.* FROM headers JOIN dup USING (invoice_number, vendor_id, total_amount)"),
            _f("vendor_behavior", "amount", "CASE WHEN abs(zscore) >= 3 THEN 'critical' ELSE 'review' END", "CASE WHEN abs(zscore) >= 3 THEN 0.85 ELSE 0.65 END", "SELECT * FROM z WHERE abs(zscore) >= 2.5"),
            _f("phantom_services", "no order", "'review'", "0.75", "SELECT invoice_id, headers.vendor_id, total_amount FROM headers JOIN pv USING (vendor_id) WHERE po IS NULL AND total_amount >= 1000 AND NOT (n >= 10 AND blank >= 0.8 * n)"),
            _f("phantom_services", "no receipt", "'review'", "0.80", "SELECT big.* FROM big, cr WHERE share >= 0.2 AND NOT EXISTS (SELECT 1 FROM kr WHERE kr.invoice_id = big.invoice_id)"),
            _f("split_invoicing", "order", "'review'", "0.75", "SELECT headers.* FROM headers JOIN os USING (vendor_id, po) WHERE total_amount > 0"),
        ]
    )
    + ")"
)
_W = "confidence * CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in adj.SEVERITY_WEIGHTS.items()) + " END::DOUBLE * CASE module " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in adj.MODULE_WEIGHTS.items()) + " END::DOUBLE"
_TIER = "CASE " + " ".join(f"WHEN score >= {x} THEN '{t}'" for t, x in adj.TIERS[:-1]) + f" ELSE '{adj.TIERS[-1][0]}' END"


def _scores(key: str) -> str:
    return f"scores AS (SELECT *, {_TIER} AS tier FROM (SELECT {key}, count(*) AS findings, count(DISTINCT module) AS modules, round(least(100.0, 100 * (1 - exp(-8 * sum({_W})))), 1) AS score FROM findings WHERE {key} IS NOT NULL GROUP BY 1))"


@query(f"WITH {_FINDINGS} SELECT finding_id, module, method, severity, confidence, vendor_id, invoice_id, amount FROM findings")
def all_findings(spark, folder):
    return findings(spark, folder)


@query(f"""WITH {_FINDINGS}, rk AS (SELECT finding_id, module, confidence, invoice_id, vendor_id, row_number() OVER (PARTITION BY invoice_id, vendor_id ORDER BY confidence DESC, finding_id) AS k FROM findings WHERE confidence >= 0.5),
  mm AS (SELECT invoice_id, vendor_id, list(DISTINCT module ORDER BY module) AS ms FROM rk GROUP BY 1, 2)
  SELECT finding_id, module, array_to_string(ms, ',') AS modules FROM rk JOIN mm m ON rk.invoice_id IS NOT DISTINCT FROM m.invoice_id AND rk.vendor_id IS NOT DISTINCT FROM m.vendor_id WHERE len(ms) < 2 OR k = 1""")
def module_dedup(spark, folder):
    return adj.module_dedup(findings(spark, folder)).select("finding_id", "module", F.array_join("modules", ",").alias("modules"))


@query(f"""WITH {_FINDINGS}, d AS (SELECT * REPLACE (round(CASE WHEN module = 'duplicate_detection' AND max(CASE WHEN module = 'phantom_services' THEN 1 ELSE 0 END) OVER (PARTITION BY invoice_id) = 1 AND invoice_id IS NOT NULL THEN confidence * 0.6 ELSE confidence END, 6) AS confidence) FROM findings),
  v AS (SELECT vendor_id, coalesce(bool_or(module = 'vendor_behavior') AND NOT bool_or(module = 'vendor_behavior' AND severity <> 'review'), false) AS yields FROM d WHERE vendor_id IS NOT NULL GROUP BY 1),
  sup AS (SELECT d.*, module = 'split_invoicing' AND coalesce(yields, false) AS suppressed FROM d LEFT JOIN v USING (vendor_id)),
  c AS (SELECT vendor_id, count(DISTINCT module) FILTER (NOT suppressed AND confidence >= 0.75) AS n FROM sup WHERE vendor_id IS NOT NULL GROUP BY 1)
  SELECT finding_id, confidence, suppressed, CAST(CASE WHEN NOT suppressed AND n >= 3 THEN n ELSE 0 END AS INTEGER) AS corroborated_by FROM sup LEFT JOIN c USING (vendor_id)""")
def rule_chain(spark, folder):
    return adj.rule_chain(findings(spark, folder)).select("finding_id", "confidence", "suppressed", "corroborated_by")


@query(f"WITH {_FINDINGS}, {_scores('vendor_id')} SELECT * FROM scores")
def risk_score_vendor(spark, folder):
    return adj.risk_scores(findings(spark, folder), "vendor_id")


@query(f"WITH {_FINDINGS}, {_scores('vendor_id')} SELECT * FROM scores ORDER BY score DESC, vendor_id LIMIT 10")
def top_risk_vendors(spark, folder):
    return adj.top_scores(adj.risk_scores(findings(spark, folder), "vendor_id"), "vendor_id")


@query(f"WITH {_FINDINGS}, {_scores('invoice_id')} SELECT * FROM scores ORDER BY score DESC, invoice_id LIMIT 10")
def top_risk_invoices(spark, folder):
    return adj.top_scores(adj.risk_scores(findings(spark, folder), "invoice_id"), "invoice_id")


@query(f"WITH {_FINDINGS}, {_scores('invoice_id')} SELECT * FROM scores")
def risk_score_invoice(spark, folder):
    return adj.risk_scores(findings(spark, folder), "invoice_id")


@query(f"WITH {_FINDINGS}, {_scores('vendor_id')} SELECT t.tier, count(s.tier) AS n FROM (VALUES " + ", ".join(f"('{t}')" for t, _ in adj.TIERS) + ") t(tier) LEFT JOIN scores s ON s.tier = t.tier GROUP BY 1")
def risk_distribution(spark, folder):
    return adj.risk_distribution(adj.risk_scores(findings(spark, folder), "vendor_id"))


_ALERT = "CASE WHEN severity = 'critical' OR (confidence >= 0.85 AND amount >= 5000) THEN 'critical' WHEN (confidence >= 0.6 AND amount >= 1000) OR (confidence >= 0.85 AND amount >= 500) THEN 'review' ELSE 'informational' END"


@query(f"WITH {_FINDINGS} SELECT {_ALERT} AS alert, count(*) AS n, round(sum(amount), 2) AS amount, count(DISTINCT module) AS modules, count(DISTINCT vendor_id) AS vendors FROM findings GROUP BY 1")
def alert_tiers(spark, folder):
    return adj.alert_summary(findings(spark, folder)).withColumn("amount", F.round("amount", 2))


@query(f"WITH {_FINDINGS} SELECT finding_id, module, vendor_id, invoice_id, amount, confidence FROM findings WHERE confidence >= 0.7 AND amount > 0 ORDER BY amount DESC, finding_id LIMIT 100")
def recovery_report(spark, folder):
    return adj.recovery(findings(spark, folder))


@query(f"WITH {_FINDINGS} SELECT strftime(h.invoice_date, '%Y-%m') AS month, module, count(*) AS n, round(sum(f.amount), 2) AS amount FROM findings f JOIN headers h ON f.invoice_id = h.invoice_id WHERE h.invoice_date IS NOT NULL GROUP BY 1, 2")
def dashboard_timeline(spark, folder):
    when = headers(spark, folder, "invoice_date").where("invoice_date is not null").select("invoice_id", dates.period(F.col("invoice_date"), "monthly").alias("month"))
    return findings(spark, folder).join(when, "invoice_id").groupBy("month", "module").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


_FEEDBACK = "fb AS (SELECT finding_id, CASE WHEN amount < 5000 THEN 'false_positive' ELSE 'confirmed' END AS verdict FROM findings)"


def _feedback(found: DataFrame) -> DataFrame:
    """Verdicts as a reviewer may give them: small amounts were no problem, after all."""
    return found.select("finding_id", F.when(F.col("amount") < 5000, "false_positive").otherwise("confirmed").alias("verdict"), F.lit(1).alias("given_at"))


@query(f"""WITH {_FINDINGS}, {_FEEDBACK}, g AS (SELECT module, count(*) AS verdicts, count(*) FILTER (verdict = 'false_positive') AS false_positives FROM findings JOIN fb USING (finding_id) GROUP BY 1)
  SELECT module, verdicts, false_positives, round(false_positives::DOUBLE / verdicts, 6) AS rate, round(CASE WHEN verdicts >= 5 AND false_positives::DOUBLE / verdicts > 0.2 THEN least(false_positives::DOUBLE / verdicts * 0.3, 0.2) ELSE 0 END, 6) AS bump FROM g""")
def feedback_rates(spark, folder):
    found = written(findings(spark, folder), "findings")
    return adj.feedback_rates(found, _feedback(found))


@query(f"""WITH {_FINDINGS}, {_FEEDBACK}, w AS (SELECT module || '|' || coalesce(vendor_id, '') AS p, count(*) AS n FROM findings JOIN fb USING (finding_id) WHERE verdict = 'false_positive' GROUP BY 1)
  SELECT finding_id, coalesce(n >= 3, false) AS suppressed FROM findings LEFT JOIN w ON p = module || '|' || coalesce(vendor_id, '')""")
def feedback_suppression(spark, folder):
    found = written(findings(spark, folder), "findings")
    return adj.suppress_known(found, _feedback(found), text.pattern_hash(F.col("module"), F.col("vendor_id"))).select("finding_id", "suppressed")


@query(f"""WITH {_FINDINGS}, truth AS (SELECT 'credit' AS kind, invoice_id FROM headers WHERE total_amount < 0 UNION ALL SELECT 'large', invoice_id FROM headers WHERE total_amount >= 100000)
  SELECT kind, count(DISTINCT invoice_id) AS total, count(DISTINCT CASE WHEN invoice_id IN (SELECT invoice_id FROM findings) THEN invoice_id END) AS detected, round(count(DISTINCT CASE WHEN invoice_id IN (SELECT invoice_id FROM findings) THEN invoice_id END)::DOUBLE / count(DISTINCT invoice_id), 6) AS rate FROM truth GROUP BY 1""")
def detection_accuracy(spark, folder):
    h = headers(spark, folder, "total_amount")
    truth = h.where("total_amount < 0").select(F.lit("credit").alias("kind"), "invoice_id").unionAll(h.where("total_amount >= 100000").select(F.lit("large").alias("kind"), "invoice_id"))
    return adj.accuracy(findings(spark, folder), truth)


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n, round(sum(value), 2) AS cost FROM events GROUP BY 1, 2")
def cost_rollup(spark, folder):
    return table(spark, folder, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("cost"))


@query("SELECT time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01') AS starts, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, folder):
    """The batch form of the streaming aggregate: tumbling windows of seven days by event type."""
    from ledgersift.streaming.windows import windowed_totals

    got = windowed_totals(table(spark, folder, "events"), "ts", "event_type", "value", "7 days")
    return got.withColumn("total", F.round("total", 2))


@query("""WITH e AS (SELECT user_id, ts, ts > lag(ts) OVER w + INTERVAL 1 DAY AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
  SELECT user_id, min(ts) AS starts, max(ts) + INTERVAL 1 DAY AS ends, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, folder):
    """The batch form of sessions: events of a user with less than a day between them."""
    from ledgersift.streaming.windows import sessions

    return sessions(table(spark, folder, "events"), "ts", "user_id", "1 day")

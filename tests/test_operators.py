from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from ledgersift.functions.taxonomy import classify, keywords
from ledgersift.operators import adjudication as adj
from ledgersift.operators import groups, pairs, prices, quality, search
from ledgersift.streaming.windows import running_zscores, sessions, windowed_totals
from tests.conftest import rows

D0 = date(2025, 1, 15)
HEAD = "invoice_id string, vendor_id string, invoice_date date, total_amount decimal(18,2), po_number string, words array<string>, quantities array<double>"


def inv(i, amount=1000, day=0, vendor="V1", po=None, words=("steel", "beam"), q=(1.0,)):
    return (i, vendor, D0 + timedelta(day), Decimal(amount), po, list(words), list(q))


def test_duplicate_pairs(spark):
    df = spark.createDataFrame([inv("a"), inv("b", 1005, 3), inv("c", 1000, 200), inv("d", 5000), inv("e", 1000, 0, "V2"), inv("n", -1000), inv("z", 0)], HEAD)
    got = pairs.duplicate_pairs(df).collect()
    assert [(r.invoice_id_a, r.invoice_id_b) for r in got] == [("a", "b")] and got[0].score > 0.85
    assert pairs.duplicate_pairs(df.limit(0)).count() == 0


def test_similar_invoices(spark):
    """A slip in a word or in an order number costs its letters only; words counted whole lose these pairs."""
    kind = HEAD.replace("words array<string>", "description string")
    row = lambda i, text, po, day=0, amount=1000: (i, "V1", D0 + timedelta(day), Decimal(amount), po, text, [1.0])
    data = [
        row("a", "Copper gutter", "PO-1002000"), row("b", "Cop. gutter", "PO-1002000", 20), row("c", "gutter Coper", "PO-1002001", 3), row("d", "Crane hire", "X", 1), row("e", "Copper gutters", "Q-7", 2, 1005),
        row("f", None, None, 2),
    ]
    df = spark.createDataFrame(data, kind)
    got = pairs.similar_invoices(df)
    assert {("a", "b"), ("a", "c")} <= {(r.invoice_id_a, r.invoice_id_b) for r in got.collect()} and got.where("'d' in (invoice_id_a, invoice_id_b)").count() == 0
    words = df.withColumn("words", F.split(F.lower("description"), " "))
    assert pairs.duplicate_pairs(words.where("invoice_id in ('a', 'b')")).count() == 0
    none = spark.createDataFrame([], "invoice_id_a string, invoice_id_b string")
    across = pairs.similar_across_orders(df, none).select("invoice_id_a", "invoice_id_b")
    assert ("a", "e") in rows(across) and not any("d" in x or "f" in x for x in rows(across))


def test_cross_order_pairs(spark):
    df = spark.createDataFrame([inv("a", po="P1"), inv("b", 1010, 5, po="P2"), inv("c", 1010, 5, po="P1")], HEAD)
    none = spark.createDataFrame([], "invoice_id_a string, invoice_id_b string")
    assert rows(pairs.cross_order_pairs(df, none).select("invoice_id_a", "invoice_id_b")) == [("a", "b"), ("b", "c")]
    known = spark.createDataFrame([("b", "a")], "invoice_id_a string, invoice_id_b string")
    assert rows(pairs.cross_order_pairs(df, known).select("invoice_id_a", "invoice_id_b")) == [("b", "c")]


def test_credits(spark):
    df = spark.createDataFrame([inv("a", 1000), inv("b", -1000), inv("c", -1200), inv("d", 1003, vendor="V2")], HEAD)
    assert rows(pairs.credits_and_rebills(df)) == [("a", "invoice"), ("b", "credit")]


def test_related_vendors(spark):
    kind = "vendor_id string, vendor_name string, address string, phone string, tax_id string, bank_account_last4 string, contact_person string"
    df = spark.createDataFrame(
        [("A", "Acme Steel", "1 Main St", "555", "T1", "1111", "Ann"), ("B", "Bolt Works", "1 main street", "556", "T2", "2222", "Bob"), ("C", "Acme Steel Inc", "9 Elm", "557", "T3", "1111", None), ("D", None, None, None, "n/a", None, None), ("E", "Else", None, None, "N/A", "0000", None)], kind
    )
    assert [(a, b) for a, b, _ in rows(pairs.related_vendors(df))] == [("A", "B"), ("A", "C")]


def test_related_vendors_are_all_found(spark):
    """Against all pairs: equal bank numbers without another sign, near addresses, an address from 75 with two other signs."""
    import random

    from ledgersift.functions.fuzzy import token_sort_ratio_of

    kind = "vendor_id string, vendor_name string, address string, phone string, tax_id string, bank_account_last4 string, contact_person string"
    data = [
        ("A", "Acme Steel", "4637 nesaskstome terrace fros heights", "555", "T1", "1111", "Ann"), ("B", "Bolt Works", "12 elm grove road", "556", "T2", "1111", "Bob"),
        ("C", "Quill Press", "4637 nesakstome terrace fros heights", "557", "T3", "2222", "Cid"), ("D", "Quill Presss", "4637 nesakstome tarn fros heights", "557", "T3", "3333", "Dan"),
    ]
    got = {(x, y): z for x, y, z in rows(pairs.related_vendors(spark.createDataFrame(data, kind)))}
    assert set(got) == {("A", "B"), ("A", "C"), ("C", "D")} and 0.6 <= got["C", "D"] < 0.8
    r = random.Random(1)
    texts = [" ".join("".join(r.choice("abc") for _ in range(r.randint(2, 5))) for _ in range(r.randint(1, 6))) for _ in range(200)]
    for x in list(texts):
        y = list(x)
        for _ in range(r.randint(1, 3)):
            y[r.randrange(len(y))] = r.choice("abc ")
        texts.append("".join(y).strip())
    texts = sorted({x for x in texts if x})
    wanted = sorted((x, y) for k, x in enumerate(texts) for y in texts[k + 1 :] if token_sort_ratio_of(x, y) >= 90)
    assert len(wanted) > 20 and rows(pairs.near_texts(spark.createDataFrame([(x,) for x in texts], "x string"), "x").select("text_a", "text_b")) == wanted


def series(spark, data):
    return spark.createDataFrame([("V", "i", D0 + timedelta(30 * k), float(p), float(q), k) for k, (p, q) in enumerate(data)], "vendor string, item string, day date, price double, quantity double, seq int")


def test_jumps(spark):
    got = prices.jumps(series(spark, [(100, 1), (101, 1), (103, 1), (107, 1)])).first()
    assert got.accelerating and abs(got.change_pct - 7) < 1e-9 and got.max_jump_day == D0 + timedelta(90)
    tied = prices.jumps(series(spark, [(100, 1), (110, 1), (99, 1)])).first()
    assert tied.max_jump_pct == 10 and not tied.accelerating
    assert prices.eligible(series(spark, [(100, 1)] * 3)).count() == 0


def test_quantity_shift(spark):
    got = prices.quantity_shift(series(spark, [(1, 10), (1, 10), (1, 20), (1, 20), (1, 20)])).first()
    assert (got.first_half, got.second_half, got.shift_pct) == (10, 20, 100)


def test_benchmark_and_blend(spark):
    df = spark.createDataFrame([("c", f"v{i % 3}", float(p)) for i, p in enumerate((1, 2, 3, 4))] + [("few", "v1", 1.0)], "c string, v string, p double")
    b = prices.benchmark(df, "c", "v", "p").collect()
    assert len(b) == 1 and b[0].median == 2.5 and abs(b[0].p90 - 3.7) < 1e-9
    a = spark.createDataFrame([("x", 10.0, 1), ("y", 5.0, 2)], "category string, median double, n long")
    c = spark.createDataFrame([("x", 20.0, 3), ("z", 7.0, 4)], "category string, median double, n long")
    assert rows(prices.blend(a, c)) == [("x", 17.5, 4, "both"), ("y", 5.0, 2, "inside"), ("z", 7.0, 4, "outside")]


def test_rate_as_of(spark):
    pts = spark.createDataFrame([("V", "i", date(2024, 6, 1), 100.0, 1), ("V", "i", date(2025, 6, 1), 100.0, 2), ("V", "i", date(2023, 1, 1), 900.0, 3)], "vendor string, item string, day date, price double, invoice int")
    rates = spark.createDataFrame([("V", "i", date(2024, 1, 1), 80.0), ("V", "i", date(2025, 1, 1), 120.0)], "vendor string, item string, start date, rate double")
    assert [r.invoice for r in prices.rate_as_of(pts, rates, 0.0, 0.05).collect()] == [1]


def test_sliding_clusters(spark):
    df = spark.createDataFrame([inv(f"i{k}", 1300, k * 2) for k in range(4)] + [inv("x", 1300, 100)], HEAD)
    got = groups.sliding_clusters(df, [5000.0])
    assert rows(got.select("invoice_id", "window_days", "n")) == [("i0", 14, 4), ("i0", 30, 4), ("i0", 7, 4)]


def test_recurring(spark):
    df = spark.createDataFrame([inv(f"i{k}", 1000 + k, 30 * k) for k in range(4)] + [inv(f"j{k}", 5000, 3 * k) for k in range(4)], HEAD)
    got = groups.recurring(df).collect()
    assert [(r.bucket, r.n, r.mean_gap) for r in got] == [(1000.0, 4, 30.0)]


def test_baseline_matches_plain_definition(spark):
    import statistics as s

    amounts, days = [100, 200, 300, 150, 250], [0, 0, 10, 40, 41]
    df = spark.createDataFrame([inv(f"i{k}", a, d) for k, (a, d) in enumerate(zip(amounts, days, strict=True))], HEAD)
    r = groups.baseline(df).first()
    gaps = [b - a for a, b in zip(days, days[1:])]
    assert abs(r.std_amount - s.stdev(amounts)) < 1e-6 and abs(r.mean_gap - s.mean(gaps)) < 1e-9 and abs(r.std_gap - s.stdev(gaps)) < 1e-6
    lone = groups.baseline(df.where("invoice_id = 'i0'")).first()
    assert (lone.std_amount, lone.mean_gap, lone.std_gap) == (20.0, 30.0, 9.0)


def test_unusual_amounts(spark):
    df = spark.createDataFrame([inv(f"i{k:02}", 1000 + k, k) for k in range(12)] + [inv("odd", 9000, 50)], HEAD)
    assert [(r.invoice_id, r.level) for r in groups.unusual_amounts(df).collect() if r.invoice_id == "odd"] == [("odd", "severe")]


def test_quality(spark):
    df = spark.createDataFrame([("a", None), (" ", 1.0)], "s string, n double")
    assert rows(quality.completeness(df, ["s", "n"])) == [("n", 1, 0.5), ("s", 1, 0.5)]
    assert rows(quality.completeness(df.limit(0), ["s"])) == [("s", 0, 0.0)]


def test_keywords(spark):
    df = spark.createDataFrame([("Copper Pipe 1 inch",), ("zzz",), (None,)], "x string")
    got = [r[0] for r in df.select(classify(F.col("x"))).collect()]
    assert got[0].endswith("Copper Pipe") and got[1:] == [None, None]
    assert len(keywords()) < 250


def finding_rows(spark):
    data = [
        ("f1", "duplicate_detection", "m", "critical", 0.9, "V", "I", 10000.0), ("f2", "phantom_services", "m", "review", 0.8, "V", "I", 2000.0), ("f3", "split_invoicing", "m", "review", 0.75, "V", "J", 600.0),
        ("f4", "vendor_behavior", "m", "review", 0.8, "V", "K", 100.0), ("f5", "price_creep", "m", "informational", 0.4, "W", None, 1.0),
    ]
    return spark.createDataFrame(data, "finding_id string, module string, method string, severity string, confidence double, vendor_id string, invoice_id string, amount double")


def test_adjudication(spark):
    f = finding_rows(spark)
    kept = adj.module_dedup(f)
    assert rows(kept.select("finding_id")) == [("f1",), ("f3",), ("f4",)]
    got = {r.finding_id: r for r in adj.rule_chain(f).collect()}
    assert abs(got["f1"].confidence - 0.54) < 1e-9 and got["f3"].suppressed and got["f4"].corroborated_by == 0 and not got["f5"].suppressed
    scores = adj.risk_scores(f, "vendor_id")
    assert {r.vendor_id for r in scores.collect()} == {"V", "W"}
    assert dict(adj.risk_distribution(scores).collect())["high"] >= 0 and adj.risk_distribution(scores).count() == 4
    assert {r.alert for r in adj.alert_summary(f).collect()} == {"critical", "review", "informational"}
    assert [r.finding_id for r in adj.recovery(f, n=2).collect()] == ["f1", "f2"]
    fb = spark.createDataFrame([("f1", "confirmed", 1), ("f1", "false_positive", 2), ("f2", "confirmed", 1)], "finding_id string, verdict string, given_at int")
    rates = {r.module: r.rate for r in adj.feedback_rates(f, fb).collect()}
    assert rates == {"duplicate_detection": 1.0, "phantom_services": 0.0}
    truth = spark.createDataFrame([("k", "I"), ("k", "none")], "kind string, invoice_id string")
    assert adj.accuracy(f, truth).first().rate == 0.5


def test_without_receipt(spark):
    i = spark.createDataFrame([("a",), ("b",), ("c",)], "invoice_id string")
    r = spark.createDataFrame([("a",), ("b",), (None,)], "invoice_id string")
    assert rows(groups.without_receipt(i, r, 0.5)) == [("c",)] and groups.without_receipt(i, r, 0.9).count() == 0


def test_nearest(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, None)], "id int, v array<double>")
    assert rows(search.nearest(df, "id", "v", F.col("id") == 0, 1).select("query_id", "id")) == [(0, 1)]


def test_enrich_and_usual_name(spark):
    a = spark.createDataFrame([("1", ""), ("2", "x")], "k string, n string")
    b = spark.createDataFrame([("1", "m"), ("3", "z")], "k string, n string")
    assert rows(groups.enrich(a, b, "k", ["n"])) == [("1", "m"), ("2", "x"), ("3", "z")]
    c = spark.createDataFrame([("1", "b"), ("1", " a"), ("1", "a"), ("1", "b")], "k string, n string")
    assert rows(groups.usual_name(c, "k", "n")) == [("1", "a", 2)]


def test_streams(spark, tmp_path):
    t = datetime(2024, 1, 1)
    events = [(t + timedelta(minutes=k), "u", 10.0 + k % 2) for k in range(10)] + [(t + timedelta(minutes=10), "u", 99.0)]
    df = spark.createDataFrame(events, "ts timestamp, user string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, mode):
        q = out.writeStream.outputMode(mode).format("memory").queryName("got").option("checkpointLocation", str(tmp_path / f"cp{mode}{out.columns[0]}")).start()
        q.processAllAvailable()
        q.stop()
        return spark.table("got").collect()

    totals = run(windowed_totals(stream, "ts", "user", "value", "1 hour"), "complete")
    assert [(r.n, r.total) for r in totals] == [(11, sum(v for *_, v in events))]
    assert [round(r.value) for r in run(running_zscores(stream, "user", "value"), "append")] == [99]
    assert sessions(df, "ts", "user", "5 minutes").first().n == 11

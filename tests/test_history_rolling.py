"""Problems 4 and 6 against brute force."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgersift.operators.history import bitemporal_ledger, vendor_ledger
from ledgersift.operators.rolling import one_per_key, trailing_totals
from tests.conftest import rows

D0 = date(2024, 1, 1)


def brute_totals(data, windows=(7, 30)):
    days = defaultdict(list)
    for v, d, a in data:
        if v is not None and d is not None and a is not None:
            days[v].append((d, a))
    out = []
    for v, xs in days.items():
        d, last = min(x for x, _ in xs), max(x for x, _ in xs)
        while d <= last:
            row = [v, d]
            for w in windows:
                inside = [a for x, a in xs if d - timedelta(w - 1) <= x <= d]
                row += [sum(inside, Decimal("0.00")), len(inside), float(sum(inside)) / len(inside) if inside else None]
            out.append(tuple(row))
            d += timedelta(1)
    return out


def test_trailing_totals(spark):
    rng = random.Random(5)
    data = [(rng.choice(["a", "b", "hot", "hot", None]), rng.choice([D0 + timedelta(rng.randrange(70)), None] if rng.random() < 0.1 else [D0 + timedelta(rng.randrange(70))]), rng.choice([Decimal(rng.randrange(-9999, 99999)) / 100, None])) for _ in range(300)]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "v string, d date, a decimal(18,2), entity int, lag string")
    got = {(r[0], r[1]): r for r in trailing_totals(df, "v", "d", "a").collect()}
    wanted = brute_totals(data)
    assert len(got) == len(wanted)
    for row in wanted:
        r = got[row[:2]]
        for x, y in zip(r, row, strict=True):
            assert x == y or abs(float(x) - float(y)) < 1e-6


def test_trailing_totals_empty(spark):
    df = spark.createDataFrame([], "v string, d date, a decimal(18,2)")
    assert trailing_totals(df, "v", "d", "a").count() == 0
    assert trailing_totals(spark.createDataFrame([(None, None, None)], "v string, d date, a decimal(18,2)"), "v", "d", "a").count() == 0


def test_one_per_key(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), (None, 3, 30), ("b", None, 40)], "k string, t int, v int")
    assert rows(one_per_key(df, "k", ["v"], ["t"])) == [("a", 20), ("b", 40)]


def brute_state(deliveries, until=None):
    """What is believed at a recorded time: {day: (a, b)} with nulls filled."""
    latest = {}
    for i, (day, told, a, b) in enumerate(deliveries):
        if until is None or told <= until:
            if day not in latest or (told, i) >= latest[day][0]:
                latest[day] = ((told, i), (a, b))
    held, out = (None, None), {}
    for day in sorted(latest):
        held = tuple(h if x is None else x for x, h in zip(latest[day][1], held, strict=True))
        out[day] = held
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 8), st.sampled_from(["x", "y", None]), st.sampled_from(["p", "q", None])), max_size=14))
def test_ledger(spark, drawn):
    told = lambda n: datetime(2024, 2, 1) + timedelta(hours=n)
    deliveries = [(D0 + timedelta(d), told(t), a, b) for d, t, a, b in drawn]
    df = spark.createDataFrame([("v", d, t, a, b, i, "clash") for i, (d, t, a, b) in enumerate(deliveries)], "e string, d date, t timestamp_ntz, a string, b string, i int, valid string")
    ledger = [r.asDict() for r in bitemporal_ledger(df, "e", "d", "t", ["a", "b"], "i").collect()]
    for moment in [*{t for _, t, _, _ in deliveries}, datetime(2030, 1, 1)]:
        seen = {r["valid_from"]: (r["a"], r["b"]) for r in ledger if r["recorded_from"] <= moment and (r["recorded_to"] is None or moment < r["recorded_to"])}
        assert seen == brute_state(deliveries, moment)
    now = sorted((r for r in ledger if r["recorded_to"] is None), key=lambda r: r["valid_from"])
    for i, r in enumerate(now):
        assert r["valid_to"] == (now[i + 1]["valid_from"] if i + 1 < len(now) else None)
        assert r["starts_version"] == (i == 0 or (r["a"], r["b"]) != (now[i - 1]["a"], now[i - 1]["b"]))


def test_ledger_edges(spark):
    kind = "e string, d date, t timestamp_ntz, a string"
    assert bitemporal_ledger(spark.createDataFrame([], kind), "e", "d", "t", ["a"]).count() == 0
    df = spark.createDataFrame([(None, D0, datetime(2024, 1, 2), "x"), ("v", None, datetime(2024, 1, 2), "x"), ("v", D0, None, "y"), ("v", D0, datetime(2024, 1, 2), "z")], kind)
    now = bitemporal_ledger(df, "e", "d", "t", ["a"]).where("recorded_to is null").collect()
    assert [(r.e, r.a) for r in now] == [("v", "z")]


def test_vendor_values_are_comparable(spark):
    t = datetime(2024, 1, 2)
    df = spark.createDataFrame(
        [(1, "v", D0, " 1 Main  St\n", "0123", "Ann", t), (2, "v", D0 + timedelta(31), "1 MAIN ST", "123", " ANN ", t), (3, "v", D0 + timedelta(60), None, "0124", None, t), (4, "v", D0 + timedelta(90), "", "0123", "ann", t)],
        "snapshot_id long, vendor_id string, snapshot_date date, address string, bank_account_last4 string, contact_person string, loaded_at timestamp_ntz",
    )
    got = vendor_ledger(df).where("recorded_to is null and starts_version").orderBy("valid_from").collect()
    assert [r.valid_from for r in got] == [D0, D0 + timedelta(60), D0 + timedelta(90)]

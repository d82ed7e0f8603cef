from functools import cache

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgersift.functions import fuzzy, stats
from ledgersift.operators import groups
from tests.conftest import rows

TEXT = st.text(alphabet="abc ", max_size=9)


def plain(a, b):
    @cache
    def f(i, j):
        if i == len(a) or j == len(b):
            return 0
        return f(i + 1, j + 1) + 1 if a[i] == b[j] else max(f(i + 1, j), f(i, j + 1))

    return f(0, 0)


@given(TEXT, TEXT)
@settings(max_examples=200)
def test_common_subsequence(a, b):
    assert fuzzy.common_subsequence(a, b) == plain(a, b)


def test_ratios(spark):
    df = spark.createDataFrame([("steel beam", "beam steel"), ("PO-123", "PO-1234"), ("acme", "the acme company"), (None, "x"), ("", "")], "a string, b string")
    got = df.select(fuzzy.token_sort_ratio(F.col("a"), F.col("b")), fuzzy.ratio(F.col("a"), F.col("b")), fuzzy.partial_ratio(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == 100 and round(got[1][1], 3) == 92.308 and got[2][2] == 100 and tuple(got[3]) == (0, 0, 0) == tuple(got[4])


def test_chi_squared(spark):
    o = spark.createDataFrame([("a", 10), ("b", 20), ("z", 5)], "k string, n int")
    e = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n int")
    r = stats.chi_squared(o, e, "k", "n").first()
    assert abs(r.chi2 - 20) < 1e-9 and r.dof == 2  # 10, 20, 0 against 10, 10, 10


def test_percentiles(spark):
    import random
    import statistics

    rng = random.Random(3)
    data = [("hot" if i % 3 else "b", float(rng.randrange(40))) for i in range(500)] + [("one", 7.0), (None, 1.0), ("b", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r for r in stats.percentiles(df.repartition(5), "g", "v", {"q1": 0.25, "mid": 0.5}).collect()}
    for g in ("hot", "b"):
        xs = [v for k, v in data if k == g and v is not None]
        q = statistics.quantiles(xs, n=4, method="inclusive")
        assert abs(got[g].q1 - q[0]) < 1e-9 and abs(got[g].mid - q[1]) < 1e-9
    assert got["one"].mid == 7.0 and len(got) == 3
    assert stats.percentiles(df.limit(0), "g", "v", {"mid": 0.5}).count() == 0


def test_outside_scope(spark):
    lines = spark.createDataFrame([("V", "steel beam delivery"), ("V", "catering"), ("W", "x"), (None, "y")], "key string, description string")
    scope = spark.createDataFrame([("V", "Steel beam delivery"), ("V", None)], "key string, entry string")
    assert rows(groups.outside_scope(lines, scope)) == [("V", "catering", 0.0)]


def test_similar_names(spark):
    """Against every pair by the ratio itself; equal names, nulls, blanks and repeated rows."""
    import random

    from ledgersift.functions.fuzzy import token_sort_ratio_of
    from ledgersift.operators.pairs import similar_names
    from tests.conftest import rows

    rng = random.Random(3)
    base = ["harbor freight supply", "copper river plumbing", "north lake legal partners", "blue mesa concrete works"]
    names = [(f"V{k:02}", "".join(rng.choice("abcxyz") if rng.random() < 0.07 else c for c in rng.choice(base)) + rng.choice([" LLC", "", " Inc"])) for k in range(40)]
    names += [("W1", None), ("W2", "  "), ("W3", "Same Name Ltd"), ("W4", "name same"), ("W5", "Same  Name"), ("W5", "Same  Name"), (None, "Same Name")]
    df = spark.createDataFrame([(*r, 1) for r in names], "vendor_id string, vendor_name string, name int")
    plain = {v: " ".join(w for w in (n or "").lower().split() if w not in ("llc", "inc", "ltd")) for v, n in names if v}
    want = {(a, b, round(r, 6), "merge" if r >= 90 else "pending") for a in plain for b in plain if a < b and plain[a] and plain[b] and (r := token_sort_ratio_of(plain[a], plain[b])) >= 85}
    assert set(rows(similar_names(df))) == want and len(want) > 20
    assert similar_names(df.limit(0)).count() == 0

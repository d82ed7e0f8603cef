"""Problems 8, 9 and 10 against brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgersift.llm import leakage, packing, spans
from tests.conftest import rows

DOCS = "doc_id long, text string, doc string, h int, words string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts], DOCS)


def brute_passages(ds, items, span):
    w = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = set()
    for i, t in items:
        a = w(t)
        n = min(span, len(a))
        grams = {tuple(a[k : k + n]) for k in range(len(a) - n + 1)} if n else set()
        for d, u in ds:
            b = w(u)
            if any(tuple(b[k : k + n]) in grams for k in range(len(b) - n + 1) if n):
                found.add((i, d))
    return found


def test_passages(spark, monkeypatch):
    monkeypatch.setattr(leakage, "SHARD_CHARS", 60)  # every longer text is cut
    rng = random.Random(3)
    word = lambda: rng.choice(["ab", "cd", "ef", "gh", "Über", "x1"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 6, 9])))) for i in range(12)] + [(90, None), (91, "--")]
    texts = [(d, ", ".join(word() for _ in range(rng.choice([0, 2, 8, 60])))) for d in range(40)] + [(100, None), (101, ""), (102, texts_of(items)), (0, "repeated id ab cd")]
    eval_items = spark.createDataFrame(items, "item_id long, text string")
    got = leakage.find_passages(docs(spark, texts), eval_items, 5)
    assert set(rows(got.select("item_id", "doc_id").distinct())) == brute_passages(texts, items, 5)
    blocks = leakage.find_passages(docs(spark, texts), eval_items, 5, block=4)
    assert set(rows(blocks.distinct())) == set(rows(got.distinct()))
    for r in got.collect():
        t = [u for d, u in texts if d == r.doc_id and u]
        item = leakage.words(dict(items)[r.item_id])[r.item_word : r.item_word + r.words]
        assert any(leakage.words(u)[r.doc_word : r.doc_word + r.words] == item for u in t)
    kept = leakage.without_leaks(docs(spark, texts), got)
    assert {r.doc_id for r in kept.collect()}.isdisjoint({r.doc_id for r in got.collect()})


def texts_of(items):
    return " | ".join(t for _, t in items if t)


def test_passages_empty(spark):
    none, items = docs(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert leakage.find_passages(none, items).count() == 0
    assert leakage.find_passages(docs(spark, [(1, "a b c")]), items).count() == 0


def brute_shared(texts, n):
    grams = {}
    for d, t in texts:
        for k in range(len(t or "") - n + 1):
            grams.setdefault(t[k : k + n], {}).setdefault(d, set()).add(k)
    pairs, covered = set(), {}
    for _, by in ((g, by) for g, by in grams.items() if len(by) > 1):
        for d, at in by.items():
            pairs |= {(min(d, e), max(d, e)) for e in by if e != d}
            covered.setdefault(d, set()).update(p for k in at for p in range(k, k + n))
    return pairs, {d: len(c) for d, c in covered.items()}


@pytest.mark.parametrize("shard", [150, 10_000])
def test_shared_spans(spark, monkeypatch, shard):
    monkeypatch.setattr(spans, "SHARD_CHARS", shard)
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice(["a", "b", "c ", ". ", "é", "d\n"]) for _ in range(n))
    shared = [text(70), text(45), "x" * 80]
    texts = [(i, text(rng.randrange(60)) + rng.choice([*shared, ""]) + text(rng.randrange(60)) + rng.choice([*shared, ""])) for i in range(30)]
    texts += [(50, None), (51, ""), (52, shared[0]), (53, shared[0]), (54, shared[0][3:53]), (55, text(1500) + shared[1] + text(900) + shared[0])]
    n = 40
    got = spans.repeated_spans(docs(spark, texts), n)
    pairs, covered = brute_shared(texts, n)
    assert set(rows(spans.shared_pairs(got, n))) == pairs
    chars = {r.doc_id: r.shared_chars for r in spans.shared_characters(got, docs(spark, texts), n).collect()}
    assert chars == covered
    later = {}
    for r in spans.shared_intervals(got, n, later_only=True).collect():
        later[r.doc_id] = later.get(r.doc_id, 0) + r["to"] - r["from"]
    assert later == brute_later(texts, n)


def brute_later(texts, n):
    """Characters of each text in runs of n that a text with a smaller id has too."""
    seen, out = set(), {}
    for i, t in sorted((i, t) for i, t in texts if t):
        windows = [t[k : k + n] for k in range(len(t) - n + 1)]
        if marked := {k + j for k, w in enumerate(windows) if w in seen for j in range(n)}:
            out[i] = len(marked)
        seen.update(windows)
    return out


def test_ten_thousand_copies(spark):
    """Copies in another frame each: coverage and removal make no pairs."""
    text = "This paragraph stands in all of them, word for word. It has a second sentence, and it goes on for a while."
    d = spark.range(10_000).selectExpr("id as doc_id", f"concat('Letter ', id, '. ', '{text}', ' Signed ', id % 7, '.') as text")
    got = spans.repeated_spans(d, 60)
    chars = spans.shared_characters(got, d, 60)
    assert chars.count() == 10_000 and chars.where(f"shared_chars < {len(text)}").count() == 0
    cut = spans.without_repeats(d, got, 60)
    assert cut.where("removed >= 2").count() == 9_999 and cut.where("doc_id = 0 and removed = 0").count() == 1


def test_sentence_runs():
    t = "One two. Three four five! Six. " + "x" * 30 + "\nSeven eight nine ten."
    runs = spans.sentence_runs(t, 20)
    assert runs == [(0, 26), (9, 31), (26, 62), (31, 83)] or all(e - s >= 20 for s, e in runs)
    assert all(len([1 for a, b in spans.sentences(t) if s <= a and b <= e]) >= 2 for s, e in runs)
    assert spans.sentence_runs("no sentence ends here", 5) == [] == spans.sentence_runs("", 5)


def test_shared_spans_edges(spark):
    assert spans.repeated_spans(docs(spark, []), 40).count() == 0 == spans.shared_intervals(spans.repeated_spans(docs(spark, []), 40), 40).count()
    same = "one text that is long enough to be shared by all who have it, twice"
    assert rows(spans.shared_pairs(spans.repeated_spans(docs(spark, [(1, same), (1, same), (None, same)]), 40), 40)) == []


@given(st.text(alphabet="ab .!?\n", max_size=60))
@settings(max_examples=60)
def test_sentences_are_the_text(t):
    assert "".join(t[s:e] for s, e in spans.sentences(t)) == t


def test_without_repeats(spark):
    a, b = "The first sentence is here for all to read.", "Another one follows it with many words."
    texts = [(1, f"{a} {b} Own end."), (2, f"Begin. {a} {b} More."), (3, "Nothing shared."), (4, None)]
    d = docs(spark, texts)
    cut = {r.doc_id: (r.text, r.removed) for r in spans.without_repeats(d, spans.repeated_spans(d, 60), 60).collect()}
    assert cut[1] == (texts[0][1], 0) and cut[3][1] == 0 and cut[4] == (None, 0)
    assert cut[2][0] == "Begin. More." and cut[2][1] == 2


def brute_padding(sizes, buckets):
    from functools import cache

    s = sorted(sizes)

    @cache
    def best(i, k):
        if i == len(s):
            return 0
        if k == 0:
            return 10**9
        return min(sum(s[j] for _ in range(i, j + 1)) + best(j + 1, k - 1) for j in range(i, len(s)))

    return best(0, buckets)


@given(st.lists(st.integers(1, 20), min_size=1, max_size=9), st.integers(1, 4))
@settings(max_examples=60)
def test_bucket_bounds_are_optimal(sizes, k):
    bounds = packing.bucket_bounds({n: sizes.count(n) for n in sizes}, 20, k)
    assert len(bounds) <= k and max(bounds) == max(sizes)
    assert sum(min(b for b in bounds if b >= n) for n in sizes) == brute_padding(tuple(sizes), k)


def test_pack(spark):
    rng = random.Random(2)
    sized = [(i, rng.choice([1, 30, 55, 64, 99, 100, 101, 250, 300])) for i in range(400)] + [(900, 0), (901, None), (None, 5), (7, 64)]
    df = spark.createDataFrame(sized, "doc_id long, tokens long")
    got = packing.pack(df, 100, 8, group=150).collect()
    used, parts = {}, {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.tokens
        parts.setdefault(r.doc_id, []).append((r.first_token, r.tokens))
    assert max(used.values()) <= 100
    wanted = {}
    for i, n in sized:
        if i is not None and n is not None:
            wanted.setdefault(i, []).append(n)
    assert set(parts) == set(wanted)
    for i, ns in wanted.items():
        assert sum(t for _, t in parts[i]) == sum(ns)
        if max(ns) <= 100:
            assert sorted(t for _, t in parts[i]) == sorted(ns)
    report = packing.container_report(packing.pack(df, 100, 8), 100).first()
    assert report.unused_share < 0.08 and report.fullest <= 100
    assert rows(packing.pack(df, 100, 8, group=150)) == rows(packing.pack(df.repartition(7), 100, 8, group=150))
    assert packing.pack(df.limit(0), 100, 8).count() == 0
    inside = packing.pack(df, 100, 8, group=150, mixed=False).collect()
    assert len(inside) == len(got) and len({(r.container, r.bucket) for r in inside if r.tokens}) == len({r.container for r in inside if r.tokens})
    full = {}
    for r in inside:
        full[r.container] = full.get(r.container, 0) + r.tokens
        assert r.tokens <= r.bucket
    assert max(full.values()) <= 100


def test_long_items_take_little_memory(spark):
    """An item of 5,000 words, found whole and in part."""
    import resource

    words = [f"w{k % 997}x{k}" for k in range(5000)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "short item here")], "item_id long, text string")
    filler = " ".join(f"w{k % 997}x{k}" for k in range(0, 5000, 2))
    d = docs(spark, [(1, "start " + " ".join(words) + " end"), (2, " ".join(words[700:720])), (3, " ".join(words[10:22])), *[(k, filler) for k in range(4, 60)]])
    best = {}
    for r in leakage.find_passages(d, items).collect():
        best[r.item_id, r.doc_id] = max(best.get((r.item_id, r.doc_id), 0), r.words)
    assert best == {(1, 1): 5000, (1, 2): 20}
    searcher = leakage._searcher([(1, words)], 13)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    list(searcher([1] * 100, [" ".join(words)[:20_000]] * 100))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # KB


def test_token_counts(spark):
    import base64

    import tiktoken

    try:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(packing.VOCABULARY, "rb"))}
    except OSError:
        pytest.skip("no vocabulary")
    enc = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [(1, "Hello, wörld 123!"), (2, ""), (3, None), (4, "<|endoftext|> is text"), (5, "a" * 3000)]
    got = {r.doc_id: r.tokens for r in packing.count_tokens(docs(spark, texts)).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in texts}


def test_span_hashes_do_not_depend_on_place():
    a = np.frombuffer("xxhello worldyy".encode("utf-32-le"), np.uint32)
    b = np.frombuffer("hello world".encode("utf-32-le"), np.uint32)
    assert spans._span_hashes(a, np.array([2]), 11)[0] == spans._span_hashes(b, np.array([0]), 11)[0]

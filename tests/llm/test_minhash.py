import random
from itertools import combinations

import helpers as h
import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import minhash, queries


def brute(rows, k, percent=80):
    """component by id of all pairs of full sets; rows of one id are one document."""
    sets = [(i, h.shingles(t, k)) for i, t in rows if i is not None]
    links = [(a, b) for (a, s), (b, t) in combinations(sets, 2) if s and t and 100 * len(s & t) >= percent * len(s | t)]
    return h.components({i for i, _ in sets}, links)


def near_copies(seed, n_base, per, length, edits):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(n_base):
        base = [f"w{rng.randrange(3000)}" for _ in range(length)]
        for _ in range(per):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
            rows.append((i, " ".join(w)))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("case", [(1, 6, 12, 100, 4), (2, 2, 60, 120, 9), (3, 1, 80, 60, 3)])
def test_components_equal_all_pairs(spark, case):
    rows = near_copies(*case)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4)
    want = brute(rows, 4)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


@pytest.mark.parametrize("case", [(1, 6, 12, 100, 4), (5, 2, 70, 90, 12)])
def test_blocks_of_large_buckets(spark, monkeypatch, case):
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    rows = near_copies(*case)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4)
    assert {r.doc_id: r.component_id for r in got.collect()} == brute(rows, 4)


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs, 4)
    got = queries.op10_minhash(spark, sf).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(h.shingles(t, 4)) for i, t in docs}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_awkward_rows(spark):
    docs = h.awkward_documents(spark)
    got = minhash.near_duplicates(h.with_clashes(docs), shingle=4).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 4)
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == sorted((r.doc_id, want[r.doc_id]) for r in docs.collect() if r.doc_id is not None)
    assert {(r.component_id, r.kept) for r in got if r.doc_id is None} == {(None, True)}
    assert len(got) == docs.count()
    assert {r.doc_id: r.n_shingles for r in got}[6] == 0


def test_an_id_on_different_texts_is_one_document(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(5, a), (5, b), (1, a), (9, b)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(5, 1), (1, 1), (9, 1)}


def test_empty_table(spark):
    assert minhash.near_duplicates(h.awkward_documents(spark).limit(0)).count() == 0


def test_group_of_copies_costs_about_one_comparison_each(spark, monkeypatch):
    rows = near_copies(4, 1, 300, 80, 1)
    made = []
    inner = minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, *a: (made.append(pairs.count()), inner(pairs, *a))[1])
    minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).count()
    assert made[0] < 5 * len(rows) and sum(made) < 8 * len(rows)


def test_a_stray_member_costs_one_more_copy_of_each_text(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 100)
    large = spark.range(5000).selectExpr("7L as key", "id", "10L as size", "5000L as n", "if(id = 4321, id, 0L) as comp")
    dealt = minhash._dealt(large).collect()
    assert sum(not r.apart for r in dealt) == 5000 and sum(r.apart for r in dealt) == 50
    assert {r.id for r in dealt if r.apart} == {4321} and {r.i for r in dealt} == {0} and {r.j for r in dealt} == set(range(50))
    # every member meets every other that is outside the largest component, once from its side
    some = large.selectExpr("key", "id", "size", "n", "if(id % 20 = 3, id, 0L) as comp")
    dealt = minhash._dealt(some).collect()
    strays, at = {}, {}
    for r in dealt:
        (strays if r.apart else at).setdefault(r.id, set()).add((r.i, r.j))
    assert len(strays) == 250 and len(at) == 5000
    assert all(len(strays[x] & at[y]) == 1 for x in list(strays)[:50] for y in list(at)[::50])


def test_small_sets_are_found_exactly():
    """Every pair of sets of up to ten shingles that differ by one, or by one each, has a key in common, as min-max buckets alone would not ensure."""
    rng = np.random.default_rng(5)
    for _ in range(3000):
        n = int(rng.integers(4, 11))
        base = rng.integers(0, 1 << 63, n + 2, dtype=np.uint64)
        a = np.unique(base[:n])
        for b in (np.unique(np.append(base[1:n], base[n])), a[:-1], np.unique(base[: n + 1])):
            sets = {len(a), len(b)}
            inter = len(np.intersect1d(a, b))
            if 100 * inter >= 80 * (len(a) + len(b) - inter) and max(sets) <= 10:
                assert set(minhash.tiny_keys(a, 80)) & set(minhash.tiny_keys(b, 80))
    assert minhash.tiny_keys(base[:3], 80) == [] and minhash.tiny_keys(np.sort(rng.integers(0, 99, 11, dtype=np.uint64)), 80) == []
    assert len(minhash.tiny_keys(np.sort(base[:4]), 80)) == 1 and minhash.tiny_keys(base[:4], 100) == []


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_many_short_texts_equal_all_pairs(spark, monkeypatch, percent):
    rng = random.Random(percent)
    rows = [(i, " ".join(rng.choice("abc") if rng.random() < 0.1 else f"t{j}" for j in range(rng.randrange(3, 15)))) for i in range(250)]
    monkeypatch.setattr(minhash.MinMax, "keys", lambda self, s: [])  # without the buckets
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1, percent=percent).collect()}
    monkeypatch.undo()
    both = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1, percent=percent).collect()}
    assert both == brute(rows, 1, percent)
    sets = {i: h.shingles(t, 1) for i, t in rows}
    high = minhash._tiny(percent)[1]
    links = [(i, j) for i, j in combinations(sets, 2) if len(sets[i] ^ sets[j]) <= 2 and abs(len(sets[i]) - len(sets[j])) <= 1 and max(len(sets[i]), len(sets[j])) <= high and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    assert all(got[i] == got[j] for i, j in links) and links


def test_minima_and_maxima_estimate_similarity():
    index = minhash.MinMax(100, 8, 5)
    rng = random.Random(1)
    common = [f"c{i}" for i in range(600)]
    a = " ".join(common + [f"a{i}" for i in range(200)])
    b = " ".join(common + [f"b{i}" for i in range(200)])
    s, t = minhash.shingle_hashes(a, 1), minhash.shingle_hashes(b, 1)
    agree = (index.signature(s) == index.signature(t)).mean()
    assert abs(agree - 0.6) < 0.06
    assert rng and len(index.signature(s)) == 2 * len(index.a)


def test_shingles_are_sets_of_words():
    for t in ("", " ", "a", "a b", "A b C d", "a a a a a a", "x y z w v", None):
        for k in (1, 4, 5):
            assert len(minhash.shingle_hashes(t, k)) == len(h.shingles(t, k))
    assert np.array_equal(minhash.shingle_hashes("A B C", 4), minhash.shingle_hashes("a\tb\nc", 4))
    assert not np.intersect1d(minhash.shingle_hashes("a b c", 4), minhash.shingle_hashes("z a b c", 4)).size


@pytest.mark.parametrize("local", [100_000, 10])
def test_components_helper(spark, monkeypatch, local):
    from tamis.llm import common
    from tamis.llm.common import connected_components

    monkeypatch.setattr(common, "LOCAL_EDGES", local)

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1080)] + [(7000, 7000)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == h.components({x for e in edges for x in e}, edges)
    assert connected_components(spark.createDataFrame([], "u long, v long")).select(F.count("*")).first()[0] == 0

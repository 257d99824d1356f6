import math
import random
from decimal import Decimal

import helpers as h
import numpy as np
import pytest

from tamis.llm import gridjoin, queries

FLOATS = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    ok = [(i, np.array(v, np.float64), l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    n, links = [0] * len(ok), []
    for a in range(len(ok)):
        for b in range(a + 1, len(ok)):
            (i, x, l), (j, y, m) = ok[a], ok[b]
            if l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                n[a] += 1
                n[b] += 1
                links.append((i, j))
    comp = h.components({i for i, _, _ in rows if i is not None}, links)
    return sorted([(i, k, comp[i]) for (i, _, _), k in zip(ok, n)])


def run(df):
    return sorted((r.vec_id, r.n_links, r.component_id) for r in gridjoin.near_vectors(df).collect())


def clustered(seed, n, dim, labels=3, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 8), dim))
    out = []
    for i in range(n):
        v = centres[rng.integers(len(centres))] * rng.uniform(0.1, 30) + 0
        v = v / np.linalg.norm(v) + rng.normal(size=dim) * spread / math.sqrt(dim) * rng.integers(0, 3)
        out.append((i, [float(np.float32(x)) for x in v], int(rng.integers(labels))))
    return out


@pytest.mark.parametrize("case", [(1, 300, 16), (2, 400, 3), (3, 200, 64), (4, 150, 1)])
def test_links_and_components_equal_all_pairs(spark, monkeypatch, case):
    monkeypatch.setattr(gridjoin, "BLOCK", 9)
    monkeypatch.setattr(gridjoin, "FAN", 3)
    rows = clustered(*case)
    assert run(spark.createDataFrame(rows, FLOATS)) == brute(rows)


def test_distant_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(gridjoin, "BLOCK", 20)
    rng = random.Random(1)
    rows = []
    for i in range(400):  # along a circle: only blocks near each other can hold links
        a = i / 400 * 2 * math.pi
        rows.append((i, [math.cos(a), math.sin(a), rng.random() * 0.01], 1))
    seen = []
    inner = gridjoin._compared
    monkeypatch.setattr(gridjoin, "_compared", lambda pairs, *a: (seen.append(pairs.count()), inner(pairs, *a))[1])
    rows = [(i, [float(np.float32(x)) for x in v], l) for i, v, l in rows]
    assert run(spark.createDataFrame(rows, FLOATS)) == brute(rows)
    assert seen[0] < 0.6 * 20 * 21 / 2 * 1.5


def test_query_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = queries.op4_gridjoin(spark, sf).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, nan, 1.0], 1), (8, [1.0, inf, 1.0], 1), (9, [1.0, None, 3.0], 1), (10, [], 1), (11, [2.0, 4.0, 6.0], 1), (12, [1.0, 2.0], 1), (13, [1e-30, 2e-30, 3e-30], 1), (14, [1e30, 2e30, 3e30], 1), (15, [-1.0, -2.0, -3.0], 1), (16, [0.0, -0.0, 5.0], 2), (17, [-0.0, 0.0, 5.0], 2)]
    df = h.with_clashes(spark.createDataFrame(rows, FLOATS))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in gridjoin.near_vectors(df).collect()}
    want = {i: (0, i, True) for i, _, _ in rows}
    want |= {i: (4, 1, i == 1) for i in (1, 2, 11, 13, 14)} | {16: (1, 16, True), 17: (1, 16, False)}
    assert got == want
    odd = spark.createDataFrame([(None, v, 1), (1, v, 1), (1, v, 1), (1, [3.0, -1.0, 0.0], 1), (0, [3.0, -1.0, 0.0], 1)], FLOATS)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in gridjoin.near_vectors(odd).collect()), key=str) == [(0, 1, 0, True), (1, 1, 0, False), (1, 1, 0, False), (1, 1, 0, False), (None, 0, None, True)]
    assert gridjoin.near_vectors(df.limit(0)).count() == 0
    doubles = spark.createDataFrame([(1, [1e200, 1e200], 1), (2, [1e-200, 1e-200], 1)], "vec_id long, embedding array<double>, label int")
    assert [r.n_links for r in gridjoin.near_vectors(doubles).collect()] == [1, 1]


def test_labels_and_numbers_of_any_type(spark):
    rows = [(i, v, f"l{l}") for i, v, l in clustered(8, 120, 4)]
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")) == brute(rows)
    exact = [(1, [Decimal("0.1234567890123"), Decimal("1")], True), (2, [Decimal("0.1234567890123"), Decimal("1")], True), (3, [Decimal("1"), Decimal("-7")], False)]
    assert run(spark.createDataFrame(exact, "vec_id long, embedding array<decimal(20,13)>, label boolean")) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_very_many_lengths_have_one_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(gridjoin, "FITTED", 10)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=1 + i % 40)], 1) for i in range(300)]
    seen = []
    inner = gridjoin._directions
    monkeypatch.setattr(gridjoin, "_directions", lambda c: seen.append(inner(c)) or seen[-1])
    assert run(spark.createDataFrame(rows, FLOATS)) == brute(rows)
    assert 0 < len(seen[0]) <= 10


def test_forest_spans():
    rng = np.random.default_rng(1)
    for _ in range(20):
        m = rng.random((30, 30)) < 0.04
        m = (m | m.T) & ~np.eye(30, dtype=bool)
        edges = gridjoin._forest(m)
        pairs = [(int(a), int(b)) for a, b in np.argwhere(m)]
        assert h.components(range(30), edges) == h.components(range(30), pairs)
        assert len(edges) == 30 - len(set(h.components(range(30), pairs).values()))

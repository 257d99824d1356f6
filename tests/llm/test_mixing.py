import random
from fractions import Fraction

import helpers as h
import pytest

from tamis.llm import common, mixing, queries


def targets(sizes, weights=(5, 2, 1), num=3, den=2, cap=2):
    """By the rule: share by weight, stop at the ceiling, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = Fraction(sum(sizes.values()) * num, den), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        rest, all_ = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / all_ > cap * sizes[s]]
        if not over:
            return fixed | {s: rest * weight[s] / all_ for s in free}
        fixed |= {s: Fraction(cap * sizes[s]) for s in over}


def seats(votes, n):
    """n seats to the highest quotients, one after another."""
    won = [0] * len(votes)
    for _ in range(n):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


def check(rows, got, block_words=8, shards=1):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(h.words(t))
    want = targets(sizes)
    taken = {s: 0 for s in sizes}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(want[r.source]), rel=1e-12)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= block_words * (1 + 2 * shards), (s, taken[s], float(want[s]))
    return taken


def test_query_comes_near_its_targets(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = queries.op3_mixing(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.size for r in got} == {i: len(h.words(t)) for i, t, _ in docs}
    check(docs, got)


@pytest.mark.parametrize("seed", range(3))
def test_random_tables(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(200))), rng.choice([None, "", "a", "B", "é", "zz"])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, shard_words=1000, seed=seed).collect()
    check(rows, got, shards=10)
    again = mixing.mix(df.repartition(5), shard_words=1000, seed=seed).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_sainte_lague_gives_the_highest_quotients(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    parties, want = [], {}
    for g in range(30):
        votes = [float(rng.choice([0, 1, 3, 10, 500, 10_000, rng.random() * 1000])) for _ in range(rng.randrange(1, 40))]
        n = rng.choice([0, 1, 7, 200, 1500])
        if not sum(votes):
            votes[0] = 1.0
        parties += [(g, i, v, n) for i, v in enumerate(votes)]
        want |= {(g, i): w for i, w in enumerate(seats(votes, n))}
    df = spark.createDataFrame(parties, "g long, i long, votes double, n long")
    got = mixing.sainte_lague(df, "votes", F.col("n"), ["g"], ["i"])
    assert {(r.g, r.i): r.quota for r in got.collect()} == want


def test_rows_of_the_mixture_hold_the_words_taken(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"{i}.{j}" for j in range(rng.randrange(60))), rng.choice("ab"), 0) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(df, block_words=3, shard_words=300).collect()}
    out = {}
    for r in mixing.apply_mix(df, block_words=3, shard_words=300).collect():
        out.setdefault(r.doc_id, []).extend(h.words(r.text))
    for i, t, _, _ in rows:
        n, own = taken[i][0], out.get(i, [])
        assert len(own) == n
        assert all(own.count(w) <= 2 for w in own) and set(own) <= set(h.words(t))
    assert mixing.apply_mix(df).columns == df.columns


def test_awkward_rows(spark):
    docs = h.awkward_documents(spark)
    got = mixing.mix(h.with_clashes(docs)).collect()
    assert len(got) == docs.count()
    check([(r.doc_id, r.text, r.source) for r in docs.collect()], got)
    out = mixing.apply_mix(h.with_clashes(docs))
    assert out.columns == h.with_clashes(docs).columns and out.where("text is null or text = ''").count() == 0
    plain = mixing.apply_mix(docs)
    assert h.rows_of(out, *docs.columns) == h.rows_of(plain, *docs.columns) and plain.count() > 5
    assert {tuple(r[c] for c in h.CLASHES) for r in out.collect()} == {tuple(f"clash {c}" for c in h.CLASHES)}
    kept = mixing.mix(h.with_clashes(docs), keep=("text", "size", "a.b", "taken")).collect()
    assert {(r["kept_size"], r["a.b"], r["kept_taken"]) for r in kept} == {("clash size", "clash a.b", "clash taken")}
    assert sorted((str(r.doc_id), r.size, r.taken) for r in kept) == sorted((str(r.doc_id), r.size, r.taken) for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.apply_mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.where("text is null")).agg({"taken": "sum"}).first()[0] == 0


def test_many_sources_are_joined_alike(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(60), None if i % 9 == 0 else "big" if i % 3 else f"s{i % 40}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = sorted(map(tuple, mixing.mix(df).collect()), key=str)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    monkeypatch.setattr(common, "HEAVY_KEYS", 4)
    assert sorted(map(tuple, mixing.mix(df).collect()), key=str) == one


def test_main_path_has_no_python(spark):
    plan = mixing.mix(h.awkward_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

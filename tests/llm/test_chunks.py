import random

import helpers as h
import pytest

from tamis.llm import chunks, queries


def slow_ends(text):
    """The rule, one code point after another."""
    ends, at, x, bits = [], 0, 0, chunks.NORMAL.bit_length() - 1
    for i, c in enumerate(text):
        x = ((x << 1) + int(chunks.GEAR[ord(c) & 0xFFFF])) & 0xFFFFFFFF
        size = i + 1 - at
        strict, loose = x >> (32 - bits - 2) == 0, x >> (32 - bits + 2) == 0
        if size >= chunks.MOST or (chunks.LEAST <= size < chunks.NORMAL and strict) or (size >= chunks.NORMAL and loose):
            ends.append(i + 1)
            at = i + 1
    return ends + [len(text)] * (at < len(text))


def text(rng, n, letters="abcdefgh ijklmnop é日😀"):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 31, 33, 128, 129, 500, 5000])
def test_ends_follow_the_rule(n, monkeypatch):
    rng = random.Random(n)
    for t in (text(rng, n), "a" * n, text(rng, n, "ab")):
        want = slow_ends(t)
        assert chunks.chunk_ends(t) == want
        monkeypatch.setattr(chunks, "SLICE", 64)
        assert chunks.chunk_ends(t) == want
        monkeypatch.undo()


def test_chunk_lengths_are_normalised():
    rng = random.Random(1)
    t = text(rng, 200_000)
    sizes = [b - a for a, b in zip([0, *chunks.chunk_ends(t)], chunks.chunk_ends(t))]
    assert max(sizes) <= chunks.MOST and min(sizes[:-1]) >= chunks.LEAST
    assert 0.7 * chunks.NORMAL < sum(sizes) / len(sizes) < 1.6 * chunks.NORMAL


def test_shifted_texts_share_their_chunks():
    rng = random.Random(2)
    t = text(rng, 4000)
    own = chunks.chunk_set(t)
    assert chunks.containment(own, chunks.chunk_set("xyz" + t)) > 0.95
    assert chunks.containment(own, chunks.chunk_set(text(rng, 3000) + t + text(rng, 500))) > 0.95
    assert chunks.containment(own, chunks.chunk_set(t[:2000] + "!" + t[2000:])) > 0.95
    assert chunks.containment(own, chunks.chunk_set(text(rng, 4000))) < 0.02
    assert chunks.containment(own, own) == 1.0


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: r[0])
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        own = chunks.chunk_set(t)
        out[i] = (len(t), h.sha256(edited), chunks.fingerprint(own), chunks.fingerprint(chunks.chunk_set(edited)), chunks.containment(own, chunks.chunk_set(edited)), chunks.containment(own, chunks.chunk_set(after)))
    return out


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op7_chunks(spark, sf).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got} == brute(docs)
    long = [r for r in got if r.n_chars > 400]
    assert sum(r.near_edited > 0.55 for r in long) > 0.97 * len(long)


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_next_goes_round(spark, n):
    rng = random.Random(n)
    rows = [(i * 7 - 50, text(rng, rng.randrange(300))) for i in range(n)]
    rng.shuffle(rows)
    got = chunks.probe(h.with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows)


def test_long_texts_come_back_once(spark):
    """Ranges of several MB under many cores, which Spark would coalesce one way for the walk and another for the ends."""
    rng = random.Random(3)
    seeds = [text(rng, 100_000, "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(7)]
    docs = spark.createDataFrame([(i, seeds[i % 7][i * 37 :] + seeds[i % 7][: i * 37]) for i in range(300)], "doc_id long, text string").repartition(12)
    conf = {"spark.sql.shuffle.partitions": "200", "spark.sql.adaptive.coalescePartitions.minPartitionNum": "12"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = [r.doc_id for r in chunks.probe(docs).collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(got) == list(range(300))


def test_awkward_rows(spark):
    docs = h.awkward_documents(spark)
    got = chunks.probe(docs).collect()
    assert len(got) == docs.count()
    by_text = {}
    texts = sorted((r.doc_id is not None, r.doc_id or 0, len(r.text or "")) for r in docs.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in got) == texts
    for r in got:
        by_text.setdefault((r.n_chars, r.doc_id in (1, 2)), set()).add(r.fingerprint)
    assert len(by_text[(len("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), True)]) == 1
    assert chunks.probe(docs.limit(0)).count() == 0
    one = chunks.with_fingerprints(h.with_clashes(docs)).collect()
    assert len(one) == len(got) and {r.n_chunks for r in one if r.doc_id in (4, 5)} == {0}

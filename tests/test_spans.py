"""Span operators against plain Python."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamis.functions import rules as R
from tamis.functions import validators as V
from tamis.operators import config as C
from tamis.operators import model
from tamis.operators import postfilter as PF
from tamis.operators import spans as S

TEXTS = [
    "Server 192.168.1.10 and 256.1.1.1, v6 2001:0db8:85a3:0000:0000:8a2e:0370:7334 here", "mac 00:1A:2B:3C:4D:5E or 00-1A-2B-3C-4D-5E mixed 00:1A-2B:3C:4D:5E",
    "ghp_" + "a1" * 20 + " AKIA" + "A1B2" * 4, "eyJhbGciOi.eyJzdWIi.c2ln", "cards 4111111111111111 4111111111111112 378282246310005", "fr 184127512345678 ch 756.1234.5678.97 be 850730-033-28 de 12345678901",
    "tel 079 123 45 67, 0041 79 123 45 67, x+41791234567, +41 79 123 45 67, 079 123 45 67", "😀 10.0.0.1 é 10.0.0.2\n10.0.0.3", "", "nothing here", None,
]


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return len(d) >= 13 and sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d)) % 10 == 0


def brute(text, rules=R.REGEX_RULES):
    found = [(-R.PRIORITY[r.priority], -r.score, i, m.start(), m.end(), r.pii_type) for i, r in enumerate(rules) for m in re.finditer(r.pattern, text or "") if r.check != "luhn" or luhn(m[0])]
    kept = []
    for x in sorted(found):
        if not any(x[3] < y[4] and y[3] < x[4] for y in kept):
            kept.append(x)
    return sorted((x[3], x[4], x[5]) for x in kept)


def test_rule_spans_are_those_of_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")
    got = {r.id: r.s for r in df.select("id", S.detect(F.col("text")).alias("s")).collect()}
    for i, t in enumerate(TEXTS):
        assert [(x.start, x.end, x.pii_type) for x in got[i]] == brute(t), t
        assert all((t or "")[x.start : x.end] == x.text for x in got[i])


SPANS = st.lists(st.tuples(st.integers(0, 20), st.integers(1, 6), st.sampled_from("AB"), st.sampled_from([0.5, 0.7, 0.9]), st.integers(1, 3)), max_size=12)


def python_merge(spans):
    best = {}
    for i, (a, n, t, c, _) in enumerate(spans):
        k = (a, a + n, t)
        if k not in best or c > best[k][0]:
            best[k] = (c, best.get(k, (0, i))[1])
    kept = []
    for (a, b, t), (c, i) in sorted(best.items(), key=lambda x: (x[0][0], -x[0][1], -x[1][0], x[1][1])):
        if not any(k[2] == t and a < k[1] and k[0] < b for k in kept):
            kept.append((a, b, t, c))
    return sorted(kept)


def python_mask(text, spans):
    out, at = "", 0
    for a, b, t, _ in sorted(spans):
        if a >= at:
            out += text[at:a] + f"[{t}]"
            at = b
    return out + text[at:]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(SPANS, min_size=20, max_size=40))
def test_merge_and_mask(spark, lists):
    text = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, [(a, a + n, t, text[a : a + n], c, "REGEX", p, 0) for a, n, t, c, p in s]) for i, s in enumerate(lists)]
    df = spark.createDataFrame(rows, f"id int, spans {S.SPANS}")
    merged = S.merge(F.col("spans"))
    for r in df.select("id", merged.alias("m"), S.mask(F.lit(text), merged).alias("mask")).collect():
        want = python_merge(lists[r.id])
        assert [(x.start, x.end, x.pii_type) for x in r.m] == [w[:3] for w in want]
        assert r.mask == python_mask(text, want)


def test_priority_beats_score_and_order(spark):
    rows = [([(0, 5, "A", "x", 0.9, "R", 1, 0), (3, 8, "B", "x", 0.5, "R", 3, 1), (8, 9, "C", "x", 0.5, "R", 1, 2), (8, 9, "D", "x", 0.5, "R", 1, 3)],)]
    got = spark.createDataFrame(rows, f"spans {S.SPANS}").select(S.resolve_by_priority(F.col("spans"))).first()[0]
    assert [(x.start, x.pii_type) for x in got] == [(3, "B"), (8, "C")]


def test_contexts(spark):
    text = "first line\nmail a@b.ch and 10.0.0.1 tail text\nlast"
    spans = [(16, 22, "EMAIL", "a@b.ch", 1.0, "R", 1, 0), (27, 35, "IP_ADDRESS", "10.0.0.1", 1.0, "R", 1, 1)]
    d = spark.createDataFrame([(text, spans)], f"text string, spans {S.SPANS}").withColumn("x", F.col("spans")[0])
    r = d.select(S.masked_context(F.col("text"), F.col("x"), F.col("spans")).alias("m"), S.sensitive_context(F.col("text"), F.col("x")).alias("s"), S.masked_content(F.col("text"), F.col("spans"), 20).alias("c")).first()
    assert r.m == "mail [EMAIL] and [IP_ADDRESS] ta…" and r.s == "mail a@b.ch and 10.0.0.1 tail text" and r.c == "first line\nmail [EMA…"


def test_service_mask_and_tokens(spark):
    d = spark.createDataFrame([("x" * 10_001,), ("short",)], "t string")
    assert [r[0] for r in d.select(S.service_mask(F.col("t"), S.empty())).collect()] == [S.NOTICE, "short"]
    t = spark.createDataFrame([(None,), (" ",), ("null",), ("A",)], "t string")
    assert [r[0] for r in t.select(S.token(F.col("t"))).collect()] == ["[UNKNOWN]"] * 3 + ["[A]"]


def test_severity(spark):
    assert {k: len(v) for k, v in R.SEVERITY.items()} == {"HIGH": 32, "MEDIUM": 52, "LOW": 37}
    t = spark.createDataFrame([(" iban ",), ("AGE",), ("X",), ("IP_ADDRESS",)], "t string")
    assert [r[0] for r in t.select(S.severity(F.col("t"), {"IP_ADDRESS": "MEDIUM"})).collect()] == ["HIGH", "MEDIUM", "LOW", "MEDIUM"]


def test_gate(spark):
    rows = (("A", "REGEX", True, 0.8, "x", "LOW"), ("B", "REGEX", False, 0.1, "x", "LOW"), ("C", "PRESIDIO", False, 0.1, "x", "LOW"))
    spans = [(i, i + 1, t, "v", c, "REGEX", 1, 0) for i, (t, c) in enumerate([("A", 0.9), ("A", 0.7), ("B", 0.9), ("C", 0.9), ("D", 0.1)])]
    d = spark.createDataFrame([(spans,)], f"spans {S.SPANS}")
    by_list = [x.start for x in d.select(C.gate(F.col("spans"), rows)).first()[0]]
    by_join = sorted(r.start for r in C.gate_join(d.select(F.explode("spans").alias("x")).select("x.*"), C.config_table(spark, rows)).collect())
    assert by_list == by_join == [0, 3, 4]


def test_checksums(spark):
    rng = random.Random(5)
    numbers = ["".join(rng.choice("0123456789") for _ in range(rng.randrange(11, 20))) for _ in range(300)]
    d = spark.createDataFrame([(n,) for n in numbers], "n string")
    assert [r[0] for r in d.select(V.luhn(F.col("n"))).collect()] == [luhn(n) for n in numbers]

    def mod(s):
        s = s[4:] + s[:4]
        return int("".join(str(int(c, 36)) for c in s)) % 97

    ibans = ["".join(rng.choice("ABCXYZ0123456789") for _ in range(22)) for _ in range(200)] + ["GB82WEST12345698765432", "CH9300762011623852957"]
    d = spark.createDataFrame([(n,) for n in ibans], "n string")
    assert [r[0] for r in d.select(V.mod97(F.col("n"))).collect()] == [mod(n) for n in ibans]
    assert [r[0] for r in d.select(V.iban(F.col("n"))).collect()][-2:] == [True, True]


@pytest.mark.parametrize("text,good", [("::", True), ("::1", True), ("1::", True), ("2001:db8::ff00:42:8329", True), ("::ffff:1.2.3.4", True), ("1:2:3:4:5:6:7:8", True), ("1:2:3:4:5:6:7", False), ("1::2::3", False), (":::", False), ("12345::", False), ("1:2:3:4:5:6:7:8:9", False), ("", False)])
def test_ipv6(spark, text, good):
    assert spark.range(1).select(V.ipv6(F.lit(text))).first()[0] is good


def test_model_hook(spark):
    assert model.first_array('<think>[9]</think> x [{"a": [1]}] [2]') == [{"a": [1]}] and model.first_array("none") == [] and model.first_array("[broken") == []
    docs = spark.createDataFrame([(1, "Ann met Bob, Ann left"), (2, "boom"), (3, None)], "doc_id long, text string")

    def ask(text):
        if text == "boom":
            raise RuntimeError
        return '[{"text": "Ann", "label": "personName"}, {"text": "Zed", "label": "x"}, {"text": "Bob", "label": ""}, {"text": "Bob", "label": "Odd One"}]'

    got = {r.doc_id: [(x.start, x.pii_type) for x in r.spans] for r in model.detect_with(docs, ask, {"person_name": "PERSON"}).collect()}
    assert got == {1: [(0, "PERSON"), (8, "ODD_ONE")], 2: [], 3: []}


def test_a_text_with_very_many_spans(spark):
    """Folds go in blocks, so a log of 30,000 addresses is a matter of seconds."""
    import time

    text = " ".join(f"10.{i % 200}.3.4 u{i}@example.org" for i in range(30_000))
    d = spark.createDataFrame([(text,)], "text string")
    began = time.perf_counter()
    spans = S.merge(S.detect(F.col("text")), S.detect(F.col("text"), R.ENTITY_RULES))
    got = d.select(F.size(spans).alias("n"), F.length(S.mask(F.col("text"), spans)).alias("m")).first()
    assert got.n == 60_000 and got.m == len(" ".join(["[IP_ADDRESS] [EMAIL]"] * 30_000))
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("block", [2, 3, 256])
def test_blocks_do_not_matter(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for _ in range(60):
        text = "".join(rng.choice("ab é😀") for _ in range(40))
        spans = [(a, min(40, a + rng.randrange(1, 9)), rng.choice("AB"), "x", rng.choice([0.5, 0.9]), "S", rng.randrange(1, 4), i) for i in range(rng.randrange(12)) for a in [rng.randrange(39)]]
        rows.append((text, spans))
    d = spark.createDataFrame(rows, f"text string, spans {S.SPANS}")
    got = d.select("text", "spans", S.resolve_by_priority(F.col("spans")).alias("p"), S.resolve_by_type(F.col("spans")).alias("t"), S.mask(F.col("text"), F.col("spans")).alias("m")).collect()

    def greedy(spans, key, clash):
        kept = []
        for s in sorted(spans, key=key):
            if not any(s.start < k.end and k.start < s.end and clash(s, k) for k in kept):
                kept.append(s)
        return sorted(kept)

    for r in got:
        assert r.p == greedy(r.spans, lambda s: (-s.priority, -s.score, s.ord, s.start), lambda s, k: True)
        assert r.t == greedy(r.spans, lambda s: (s.start, -s.end, -s.score), lambda s, k: s.pii_type == k.pii_type)
        out, at = "", 0
        for s in sorted(r.spans):
            if s.start >= at:
                out, at = out + r.text[at : s.start] + f"[{s.pii_type}]", s.end
        assert r.m == out + r.text[at:]


def test_a_digest_read_as_a_wallet_is_discarded_and_an_address_kept(spark):
    """A SHA-1 digest may begin like an address; the post-filter goes by its shape, whatever its type is."""
    digest, address = "bc141c8477ceaed7b9aa8bfba357b8827d687865", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"
    d = spark.createDataFrame([(f"commit {digest} pays {address}",)], "text string")
    x = d.select(PF.split(S.detect(F.col("text"), R.ENTITY_RULES)).alias("x")).first().x
    assert [(s.pii_type, s.text) for s in x.kept] == [("CRYPTO_WALLET", address)]
    assert [(g.span.pii_type, g.span.text, g.reason) for g in x.discarded] == [("CRYPTO_WALLET", digest, "technical artifact: sha1-digest (hex-40)")]

"""Check digits against public examples and plain Python; rules from a file; which rules a configuration enables."""

import random

import pytest
from pyspark.sql import functions as F

from tamis.functions import rules as R
from tamis.functions import validators as V
from tamis.operators import spans as S

VALID = {
    "nhs": ["943 476 5919", "9434765919"], "pesel": ["44051401359", "02070803628"], "abn": ["51 824 753 556", "53004085616"], "acn": ["004 085 616", "000000019"], "tfn": ["123 456 782", "876543210"],
    "medicare": ["2123 45670 1", "2428778132"], "verhoeff": ["2363", "758722", "234123412346"], "nif": ["12345678Z", "X1234567L", "00000000T"], "nric": ["S1234567D", "T1234567J", "F1234567N", "G1234567X"], "hetu": ["131052-308T"],
    "rrn": ["970131-2234565"], "luhn11": ["IT07643520567", "00743110157"], "tnin": ["1234567890121"],
}


@pytest.mark.parametrize("check", sorted(VALID))
def test_check_digits(spark, check):
    rows = []
    for t in VALID[check]:
        at = [i for i, c in enumerate(t) if c.isdigit()]
        k = at[-2] if check == "medicare" else at[-1]  # the last digit there is the card's issue
        wrong = [t[:k] + str((int(t[k]) + d) % 10) + t[k + 1 :] for d in range(1, 10)]
        rows += [(t, True)] + [(w, False) for w in wrong]
    got = spark.createDataFrame(rows, "t string, want boolean").select("t", "want", V.CHECKS[check](F.col("t")).alias("ok")).collect()
    assert all(r.ok for r in got if r.want), [r.t for r in got if r.want and not r.ok]
    # a change of the last digit is always noticed, but where other numbers of the same check digit are reached
    assert sum(r.ok for r in got if not r.want) <= (1 if check in ("tnin", "rrn") else 0) * len(VALID[check])


def test_verhoeff_notices_every_change_and_swap(spark):
    rng = random.Random(1)
    t = "234123412346"
    rows = [t[:i] + str((int(t[i]) + d) % 10) + t[i + 1 :] for i in range(12) for d in range(1, 10)] + [t[:i] + t[i + 1] + t[i] + t[i + 2 :] for i in range(11) if t[i] != t[i + 1]]
    rng.shuffle(rows)
    assert spark.createDataFrame([(x,) for x in rows], "t string").where(V.verhoeff(F.col("t"))).count() == 0


FILE = """
[[patterns]]
name = "badge"
pii_type = "BADGE"
pattern = 'B-[0-9]{4}'
score = 0.9
priority = "high"

[[patterns]]
name = "off"
pii_type = "OFF"
pattern = 'x'
enabled = false

[[patterns]]
name = "broken"
pii_type = "BROKEN"
pattern = '('

[[patterns]]
name = "card"
pii_type = "CARD"
pattern = '[0-9]{16}'
validation = "luhn"

[[patterns]]
name = "odd"
pii_type = "ODD"
pattern = 'odd'
validation = "nobody knows"
"""


def test_rules_from_a_file(spark):
    rules = R.load_rules(FILE)
    assert [(r.name, r.score, r.priority, r.check) for r in rules] == [("badge", 0.9, "high", None), ("card", 0.5, "medium", "luhn"), ("odd", 0.5, "medium", "nobody knows")]
    d = spark.createDataFrame([("B-1234 x 4111111111111111 4111111111111112 odd",)], "t string")
    assert [(s.pii_type, s.text) for s in d.select(S.detect(F.col("t"), rules).alias("s")).first().s] == [("BADGE", "B-1234"), ("CARD", "4111111111111111"), ("ODD", "odd")]
    assert R.load_rules("") == ()


def test_enabled_types_and_thresholds():
    on = lambda *rows: {r.name for r in R.entity_rules([(t, R.ENTITY, e, th, "c", "LOW") for t, e, th in rows])}
    assert on(("EMAIL_ADDRESS", True, 0.7), ("URL", False, 0.1), ("URL", False, 0.9), ("ES_NIF", True, 0.9)) == {"email", "es_nif_checked"}
    assert on(("ES_NIF", True, 0.5)) == {"es_nif_checked", "es_nif"} and on() == set()
    assert {r.name for r in R.entity_rules(R.TYPE_CONFIG)} == {"credit_card", "iban", "btc", "mac_address"}


def test_detectors_together(spark):
    d = spark.createDataFrame([(1, "10.0.0.1 a@b.org"), (2, ""), (3, None)], "id int, t string")
    detectors = {"a": S.detect, "b": lambda t: S.detect(t, R.ENTITY_RULES), "c": lambda t: F.lit(None).cast(S.SPANS)}
    got = {r.id: (r.x.stats, [s.text for s in r.x.spans]) for r in d.select("id", S.detect_all(F.col("t"), detectors).alias("x")).collect()}
    assert got == {1: ({"a": 1, "b": 2, "c": 0}, ["10.0.0.1", "a@b.org"]), 2: ({"a": 0, "b": 0, "c": 0}, []), 3: ({"a": 0, "b": 0, "c": 0}, [])}
    off = d.select(S.detect_all(F.col("t"), detectors, ("b",)).alias("x")).first().x
    assert off.stats == {"b": 2}
    assert d.select(S.detect_all(F.col("t"), detectors, ()).alias("x")).first().x.spans == []

"""Lines as the services write them, and what is to be read from them, by hand."""

import pytest

from tamis.operators import logs as L

DETECTION = "[THROUGHPUT] phase=detection request_id=req_42 chars=15234 duration_s=3.421 chars_per_s=4453.4 entities_in=42"
TOTAL = "[THROUGHPUT] phase=total request_id=req_42 chars=15234 duration_s=3.500 chars_per_s=4352.6 entities_final=24"
CLIENT = "[THROUGHPUT] phase=grpc.client request_id=550e8400-e29b-41d4-a716-446655440000 chars=15234 duration_ms=3421 chars_per_s=4453.40"


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def parsed(spark, *texts):
    return [(r.phase, r.request_id, r.chars, r.duration_s, r.chars_per_s, r.extra) for r in L.parse_throughput(lines(spark, *texts)).orderBy("phase", "request_id").collect()]


def test_throughput_lines(spark):
    assert parsed(spark, DETECTION) == [("detection", "req_42", 15234, 3.421, 4453.4, {"entities_in": "42"})]
    assert parsed(spark, TOTAL)[0][5] == {"entities_final": "24"}
    assert parsed(spark, "2026-05-25 12:34:56.789 INFO 1 --- [reactor-http-nio-2] p.s.a.Client : " + CLIENT) == [("grpc.client", "550e8400-e29b-41d4-a716-446655440000", 15234, 3.421, 4453.4, {})]
    assert parsed(spark, "2026-05-25 12:34:56,789 INFO x.throughput " + DETECTION)[0][:2] == ("detection", "req_42")
    assert parsed(spark, "INFO some unrelated log line", "", "[THROUGHPUT] phase=detection request_id=req duration_s=1.0", "[THROUGHPUT] nothing", None) == []
    assert parsed(spark, "[THROUGHPUT] phase=a chars=1 duration_s=1", "[THROUGHPUT] phase=a request_id=r chars=x duration_s=1", "[THROUGHPUT] phase=a request_id=r chars=1 duration_s=x") == []
    extra = "[THROUGHPUT] phase=detection request_id=req_99 chars=10 duration_s=1.0 chars_per_s=10.0 custom_field=hello another=42 a.b2=\"x y\""
    assert parsed(spark, extra)[0][5] == {"custom_field": "hello", "another": "42", "a.b2": "x y"}
    odd = "[THROUGHPUT] phase=a request_id=r chars=42.0 duration_s=n duration_ms=500 entities_in=7.0 phase=b entities_in=8.0"
    assert parsed(spark, odd) == [("b", "r", 42, 0.5, 84.0, {"entities_in": "8"})]
    assert parsed(spark, "[THROUGHPUT] phase=a request_id=r chars=1 duration_s=0")[0][4] == 0.0


def test_finding_lines(spark):
    got = L.parse_funnel(lines(spark, "x [FINDING_TRACKER] [r1] step=GRPC_FINAL_RESPONSE count=7", "[FINDING_TRACKER] step=MERGER_AFTER_DEDUP in=9 out=7 dropped=2", "[FINDING_TRACKER] [r 2]  step=OTHER in=1 out=3", "[FINDING_TRACKER] step=ODD", "[FINDINGS] [r1] RAW=7", "step=A count=1"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([("r1", "GRPC_FINAL_RESPONSE", 7, None, None, None), (None, "MERGER_AFTER_DEDUP", None, 9, 7, 2), ("r 2", "OTHER", None, 1, 3, None), (None, "ODD", None, None, None, None)], key=str)


def test_bisection_of_a_request(spark):
    d = L.parse_funnel(
        lines(
            spark, "[FINDING_TRACKER] [r] step=GRPC_FINAL_RESPONSE count=10", "[FINDING_TRACKER] [r] step=COMPOSITE_REGEX_RAW count=20", "[FINDING_TRACKER] [r] step=MERGER_AFTER_DEDUP in=20 out=19 dropped=1",
            "[FINDING_TRACKER] [r] step=GRPC_AFTER_TYPE_CONFIG_FILTER in=19 out=12", "[FINDING_TRACKER] [r] step=MINE count=3", "[FINDING_TRACKER] step=MERGER_AFTER_DEDUP in=4 out=2 dropped=2",
        )
    )
    got = {(r.request_id, r.step): (r.position, r.findings, r.dropped, r.recall_pct, r.marked) for r in L.funnel(d).collect()}
    assert got == {
        ("r", "COMPOSITE_REGEX_RAW"): (1, 20, None, 100.0, False), ("r", "MERGER_AFTER_DEDUP"): (5, 19, 1, 95.0, False), ("r", "GRPC_AFTER_TYPE_CONFIG_FILTER"): (8, 12, 7, 60.0, True),
        ("r", "GRPC_FINAL_RESPONSE"): (9, 10, None, 50.0, False), ("r", "MINE"): (None, 3, None, None, False), ("<no-request-id>", "MERGER_AFTER_DEDUP"): (5, 2, 2, 50.0, False),
    }


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_bench_summary_by_position(spark, keys):
    durations = [5, 1, 9, 9, 3, 7, 2, 2, 8, 30, None]
    d = spark.createDataFrame([(k, 10, x, 1) for k in ("a", None) for x in durations], "k string, chars int, duration_ms int, findings int")
    n = 1 if keys else 2
    known = sorted(x for x in durations if x is not None for _ in range(n))
    for r in L.bench_summary(d, *keys).collect():
        assert (r.n, r.p95_ms) == (11 * n, known[max(0, int(len(known) * 0.95) - 1)])

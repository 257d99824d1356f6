"""Queries of the reporting side, over the event table read as an event store, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions import crypto
from tamis.functions import rules as R
from tamis.operators import config as C
from tamis.operators import evaluation as E
from tamis.operators import logs as L
from tamis.operators import scans as S
from tamis.plans.detection import SQL_REGEX, exploded, regex_spans, sql_severity, table

QUERIES, ORACLES = {}, {}
TYPES = {"signup": "start", "view": "item", "click": "attachmentItem", "purchase": "pageComplete", "error": "scanError"}

SQL_EVENTS = """ev AS (
    SELECT 'scan' || (user_id % 3) AS scan_id, 'space' || (user_id % 20) AS space_key, event_id AS event_seq, ts,
        CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'complete' ELSE 'start' END WHEN 'view' THEN 'item' WHEN 'click' THEN 'attachmentItem' WHEN 'purchase' THEN 'pageComplete' ELSE 'scanError' END AS event_type,
        'p' || (event_id % 50) AS page_id, CASE WHEN event_type = 'click' OR event_type = 'error' AND event_id % 2 = 0 THEN 'a' || (event_id % 7) || '.pdf' END AS attachment_name,
        event_id % 1000 AS chars, CAST(event_id % 101 AS DOUBLE) AS progress, event_id % 4 AS findings
    FROM events)"""
SQL_STATES = f"""{SQL_EVENTS}, cr AS (
    SELECT *, CASE event_type WHEN 'complete' THEN 'COMPLETED' ELSE 'RUNNING' END AS status FROM ev WHERE event_type IN ('item', 'attachmentItem', 'pageComplete', 'complete')),
    st AS (SELECT scan_id, space_key, arg_max(page_id, event_seq) FILTER (WHERE event_type = 'pageComplete') AS last_page, arg_max(attachment_name, event_seq) FILTER (WHERE event_type = 'attachmentItem') AS last_attachment,
        arg_max(progress, event_seq) AS progress, arg_max(status, event_seq) AS status, arg_max(ts, event_seq) AS updated_at FROM cr GROUP BY ALL),
    latest AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY space_key ORDER BY updated_at DESC, scan_id DESC) = 1)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def store(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.when((F.lit(k) == "signup") & (F.col("event_id") % 5 == 0), "complete").otherwise(v)) for k, v in TYPES.items()])
    named = (F.col("event_type") == "click") | ((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0))
    return e.select(
        F.concat(F.lit("scan"), F.col("user_id") % 3).alias("scan_id"), F.concat(F.lit("space"), F.col("user_id") % 20).alias("space_key"), F.col("event_id").alias("event_seq"), "ts", kind.alias("event_type"),
        F.concat(F.lit("p"), F.col("event_id") % 50).alias("page_id"), F.when(named, F.concat(F.lit("a"), F.col("event_id") % 7, F.lit(".pdf"))).alias("attachment_name"),
        (F.col("event_id") % 1000).alias("chars"), (F.col("event_id") % 101).cast("double").alias("progress"), (F.col("event_id") % 4).alias("findings"),
    )


def states(spark, sf) -> DataFrame:
    return S.checkpoints(S.checkpoint_rows(store(spark, sf)))


@query(f"WITH {SQL_EVENTS} SELECT scan_id, space_key, count(*) FILTER (WHERE event_type = 'pageComplete') AS pages_done, count(*) FILTER (WHERE event_type = 'attachmentItem') AS attachments_done, max(ts) AS last_event_ts FROM ev GROUP BY ALL")
def agg03_space_counters(spark, sf):
    return S.space_counters(store(spark, sf))


@query(f"WITH {SQL_EVENTS} SELECT scan_id, max(ts) AS last_ts, count(DISTINCT space_key) AS spaces FROM ev GROUP BY scan_id ORDER BY last_ts DESC, scan_id LIMIT 1")
def agg04_latest_scan(spark, sf):
    return S.latest_scan(store(spark, sf))


@query(f"WITH {SQL_EVENTS} SELECT coalesce(max(event_seq), 0) AS max_seq FROM ev WHERE scan_id = 'scan1'")
def agg05_max_seq(spark, sf):
    return S.max_seq(store(spark, sf), "scan1")


@query(
    f"""WITH {SQL_EVENTS}, a AS (SELECT scan_id, space_key, min(ts) FILTER (WHERE event_type = 'start') AS started_at, max(ts) FILTER (WHERE event_type = 'complete') AS finished_at,
        count(*) FILTER (WHERE event_type = 'item') AS pages, CAST(coalesce(sum(chars) FILTER (WHERE event_type = 'item'), 0) AS BIGINT) AS page_chars,
        count(*) FILTER (WHERE event_type = 'attachmentItem') AS attachments, CAST(coalesce(sum(chars) FILTER (WHERE event_type = 'attachmentItem'), 0) AS BIGINT) AS attachment_chars,
        count(*) FILTER (WHERE event_type = 'scanError' AND attachment_name IS NULL) AS failed_pages, count(*) FILTER (WHERE event_type = 'scanError' AND attachment_name IS NOT NULL) AS failed_attachments FROM ev GROUP BY ALL)
    SELECT *, epoch_us(finished_at) // 1000 - epoch_us(started_at) // 1000 AS duration_ms FROM a"""
)
def agg06_space_stats(spark, sf):
    return S.space_stats(store(spark, sf))


@query(
    f"""WITH {SQL_REGEX}, f AS (SELECT doc_id, count(*) AS n FROM regex GROUP BY 1), r AS (SELECT 'scan1' AS scan_id, source AS space_key, unnest(['REGEX', 'PRESIDIO']) AS detector, CAST(1 + length(text) // 100 AS BIGINT) AS busy_ms,
        CAST(length(text) AS BIGINT) AS chars, coalesce(n, 0) AS found FROM documents LEFT JOIN f USING (doc_id))
    SELECT scan_id, space_key, detector, CAST(sum(busy_ms) AS BIGINT) AS busy_ms, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(found) AS BIGINT) AS found, CAST(0 AS BIGINT) AS discarded,
        round(sum(chars) * 1000.0 / sum(busy_ms), 1) AS chars_per_s FROM r GROUP BY ALL"""
)
def agg07_detector_stats(spark, sf):
    d = regex_spans(spark, sf)
    runs = d.select(
        F.lit("scan1").alias("scan_id"), F.col("source").alias("space_key"), F.explode(F.array(F.lit("REGEX"), F.lit("PRESIDIO"))).alias("detector"), (1 + F.floor(F.length("text") / 100)).cast("long").alias("busy_ms"),
        F.length("text").cast("long").alias("chars"), F.size("spans").cast("long").alias("found"), F.lit(0).cast("long").alias("discarded"),
    )
    return S.detector_stats(runs)


@query(f"WITH {SQL_STATES} SELECT scan_id, space_key, last_page, last_attachment, progress, status, updated_at FROM st")
def stt01_checkpoints(spark, sf):
    return states(spark, sf)


@query(f"WITH {SQL_STATES} SELECT scan_id, space_key, event_seq, status, CASE WHEN event_type = 'pageComplete' THEN page_id END AS last_page, CASE WHEN event_type = 'attachmentItem' THEN attachment_name END AS last_attachment FROM cr")
def stt02_checkpoint_rows(spark, sf):
    return S.checkpoint_rows(store(spark, sf)).drop("ts", "progress")


@query(f"WITH {SQL_STATES} SELECT scan_id, space_key, status, updated_at FROM latest")
def win01_latest_checkpoints(spark, sf):
    return S.latest_checkpoints(states(spark, sf)).select("scan_id", "space_key", "status", "updated_at")


@query(f"WITH {SQL_EVENTS} SELECT scan_id, event_seq AS source_seq, row_number() OVER (PARTITION BY scan_id ORDER BY ts, event_seq) AS event_seq FROM ev")
def snk01_event_numbers(spark, sf):
    return S.appended(store(spark, sf).withColumnRenamed("event_seq", "source_seq"), ["ts", "source_seq"]).select("scan_id", "source_seq", "event_seq")


_SQL_SEVERITY = f"sev AS (SELECT scan_id, space_key, count(*) FILTER (WHERE findings = 3) AS high, count(*) FILTER (WHERE findings = 2) AS medium, count(*) FILTER (WHERE findings = 1) AS low FROM ev GROUP BY ALL)"


@query(
    f"""WITH {SQL_STATES}, {_SQL_SEVERITY}, c AS (SELECT scan_id, space_key, count(*) FILTER (WHERE event_type = 'pageComplete') AS pages_done, count(*) FILTER (WHERE event_type = 'attachmentItem') AS attachments_done, max(ts) AS last_event_ts FROM ev GROUP BY ALL)
    SELECT scan_id, space_key, status, progress, pages_done, attachments_done, last_event_ts, high, medium, low FROM latest LEFT JOIN c USING (scan_id, space_key) LEFT JOIN sev USING (scan_id, space_key)"""
)
def agg14_global_summary(spark, sf):
    e = store(spark, sf)
    n = lambda k, name: F.count_if(F.col("findings") == k).alias(name)
    return S.reporting_summary(e, states(spark, sf), e.groupBy(*S.KEY).agg(n(3, "high"), n(2, "medium"), n(1, "low")))


@query(
    f"""WITH {SQL_STATES}, c AS (SELECT scan_id, space_key, count(*) FILTER (WHERE event_type = 'pageComplete') AS pages_done, count(*) FILTER (WHERE event_type = 'attachmentItem') AS attachments_done, max(ts) AS last_event_ts FROM ev WHERE scan_id = 'scan1' GROUP BY ALL)
    SELECT space_key, coalesce(status, CASE WHEN pages_done + attachments_done > 0 THEN 'PAUSED' ELSE 'NOT_STARTED' END) AS status, progress, pages_done, attachments_done, last_event_ts FROM c LEFT JOIN st USING (scan_id, space_key)"""
)
def join02_scan_summary(spark, sf):
    return S.scan_summary(store(spark, sf), states(spark, sf), "scan1")


@query(
    f"""WITH {SQL_EVENTS} SELECT scan_id, event_seq, row_number() OVER (PARTITION BY scan_id ORDER BY CASE event_type WHEN 'start' THEN 0 WHEN 'complete' THEN 2 ELSE 1 END,
        CASE WHEN event_type NOT IN ('start', 'complete') THEN CAST(substr(page_id, 2) AS BIGINT) END, CASE event_type WHEN 'attachmentItem' THEN 1 WHEN 'pageComplete' THEN 3 ELSE 2 END, event_seq) - 1 AS position FROM ev"""
)
def stt08_stream_order(spark, sf):
    return S.stream_order(store(spark, sf).withColumn("idx", F.substr("page_id", F.lit(2)).cast("long"))).select("scan_id", "event_seq", "position")


@query(f"WITH {SQL_EVENTS}, f AS (SELECT scan_id, space_key, max(ts) FILTER (WHERE event_type = 'complete') AS finished_at FROM ev GROUP BY ALL) SELECT * FROM f WHERE finished_at IS NULL OR finished_at + INTERVAL 1 HOUR >= TIMESTAMP '2024-01-25 00:00:00'")
def stt11_unexpired(spark, sf):
    e = store(spark, sf)
    now = F.lit("2024-01-25 00:00:00").cast(e.schema["ts"].dataType)
    return S.unexpired(S.space_stats(e).select("scan_id", "space_key", "finished_at"), now)


@query(f"WITH {SQL_STATES} SELECT ev.scan_id, ev.space_key, event_seq FROM ev JOIN latest USING (scan_id, space_key) WHERE event_type IN ('item', 'attachmentItem')")
def join04_latest_items(spark, sf):
    return S.latest_items(store(spark, sf), states(spark, sf)).select("scan_id", "space_key", "event_seq")


@query(f"WITH {SQL_EVENTS} SELECT CASE WHEN attachment_name IS NULL THEN 'PAGE' ELSE 'ATTACHMENT' END AS kind, coalesce(attachment_name, page_id) AS name, min(event_seq) AS first_seq FROM ev WHERE event_type = 'scanError' GROUP BY ALL ORDER BY first_seq LIMIT 20")
def top02_failed_items(spark, sf):
    return S.failed_items(store(spark, sf))


@query(
    f"""WITH {SQL_EVENTS}, one AS (SELECT * FROM ev WHERE findings > 0 QUALIFY row_number() OVER (PARTITION BY space_key, page_id, coalesce(attachment_name, '') ORDER BY event_seq) = 1)
    SELECT space_key, page_id, attachment_name, event_seq FROM one QUALIFY row_number() OVER (PARTITION BY space_key ORDER BY event_seq) <= 400"""
)
def top03_first_items(spark, sf):
    return S.first_items(store(spark, sf)).select("space_key", "page_id", "attachment_name", "event_seq")


@query(
    f"""WITH {SQL_STATES}, pg AS (SELECT DISTINCT space_key, page_id, CAST(substr(page_id, 2) AS BIGINT) AS idx FROM ev), s AS (SELECT l.*, pg.idx AS li FROM latest l LEFT JOIN pg ON pg.space_key = l.space_key AND pg.page_id = l.last_page)
    SELECT pg.space_key, pg.page_id, pg.idx, CAST(CASE WHEN s.space_key IS NULL THEN 0 ELSE greatest(0, coalesce(li + 1, 0) - CASE WHEN last_attachment IS NOT NULL AND status = 'RUNNING' THEN 1 ELSE 0 END) END AS BIGINT) AS analyzed_offset
    FROM pg LEFT JOIN s USING (space_key) WHERE s.space_key IS NULL OR status <> 'COMPLETED' AND pg.idx >= CASE WHEN li IS NULL THEN 0 WHEN last_attachment IS NOT NULL THEN li ELSE li + 1 END"""
)
def stt04_remaining_pages(spark, sf):
    pages = store(spark, sf).select("space_key", "page_id", F.substr("page_id", F.lit(2)).cast("long").alias("idx")).distinct()
    return S.remaining_pages(pages, S.latest_checkpoints(states(spark, sf))).withColumn("analyzed_offset", F.col("analyzed_offset").cast("long"))


_STATUS = ("NOT_STARTED", "RUNNING", "PAUSED", "FAILED", "COMPLETED")
_ALLOWED = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in S.TRANSITIONS)


@query(
    f"""SELECT f AS status, t AS next, i AS initiator, f = t OR (f, t, i) IN ({_ALLOWED}) AS allowed FROM (SELECT unnest({list(_STATUS)}) AS f), (SELECT unnest({list(_STATUS)}) AS t), (SELECT unnest(['USER', 'SYSTEM']) AS i)"""
)
def stt03_transitions(spark, sf):
    d = spark.createDataFrame([(a, b, c) for a in _STATUS for b in _STATUS for c in ("USER", "SYSTEM")], "status string, next string, initiator string")
    return d.withColumn("allowed", S.transition_allowed(F.col("status"), F.col("next"), F.col("initiator")))


@query(f"WITH {SQL_STATES} SELECT scan_id, space_key, CASE WHEN scan_id = 'scan1' AND status = 'RUNNING' THEN 'PAUSED' ELSE status END AS status FROM st")
def stt06_paused(spark, sf):
    return S.paused(states(spark, sf), "scan1").select("scan_id", "space_key", "status")


@query(f"WITH {SQL_STATES} SELECT scan_id, space_key, CASE WHEN status = 'RUNNING' THEN 'COMPLETED' ELSE status END AS status FROM st WHERE space_key NOT IN ('space1', 'space2')")
def stt07_purged(spark, sf):
    return S.purged(states(spark, sf), ["space1", "space2"]).select("scan_id", "space_key", "status")


@query(
    f"""WITH {SQL_EVENTS}, e AS (SELECT scan_id, 'multiStart' AS event_type, min(ts) AS ts, 0 AS k, 0 AS q FROM ev GROUP BY 1 UNION ALL SELECT scan_id, event_type, ts, 1, event_seq FROM ev UNION ALL SELECT scan_id, 'multiComplete', max(ts), 2, 0 FROM ev GROUP BY 1)
    SELECT scan_id, event_type, ts, row_number() OVER (PARTITION BY scan_id ORDER BY k, q) - 1 AS position FROM e"""
)
def stt09_envelope(spark, sf):
    return S.envelope(store(spark, sf))


@query("SELECT event_id, ts + INTERVAL 730 DAY AS retention_until FROM events WHERE ts + INTERVAL 730 DAY >= TIMESTAMP '2026-01-10 00:00:00'")
def stt12_retained_audit(spark, sf):
    d = S.audit_row(table(spark, sf, "events").select("event_id", F.col("ts").alias("accessed_at")))
    return S.retained(d, F.lit("2026-01-10 00:00:00").cast("timestamp")).select("event_id", "retention_until")


@query("SELECT event_type AS phase, count(value) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY 1")
def agg10_percentiles(spark, sf):
    return L.percentiles(table(spark, sf, "events").withColumnRenamed("event_type", "phase"), "value", "phase")


@query(
    """WITH b AS (SELECT event_type AS phase, avg(value) AS base_mean FROM events WHERE user_id % 2 = 0 AND event_type <> 'error' GROUP BY 1), n AS (SELECT event_type AS phase, avg(value) AS new_mean FROM events WHERE user_id % 2 = 1 AND event_type <> 'view' GROUP BY 1)
    SELECT phase, base_mean, new_mean, new_mean - base_mean AS delta, CASE WHEN new_mean - base_mean IS NOT NULL THEN CASE WHEN base_mean > 0 THEN (new_mean - base_mean) * 100 / base_mean ELSE 0 END END AS delta_pct FROM b FULL JOIN n USING (phase)"""
)
def agg11_baseline_delta(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("event_type", "phase")
    base, new = e.where("user_id % 2 = 0 and phase <> 'error'"), e.where("user_id % 2 = 1 and phase <> 'view'")
    return L.delta(L.percentiles(new, "value", "phase"), L.percentiles(base, "value", "phase"))


_SQL_SAMPLES = "s AS (SELECT 'space' || (user_id % 20) AS space_key, event_id % 2 AS side, event_id % 1000 AS chars, event_id % 977 + 1 AS duration_ms, event_id % 4 AS findings FROM events)"
_SQL_BENCH = """SELECT space_key, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(findings) AS BIGINT) AS findings, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, avg(duration_ms) AS mean_ms, quantile_cont(CAST(duration_ms AS DOUBLE), 0.5) AS median_ms,
    list_sort(list(duration_ms))[1 + CAST(greatest(0, floor(count(*) * 95 / 100) - 1) AS INT)] AS p95_ms, sum(chars) * 1000.0 / sum(duration_ms) AS chars_per_s FROM s"""


def _samples(spark, sf):
    return table(spark, sf, "events").select(F.concat(F.lit("space"), F.col("user_id") % 20).alias("space_key"), (F.col("event_id") % 2).alias("side"), (F.col("event_id") % 1000).alias("chars"), (F.col("event_id") % 977 + 1).alias("duration_ms"), (F.col("event_id") % 4).alias("findings"))


@query(f"WITH {_SQL_SAMPLES} {_SQL_BENCH} GROUP BY space_key")
def agg12_bench_summary(spark, sf):
    return L.bench_summary(_samples(spark, sf), "space_key")


@query(f"WITH {_SQL_SAMPLES}, r AS (SELECT space_key, side, sum(chars) * 1000.0 / sum(duration_ms) AS v FROM s GROUP BY ALL) SELECT a.space_key, b.v / a.v AS speedup FROM r a JOIN r b ON a.space_key = b.space_key AND a.side = 0 AND b.side = 1")
def agg12_speedups(spark, sf):
    s = _samples(spark, sf)
    return L.speedups(L.bench_summary(s.where("side = 0"), "space_key"), L.bench_summary(s.where("side = 1"), "space_key"), "space_key")


@query(f"WITH {_SQL_SAMPLES} SELECT chars, duration_ms, chars * 1000.0 / duration_ms AS chars_per_s, request_id FROM (SELECT *, 0 FROM (SELECT event_id AS request_id, event_id % 1000 AS chars, event_id % 977 + 1 AS duration_ms FROM events)) ORDER BY chars_per_s, request_id LIMIT 10")
def top01_slowest(spark, sf):
    d = table(spark, sf, "events").select(F.col("event_id").alias("request_id"), (F.col("event_id") % 1000).alias("chars"), (F.col("event_id") % 977 + 1).alias("duration_ms"))
    return L.slowest(d.withColumn("chars_per_s", F.col("chars") * 1000.0 / F.col("duration_ms")))


@query(
    """WITH l AS (SELECT event_id, user_id, event_type, CAST(event_id % 5000 AS INT) AS chars, CAST(1 + event_id % 300 AS DOUBLE) AS ms FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0)
    SELECT event_type AS phase, CAST(user_id AS VARCHAR) AS request_id, chars, ms / 1000 AS duration_s, chars / (ms / 1000) AS chars_per_s, 'pool ' || (event_id % 3) AS note, '7' AS p95, '42' AS entities FROM l"""
)
def fn01_throughput_lines(spark, sf):
    """Log lines written from the events and read back; some have no duration, some no request."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    ms = F.when(i % 11 == 0, F.lit("n/a")).otherwise((1 + i % 300).cast("string"))
    request = F.when(i % 13 == 0, "").otherwise(F.concat(F.lit(" request_id="), "user_id"))
    chars = F.concat((i % 5000).cast("string"), F.when(i % 7 == 0, ".0").otherwise(""))
    line = F.concat(F.lit("2026-05-25 12:34:56,789 INFO throughput [THROUGHPUT] phase="), "event_type", request, F.lit(" chars="), chars, F.lit(" duration_ms="), ms, F.lit(' note="pool '), i % 3, F.lit('" grpc.p95=7 entities_in=42.0'))
    d = L.parse_throughput(e.select(line.alias("value")))
    return d.withColumns({"note": F.col("extra")["note"], "p95": F.col("extra")["grpc.p95"], "entities": F.col("extra")["entities_in"]}).drop("extra")


#: Steps by hand, in the order of a request; the 4th to 6th and the 8th say what came in and went out, the others a count.
_SQL_STEPS = """['COMPOSITE_REGEX_RAW', 'COMPOSITE_PRESIDIO_RAW', 'COMPOSITE_MINISTRAL_RAW', 'COMPOSITE_AFTER_MERGE', 'MERGER_AFTER_DEDUP', 'MERGER_AFTER_OVERLAP',
    'GRPC_AFTER_DETECTION', 'GRPC_AFTER_TYPE_CONFIG_FILTER', 'GRPC_FINAL_RESPONSE', 'SOMETHING_ELSE']"""
_SQL_FUNNEL = f"""f AS (SELECT event_id // 10 AS r, event_id % 10 AS pos, {_SQL_STEPS}[event_id % 10 + 1] AS step, 100 - (event_id % 10) * (event_id % 11) AS findings, event_id % 4 AS gone,
    event_id % 10 IN (3, 4, 5, 7) AS passed FROM events)"""


def _funnel_lines(spark, sf) -> DataFrame:
    e, i = table(spark, sf, "events"), F.col("event_id")
    names = [*L.STEPS, "SOMETHING_ELSE"]
    left, gone = 100 - (i % 10) * (i % 11), i % 4
    numbers = F.when((i % 10).isin(3, 4, 5, 7), F.concat(F.lit("in="), left + gone, F.lit(" out="), left, F.when(gone != 3, F.concat(F.lit(" dropped="), gone)).otherwise(""))).otherwise(F.concat(F.lit("count="), left))
    request = F.when(F.floor(i / 10) % 5 == 4, "").otherwise(F.concat(F.lit(" [req_"), F.floor(i / 10), F.lit("]")))
    return e.select(F.concat(F.lit("2026 INFO pii - [FINDING_TRACKER]"), request, F.lit(" step="), F.get(F.array(*map(F.lit, names)), (i % 10).cast("int")), F.lit(" "), numbers).alias("value"))


@query(
    f"""WITH {_SQL_FUNNEL} SELECT CASE WHEN r % 5 <> 4 THEN 'req_' || r END AS request_id, step, CASE WHEN NOT passed THEN findings END AS count, CASE WHEN passed THEN findings + gone END AS "in",
        CASE WHEN passed THEN findings END AS "out", CASE WHEN passed AND gone <> 3 THEN gone END AS dropped FROM f"""
)
def fn02_funnel_lines(spark, sf):
    """Lines of the finding tracker read back, some without a request."""
    return L.parse_funnel(_funnel_lines(spark, sf))


@query(
    f"""WITH {_SQL_FUNNEL}, o AS (SELECT * FROM f WHERE r % 5 <> 4), w AS (SELECT *, lag(findings) OVER (PARTITION BY r ORDER BY pos) - findings AS less,
        first_value(CASE WHEN passed THEN findings + gone ELSE findings END) OVER (PARTITION BY r ORDER BY pos) AS f0 FROM o WHERE pos < 9)
    SELECT 'req_' || r AS request_id, pos + 1 AS position, step, findings, CASE WHEN passed THEN gone END AS dropped, CASE WHEN f0 > 0 THEN findings * 100.0 / f0 ELSE 0 END AS recall_pct, coalesce(less >= 5, false) AS marked FROM w
    UNION ALL SELECT 'req_' || r, NULL, step, findings, NULL, NULL, false FROM o WHERE pos = 9"""
)
def agg13_finding_funnel(spark, sf):
    return L.funnel(L.parse_funnel(_funnel_lines(spark, sf)).where("request_id is not null"))


@query(
    "WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{d}', '{c}')" for t, d, _, _, c, _ in R.TYPE_CONFIG) + ") AS t(pii_type, detector, category)) SELECT detector, category, string_agg(pii_type, ',' ORDER BY pii_type) AS types FROM c GROUP BY ALL"
)
def agg16_config_by_category(spark, sf):
    return C.by_category(C.config_table(spark, R.TYPE_CONFIG), "detector", "category")


@query(
    f"""WITH {SQL_REGEX}, h AS (SELECT DISTINCT doc_id FROM regex), c AS (SELECT count(*) FILTER (WHERE toxic = 1 AND h.doc_id IS NOT NULL) AS tp, count(*) FILTER (WHERE toxic = 0 AND h.doc_id IS NOT NULL) AS fp, count(*) FILTER (WHERE toxic = 1 AND h.doc_id IS NULL) AS fn FROM labels l LEFT JOIN h USING (doc_id) WHERE toxic IS NOT NULL)
    SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM c"""
)
def agg17_label_scores(spark, sf):
    return E.label_scores(table(spark, sf, "labels"), exploded(regex_spans(spark, sf)), "toxic")


@query(
    f"""WITH {SQL_REGEX}, found AS (SELECT doc_id, s, CAST(e AS INT) AS e, pii_type AS concept FROM regex), gold AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN s + 1 ELSE s END AS s, e, CASE WHEN doc_id % 7 = 0 THEN 'OTHER' ELSE concept END AS concept FROM found),
        hit AS (SELECT * FROM found INTERSECT SELECT * FROM gold), x AS (SELECT concept, 'tp' AS k FROM hit
        UNION ALL SELECT concept, 'fp' FROM (SELECT * FROM found EXCEPT SELECT * FROM gold) WHERE NOT (doc_id % 3 = 0 AND s < 2000 AND e > 0) UNION ALL SELECT concept, 'fn' FROM (SELECT * FROM gold EXCEPT SELECT * FROM found) WHERE NOT (doc_id % 3 = 0 AND s < 2000 AND e > 0)),
        c AS (SELECT concept, count(*) FILTER (WHERE k = 'tp') AS tp, count(*) FILTER (WHERE k = 'fp') AS fp, count(*) FILTER (WHERE k = 'fn') AS fn FROM x GROUP BY 1)
    SELECT concept, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS "precision", CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM c"""
)
def agg17_span_scores(spark, sf):
    found = exploded(regex_spans(spark, sf)).select("doc_id", "start", "end", F.col("pii_type").alias("concept"))
    gold = found.select("doc_id", (F.col("start") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("start"), "end", F.when(F.col("doc_id") % 7 == 0, "OTHER").otherwise(F.col("concept")).alias("concept"))
    zones = table(spark, sf, "documents").where("doc_id % 3 = 0").select("doc_id", F.lit(0).alias("start"), F.lit(2000).alias("end"))
    return E.span_scores(gold, found, zones)


@query(f"WITH {SQL_REGEX}, v AS (SELECT source, {sql_severity('pii_type')} AS v FROM regex) SELECT source AS space_key, count(*) FILTER (WHERE v = 'HIGH') AS high, count(*) FILTER (WHERE v = 'MEDIUM') AS medium, count(*) FILTER (WHERE v = 'LOW') AS low FROM v GROUP BY 1")
def srt01_spaces_by_severity(spark, sf):
    from tamis.operators.spans import severity

    v = exploded(regex_spans(spark, sf)).withColumn("v", severity(F.col("pii_type")))
    n = lambda k: F.count_if(F.col("v") == k).alias(k.lower())
    return S.sorted_by_severity(v.groupBy(F.col("source").alias("space_key")).agg(n("HIGH"), n("MEDIUM"), n("LOW")))


@query("SELECT doc_id, lang FROM documents WHERE lang IS NULL OR lower(lang) LIKE 'fr%' OR lower(lang) LIKE 'de%'")
def flt13_language_match(spark, sf):
    return table(spark, sf, "documents").where(S.language_matches(F.col("lang"), ["fr-CH", "DE"])).select("doc_id", "lang")


@query()
def top04_seeded_sample(spark, sf):
    return S.seeded_sample(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 100, 7)


@query(f"WITH {SQL_REGEX} SELECT doc_id, s AS start, txt AS value, true AS sealed FROM regex")
def enc01_round_trip(spark, sf):
    """Values of the rule spans encrypted and read back."""
    key = bytes(range(32))
    d = exploded(regex_spans(spark, sf)).withColumns({"salt": crypto.random_bytes(32), "iv": crypto.random_bytes(12)})
    token = crypto.encrypt(F.col("text"), F.col("pii_type"), F.col("start"), F.col("end"), key, F.col("salt"), F.col("iv"))
    d = d.withColumn("token", token)
    back = crypto.decrypt(F.col("token"), F.col("pii_type"), F.col("start"), F.col("end"), key)
    return d.select("doc_id", "start", back.alias("value"), F.col("token").startswith(crypto.PREFIX).alias("sealed"))


@query(f"WITH {SQL_REGEX} SELECT source AS space_key, doc_id AS page_id, pii_type, {sql_severity('pii_type')} AS severity, s AS start, CAST(e AS INT) AS \"end\", score FROM regex")
def exp01_report_rows(spark, sf):
    from tamis.operators.spans import severity

    d = exploded(regex_spans(spark, sf))
    return d.select(F.col("source").alias("space_key"), F.col("doc_id").alias("page_id"), "pii_type", severity(F.col("pii_type")).alias("severity"), "start", "end", "score")

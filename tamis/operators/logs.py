"""Throughput logs and benchmark samples: parsing, percentiles, deltas, funnels by request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The steps of a request's findings as the pipeline logs them, in order.
STEPS = [
    "COMPOSITE_REGEX_RAW", "COMPOSITE_PRESIDIO_RAW", "COMPOSITE_MINISTRAL_RAW", "COMPOSITE_AFTER_MERGE", "MERGER_AFTER_DEDUP", "MERGER_AFTER_OVERLAP",
    "GRPC_AFTER_DETECTION", "GRPC_AFTER_TYPE_CONFIG_FILTER", "GRPC_FINAL_RESPONSE",
]
# Fields of a throughput line that are whole numbers, and those that are not passed on.
WHOLE = ("chars", "entities_in", "entities_kept", "entities_rejected", "entities_final")
MEASURES = ("phase", "request_id", "chars", "duration_s", "duration_ms", "chars_per_s")

_PAIR = r"([A-Za-z_][A-Za-z0-9_.]*)=(\"[^\"]*\"|\S+)"


def parse_throughput(lines: DataFrame, tag: str = "[THROUGHPUT]") -> DataFrame:
    """``phase, request_id, chars, duration_s, chars_per_s, extra`` of lines with a tag and ``key=value`` pairs.

    Values in quotes may hold blanks; the last of repeated keys counts. Whole numbers may be written ``42.0``.
    ``duration_ms`` becomes seconds, a missing rate is derived (0 without time). Lines without phase, request, characters
    or a duration, or where these are no numbers, are skipped. ``extra`` holds all other fields as text.
    """
    v = F.col("value")
    body = F.regexp_extract(v, r"\Q" + tag + r"\E\s+(.*)$", 1)
    # each line is searched twice, for keys and for values; the lists are named, so nothing is evaluated again
    d = lines.where(v.contains(tag)).select(body.alias("body"))
    d = d.select(F.regexp_extract_all("body", F.lit(_PAIR), F.lit(1)).alias("keys"), F.regexp_extract_all("body", F.lit(_PAIR), F.lit(2)).alias("found"))
    d = d.select(F.explode(F.array(F.struct("keys", F.transform("found", lambda x: F.trim(x, F.lit('"'))).alias("found")))).alias("x"))  # a row each: a barrier to inlining
    keys, found = F.col("x.keys"), F.col("x.found")
    # the last of a key, counted from the end
    of = lambda k: F.get(F.reverse(found), F.array_position(F.reverse(keys), F.lit(k)).cast("int") - 1)
    number = lambda k: of(k).try_cast("double")
    whole = lambda k: F.coalesce(of(k).try_cast("long"), F.when(~F.isnan(number(k)), number(k).cast("long")))
    entries = F.filter(F.arrays_zip(keys.alias("k"), found.alias("v")), lambda e: ~e["k"].isin(*MEASURES))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["k"] == e["k"]))
    shown = lambda e: F.when(e["k"].isin(*WHOLE), F.coalesce(e["v"].try_cast("long"), e["v"].try_cast("double").cast("long")).cast("string")).otherwise(F.lit(None))
    extra = F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"].alias("k"), F.coalesce(shown(e), e["v"]).alias("v"))))
    d = d.select(of("phase").alias("phase"), of("request_id").alias("request_id"), whole("chars").alias("chars"), F.coalesce(number("duration_s"), number("duration_ms") / 1000).alias("duration_s"), number("chars_per_s").alias("_rate"), extra.alias("extra"))
    d = d.where("phase is not null and request_id is not null and chars is not null and duration_s is not null")
    derived = F.when(F.col("duration_s") > 0, F.col("chars") / F.col("duration_s")).otherwise(0.0)
    return d.select("phase", "request_id", F.col("chars").cast("int").alias("chars"), "duration_s", F.coalesce("_rate", derived).alias("chars_per_s"), "extra")


def percentiles(d: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, mean and inclusive interpolated 50th, 95th and 99th percentiles by keys."""
    p = lambda q: F.percentile(value, q).alias(f"p{int(q * 100)}")
    return d.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), p(0.5), p(0.95), p(0.99))


def delta(now: DataFrame, base: DataFrame, key: str = "phase") -> DataFrame:
    """Means of two reports side by side: difference, and percent (0 for a base of 0 or less); null where a side is missing."""
    d = base.select(key, F.col("mean").alias("base_mean")).join(now.select(key, F.col("mean").alias("new_mean")), key, "full")
    diff = F.col("new_mean") - F.col("base_mean")
    percent = F.when(diff.isNotNull(), F.when(F.col("base_mean") > 0, diff * 100 / F.col("base_mean")).otherwise(0.0))
    return d.select(key, "base_mean", "new_mean", diff.alias("delta"), percent.alias("delta_pct"))


def bench_summary(samples: DataFrame, *keys: str) -> DataFrame:
    """Samples (``chars, duration_ms, findings``) by keys: sums, mean, median, 95th percentile by position, weighted rate."""
    if not keys:
        return bench_summary(samples.withColumn("_all", F.lit(0)), "_all").drop("_all")
    d = samples.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("findings").alias("findings"), F.sum("duration_ms").alias("duration_ms"), F.avg("duration_ms").alias("mean_ms"), F.percentile("duration_ms", 0.5).alias("median_ms"))
    # the 95th by position of the sorted durations, from counts by duration: no list of a key's samples
    keyed = samples.groupBy(*keys, "duration_ms").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("duration_ms")
    ranked = keyed.where("duration_ms is not null").select(*keys, "duration_ms", F.sum("_c").over(upto).alias("_upto"), F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"))
    wanted = F.greatest(F.lit(0), F.floor(F.col("_n") * F.lit(95) / 100).cast("long") - 1)
    p95 = ranked.where(F.col("_upto") > wanted).groupBy(*keys).agg(F.min("duration_ms").alias("p95_ms"))
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    d = d.alias("d").join(p95.alias("p"), on, "left").select("d.*", "p.p95_ms")
    return d.withColumn("chars_per_s", F.when(F.col("duration_ms") > 0, F.col("chars") * 1000.0 / F.col("duration_ms")))


def speedups(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The ratio of rates over the keys that both have."""
    return base.select(key, F.col("chars_per_s").alias("base")).join(new.select(key, F.col("chars_per_s").alias("new")), key).select(key, (F.col("new") / F.col("base")).alias("speedup"))


def slowest(d: DataFrame, n: int = 10) -> DataFrame:
    return d.orderBy("chars_per_s", "request_id").limit(n)


def parse_funnel(lines: DataFrame, tag: str = "[FINDING_TRACKER]") -> DataFrame:
    """``request_id, step, count, in, out, dropped`` of lines ``TAG [id] step=NAME count=N`` or ``TAG step=NAME in=N out=M dropped=K``.

    The request, in brackets, may be missing (null), as may what was dropped; a step without numbers is a row of nulls.
    """
    v = F.col("value")
    head = r"\Q" + tag + r"\E(?:\s*\[([^\]]+)\])?\s+step=(\w+)(.*)$"
    d = lines.where(v.contains(tag) & v.rlike(head))
    d = d.select(F.nullif(F.regexp_extract(v, head, 1), F.lit("")).alias("request_id"), F.regexp_extract(v, head, 2).alias("step"), F.regexp_extract(v, head, 3).alias("_rest"))
    counted, passed = r"^\s+count=(\d+)", r"^(?:\s+count=\d+)?\s+in=(\d+)\s+out=(\d+)(?:\s+dropped=(-?\d+))?"
    number = lambda pattern, k: F.regexp_extract("_rest", pattern, k).try_cast("long")
    return d.select("request_id", "step", number(counted, 1).alias("count"), number(passed, 1).alias("in"), number(passed, 2).alias("out"), number(passed, 3).alias("dropped"))


def funnel(d: DataFrame, steps: list[str] = STEPS, large: int = 5) -> DataFrame:
    """Each request's steps: findings after them, dropped, the share of the first step's, a mark for large drops since the step before.

    Steps that are not in the list come last and without a share (``position`` null). Of a step that a request logs more
    than once, the largest findings count, as the order of lines is not known. Requests without an id are one, ``<no-request-id>``.
    """
    at = F.nullif(F.array_position(F.array(*map(F.lit, steps)), F.col("step")), F.lit(0))
    d = d.withColumn("request_id", F.coalesce("request_id", F.lit("<no-request-id>"))).withColumn("position", at)
    findings, first = F.coalesce("count", "out"), F.coalesce("count", "in")
    gone = F.when(F.col("count").isNull(), F.coalesce("dropped", F.col("in") - F.col("out")))
    row = F.max(F.struct(findings.alias("findings"), first.alias("first"), gone.alias("dropped"))).alias("x")
    d = d.groupBy("request_id", "position", "step").agg(row).select("request_id", "position", "step", "x.*")
    order = Window.partitionBy("request_id").orderBy("position")
    known, initial = d.where("position is not null"), F.coalesce(F.first("first").over(order), F.lit(0))
    recall = F.when((initial > 0) & F.col("findings").isNotNull(), F.col("findings") * 100.0 / initial).otherwise(0.0)
    marked = F.coalesce(F.lag("findings").over(order) - F.col("findings") >= large, F.lit(False))
    known = known.select("request_id", "position", "step", "findings", "dropped", recall.alias("recall_pct"), marked.alias("marked"))
    return known.unionByName(d.where("position is null").select("request_id", "position", "step", "findings", "dropped", F.lit(None).cast("double").alias("recall_pct"), F.lit(False).alias("marked")))


def tsv_row(*columns: Column) -> Column:
    """A line of a tab-separated file: tabs and line breaks inside become blanks."""
    return F.concat_ws("\t", *[F.coalesce(F.translate(c.cast("string"), "\t\n\r", "   "), F.lit("")) for c in columns])

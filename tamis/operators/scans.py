"""The event store and what is reported from it: sequences, checkpoints, statistics, resuming, retention.

Counters are derived from events, never incremented, so reading an event twice can't count twice once repeated
``(scan_id, event_seq)`` are dropped. All of it is aggregates and windows by scan and space.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamis.functions.text import is_blank, strip

EVENT_TYPES = "multiStart start pageStart item attachmentItem pageComplete scanError complete multiComplete keepalive".split()
KEY = ["scan_id", "space_key"]

# Allowed changes of a scan's status and who may make them.
TRANSITIONS = (
    ("FAILED", "RUNNING", "USER"), ("RUNNING", "PAUSED", "USER"), ("RUNNING", "COMPLETED", "SYSTEM"), ("RUNNING", "FAILED", "SYSTEM"),
    ("PAUSED", "RUNNING", "USER"), ("PAUSED", "COMPLETED", "SYSTEM"), ("NOT_STARTED", "RUNNING", "SYSTEM"),
)


def appended(events: DataFrame, order: list[str], store: DataFrame | None = None) -> DataFrame:
    """New events with their numbers: per scan from the store's largest on, in order. Blank scans or types are refused."""
    good = events.where(~is_blank(F.col("scan_id")) & ~is_blank(F.col("event_type")))
    number = F.row_number().over(Window.partitionBy("scan_id").orderBy(*order)).cast("long")
    if store is None:
        return good.withColumn("event_seq", number)
    last = store.groupBy("scan_id").agg(F.max("event_seq").alias("_last"))
    return good.join(last, "scan_id", "left").withColumn("event_seq", number + F.coalesce("_last", F.lit(0))).drop("_last")


def events_of(events: DataFrame, scan_id: str, *, space_key: str | None = None, page_id: str | None = None, types: tuple[str, ...] = ("item", "attachmentItem")) -> DataFrame:
    """Events of a scan, of a space or page of it, of some types, in order."""
    found = events.where((F.col("scan_id") == scan_id) & F.col("event_type").isin(*types))
    for name, value in (("space_key", space_key), ("page_id", page_id)):
        found = found if value is None else found.where(F.col(name) == value)
    return found.orderBy("event_seq")


def max_seq(events: DataFrame, scan_id: str) -> DataFrame:
    return events.where(F.col("scan_id") == scan_id).agg(F.coalesce(F.max("event_seq"), F.lit(0)).alias("max_seq"))


def space_counters(events: DataFrame) -> DataFrame:
    """Pages done, attachments done and the last event by scan and space."""
    kind = F.col("event_type")
    return events.groupBy(*KEY).agg(F.count_if(kind == "pageComplete").alias("pages_done"), F.count_if(kind == "attachmentItem").alias("attachments_done"), F.max("ts").alias("last_event_ts"))


def latest_scan(events: DataFrame) -> DataFrame:
    """The scan with the latest event, and how many spaces it has."""
    return events.groupBy("scan_id").agg(F.max("ts").alias("last_ts"), F.count_distinct("space_key").alias("spaces")).orderBy(F.desc("last_ts"), "scan_id").limit(1)


def checkpoint_rows(events: DataFrame) -> DataFrame:
    """What each event says to the checkpoint of its space: status, page, attachment, progress. Other events say nothing."""
    kind = F.col("event_type")
    status = F.when(kind.isin("item", "attachmentItem", "pageComplete"), "RUNNING").when(kind == "complete", "COMPLETED")
    return events.withColumn("status", status).where("status is not null").select(
        *KEY, "event_seq", "ts", "status",
        F.when(kind == "pageComplete", F.col("page_id")).alias("last_page"),
        F.when(kind == "attachmentItem", F.col("attachment_name")).alias("last_attachment"),
        "progress",
    )


def checkpoints(rows: DataFrame) -> DataFrame:
    """The state after all rows by scan and space: the last value that is not null or blank; the time always moves.

    A paused scan stays paused whatever is still running; anything else replaces the status.
    """
    last = lambda c: F.max_by(c, F.when(~is_blank(F.col(c).cast("string")), F.col("event_seq")))
    said = F.max_by("status", F.when(F.col("status") != "RUNNING", F.col("event_seq")))
    paused = F.max(F.when(F.col("status") != "RUNNING", F.col("event_seq")))
    ran = F.max(F.when(F.col("status") == "RUNNING", F.col("event_seq")))
    status = F.when((said == "PAUSED") | (paused > ran) | ran.isNull(), said).otherwise("RUNNING")
    return rows.groupBy(*KEY).agg(last("last_page").alias("last_page"), last("last_attachment").alias("last_attachment"), last("progress").alias("progress"), status.alias("status"), F.max_by("ts", "event_seq").alias("updated_at"))


def latest_checkpoints(rows: DataFrame) -> DataFrame:
    """The latest checkpoint of each space."""
    newest = Window.partitionBy("space_key").orderBy(F.desc("updated_at"), F.desc("scan_id"))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def space_stats(events: DataFrame) -> DataFrame:
    """First start, last completion, pages, attachments, characters and failures by scan and space."""
    kind, chars = F.col("event_type"), F.coalesce("chars", F.lit(0))
    named = ~is_blank(F.col("attachment_name"))
    started, finished = F.min(F.when(kind == "start", F.col("ts"))), F.max(F.when(kind == "complete", F.col("ts")))
    return events.groupBy(*KEY).agg(
        started.alias("started_at"), finished.alias("finished_at"), duration_ms(started, finished).alias("duration_ms"),
        F.count_if(kind == "item").alias("pages"), F.sum(F.when(kind == "item", chars).otherwise(0)).alias("page_chars"),
        F.count_if(kind == "attachmentItem").alias("attachments"), F.sum(F.when(kind == "attachmentItem", chars).otherwise(0)).alias("attachment_chars"),
        F.count_if((kind == "scanError") & ~named).alias("failed_pages"), F.count_if((kind == "scanError") & named).alias("failed_attachments"),
    )


def duration_ms(started: Column, finished: Column) -> Column:
    """Null while it runs."""
    return F.unix_millis(finished.cast("timestamp")) - F.unix_millis(started.cast("timestamp"))


def chars_per_second(chars: Column, busy_ms: Column) -> Column:
    """To one decimal, half up; null without time."""
    return F.when(busy_ms > 0, F.round(chars * 1000.0 / busy_ms, 1))


def detector_stats(runs: DataFrame) -> DataFrame:
    """Runs of detectors (``detector, busy_ms, chars, found, discarded``) summed by scan, space and detector."""
    total = runs.groupBy(*KEY, "detector").agg(*[F.sum(c).alias(c) for c in ("busy_ms", "chars", "found", "discarded")])
    return total.withColumn("chars_per_s", chars_per_second(F.col("chars"), F.col("busy_ms")))


def progress(analyzed: Column, total: Column) -> Column:
    return F.when(total <= 0, 100.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), analyzed * 100.0 / total)))


def presentation_status(status: Column, pages: Column, attachments: Column) -> Column:
    started = (F.coalesce(pages, F.lit(0)) > 0) | (F.coalesce(attachments, F.lit(0)) > 0)
    return F.coalesce(status, F.when(started, "PAUSED").otherwise("NOT_STARTED"))


def reporting_summary(events: DataFrame, states: DataFrame, severities: DataFrame) -> DataFrame:
    """Each space's latest checkpoint with the counters and severity counts of its scan."""
    s = latest_checkpoints(states).join(space_counters(events), KEY, "left").join(severities, KEY, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return s.select(*KEY, presentation_status(F.col("status"), F.col("pages_done"), F.col("attachments_done")).alias("status"), "progress", zero("pages_done"), zero("attachments_done"), "last_event_ts", zero("high"), zero("medium"), zero("low"))


def scan_summary(events: DataFrame, states: DataFrame, scan_id: str) -> DataFrame:
    """One scan's spaces that have events: their counters with the checkpoint of that scan, if there is one."""
    own = F.col("scan_id") == scan_id
    s = space_counters(events.where(own)).join(states.where(own).select(*KEY, "status", "progress"), KEY, "left")
    status = presentation_status(F.col("status"), F.col("pages_done"), F.col("attachments_done"))
    return s.select("space_key", status.alias("status"), "progress", "pages_done", "attachments_done", "last_event_ts")


def stream_order(items: DataFrame) -> DataFrame:
    """Items (``scan_id, idx, event_type, event_seq``) numbered as a scan emits them: start, pages in order with their attachments first, complete."""
    kind = F.col("event_type")
    stage = F.when(kind == "start", 0).when(kind == "complete", 2).otherwise(1)
    part = F.when(kind == "pageStart", 0).when(kind == "attachmentItem", 1).when(kind == "pageComplete", 3).otherwise(2)
    order = Window.partitionBy("scan_id").orderBy(stage, F.when(stage == 1, F.col("idx")), part, "event_seq")
    return items.withColumn("position", (F.row_number().over(order) - 1).cast("long"))


def unexpired(ended: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    """Managed scans (``finished_at``, null while they run) that a clean-up at a time leaves."""
    return ended.where(F.col("finished_at").isNull() | (F.col("finished_at") + F.make_interval(hours=F.lit(hours)) >= now))


def latest_items(events: DataFrame, states: DataFrame) -> DataFrame:
    """Item events of each space's latest scan."""
    return events.where(F.col("event_type").isin("item", "attachmentItem")).join(latest_checkpoints(states).select(*KEY), KEY)


def failed_items(events: DataFrame, limit: int = 20) -> DataFrame:
    """Distinct failed items in the order they first failed, at most ``limit``."""
    named = ~is_blank(F.col("attachment_name"))
    kind, name = F.when(named, "ATTACHMENT").otherwise("PAGE"), F.when(named, F.col("attachment_name")).otherwise(F.col("page_id"))
    failed = events.where("event_type = 'scanError'").groupBy(kind.alias("kind"), name.alias("name")).agg(F.min("event_seq").alias("first_seq"))
    return failed.orderBy("first_seq").limit(limit)


def first_items(items: DataFrame, per_space: int = 400) -> DataFrame:
    """The first items with findings of each space, one for each page and attachment; later ones are left out."""
    first = Window.partitionBy("space_key", "page_id", F.coalesce("attachment_name", F.lit(""))).orderBy("event_seq")
    one = items.where("findings > 0").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return one.withColumn("_n", F.row_number().over(Window.partitionBy("space_key").orderBy("event_seq"))).where(F.col("_n") <= per_space).drop("_n")


def remaining_pages(pages: DataFrame, states: DataFrame) -> DataFrame:
    """Pages (``space_key, page_id, idx`` from 0) that a resumed scan still has to read, with the offset of those done.

    After the last page; that page again if an attachment of it was in progress; all for an unknown page; none if completed.
    """
    blank = lambda c: is_blank(F.col(c))
    last = pages.select("space_key", F.col("page_id").alias("last_page"), F.col("idx").alias("_last"))
    s = states.join(last, ["space_key", "last_page"], "left")
    busy = ~blank("last_attachment")
    begin = F.when(blank("last_page") | F.col("_last").isNull(), 0).otherwise(F.col("_last") + F.when(busy, 0).otherwise(1))
    offset = F.greatest(F.lit(0), F.coalesce(F.col("_last") + 1, F.lit(0)) - F.when(busy & (F.col("status") == "RUNNING"), 1).otherwise(0))
    s = s.select("space_key", F.when(F.col("status") != "COMPLETED", begin).alias("_begin"), offset.alias("_offset"), F.lit(True).alias("_has"))
    d = pages.join(s, "space_key", "left").where(F.col("_has").isNull() | (F.col("idx") >= F.col("_begin")))
    return d.select("space_key", "page_id", "idx", F.coalesce("_offset", F.lit(0)).alias("analyzed_offset"))


def transition_allowed(now: Column, to: Column, initiator: Column) -> Column:
    """Whether a status may change; staying is always allowed, leaving COMPLETED never."""
    allowed = reduce(lambda a, t: a | ((now == t[0]) & (to == t[1]) & (initiator == t[2])), TRANSITIONS, F.lit(False))
    return (now == to) | allowed


def paused(states: DataFrame, scan_id: str) -> DataFrame:
    """A pause: what runs of a scan is paused."""
    return states.withColumn("status", F.when((F.col("scan_id") == scan_id) & (F.col("status") == "RUNNING"), "PAUSED").otherwise(F.col("status")))


def resumed(states: DataFrame, scan_id: str) -> DataFrame:
    return states.withColumn("status", F.when((F.col("scan_id") == scan_id) & (F.col("status") == "PAUSED"), "RUNNING").otherwise(F.col("status")))


def purged(states: DataFrame, spaces: list[str] | None = None) -> DataFrame:
    """Without the active checkpoints; or without all of some spaces, the other active ones being completed."""
    active = F.col("status").isin("RUNNING", "PAUSED")
    if spaces is None:
        return states.where(~active)
    left = states.where(~F.col("space_key").isin(*spaces))
    return left.withColumn("status", F.when(active, "COMPLETED").otherwise(F.col("status")))


def envelope(events: DataFrame) -> DataFrame:
    """All events between a multiStart and a multiComplete of their scan, numbered from 0."""
    ends = events.groupBy("scan_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    row = lambda kind, at: ends.select("scan_id", F.lit(kind).alias("event_type"), F.col(at).alias("ts"), F.lit(0 if at == "first" else 2).alias("_k"), F.lit(0).cast("long").alias("event_seq"))
    every = row("multiStart", "first").unionByName(events.select("scan_id", "event_type", "ts", F.lit(1).alias("_k"), "event_seq")).unionByName(row("multiComplete", "last"))
    order = Window.partitionBy("scan_id").orderBy("_k", "event_seq")
    return every.select("scan_id", "event_type", "ts", (F.row_number().over(order) - 1).cast("long").alias("position"))


def audit_row(d: DataFrame, days: int = 730) -> DataFrame:
    """Audit rows with the time until which they are kept."""
    return d.withColumn("retention_until", F.col("accessed_at") + F.make_interval(days=F.lit(days)))


def retained(audit: DataFrame, now: Column) -> DataFrame:
    return audit.where(F.col("retention_until") >= now)


def has_been_updated(last_modified: Column, last_scan: Column) -> Column:
    """Whether a space changed after its last scan; false without either."""
    return F.coalesce(last_modified > last_scan, F.lit(False))


def data_owners(permissions: DataFrame) -> DataFrame:
    """Distinct active administrators with an address (``space_key, operation, target, users``)."""
    one = permissions.where((F.col("operation") == "administer") & (F.col("target") == "space")).select("space_key", F.explode("users").alias("u"))
    return one.where(F.col("u.active") & ~is_blank(F.col("u.email"))).select("space_key", "u.name", "u.email").distinct()


def language_matches(lang: Column, wanted: list[str]) -> Column:
    """In any case, one being a prefix of the other; a missing language matches."""
    own = F.lower(strip(lang))
    hit = reduce(lambda a, w: a | own.startswith(w.lower()) | F.lit(w.lower()).startswith(own), wanted, F.lit(False))
    return F.coalesce(own, F.lit("")).isin("") | hit


def seeded_sample(d: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by a seeded hash of their key, in the order of the key: a sampling operator."""
    return d.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n).orderBy(key)


def sorted_by_severity(spaces: DataFrame) -> DataFrame:
    return spaces.orderBy(F.desc("high"), F.desc("medium"), F.desc("low"), "space_key")

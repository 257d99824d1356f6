"""Streaming and hook queries over bounded input, held against the same SQL as their batch twins."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from tamis.operators import model
from tamis.plans.detection import ORACLES as DETECTION
from tamis.plans.detection import documents, each_span, table
from tamis.streaming import scan

QUERIES, ORACLES = {}, {}


def stream_regex_spans(spark, sf):
    return scan.finished(scan.span_stream(scan.document_stream(spark, f"{sf}/documents.parquet*"))).select("doc_id", "start", "end", "pii_type", "text", "score")


def stream_event_dedup(spark, sf):
    """All events read twice, each kept once."""
    e = table(spark, sf, "events")
    s = spark.readStream.schema(e.schema).parquet(f"{sf}/events.parquet*").select(F.concat(F.lit("scan"), F.col("user_id") % 3).alias("scan_id"), F.col("event_id").alias("event_seq"), F.col("ts").cast("timestamp").alias("ts"))
    twice = s.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    return scan.finished(scan.replay_safe(twice)).select("scan_id", "event_seq")


def _stub(text: str) -> str:
    """A service that finds dates."""
    found = [{"text": m, "label": "eventDate"} for m in re.findall(r"\b\d{4}-\d{2}-\d{2}\b", text)] + [{"text": m, "label": "ip"} for m in re.findall(r"\b\d{1,3}(?:\.\d{1,3}){3}\b", text)]
    return "<think>[1]</think> Here: " + json.dumps(found)


def det05_model_spans(spark, sf):
    found = model.detect_with(documents(spark, sf), _stub, {"Event Date": "DATE", "IP": "IP_ADDRESS"})
    return each_span(found, "doc_id").select("doc_id", "x.start", "x.end", "x.pii_type", "x.text")


QUERIES |= {f.__name__: f for f in (stream_regex_spans, stream_event_dedup, det05_model_spans)}
ORACLES["stream_regex_spans"] = DETECTION["det01_regex_spans"]
ORACLES["stream_event_dedup"] = "SELECT 'scan' || (user_id % 3) AS scan_id, event_id AS event_seq FROM events"

"""The model detector: a hook for a service that answers with JSON, and what is done with its answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.rules import MODEL
from tamis.functions.text import char_chunks, normal_label
from tamis.operators.spans import SPANS


def first_array(answer: str | None) -> list:
    """The entities of the first balanced JSON array, after any thoughts; empty if there is none."""
    text = re.sub(r"(?s)<think>.*?</think>", "", answer or "")
    depth, start = 0, -1
    for i, c in enumerate(text):
        if c == "[":
            start = i if not depth else start
            depth += 1
        elif c == "]" and depth:
            depth -= 1
            if not depth:
                try:
                    found = json.loads(text[start : i + 1])
                except ValueError:
                    return []
                return [x for x in found if isinstance(x, dict)]
    return []


def resolve_label(label: Column, types: dict[str, str]) -> Column:
    """The type of a label: as configured, else normalised (the first configured wins), else the label in upper case."""
    normal: dict[str, str] = {}
    for k, v in types.items():
        plain = re.sub(r"[^a-z0-9]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", k).lower()).strip("_")
        normal.setdefault(plain, v)
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) if m else F.create_map().cast("map<string,string>")
    name = normal_label(label)
    return F.coalesce(table(types)[label], table(normal)[name], F.when(name != "", F.upper(name)))


def detect_with(docs: DataFrame, ask: Callable[[str], str], types: dict[str, str], *, key: str = "doc_id", size: int = 1000, overlap: int = 50, every: bool = False) -> DataFrame:
    """``key, spans``: what a service finds in the chunks of each text. A chunk whose call fails gives nothing.

    ``ask`` takes a chunk and gives the service's answer. A found text is placed at its first occurrence in the chunk
    (at every one, if asked); one that isn't there, or has no label, is dropped.
    """
    chunks = docs.select(key, F.posexplode(char_chunks(F.coalesce("text", F.lit("")), size, overlap)).alias("n", "c")).select(F.col(key).alias("key"), "c.text", "c.start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, text, start in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    found = first_array(ask(text))
                except Exception:  # noqa: BLE001  a failed call costs its chunk only
                    continue
                for e in found:
                    value, label = e.get("text"), e.get("label")
                    if not value or not label:
                        continue
                    at = text.find(value)
                    while at >= 0:
                        rows.append((k, start + at, start + at + len(value), str(label), value))
                        at = text.find(value, at + len(value)) if every else -1
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], b.schema.field("key").type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())], ["key", "start", "end", "label", "text"])

    kind = docs.schema[key].dataType.simpleString()
    found = chunks.mapInArrow(run, f"key {kind}, start int, end int, label string, text string")
    found = found.withColumn("pii_type", resolve_label(F.col("label"), types)).where("pii_type is not null")
    span = F.struct("start", "end", "pii_type", "text", F.lit(1.0).alias("score"), F.lit(MODEL).alias("source"), F.lit(2).alias("priority"), F.lit(0).alias("ord"))
    own = found.groupBy("key").agg(F.array_sort(F.collect_set(span)).cast(SPANS).alias("spans"))
    return docs.select(F.col(key)).join(own.withColumnRenamed("key", key), key, "left").select(key, F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))

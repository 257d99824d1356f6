"""Evaluation of spans against labelled ones: concepts, ignore zones, precision, recall, F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GOLD = "array<struct<start:int,end:int,label:string>>"


def concept_table(spark, maps: dict[str, dict[str, str]]) -> DataFrame:
    """A nested table ``{dataset or detector: {label: concept}}`` as rows."""
    return spark.createDataFrame([(a, b, c) for a, m in maps.items() for b, c in m.items()], "owner string, label string, concept string")


def gold_spans(raw: Column, text: Column) -> Column:
    """Labelled spans of a JSON list; those that don't lie in the text are left out, a broken list is empty."""
    spans = F.coalesce(F.from_json(raw, GOLD), F.array().cast(GOLD))
    return F.filter(spans, lambda s: F.coalesce((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(text)), F.lit(False)))


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1; null where nothing was found or to be found."""
    p, r = F.when(tp + fp > 0, tp / (tp + fp)), F.when(tp + fn > 0, tp / (tp + fn))
    return [p.alias("precision"), r.alias("recall"), F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn)).alias("f1")]


def span_scores(gold: DataFrame, found: DataFrame, ignored: DataFrame | None = None, *, strict: bool = True) -> DataFrame:
    """Counts and scores of found spans against gold ones by concept (strict) or by place alone.

    Both hold ``doc_id, start, end, concept``. What overlaps an ignore zone (``doc_id, start, end``) counts neither way,
    unless it is right. Zones are joined by document first, so the interval test sees one document's spans only.
    """
    place = ["doc_id", "start", "end"]
    keys = [*place, "concept"] if strict else place
    g, f = gold.select(*keys).distinct(), found.select(*keys).distinct()
    hit, missed, extra = f.join(g, keys, "left_semi"), g.join(f, keys, "left_anti"), f.join(g, keys, "left_anti")
    if ignored is not None:
        z = ignored.select(F.col("doc_id").alias("z_doc"), F.col("start").alias("z_start"), F.col("end").alias("z_end"))
        on = (F.col("doc_id") == F.col("z_doc")) & (F.col("start") < F.col("z_end")) & (F.col("z_start") < F.col("end"))
        missed, extra = missed.join(z, on, "left_anti"), extra.join(z, on, "left_anti")
    by = [F.col("concept")] if strict else [F.lit("any").alias("concept")]
    kind = lambda d, name: d.select(*by, F.lit(name).alias("kind"))
    every = kind(hit, "tp").unionByName(kind(extra, "fp")).unionByName(kind(missed, "fn"))
    counts = every.groupBy("concept").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")])
    return counts.select("concept", "tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def label_scores(labels: DataFrame, flagged: DataFrame, label: str) -> DataFrame:
    """Scores of flagged documents against a 0/1 label; documents without one count neither way."""
    d = labels.where(F.col(label).isNotNull()).join(flagged.select("doc_id").distinct().withColumn("_hit", F.lit(1)), "doc_id", "left")
    n = lambda y, h: F.count_if((F.col(label) == y) & (F.coalesce("_hit", F.lit(0)) == h))
    d = d.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))
    return d.select("tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))

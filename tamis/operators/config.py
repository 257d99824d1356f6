"""The type configuration: a gate on spans, by expression or by join, and its groupings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "pii_type string, detector string, enabled boolean, threshold double, category string, severity string"


def config_table(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """The configuration as a table; ``id`` is the order of the rows."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + SCHEMA)


def lookup(rows: Sequence[tuple]) -> dict[str, tuple]:
    """Rows by ``DETECTOR:TYPE``, and by type alone, where the last by category and type wins."""
    out = {}
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        out[r[0]] = out[f"{r[1]}:{r[0]}"] = r
    return out


def gate(spans: Column, rows: Sequence[tuple]) -> Column:
    """Spans that the configuration lets through: its detector's row, else the type's; none, or another detector's, keeps."""
    of = lookup(rows)
    entries = [F.lit(v) for k, r in of.items() for v in (k,)]
    fields = [F.struct(F.lit(r[1]).alias("detector"), F.lit(r[2]).alias("enabled"), F.lit(float(r[3])).alias("threshold")) for r in of.values()]
    table = F.create_map(*[x for kv in zip(entries, fields) for x in kv])

    def passes(s: Column) -> Column:
        row = F.coalesce(table[F.concat(s["source"], F.lit(":"), s["pii_type"])], table[s["pii_type"]])
        return row.isNull() | (row["detector"] != s["source"]) | (row["enabled"] & (s["score"] >= row["threshold"]))

    return F.filter(spans, passes)


def gate_join(spans: DataFrame, config: DataFrame) -> DataFrame:
    """The same for a table of spans (``pii_type, source, score``) and one of configuration, of which Spark sees the size."""
    own = config.select(F.col("detector").alias("source"), "pii_type", F.struct("detector", "enabled", "threshold").alias("own"))
    last = Window.partitionBy("pii_type").orderBy(F.desc("category"), F.desc("id"))
    any_ = config.withColumn("rank", F.row_number().over(last)).where("rank = 1").select("pii_type", F.struct("detector", "enabled", "threshold").alias("any"))
    row = F.coalesce("own", "any")
    passes = row.isNull() | (row["detector"] != F.col("source")) | (row["enabled"] & (F.col("score") >= row["threshold"]))
    return spans.join(own, ["source", "pii_type"], "left").join(any_, "pii_type", "left").where(passes).select(*spans.columns)


def sql_gate(alias: str) -> str:
    """The gate as an SQL condition over ``pii_type, det, score``."""
    from tamis.functions.rules import TYPE_CONFIG

    blocked = []
    of = lookup(TYPE_CONFIG)
    for t, d, enabled, threshold, *_ in {(r[0], r[1], r[2], r[3]) for r in of.values()}:
        blocked.append(f"({alias}.pii_type = '{t}' AND {alias}.det = '{d}' AND {'score < ' + str(threshold) if enabled else 'true'})")
    return "NOT (" + " OR ".join(sorted(blocked)) + ")"


def severities(rows: Sequence[tuple]) -> dict[str, str]:
    """Severity by type; of several rows the one that was entered last."""
    return {r[0]: r[5] for r in rows if r[5]}


def by_category(config: DataFrame, *levels: str) -> DataFrame:
    """Types of each group of the levels (a null category is Other), sorted."""
    named = config.withColumn("category", F.coalesce("category", F.lit("Other")))
    return named.groupBy(*levels).agg(F.array_join(F.sort_array(F.collect_list("pii_type")), ",").alias("types"))


def search(config: DataFrame, text: str) -> DataFrame:
    """Rows whose type or category holds a text, in any case."""
    return config.where(F.lower("pii_type").contains(text.lower()) | F.lower("category").contains(text.lower()))

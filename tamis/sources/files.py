"""File sources and sinks: documents, attachments, logs, samples, gold sets, reports."""

from __future__ import annotations

import io
import tempfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import text as T
from tamis.operators import logs as L

SAMPLE = "timestamp string, label string, scan_id string, space_key string, page_id string, item_kind string, chars int, duration_ms bigint, chars_per_s double, findings int"
REPORT = ("space_key", "page_id", "page_title", "attachment_name", "pii_type", "severity", "masked_context", "score")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder is set if driver and executors are one process (tests); a cluster
    has to name one, as folders of one machine are not seen by the others.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if where is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="tamis-shared-")
        sc.setCheckpointDir(where)
        spark.conf.set("spark.checkpoint.dir", where)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def spread(d: DataFrame) -> DataFrame:
    """``d`` over all cores where its files are too few or small to be; as it is where its scan fills them.

    A file of one row group is one task whatever its size in characters. Moving a small table once costs less than
    scanning its texts on one core; a table of many splits is never shuffled for this.
    """
    spark = d.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    size = int(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return d.repartition(cores) if size < cores * split else d


def log_lines(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.text(list(paths))


def bench_samples(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated samples with a header; broken rows are skipped."""
    return spark.read.csv(path, sep="\t", header=True, schema=SAMPLE, mode="DROPMALFORMED")


def write_samples(samples: DataFrame, path: str) -> None:
    columns = [c.split()[0] for c in SAMPLE.split(", ")]
    clean = [F.coalesce(T.tsv_safe(F.col(c).cast("string")), F.lit("")).alias(c) for c in columns]
    samples.select(*clean).write.mode("append").csv(path, sep="\t", header=True)


def gold_documents(spark: SparkSession, path: str) -> DataFrame:
    span = "array<struct<start:int,end:int,{}:string>>"
    return spark.read.json(path, schema=f"id string, dataset string, lang string, text string, spans {span.format('label')}, ignore_spans {span.format('src_label')}")


def write_gold(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """The detection sheet's columns as CSV with a header."""
    rows.select(*REPORT).write.mode("overwrite").csv(path, header=True)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.skip = io.StringIO(), 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in T.AFTER + T.AROUND + T.BEFORE:
            self.out.write("\n")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip:
            self.out.write(data)


def extracted_text(name: str, content: bytes) -> str | None:
    """The text of a text, CSV or HTML attachment; null for other types, as no reader for them is at hand."""
    ext = name.rpartition(".")[2].lower()
    if ext not in ("txt", "csv", "htm", "html"):
        return None
    text = content.decode("utf-8", "replace")
    if ext.startswith("htm"):
        parser = _Text()
        parser.feed(text)
        text = parser.out.getvalue()
    return text.strip() or None


def attachment_texts(spark: SparkSession, path: str) -> DataFrame:
    """``name, text`` of the attachments under a path that can be read and are not images of text."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    files = files.where(T.is_extractable(T.extension(F.col("name"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extracted_text(n, c) for n, c in zip(b.column("name").to_pylist(), b.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(texts, pa.string())], ["name", "text"])

    return files.mapInArrow(run, "name string, text string").where(T.quality_reason(F.col("text")).isNull())


def throughput_report(d: DataFrame, base: DataFrame | None = None) -> str:
    """A Markdown report of percentiles by phase, and of the change since a base."""
    stats = L.percentiles(d, "chars_per_s", "phase")
    out = ["# Throughput", "", "| phase | n | mean | p50 | p95 | p99 |", "|---|---|---|---|---|---|"]
    out += [f"| {r.phase} | {r.n} | {r.mean:.1f} | {r.p50:.1f} | {r.p95:.1f} | {r.p99:.1f} |" for r in stats.orderBy("phase").collect()]
    if base is not None:
        shown = lambda v: "n/a" if v is None else f"{v:+.1f}"
        rows = L.delta(stats, L.percentiles(base, "chars_per_s", "phase")).orderBy("phase").collect()
        out += ["", "| phase | delta | % |", "|---|---|---|"] + [f"| {r.phase} | {shown(r.delta)} | {shown(r.delta_pct)} |" for r in rows]
    return "\n".join(out) + "\n"

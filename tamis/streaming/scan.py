"""Scans as Structured Streaming: files of documents to spans, events to checkpoints, with replayed events dropped."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.rules import REGEX_RULES
from tamis.operators import scans
from tamis.operators import spans as S
from tamis.sources.files import shared_dir

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, source string", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def span_stream(docs: DataFrame, rules=REGEX_RULES) -> DataFrame:
    """A row for each span of each document; stateless, so nothing is kept between batches."""
    own = [F.col(f"x.{c}") for c in ("start", "end", "pii_type", "text", "score")]
    d = docs.withColumn("spans", S.detect(F.col("text"), rules))
    return d.select("doc_id", "source", F.explode("spans").alias("x")).select("doc_id", "source", *own)


def replay_safe(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each ``(scan_id, event_seq)`` once, remembering as far back as the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["scan_id", "event_seq"])


def finished(stream: DataFrame) -> DataFrame:
    """What a stream in append mode has written when all its input is read: for queries of bounded input.

    Rows go to files in the shared folder, left for the caller to remove, so none gather at the driver. Keys that are
    remembered are kept on disk, not in the heap, and go when the stream has ended.
    """
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/tamis_{uuid.uuid4().hex}"
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        # a started query has a session of its own, a clone of this one
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    finally:
        spark.conf.set(STATE_STORE, before)
    query.awaitTermination()
    state = spark._jvm.org.apache.hadoop.fs.Path(f"{out}-state")
    state.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(state, True)
    return spark.read.schema(stream.schema).parquet(out)


def keep_checkpoints(events: DataFrame, path: str, checkpoint: str):
    """A running query that keeps the state of each scan and space under ``path``, a folder for each batch.

    A batch is folded into the state of the one before it and written under its own number, so that a batch that is
    run again after a failure writes the same folder. Returns the started query.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = scans.checkpoint_rows(batch).withColumn("event_seq", F.col("event_seq").cast("long"))
        if number:
            old = spark.read.parquet(f"{path}/{number - 1}")
            rows = rows.unionByName(old.select(*scans.KEY, F.lit(-1).cast("long").alias("event_seq"), F.col("updated_at").alias("ts"), "status", "last_page", "last_attachment", "progress"))
        scans.checkpoints(rows).write.mode("overwrite").parquet(f"{path}/{number}")

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

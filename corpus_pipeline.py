"""From raw documents to token ids: language, near-duplicates, secrets, mixture, pieces.

Every stage takes and returns rows of ``documents``; further columns, whatever their names, pass through all but the last,
which returns doc_id, source, n_tokens and ids. Documents with a null or empty text or without a letter go in the first
stage, as their language is undetermined, as do all if no row names a language to learn. Null ids and sources are kept.
An empty table gives an empty result. Repeated rows are one row after the second stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import langid, minhash, mixing, pieces, secrets
from tamis.llm.common import ROW, cut, packed, shared_dir, unpacked
from tamis.llm.queries import MODEL_FILE


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language is undetermined or less likely than all others together."""
    return langid.select_identified(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays (five words, 0.8), one of the smallest id; rows without an id all stay.

    Where ids repeat, every row of another text is a document of its own, and of rows with equal id and text the first
    by the other columns (as JSON) stays. Rows are then numbered by id and text, once, in the shared folder. Null, empty
    and wordless texts are near nothing and stay, once for each id.
    """
    used = ("doc_id", "text")
    own, key = packed(docs.where("doc_id is not null"), used), "doc_id"
    if own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        one = own.groupBy(*used).agg(F.min_by(ROW, F.to_json(F.struct(ROW))).alias(ROW))
        order, key = ("doc_id", F.xxhash64("text"), "text"), "_number"
        own = cut(one.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id()))
    gone = minhash.near_duplicates(own.select(F.col(key).alias("doc_id"), "text")).where("not kept").select(F.col("doc_id").alias(key)).distinct()
    kept = own.join(gone, key, "left_anti").select(*unpacked(docs.columns, used))
    return kept.unionByName(docs.where("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked where they stand; every document stays."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by source: documents that are taken twice are two rows, those not taken go."""
    return mixing.apply_mix(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of each row, under merge-dropout."""
    return pieces.encode(docs, MODEL_FILE, keep=("source",)).select("doc_id", "source", "n_tokens", "ids")


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", minhash_near_dedup),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding", piece_encoding),
]

#: No SQL: the language model, the bucket hashes and the seeded draws are not expressible; tests hold it to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{where}/{k}")
            docs = spark.read.parquet(f"{where}/{k}")
    return docs

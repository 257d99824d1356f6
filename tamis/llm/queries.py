"""One query for each operator of this subpackage: ``opN_<name>(spark, sf_dir)``, over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.llm import chat, chunks, gridjoin, langid, minhash, mixing, pieces, secrets, urls, warc
from tamis.llm.common import shared_dir

#: The vocabulary that op1 and the last stage of the pipeline encode with.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = MODEL_FILE) -> DataFrame:
    """Every document in pieces under merge-dropout, and what they decode to: doc_id, n_tokens, ids, decoded_chars, decoded_sha256."""
    encoded = pieces.encode(_table(spark, sf_dir, "documents"), model_file)
    text = pieces.decode(encoded, model_file)
    return text.select("doc_id", "n_tokens", "ids", F.length("text").cast("long").alias("decoded_chars"), F.sha2("text", 256).alias("decoded_sha256"))


def chat_digests(formatted: Column) -> list[Column]:
    """The digests of a formatted conversation, all read back from its text."""
    turns = chat.parse(formatted)
    all_text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter(turns, lambda t: t["learnt"]), lambda t: t["text"]), "")
    return [
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(all_text, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length(formatted).cast("long").alias("formatted_chars"),
    ]


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds another template's control strings, formatted and read back."""
    d = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{odd}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    d = d.unionByName(more).withColumn("parts", chat.text_part(F.col("text")))
    return chat.format_chat(d).select("conv_id", *chat_digests(F.col("formatted")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with weights 5, 2, 1 to 150 % of their words."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "quota", "full", "cut_words")


def op4_gridjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.93."""
    return gridjoin.near_vectors(_table(spark, sf_dir, "embeddings"))


URL_RULES = (
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL by the rules, or by trees trained on the URLs that the rules label."""
    return urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by PPM code lengths."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op7_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint against those of its edited text and of the next document."""
    return chunks.probe(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records to the shared folder and read back by byte ranges."""
    path = warc.fresh_path(shared_dir(spark))
    warc.archive(_table(spark, sf_dir, "pages"), path)
    d = warc.read(spark, path)
    whole = F.octet_length("payload").cast("long")
    response = F.col("type") == "response"
    return d.select(
        warc.page_id(F.col("record_id")).alias("page_id"),
        F.when(response, whole).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, warc.sha1_base32(F.col("payload"))).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        warc.page_id(F.col("refers_to")).alias("refers_to"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *secrets.digest_columns(F.col("spans")))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents at four words and 0.8."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_chat, op3_mixing, op4_gridjoin, op5_urls, op6_langid, op7_chunks, op8_warc, op9_secrets, op10_minhash)}
ORACLES: dict[str, str] = {
    "op10_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s
            FROM w WHERE len(w) > 0),
        e AS (SELECT doc_id, unnest(s) AS g FROM s),
        shared AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT i, j FROM shared JOIN s a ON a.doc_id = i JOIN s b ON b.doc_id = j WHERE 100 * c >= 80 * (len(a.s) + len(b.s) - c)),
        reach AS (SELECT doc_id AS i, doc_id AS j FROM documents UNION SELECT r.i, l.j FROM reach r JOIN links l ON r.j = l.i),
        found AS (SELECT i, min(j) AS component_id FROM reach GROUP BY i)
        SELECT d.doc_id, CAST(coalesce(len(s.s), 0) AS BIGINT) AS n_shingles, CASE WHEN s.s IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY s.s) END AS class_id,
            component_id, d.doc_id = component_id AS kept
        FROM documents d LEFT JOIN s USING (doc_id) JOIN found ON i = d.doc_id""",
    "op4_gridjoin": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
        reach AS (SELECT vec_id AS i, vec_id AS j FROM embeddings UNION SELECT r.i, l.j FROM reach r JOIN links l ON r.j = l.i),
        found AS (SELECT i, min(j) AS component_id FROM reach GROUP BY i)
        SELECT vec_id, (SELECT count(*) FROM links WHERE i = vec_id) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN found ON i = vec_id""",
    "op2_chat": r"""
        WITH m AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
            SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'),
                '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>') AS escaped
            FROM m)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(8 + length(role) + 8 + length(escaped) + 7) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op8_warc": """
        WITH d AS (SELECT page_id, encode(coalesce(html, '')) AS payload, unhex(sha1(encode(coalesce(html, '')))) AS h FROM pages),
        bits AS (SELECT page_id, octet_length(payload) AS payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS best FROM d),
        digits AS (
            SELECT page_id, payload_bytes, best, list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + CAST(CAST(substr(CAST(CAST(h AS BIT) AS VARCHAR), 1 + 5 * i, 1) AS INT) * 16 + CAST(substr(CAST(CAST(h AS BIT) AS VARCHAR), 2 + 5 * i, 1) AS INT) * 8
                + CAST(substr(CAST(CAST(h AS BIT) AS VARCHAR), 3 + 5 * i, 1) AS INT) * 4 + CAST(substr(CAST(CAST(h AS BIT) AS VARCHAR), 4 + 5 * i, 1) AS INT) * 2
                + CAST(substr(CAST(CAST(h AS BIT) AS VARCHAR), 5 + 5 * i, 1) AS INT) AS INT), 1)), lambda a, b: a || b) AS payload_digest
            FROM bits)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
            CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> best THEN best END AS refers_to
        FROM digits""",
}

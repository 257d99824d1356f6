"""Document fingerprints by content-defined chunking.

A gear hash rolls over the code points of a text: each adds its random number to the hash shifted left by one, so a
32-bit hash depends on the last 32 code points alone. A chunk ends where the hash has zeros under a mask. Chunking is
normalised (Xia et al., "FastCDC", 2016): no end within the first ``least`` code points, a mask with two bits more up to
the ``normal`` length and one with two bits fewer from there on, and an end at ``most`` in any case. An edit moves only
the ends near it, so two texts share the chunks of the passages they share, wherever those stand.

The fingerprint is the set of chunk digests with their lengths. ``containment`` is the share of one text's chunked
length that lies in chunks of the other's set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamis.llm.common import packed, small_batches, unpacked

LEAST, NORMAL, MOST = 8, 32, 128
_WINDOW = 32
#: Code points that are hashed in one go.
SLICE = 1 << 20
#: Hexadecimal digits of a chunk's digest in a fingerprint.
DIGITS = 12


def _gear(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 1 << 16, dtype=np.uint64).astype(np.uint32)


GEAR = _gear(2016)


def gear_hashes(points: np.ndarray) -> np.ndarray:
    """uint32: the gear hash after each code point (of at most 32 code points, those of the text)."""
    h = GEAR[points & 0xFFFF]
    for j in (1, 2, 4, 8, 16):  # sums over 2, 4, ... 32 code points
        more = h.copy()
        more[j:] += h[:-j] << np.uint32(j)
        h = more
    return h


def _ends(h: np.ndarray, n: int) -> list[int]:
    """The ends of the chunks of a text of n code points."""
    bits = NORMAL.bit_length() - 1
    # the zeros are asked of the top bits, which depend on the whole window
    strict = np.flatnonzero(h >> np.uint32(32 - bits - 2) == 0)
    loose = np.flatnonzero(h >> np.uint32(32 - bits + 2) == 0)
    strict_at, loose_at = strict.tolist(), loose.tolist()
    ends, at, i, j = [], 0, 0, 0
    n_strict, n_loose = len(strict_at), len(loose_at)
    while at < n:
        low, mid, top = at + LEAST - 1, at + NORMAL - 1, min(at + MOST, n)
        while i < n_strict and strict_at[i] < low:
            i += 1
        if i < n_strict and strict_at[i] < min(mid, top):
            at = strict_at[i] + 1
        else:
            while j < n_loose and loose_at[j] < mid:
                j += 1
            at = min(top, loose_at[j] + 1) if j < n_loose else top
        ends.append(at)
    return ends


def chunk_ends(text: str) -> list[int]:
    """The ends of a text's chunks, in code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return []
    if len(points) <= SLICE:
        h = gear_hashes(points)
    else:
        h = np.empty(len(points), np.uint32)
        for lo in range(0, len(points), SLICE):
            before = min(lo, _WINDOW)
            h[lo : lo + SLICE] = gear_hashes(points[lo - before : lo + SLICE])[before:]
    return _ends(h, len(points))


def chunk_set(text: str) -> dict[str, int]:
    """Digest -> length of the distinct chunks of a text."""
    out, at, digest = {}, 0, xxhash.xxh3_64_hexdigest
    for end in chunk_ends(text):
        out[digest(text[at:end].encode("utf-8", "surrogatepass"))[:DIGITS]] = end - at
        at = end
    return out


def fingerprint(chunks: dict[str, int]) -> str:
    """The set as text: ``digest:length`` by digest."""
    return ",".join([f"{d}:{n}" for d, n in sorted(chunks.items())])


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    """How much of a's length is in chunks that b has too; empty texts are alike and contain nothing else."""
    whole = sum(a.values())
    if not whole:
        return 0.0 if b else 1.0
    return sum([n for d, n in a.items() if d in b]) / whole


def with_fingerprints(docs: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fingerprint, n_chunks`` and the columns of ``keep`` for each row's whole text.

    Null and empty texts have no chunks. Rows with equal texts have equal fingerprints. Other columns are ignored; a kept
    column with the name of a result is returned as ``kept_<name>``.
    """
    keep = tuple(c for c in keep if c != "doc_id")

    @F.pandas_udf("fingerprint string, n_chunks long")
    def of(texts):
        import pandas as pd

        sets = [chunk_set(t) for t in texts]
        return pd.DataFrame({"fingerprint": [fingerprint(s) for s in sets], "n_chunks": [len(s) for s in sets]})

    d = packed(docs, ("doc_id", "text"), keep).withColumn("_f", of(F.coalesce("text", F.lit(""))))
    return d.select("doc_id", "_f.fingerprint", "_f.n_chunks", *unpacked(keep, ("doc_id", "text"), ("doc_id", "fingerprint", "n_chunks")))


PROBED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _probed(doc_id, text: str, own: dict[str, int], after: str, after_own: dict[str, int]) -> tuple:
    n = len(text)
    m = n // 4
    edited = text[: n - m] + after[:m]
    chunks = chunk_set(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, n, sha, fingerprint(own), fingerprint(chunks), containment(own, chunks), containment(own, after_own)


def probe(docs: DataFrame) -> DataFrame:
    """Each row against an edited copy of its text and against the next row, by ascending id.

    The edited text has its last quarter (rounded down, in code points) replaced by as many first code points of the
    next document's text, or all of it; after the last comes the first. Rows are dealt out by ranges of ids once and
    sorted; a task walks its range holding two texts. The last row of a range meets the first of the next range by a
    join on the range's number, for which only those two rows of each range are read again from the same shuffle.

    Null texts are empty. Null ids come first. Rows that repeat an id stand by text. One row is its own next. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spread = F.xxhash64("text")  # an id with very many rows is still many ranges
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number is not coalesced, so all reads see the same ranges
    d = d.repartitionByRange(ranges, "doc_id", spread).sortWithinPartitions("doc_id", spread, "text").withColumn("part", F.spark_partition_id())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = chunk_set(text)
                if last is not None:
                    out.append(_probed(*last, text, own))
                last = (doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, _TYPES)], _NAMES)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = None, None
        for batch in batches:
            if batch.num_rows:
                first = batch.slice(0, 1) if first is None else first
                last = batch.slice(batch.num_rows - 1, 1)
        for row, is_first in ((first, True), (last, False)):
            if row is not None:
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([is_first])], ["doc_id", "text", "part", "is_first"])

    inner = d.select("doc_id", "text").mapInArrow(walk, PROBED)
    ends = d.mapInArrow(edges, "doc_id long, text string, part int, is_first boolean")
    # the range after each, of those that have rows: a number for each range
    parts = ends.where("is_first").select("part")
    order = Window.orderBy("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    firsts = ends.where("is_first").select(F.col("part").alias("next"), F.col("text").alias("after"))
    pairs = ends.where("not is_first").join(following, "part").join(firsts, "next").select("doc_id", "text", "after")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_probed(i, t, chunk_set(t), a, chunk_set(a)) for i, t, a in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, _TYPES)], _NAMES)

    return inner.unionByName(pairs.mapInArrow(meet, PROBED))


_NAMES = [x.split()[0] for x in PROBED.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in PROBED.split(", ")]

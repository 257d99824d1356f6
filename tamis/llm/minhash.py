"""Near-duplicates by min-max hashing (Ji et al., "Min-Max Hash for Jaccard Similarity", 2013).

Each permutation of the shingles gives two signature values, its minimum and its maximum, so a signature of
``2 * permutations`` values takes half the hash evaluations; both agree with the probability of the Jaccard
similarity, and their mean varies less than that of as many independent minima. Bands of the signature are the
buckets of a locality-sensitive index. With 50 bands of 7 values, a pair at similarity 0.8 misses all buckets with a
probability of (1 - 0.8^7)^50, under 1e-5.

Small sets are further from that figure, as the minimum and the maximum of a permutation of few shingles depend on each
other. Those of up to ten shingles (at 0.8) are therefore also looked up by their shingles less one, which finds all
links of sets that differ by one shingle, or by one each.

Texts with equal shingle sets are one class from the start. Each bucket's classes are first compared with its pivot,
the member that shares most buckets with others; links are confirmed on the full shingle sets and contracted to
components, which leaves little of most groups of copies. Then every two members of a bucket that are still in different
components are compared: as pairs in small buckets. In large ones the members outside the largest component are cut into
blocks, and so are all members; each task holds a block of either kind, of bounded expected size, and returns only links
that join components. So no pair that could join two components is left out, no group is gathered in one place or
written out as all its pairs, and a text is shipped once for each block of members outside the largest component. Tables
that are joined by bucket are cut from their lineage first, so the adaptive skew join splits large buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import connected_components, cut, small_batches

_MIX1, _MIX2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Members up to which a bucket's pairs are written out.
SMALL = 24
#: Rows and shingles of a block of a larger bucket, as dealt out by a hash.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 19
#: Shingles that are hashed by all permutations in one go.
SLICE = 4096


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """uint64, sorted and distinct: the k-word shingles of a text, A-Z lower-cased; all words as one if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    m = min(k, n)
    s = h[: n - m + 1].copy()
    for j in range(1, m):
        s *= _BASE
        s += h[j : n - m + 1 + j]
    s ^= np.uint64(m * 0x1F123BB5)  # a short text is no shingle of a longer one
    s ^= s >> np.uint64(30)
    s *= _MIX1
    s ^= s >> np.uint64(27)
    s *= _MIX2
    s ^= s >> np.uint64(31)
    return np.unique(s)


class MinMax:
    """The seeded permutations and the banding of their minima and maxima."""

    def __init__(self, bands: int, rows: int, seed: int) -> None:
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(seed)
        n = -(-bands * rows // 2)
        self.a = rng.integers(0, 1 << 31, n, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """uint32[2 * permutations]: minimum and maximum under each permutation, side by side."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low, high = np.full(len(self.a), 0xFFFFFFFF, np.uint32), np.zeros(len(self.a), np.uint32)
        for i in range(0, len(x), SLICE):
            v = self.a[:, None] * x[None, i : i + SLICE]
            v += self.b[:, None]
            v ^= v >> np.uint32(15)  # the high bits of a product alone would keep the order of multiples
            v *= np.uint32(0x2C1B3C6D)
            np.minimum(low, v.min(1), out=low)
            np.maximum(high, v.max(1), out=high)
        return np.stack([low, high], 1).ravel()

    def keys(self, shingles: np.ndarray) -> list[int]:
        """A signed 64-bit bucket key for each band."""
        sig = self.signature(shingles)[: self.bands * self.rows].tobytes()
        width = 4 * self.rows
        return [xxhash.xxh3_64_intdigest(sig[i * width : (i + 1) * width], seed=i + 1) - (1 << 63) for i in range(self.bands)]


def _tiny(percent: int) -> tuple[int, int]:
    """The least and largest sets that are looked up by their shingles less one: below, only equal sets are similar enough."""
    return (-(-100 // (100 - percent)) - 1, 200 // (100 - percent)) if percent < 100 else (0, -1)


def tiny_keys(shingles: np.ndarray, percent: int) -> list[int]:
    """Signed 64-bit keys of a small set and of what is left of it without each of its shingles; none for other sets."""
    low, high = _tiny(percent)
    if not low <= len(shingles) <= high:
        return []
    whole = shingles.sum(dtype=np.uint64)
    less = whole - shingles if len(shingles) > low else shingles[:0]
    return [xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in np.append(whole, less)]


def _signed(docs: DataFrame, k: int, percent: int, index: MinMax) -> DataFrame:
    """``doc_id`` with the size and digest of each shingle set, its bucket keys and those of a small set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest, keys, tiny = [], [], [], []
            for t in batch.column("text").to_pylist():
                s = shingle_hashes(t, k)
                size.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(index.keys(s) if len(s) else [])
                tiny.append(tiny_keys(s, percent))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, lists), pa.array(tiny, lists)], ["doc_id", "n_shingles", "digest", "keys", "tiny"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n_shingles long, digest binary, keys array<long>, tiny array<long>")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Sets whose sizes differ more can't be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _tiny_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """``u, v``: pairs of small sets that differ by one shingle, or by one each, and are similar enough.

    All that is left without one shingle is the same in a bucket, so its members are of two sizes: one set at most that
    is what is left, and sets of one shingle more. Links with the first of them join all that the others would.
    """
    keyed = classes.select("class_id", "size", F.explode("tiny").alias("key"))
    pivots = cut(keyed.groupBy("key").agg(F.min(F.struct("size", "class_id")).alias("p"), F.count("*").alias("n")).where("n > 1").select("key", "p"))
    inter = F.when(F.col("p.size") == F.col("size"), F.col("size") - 1).otherwise(F.col("p.size"))
    near = (F.col("class_id") != F.col("p.class_id")) & (100 * inter >= percent * (F.col("size") + F.col("p.size") - inter))
    return keyed.join(pivots, "key").where(near).select(F.greatest("class_id", "p.class_id").alias("u"), F.least("class_id", "p.class_id").alias("v"))


def _dealt(large: DataFrame) -> DataFrame:
    """``key, i, j, id, comp, apart``: the members of buckets dealt out to pairs of blocks, those outside the largest component (apart) to blocks i, all to blocks j."""
    by_component = large.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    stats = by_component.groupBy("key").agg(F.max(F.struct("n", "size", "comp")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_SHINGLES), F.lit(1))
    stats = cut(stats.select("key", F.col("main.comp").alias("main"), blocks(F.col("n"), F.col("size")).alias("all"), blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("apart")))
    placed = large.select("key", "id", "comp").join(stats, "key")
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = placed.where("comp <> main").select("key", "id", "comp", dealt("apart").alias("i"), numbers("all").alias("j"), F.lit(True).alias("apart"))
    others = placed.select("key", "id", "comp", numbers("apart").alias("i"), dealt("all").alias("j"), F.lit(False).alias("apart"))
    return mine.unionByName(others)


def _joined_by_blocks(large: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``u, v``: links between members of a bucket in different components, enough to join all that they join.

    Of two such members one is outside the bucket's largest component, so blocks of those meet blocks of all members.
    """
    meet = _dealt(large).join(texts.select(F.col("doc_id").alias("id"), "text"), "id")

    def join(table: pa.Table) -> pa.Table:
        apart = table.column("apart").to_numpy()
        ids, comp = table.column("id").to_numpy(), table.column("comp").to_numpy()
        sets = [shingle_hashes(t, k) for t in table.column("text").to_pylist()]
        rest = np.flatnonzero(~apart)
        sizes = np.array([len(sets[y]) for y in rest], np.int64)
        # which of the others have each shingle
        flat = np.concatenate([np.zeros(0, np.uint64), *(sets[y] for y in rest)])
        by = np.argsort(flat, kind="stable")
        owner, flat = np.repeat(np.arange(len(rest)), sizes)[by], flat[by]
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        u, v = [], []
        for x in np.flatnonzero(apart):
            a, b = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
            reach = np.repeat(b - np.cumsum(b - a), b - a) + np.arange((b - a).sum())
            inter = np.bincount(owner[reach], minlength=len(rest))
            hit = (comp[rest] != comp[x]) & (100 * inter >= percent * (sizes + len(sets[x]) - inter))
            for y in rest[hit]:
                p, q = find(int(comp[x])), find(int(comp[y]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    u.append(max(int(ids[x]), int(ids[y])))
                    v.append(min(int(ids[x]), int(ids[y])))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return meet.groupBy("key", "i", "j").applyInArrow(join, "u long, v long")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``u, v, linked`` for pairs ``(u, v)`` of ids, by the full shingle sets of their texts."""
    left = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
    both = left.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v").select("u", "v", "text_u", "text_v")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, b = None, np.zeros(0, np.uint64)  # rows of one pivot come together
        for batch in batches:
            linked = []
            for t, p in zip(batch.column("text_u").to_pylist(), batch.column("text_v").to_pylist()):
                if p != pivot:
                    pivot, b = p, shingle_hashes(p, k)
                a = shingle_hashes(t, k)
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    linked.append(False)
                    continue
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                inter = int((b[at] == a).sum())
                linked.append(100 * inter >= percent * (len(a) + len(b) - inter))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(linked, pa.bool_())], ["u", "v", "linked"])

    return both.mapInArrow(confirm, "u long, v long, linked boolean")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = 50, rows: int = 7, seed: int = 11) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id, kept`` for each row of ``docs``.

    Two documents are linked if 100 * shared shingles >= ``percent`` * all shingles of both. ``class_id`` is the
    smallest id with the same shingle set, ``component_id`` the smallest id reachable by links.

    Null and wordless texts have no shingles and link with nothing. Rows that repeat an id are one document: they
    link what any of them links. Rows without an id link with nothing, have no component and are kept. Other columns
    are ignored, whatever their names. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    signed = cut(_signed(docs, shingle, percent, MinMax(bands, rows, seed)))
    ids = signed.where("doc_id is not null and digest is not null")
    classes = ids.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("size"), F.min_by("keys", "doc_id").alias("keys"), F.min_by("tiny", "doc_id").alias("tiny"))
    buckets = classes.select("class_id", "size", F.explode("keys").alias("key"))
    shared = cut(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = cut(buckets.join(shared, "key").select("key", F.col("class_id").alias("id"), "size", "n"))
    degree = met.groupBy("id").agg(F.sum(F.col("n") - 1).alias("degree"))
    pivots = met.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"), "size")).alias("p"))
    pivots = cut(pivots.select("key", (-F.col("p.minus")).alias("p"), F.col("p.size").alias("p_size")))
    first = met.join(pivots, "key").where((F.col("id") != F.col("p")) & _may_link("size", "p_size", percent)).select(F.greatest("id", "p").alias("u"), F.least("id", "p").alias("v"))
    first = cut(first.unionByName(_tiny_pairs(classes, percent)).distinct())
    # the texts of what may link at all, once
    found = met.select("id").unionByName(first.select(F.col("u").alias("id"))).unionByName(first.select(F.col("v").alias("id"))).distinct()
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(found.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"))
    judged = cut(_confirmed(first, texts, shingle, percent))
    links = judged.where("linked").select("u", "v").distinct()
    component = cut(connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("comp")))

    placed = met.where("n > 2").join(component, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    split = cut(placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key"))
    open_ = cut(placed.join(split, "key", "left_semi"))
    small = open_.where(F.col("n") <= SMALL)
    others = small.select("key", F.col("id").alias("p"), F.col("size").alias("p_size"), F.col("comp").alias("p_comp"))
    may = (F.col("id") > F.col("p")) & (F.col("comp") != F.col("p_comp")) & _may_link("size", "p_size", percent)
    second = small.join(others, "key").where(may).select(F.col("id").alias("u"), F.col("p").alias("v")).distinct()
    second = _confirmed(second.join(judged.select("u", "v"), ["u", "v"], "left_anti"), texts, shingle, percent).where("linked").select("u", "v")
    more = cut(second.unionByName(_joined_by_blocks(open_.where(F.col("n") > SMALL), texts, shingle, percent)).distinct())
    if more.limit(1).count():
        links = links.unionByName(more)
        component = cut(connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("comp")))
    # an id on rows of different texts is one document: its classes meet
    of_class = cut(ids.groupBy("digest").agg(F.min("doc_id").alias("class_id")))
    several = cut(ids.groupBy("doc_id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("d0 <> d1").select("doc_id"))
    meet = ids.join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(of_class, "digest")
    meet = cut(meet.where("doc_id <> class_id").select(F.col("doc_id").alias("u"), F.col("class_id").alias("v")))
    if meet.count():
        component = cut(connected_components(links.unionByName(meet)).select(F.col("node").alias("id"), F.col("component").alias("comp")))
    # components are joined with classes, and rows with those once, by digest
    names = cut(of_class.join(component.select(F.col("id").alias("class_id"), "comp"), "class_id", "left").select("digest", "class_id", F.coalesce("comp", "class_id").alias("comp")))
    found = signed.select("doc_id", "n_shingles", "digest").join(names, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    found = found.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), own.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

"""What several operators share: the shared folder, documents with clashing columns, connected components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.sources.files import shared_dir

WORD = r"[^\x20\x09-\x0D]+"


#: Rows of whole texts that Spark hands to a Python worker at once, unless the session says otherwise.
TEXT_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of whole texts, which both sides of the socket hold, if the session has Spark's default.

    The setting has no effect on results. It stays for the session, as plans are made when they run.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(TEXT_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with no lineage: lost executors don't bring its plan back."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def word_count(text: Column) -> Column:
    """Words of a text, as SQL expression; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quoted(name: str) -> str:
    """A column's name as Spark reads it whatever its characters."""
    return "`" + name.replace("`", "``") + "`"


#: The caller's columns inside an operator: one struct, so that none can clash with the operator's own.
ROW = "_row"


def packed(docs: DataFrame, own: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """The columns an operator reads, and those to ``keep`` (None: all others) as the struct ``ROW``, whatever their names."""
    rest = [c for c in (docs.columns if keep is None else keep) if c not in own]
    row = F.struct(*[F.col(quoted(c)) for c in rest]) if rest else F.lit(0)
    return docs.select(*[F.col(quoted(c)) for c in own], row.alias(ROW))


def unpacked(keep: Sequence[str], own: Sequence[str], result: Sequence[str] = ()) -> list[Column]:
    """The columns to ``keep`` of a packed frame by their names; one that is also a name in ``result`` is returned as ``kept_<name>``."""
    taken = {r.lower() for r in result}
    return [(F.col(quoted(c)) if c in own else F.col(f"{ROW}.{quoted(c)}")).alias(f"kept_{c}" if c.lower() in taken else c) for c in keep]


#: Keys that one join broadcasts at most: those of so large a share of the rows that their rows should not meet in one task.
HEAVY_KEYS = 4096


def join_table(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each value of ``key`` and its number of rows in ``count``.

    Keys that hold at least one in HEAVY_KEYS of the ``total`` rows are HEAVY_KEYS at most: they are broadcast, and
    their rows stay where they are. All others are joined by a shuffle, in which no key can be large. ``how`` is inner
    or left; rows with a null key match nothing.
    """
    least = max(2, -(-total // HEAVY_KEYS))
    heavy = table.where(F.col(count) >= least).drop(count)
    light = table.where(F.col(count) < least).drop(count)
    few = F.broadcast(heavy)
    here = rows.join(few, key)
    there = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, how)
    return here.unionByName(there)


#: Edges that a task contracts at once, and up to which one task contracts a whole graph.
LOCAL_EDGES = 100_000


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of some edges that is not the least of its component, and that least node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges of the same components: those of each LOCAL_EDGES in a partition as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def stars() -> pa.RecordBatch:
            u, v = _roots(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            for lo in range(0, batch.num_rows, LOCAL_EDGES):
                part = batch.slice(lo, LOCAL_EDGES)
                if held and n + part.num_rows > LOCAL_EDGES:
                    yield stars()
                    held, n = [], 0
                held.append([part.column(c).to_numpy() for c in ("u", "v")])
                n += part.num_rows
        if held:
            yield stars()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: ``(u, v)`` of long -> ``(node, component)``, the smallest node reachable.

    Edges are first contracted to stars within each partition, which settles a graph of one partition of up to
    LOCAL_EDGES. Larger ones go on by alternating large-star and small-star steps (Kiveris et al., "Connected Components
    in MapReduce and Beyond", 2014): every step is one minimum per node, pre-aggregated before its shuffle, and one join
    back. The minima are cut from their lineage first, so both sides of the join are shuffled and a node with many
    neighbours is split by the adaptive skew join; its edges are never gathered in one place. The edges of each round
    are cut from their lineage in the shared folder. Nodes without an edge are not returned; self-loops are allowed.
    """
    now = cut(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null").distinct())
    loops = now.where("u = v").select(F.col("u").alias("node"))
    now = now.where("u <> v")
    rows = now.count()
    parts = -(-rows // LOCAL_EDGES)
    if rows:
        now = cut(_contracted(now.coalesce(parts)))
    settled = parts <= 1
    size = lambda: now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    mark = None if settled else size()
    while not settled:
        now = now.coalesce(max(2, mark[0] // LOCAL_EDGES))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every edge of large points down (u > v): small-star joins what each node points to with its least
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("a"), "u", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = cut(small.where("u <> v").distinct())
        mark, before = size(), mark
        settled = mark == before
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    alone = loops.join(found, "node", "left_anti").join(roots, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(roots).unionByName(alone)

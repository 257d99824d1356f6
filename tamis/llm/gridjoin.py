"""Near-duplicate vectors by an epsilon grid order join (after Boehm et al., "Epsilon Grid Order", 2001).

For unit vectors, a cosine of at least c is a distance of at most eps = sqrt(2 - 2 c). The vectors of a label are turned
into their principal directions (an orthonormal basis: distances stay), given the cells of a grid of width eps on the
leading ones, sorted by cell and cut into blocks of the sequence. A tree of intervals over the blocks holds the bounds of
each. The join starts with each label's whole sequence against itself and goes down to pairs of child intervals, step by
step for all pairs at once; pairs whose bounds are further apart than eps in the leading directions are provably free of
links and are dropped. What is left are pairs of blocks, each compared by one product of matrices.

Equal vectors are one class with a count from the start. A pair of blocks returns the links of each class as a count and a
spanning forest of its links, so neither the copies nor the members of a cluster are written out as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType
from pyspark.sql.window import Window

from tamis.llm.common import connected_components, cut

#: Vectors of a block; children of an interval; pairs of blocks that Python holds at once, and that a task compares.
BLOCK, FAN, PAIRS, TASK_PAIRS = 1024, 8, 8, 64
#: Leading directions that have bounds, and those of them that have cells.
BOUNDS, CELLS = 16, 4
#: Vectors that the directions are fitted on at most, and numbers in them. Any basis is right; this one is apt.
FITTED, FITTED_VALUES = 20_000, 1 << 22
#: Rounding of coordinates, which bounds must not lose a link to.
SLACK = 1e-7


def usable(embedding: Column) -> Column:
    """Whether all components are finite numbers and one is not zero."""
    fine = F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision whatever their scale."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _directions(classes: DataFrame, seed: int = 1) -> dict[int, np.ndarray]:
    """Orthonormal principal directions by length of vector, from one sample taken by hash and bounded over all lengths.

    Lengths that the sample leaves out keep the axes they have.
    """
    n, width = classes.agg(F.count("*"), F.coalesce(F.avg("dim"), F.lit(1.0))).first()
    rows = int(max(1, min(FITTED, FITTED_VALUES // max(1.0, width))))
    draw = F.pmod(F.xxhash64(F.lit(seed), "h1"), F.lit(1 << 30)) / (1 << 30)
    sample = classes.where(draw < min(1.0, 1.2 * rows / max(1, n))).orderBy("h1", "h2").limit(rows).select("dim", "embedding").toArrow()
    dims, found = sample.column("dim").to_numpy(), sample.column("embedding").combine_chunks()
    out = {}
    for dim in np.unique(dims):
        x = found.filter(pa.array(dims == dim)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        x = _unit(x)
        x -= x.mean(0)
        _, v = np.linalg.eigh(x.T @ x)
        out[int(dim)] = np.ascontiguousarray(v[:, ::-1])
    return out


def _along(x: np.ndarray, basis: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The first n coordinates of unit vectors in their basis, or in the axes they have."""
    own = basis.get(x.shape[1])
    return x[:, :n] if own is None else x @ own[:, :n]


def _blocks(classes: DataFrame, basis: dict[int, np.ndarray], eps: float, kind: str) -> DataFrame:
    """Blocks of the sequence: ``label, dim, block, ids, least, copies, data`` and the bounds ``lo0, hi0, ...`` of each."""
    shared = classes.sparkSession.sparkContext.broadcast(basis)
    cells = [f"cell{i}" for i in range(CELLS)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            found = np.zeros((CELLS, batch.num_rows), np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.array(batch.column("embedding").take(pa.array(at)).to_pylist(), np.float64)
                y = _along(_unit(x), shared.value, CELLS)
                found[: y.shape[1], at] = np.floor(y / eps).astype(np.int64).T
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], [*batch.schema.names, *cells])

    fields = f"class long, least long, label string, dim int, copies long, embedding array<{kind}>"
    placed = classes.select("class", "least", "label", "dim", "copies", "embedding").mapInArrow(place, fields + "".join(f", {c} long" for c in cells))
    order = ["label", "dim", *cells, "class"]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("class", "least", "label", "dim", "copies", "embedding", F.spark_partition_id().alias("part"))
    numpy_kind = np.float32 if kind == "float" else np.float64
    bounds = [f"{e}{i}" for i in range(BOUNDS) for e in ("lo", "hi")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, number, part = [], None, 0, 0

        def block() -> pa.RecordBatch:
            nonlocal number
            x = np.array([r[3] for r in held], numpy_kind)
            y = _along(_unit(x), shared.value, BOUNDS)
            lo, hi = np.zeros(BOUNDS), np.zeros(BOUNDS)
            lo[: y.shape[1]], hi[: y.shape[1]] = y.min(0), y.max(0)
            row = [key[0], key[1], part << 32 | number, *(np.array([r[i] for r in held], np.int64).tobytes() for i in range(3)), x.tobytes()]
            number += 1
            edge = [v for pair in zip(lo, hi) for v in pair]
            types = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), *[pa.float64()] * len(edge)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*row, *edge], types)], ["label", "dim", "block", "ids", "least", "copies", "data", *bounds])

        for batch in batches:
            for c, least, label, dim, copies, e, part in zip(*(col.to_pylist() for col in batch.columns)):
                if held and (key != (label, dim) or len(held) >= BLOCK):
                    yield block()
                    held = []
                key = (label, dim)
                held.append((c, least, copies, e))
        if held:
            yield block()

    return placed.mapInArrow(pack, "label string, dim int, block long, ids binary, least binary, copies binary, data binary" + "".join(f", {b} double" for b in bounds))


def _candidates(blocks: DataFrame, eps: float) -> DataFrame:
    """``a, b``: pairs of blocks that may hold links, by recursion over intervals of the sequence."""
    keys = ["label", "dim"]
    lows, highs = [f"lo{i}" for i in range(BOUNDS)], [f"hi{i}" for i in range(BOUNDS)]
    leaves = blocks.select(*keys, "block", *lows, *highs, (F.row_number().over(Window.partitionBy(*keys).orderBy("block")) - 1).cast("long").alias("at"))
    levels = [cut(leaves)]
    top = levels[0].agg(F.max("at")).first()[0] or 0
    while top:
        up = levels[-1].withColumn("at", F.floor(F.col("at") / FAN)).groupBy(*keys, "at").agg(*[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs])
        levels.append(cut(up))
        top //= FAN
    distance = reduce(lambda s, i: s + F.pow(F.greatest(F.lit(0.0), F.col(f"x.lo{i}") - F.col(f"y.hi{i}"), F.col(f"y.lo{i}") - F.col(f"x.hi{i}")), F.lit(2.0)), range(BOUNDS), F.lit(0.0))
    pairs = levels[-1].select(*keys, F.col("at").alias("p"), F.col("at").alias("q"))  # each label's whole sequence with itself
    for children in reversed(levels[:-1]):
        of = children.withColumn("up", F.floor(F.col("at") / FAN))
        x, y = of.alias("x"), of.alias("y")
        on = lambda side, up: (F.col(f"{side}.up") == F.col(up)) & (F.col(f"{side}.label") == F.col("o.label")) & (F.col(f"{side}.dim") == F.col("o.dim"))
        down = pairs.alias("o").join(x, on("x", "o.p")).join(y, on("y", "o.q") & (F.col("x.at") <= F.col("y.at")) & (distance <= eps * eps + SLACK))
        pairs = cut(down.select("o.label", "o.dim", F.col("x.at").alias("p"), F.col("y.at").alias("q")))
    name = levels[0].select(*keys, "at", "block")
    pairs = pairs.join(name.withColumnsRenamed({"at": "p", "block": "a"}), [*keys, "p"]).join(name.withColumnsRenamed({"at": "q", "block": "b"}), [*keys, "q"])
    return pairs.select("a", "b")


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph of a symmetric matrix, by breadth-first search over whole rows."""
    n, out = len(linked), []
    new = linked.any(1)
    while new.any():
        start = int(new.argmax())
        new[start] = False
        edge = [start]
        while edge:
            x = edge.pop()
            reach = np.flatnonzero(linked[x] & new)
            new[reach] = False
            out += [(x, int(y)) for y in reach]
            edge += reach.tolist()
    assert len(out) < max(1, n)
    return out


def _compared(pairs: DataFrame, blocks: DataFrame, threshold: float, kind: str) -> DataFrame:
    """``u, v, links``: links of class u by count (v null), and edges u - v of spanning forests, by least keys (links null)."""
    numpy_kind = np.float32 if kind == "float" else np.float64
    columns = ("ids", "least", "copies", "data")
    side = lambda n: blocks.select(F.col("block").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in columns])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    # tasks of some pairs each, however finely the joins are dealt out
    tasks = max(2 * pairs.sparkSession.sparkContext.defaultParallelism, -(-pairs.count() // TASK_PAIRS))
    both = both.select("a", "b", *[f"{n}_{c}" for n in "ab" for c in columns]).coalesce(tasks)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, ai, al, ac, ad, bi, bl, bc, bd in zip(*(c.to_pylist() for c in batch.columns)):
                ai, al, ac, bi, bl, bc = (np.frombuffer(v, np.int64) for v in (ai, al, ac, bi, bl, bc))
                x = _unit(np.frombuffer(ad, numpy_kind).reshape(len(ai), -1))
                y = x if a == b else _unit(np.frombuffer(bd, numpy_kind).reshape(len(bi), -1))
                linked = x @ y.T >= threshold
                if a == b:
                    np.fill_diagonal(linked, False)
                    counts, ids, least, square = linked @ ac, ai, al, linked
                else:
                    counts, ids, least = np.concatenate([linked @ bc, ac @ linked]), np.concatenate([ai, bi]), np.concatenate([al, bl])
                    n = len(ai)
                    square = np.zeros((len(ids), len(ids)), bool)
                    square[:n, n:], square[n:, :n] = linked, linked.T
                has = np.flatnonzero(counts)
                if not has.size:
                    continue
                edges = _forest(square)
                u = np.concatenate([ids[has], least[[e[0] for e in edges]]])
                v = pa.array([None] * len(has) + least[[e[1] for e in edges]].tolist(), pa.int64())
                links = pa.array(counts[has].tolist() + [None] * len(edges), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(u), v, links], ["u", "v", "links"])

    return both.mapInArrow(compare, "u long, v long, links long")


def near_vectors(vectors: DataFrame, *, threshold: float = 0.93, key: str = "vec_id") -> DataFrame:
    """``key, n_links, component_id, kept`` for each row of ``key, embedding, label``.

    Rows with the same non-null label (of any type that can be written as text) and vectors of the same length are linked
    at a cosine of ``threshold`` or more in double precision. ``n_links`` counts the other rows linked with a row,
    ``component_id`` is the smallest key reachable by links.

    Vectors that are null, zero, or hold nulls or non-finite numbers link with nothing, as do rows with a null label.
    Rows with a null key link with nothing, have no component and are kept. Rows that repeat a key count as vectors of
    their own, but are in one component. Other columns are ignored, whatever their names. An empty table gives an empty
    result.
    """
    spark = vectors.sparkSession
    kind = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "double"
    d = vectors.select(F.col(key).cast("long").alias("id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"), F.col("label").cast("string").alias("label"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    hashes = {"h1": F.when(good, F.xxhash64("label", "embedding")), "h2": F.when(good, F.xxhash64(F.lit(77), "embedding", "label"))}
    d = d.withColumns(hashes)
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    classes = d.where("h1 is not null").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("id").alias("least"))
    classes = cut(classes.select("h1", "h2", "label", "copies", "least", "embedding", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("class")))
    blocks = cut(_blocks(classes, _directions(classes), eps, kind))
    pairs = cut(_candidates(blocks, eps))
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PAIRS))  # rows of two blocks are large
    try:
        found = cut(_compared(pairs, blocks, threshold, kind))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    links = found.where("links is not null").groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "class")
    edges = found.where("v is not null").select("u", "v")
    # a key on rows of different vectors joins their classes
    rows = d.select("id", "h1", "h2")
    several = cut(rows.where("h1 is not null").groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("one"), F.max(F.struct("h1", "h2")).alias("other")).where("one <> other").select("id"))
    if several.limit(1).count():
        meet = rows.join(several, "id", "left_semi").distinct().join(classes.select("h1", "h2", "least"), ["h1", "h2"])
        edges = edges.unionByName(meet.where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v")))
    component = connected_components(edges).withColumnsRenamed({"node": "least", "component": "component_id"})
    # classes are joined with what is known of them, and rows with that once, through a table cut from its lineage, so that a class of very many rows is split
    own = classes.select("h1", "h2", "class", "copies", "least").join(links, "class", "left").join(component, "least", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    own = cut(own.select("h1", "h2", n_links.alias("n_links"), F.coalesce("component_id", "least").alias("component_id")))
    out = rows.join(own, ["h1", "h2"], "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))

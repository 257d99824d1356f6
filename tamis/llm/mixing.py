"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame functions only.

1. Targets: weights are shared out over the sources with a ceiling for each, the excess going to the others by
   weight (water-filling in closed form, in whole numbers up to one division).
2. Every source is cut into shards of about ``shard_words`` words by a hash of the id, so a source that holds a
   third of all words is many shards.
3. Equal blocks of ``block_words`` words are given to the sources, and each source's to its shards, by the highest
   quotients votes / (2 k - 1). Only the seats that the bounds on the divisor leave open are compared: fewer than
   four a party, however many blocks there are.
4. A shard's documents stand in a seeded order. Each of its blocks is taken quota // blocks times, and a seeded run
   of blocks, which goes round the end, once more: a random sample of documents, of which two at most are cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamis.llm.common import ROW, cut, join_table, packed, unpacked, word_count

#: Sources up to which their table (under 100 bytes a row and the name) is broadcast; of more, only the large ones are.
BROADCAST_SOURCES = 20_000

_FIRST_NULL_LAST = F.asc_nulls_last


def target_sizes(sizes: DataFrame, weights: Sequence[int], share_num: int, share_den: int, cap: int) -> DataFrame:
    """``source, source_size`` -> also ``rank, weight, target``: the weights repeat along the sources by code point, null last.

    The targets sum to ``share_num / share_den`` of all sizes (or to all ceilings, if those are less) and none is above
    ``cap`` times its size. One row per source is sorted in one place: the list of sources, not the rows.
    """
    order = Window.orderBy(_FIRST_NULL_LAST("source"))
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", weight)
    # by ceiling over weight, ascending: the first j are at their ceiling, all others at one level
    ranked = ranked.withColumn("_ratio", F.col("source_size") / F.col("weight"))
    upto = Window.orderBy("_ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    whole = lambda c: c.cast("decimal(38,0)")  # noqa: E731  products of sizes may pass 64 bits
    d = ranked.withColumns({
        "_num": F.sum("source_size").over(every) * share_num - (F.sum("source_size").over(upto) - F.col("source_size")) * (cap * share_den),
        "_den": (F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight")) * share_den,
    })
    # num / den: the level for a unit of weight if all before this source are at their ceiling
    fits = whole(F.col("_num")) * F.col("weight") <= whole(F.col("source_size") * cap) * F.col("_den")
    d = d.withColumn("_first", F.min(F.when(fits, F.struct("_ratio", "rank", "_num", "_den"))).over(every))
    under = (F.col("_ratio") < F.col("_first._ratio")) | ((F.col("_ratio") == F.col("_first._ratio")) & (F.col("rank") < F.col("_first.rank")))
    ceiling = (F.col("source_size") * cap).cast("double")
    level = (F.col("weight") * F.col("_first._num")).cast("double") / F.col("_first._den").cast("double")
    d = d.withColumn("target", F.when(F.col("_first").isNull() | under, ceiling).otherwise(level))
    return d.select(*sizes.columns, "rank", "weight", "target")


def sainte_lague(parties: DataFrame, votes: str, seats: Column, group: Sequence[str], party: Sequence[str]) -> DataFrame:
    """``parties`` with ``quota``: ``seats`` (alike within a group) given to the highest quotients votes / (2 k - 1).

    Every winning divisor d satisfies sum(votes / d) between seats - n / 2 and seats + n / 2 for n parties, so a party
    has at least floor(share * (1 - n / (2 seats))) - 1 seats and at most ceil(share * (1 + n / (2 seats))) + 1. The
    seats below are given at once; those between are ranked. Ties go to the party that comes first.
    """
    w = Window.partitionBy(*group)
    d = parties.withColumns({"_seats": F.greatest(seats, F.lit(0)).cast("long"), "_n": F.sum(F.when(F.col(votes) > 0, 1).otherwise(0)).over(w), "_votes": F.sum(votes).over(w)})
    share = F.when(F.col("_votes") > 0, F.col(votes) / F.col("_votes") * F.col("_seats")).otherwise(0.0)
    slack = F.when(F.col("_seats") > 0, F.col("_n") / (2.0 * F.col("_seats"))).otherwise(0.0)
    d = d.withColumn("_low", F.greatest(F.lit(0), F.floor(share * (1 - slack)) - 1).cast("long"))
    d = d.withColumn("_high", F.when(share > 0, F.least(F.col("_seats"), F.ceil(share * (1 + slack)) + 1)).otherwise(0).cast("long"))
    d = d.withColumn("_open", F.col("_seats") - F.sum("_low").over(w))
    between = F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))
    bids = d.select(*group, *party, votes, "_open", F.explode(between).alias("_k")).withColumn("_quotient", F.col(votes) / (2 * F.col("_k") - 1))
    won = bids.withColumn("_at", F.row_number().over(w.orderBy(F.desc("_quotient"), *[_FIRST_NULL_LAST(c) for c in party], "_k"))).where("_at <= _open")
    won = won.groupBy(*dict.fromkeys([*group, *party])).agg(F.count("*").alias("_won"))
    keys = list(dict.fromkeys([*group, *party]))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = d.alias("a").join(won.alias("b"), on, "left")
    return joined.select(*[F.col(f"a.{c}") for c in parties.columns], (F.col("a._low") + F.coalesce("b._won", F.lit(0))).cast("long").alias("quota"))


RESULT = ("doc_id", "source", "size", "source_size", "target", "quota", "taken", "full", "cut_from", "cut_words")


def mix(
    docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2, block_words: int = 8,
    shard_words: int = 1 << 20, seed: int = 7, keep: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, source, size, source_size, target, quota, taken, full, cut_from, cut_words`` and ``keep`` for each row.

    ``taken`` words of a document are ``full`` whole copies and ``cut_words`` words from word ``cut_from`` on (going
    round its end). No document gives more than ``cap`` times its size. The seed and the ids fix the result.

    Null and wordless texts have size 0 and are not taken. Null sources are one source, the last. Rows that repeat an
    id are documents of their own, that stand side by side; those of equal size are interchangeable. An empty table
    gives an empty result. Columns other than doc_id, text, source and ``keep`` are ignored, whatever their names; a
    kept column with the name of a result is returned as ``kept_<name>``. Words are counted once, and once more where
    columns are kept, which spares writing those.
    """
    keep = [c for c in keep if c not in ("doc_id", "source")]
    d = _mixed(docs, weights, share, cap, block_words, shard_words, seed, keep)
    return d.select(*RESULT, *unpacked(keep, ("doc_id", "text", "source"), RESULT))


def _mixed(docs: DataFrame, weights: Sequence[int], share: tuple[int, int], cap: int, block_words: int, shard_words: int, seed: int, keep: Sequence[str]) -> DataFrame:
    """The columns of RESULT, and text and the packed others if any is to be kept."""
    own, kept = ("doc_id", "text", "source"), ("text", ROW) if keep else ()
    size = word_count(F.col("text")).alias("size")
    measured = cut(docs.select("doc_id", "source", size))
    sizes = measured.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    targets = target_sizes(sizes, weights, share[0], share[1], cap)
    blocks = F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")
    quotas = sainte_lague(targets.withColumn("_blocks", blocks), "target", F.col("_blocks"), [], ["rank"]).drop("_blocks")
    quotas = quotas.withColumnRenamed("quota", "_source_quota").withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    # null sources are joined as well
    name = F.concat(F.when(F.col("source").isNull(), "null").otherwise("="), F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("_name")
    quotas = cut(quotas.select(name, "_rows", "source_size", "target", "rank", "_source_quota", "_shards"))  # a row for each source
    sources, rows = quotas.agg(F.count("*"), F.sum("_rows")).first()

    shard = F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), F.col("doc_id").cast("string"), "size"), F.col("_shards"))

    def place(d: DataFrame) -> DataFrame:
        d = d.withColumn("_name", name)
        d = d.join(F.broadcast(quotas.drop("_rows")), "_name") if sources <= BROADCAST_SOURCES else join_table(d, quotas, "_name", "_rows", rows)
        return d.drop("_name").withColumn("_shard", shard)

    placed = place(packed(docs, own, keep).select("doc_id", "source", *kept, size) if keep else measured)
    # the words before each document in its shard, in the seeded order
    order = Window.partitionBy("rank", "_shard").orderBy(F.xxhash64(F.lit(seed), F.lit("order"), F.col("doc_id").cast("string")), "doc_id", "size")
    placed = placed.withColumn("_before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    shards = place(measured).groupBy("rank", "_shard", "_source_quota").agg(F.sum("size").alias("_shard_size"))
    shards = sainte_lague(shards.withColumn("_votes_of", F.col("_shard_size").cast("double")), "_votes_of", F.col("_source_quota"), ["rank"], ["_shard"])
    n = F.ceil(F.col("_shard_size") / block_words).cast("long")
    q = F.least(F.col("quota"), n * cap)
    shards = shards.select("rank", "_shard", "_shard_size", q.alias("quota"), n.alias("_n"))
    base = F.when(F.col("_n") > 0, F.expr("quota div _n")).otherwise(0)
    shards = shards.withColumns({"_base": base.cast("long"), "_start": F.when(F.col("_n") > 0, F.pmod(F.xxhash64(F.lit(seed), F.lit("run"), "rank", "_shard"), F.col("_n"))).otherwise(0)})
    more = F.col("quota") - F.col("_base") * F.col("_n")
    a, end = F.col("_start"), F.col("_start") + more
    # the run as one or two intervals of words
    shards = shards.select(
        "rank", "_shard", "quota", "_base",
        "_shard_size", F.least(a * block_words, F.col("_shard_size")).alias("_a1"), F.least(F.least(end, F.col("_n")) * block_words, F.col("_shard_size")).alias("_b1"),
        F.least(F.greatest(end - F.col("_n"), F.lit(0)) * block_words, F.col("_shard_size")).alias("_b2"),
    )
    d = placed.join(shards, ["rank", "_shard"])
    lo, hi = F.col("_before"), F.col("_before") + F.col("size")
    one = F.greatest(F.lit(0), F.least(hi, F.col("_b1")) - F.greatest(lo, F.col("_a1")))
    two = F.greatest(F.lit(0), F.least(hi, F.col("_b2")) - lo)
    d = d.withColumns({"_one": one, "_two": two}).withColumn("_part", F.col("_one") + F.col("_two"))
    whole = (F.col("_part") == F.col("size")) & (F.col("size") > 0)
    return d.select(
        "doc_id", "source", "size", "source_size", "target", "quota",
        (F.col("_base") * F.col("size") + F.col("_part")).cast("long").alias("taken"),
        (F.col("_base") * F.when(F.col("size") > 0, 1).otherwise(0) + F.when(whole, 1).otherwise(0)).cast("long").alias("full"),
        F.when(F.col("_one") > 0, F.greatest(F.col("_a1") - lo, F.lit(0))).otherwise(0).cast("long").alias("cut_from"),
        F.when(whole, 0).otherwise(F.col("_part")).cast("long").alias("cut_words"),
        *kept,
    )


def cut_text(text: Column, cut_from: Column, cut_words: Column) -> Column:
    """``cut_words`` words of a text from word ``cut_from`` on, going round its end, with the white space between."""
    pieces = F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    first = F.slice(pieces, (cut_from + 1).cast("int"), cut_words.cast("int"))
    round_end = F.slice(pieces, F.lit(1), F.greatest(F.lit(0), (cut_words - F.size(first)).cast("int")))
    whole = F.array_join(first, "")
    return F.when(F.size(round_end) > 0, F.concat(whole, F.lit(" "), F.array_join(round_end, ""))).otherwise(whole)


def apply_mix(
    docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), cap: int = 2, block_words: int = 8,
    shard_words: int = 1 << 20, seed: int = 7,
) -> DataFrame:
    """The mixed documents: a row of ``docs`` for each whole copy and one for the part of a document that was cut.

    All columns come back as they were, whatever their names, but for text, and n_chars where there is one, of parts.
    """
    d = _mixed(docs, weights, share, cap, block_words, shard_words, seed, docs.columns)
    part = F.when(F.col("cut_words") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))
    d = d.withColumn("_cut", F.explode(F.concat(F.array_repeat(F.lit(False), F.col("full").cast("int")), part)))
    d = d.withColumn("text", F.when(F.col("_cut"), cut_text(F.col("text"), F.col("cut_from"), F.col("cut_words"))).otherwise(F.col("text")))
    out = unpacked(docs.columns, ("doc_id", "text", "source"))
    if "n_chars" in docs.columns:
        n = F.when(F.col("_cut"), F.length("text")).otherwise(F.col(f"{ROW}.n_chars"))
        out[docs.columns.index("n_chars")] = n.cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return d.select(*out)

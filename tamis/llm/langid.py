"""Language identification by prediction by partial matching (PPM).

One byte model per language: a tree of contexts of 0 to ``order`` bytes with the counts of what followed them,
escape probabilities by method C and exclusion of the symbols that a longer context has already offered. The
statistics are frozen after training, so the code length of a byte depends on its ``order`` predecessors only.
That makes the trees of all languages one automaton: a state for each context seen in any language, a table of
transitions, and a table of code lengths (bits) by state, byte and language. A text of any length is scored by a
few table look-ups per byte; its language is the one with the shortest code.

Texts are read as UTF-8 bytes after folding: ASCII letters to lower case, every other ASCII byte to a space, so
that digits, mark-up and layout weigh nothing. Bytes never seen in training share a single symbol, which costs
what PPM charges below order 0; that is exact, as such bytes are in no context either.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamis.llm.common import ROW, packed, small_batches, unpacked

UNDETERMINED = "und"
#: Bytes of all texts that are scored in one go.
SLICE_BYTES = 1 << 19


def _fold_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        t[b] = ord(c.lower()) if c.isalpha() else 32
    return t


FOLD = _fold_table()


@dataclass
class PpmModel:
    langs: list[str]
    order: int
    symbols: np.ndarray  # uint8[256]: byte -> symbol, the last symbol being all unseen bytes
    step: np.ndarray  # int32[states * symbols]: the state after a symbol
    bits: np.ndarray  # float32[states * symbols, langs]

    @property
    def n_symbols(self) -> int:
        return int(self.symbols.max()) + 1

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """float64[texts, langs]: bits that each language's model needs for each whole text."""
        out = np.zeros((len(texts), len(self.langs)))
        batch, size, first = [], 0, 0
        for i, t in enumerate(texts):
            raw = t.encode("utf-8", "surrogatepass")
            if batch and size + len(raw) > SLICE_BYTES:
                out[first:i] = self._score(batch)
                batch, size, first = [], 0, i
            batch.append(raw)
            size += len(raw)
        if batch:
            out[first:] = self._score(batch)
        return out

    def _score(self, raws: list[bytes]) -> np.ndarray:
        # `order` spaces before each text: no context reaches into the text before it
        k, pad = self.order, b" " * self.order
        data = FOLD[np.frombuffer(pad + pad.join(raws), dtype=np.uint8)]
        lengths = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        starts = np.cumsum(lengths + k) - lengths
        sums = np.zeros((len(raws), len(self.langs)))
        s, n = self.symbols[data].astype(np.int32), self.n_symbols
        for lo in range(0, len(s) - k, SLICE_BYTES):  # one very long text also goes in slices
            hi = min(len(s), lo + SLICE_BYTES + k)
            state = np.zeros(hi - lo - k, dtype=np.int32)
            for j in range(k):
                state = self.step[state * n + s[lo + j : hi - k + j]]
            cost = self.bits[state * n + s[lo + k : hi]]
            a, b = np.clip(starts - lo - k, 0, len(cost)), np.clip(starts + lengths - lo - k, 0, len(cost))
            has = np.flatnonzero(b > a)
            if has.size:
                # the gaps between texts fall to the odd places of reduceat and are dropped
                edges = np.stack([a[has], b[has]], 1).ravel()
                whole = np.vstack([cost, np.zeros((1, cost.shape[1]), cost.dtype)])
                sums[has] += np.add.reduceat(whole, edges, axis=0, dtype=np.float64)[::2]
        return sums


def train(samples: dict[str, list[str]], order: int = 4, min_count: int = 2) -> PpmModel:
    """The frozen model of some texts by language. Contexts seen fewer than ``min_count`` times in all are left out."""
    langs = sorted(samples)
    pad = b" " * order
    data = {l: FOLD[np.frombuffer(pad + pad.join(t.encode("utf-8", "surrogatepass") for t in samples[l]), dtype=np.uint8)] for l in langs}
    seen = np.unique(np.concatenate([np.array([32], np.uint8), *data.values()]))
    symbols = np.full(256, len(seen), dtype=np.uint8)
    symbols[seen] = np.arange(len(seen))
    n = len(seen) + 1
    # contexts of each length as numbers to base n, kept if often enough; a kept context's suffix and prefix are kept
    own = {l: symbols[data[l]].astype(np.int64) for l in langs}
    kept: list[np.ndarray] = [np.zeros(1, np.int64)]
    for k in range(1, order + 1):
        codes = np.concatenate([_grams(own[l], k, order, n) for l in langs])
        u, c = np.unique(codes, return_counts=True)
        u = u[c >= min_count]
        u = u[np.isin(u // n, kept[k - 1]) & np.isin(u % n ** (k - 1), kept[k - 1])]
        kept.append(u)
    first = np.cumsum([0, *(len(u) for u in kept)])
    total = int(first[-1])

    def state_of(code: np.ndarray, k: int) -> np.ndarray:
        """The state of the longest kept suffix of contexts of length k."""
        out = np.zeros(len(code), np.int32)
        for j in range(1, k + 1):
            c = code % n**j
            at = np.searchsorted(kept[j], c)
            hit = at < len(kept[j])
            hit[hit] = kept[j][at[hit]] == c[hit]
            out = np.where(hit, first[j] + at, out).astype(np.int32)
        return out

    step = np.zeros((total, n), np.int32)
    every = np.arange(n, dtype=np.int64)
    parent = [np.zeros(1, np.int32)]
    for k in range(order + 1):
        code = (kept[k][:, None] * n + every).ravel()
        step[first[k] : first[k + 1]] = state_of(code % n ** min(order, k + 1), min(order, k + 1)).reshape(-1, n)
        if k:
            parent.append(state_of(kept[k] % n ** (k - 1), k - 1))
    bits = np.zeros((total, n, len(langs)), np.float32)
    for x, l in enumerate(langs):
        counts = []
        for k in range(order + 1):
            codes, follow = _grams(own[l], k, order, n), own[l][order:]
            at = np.searchsorted(kept[k], codes)
            ok = at < len(kept[k])
            ok[ok] = kept[k][at[ok]] == codes[ok]
            counts.append(np.bincount(at[ok] * n + follow[ok], minlength=len(kept[k]) * n).reshape(len(kept[k]), n).astype(np.float64))
        for k in range(order + 1):
            bits[first[k] : first[k + 1], :, x] = -np.log2(_chain(counts, parent, first, k, n))
    return PpmModel(langs, order, symbols, step.ravel(), np.ascontiguousarray(bits.reshape(total * n, len(langs))))


def _grams(s: np.ndarray, k: int, order: int, n: int) -> np.ndarray:
    """The contexts of length k before each position from ``order`` on, as numbers to base n."""
    out = np.zeros(len(s) - order, np.int64)
    for j in range(k, 0, -1):
        out = out * n + s[order - j : len(s) - j]
    return out


def _chain(counts: list[np.ndarray], parent: list[np.ndarray], first: np.ndarray, k: int, n: int) -> np.ndarray:
    """float64[states of length k, symbols]: PPM probabilities, from the longest context down, with exclusion."""
    rows = np.arange(len(counts[k]))
    p = np.zeros((len(rows), n))
    left = np.ones((len(rows), 1))  # probability that escapes have left
    gone = np.zeros((len(rows), n), bool)  # symbols that longer contexts have offered
    at, j = rows, k
    while True:
        c = np.where(gone, 0.0, counts[j][at])
        new = c > 0
        total, kinds = c.sum(1, keepdims=True), new.sum(1, keepdims=True)
        whole = np.where(kinds > 0, total + kinds, 1.0)
        p += np.where(new, left * c / whole, 0.0)
        left = np.where(kinds > 0, left * kinds / whole, left)
        gone |= new
        if j == 0:
            break
        up = parent[j][at]  # a state: its length is found from where it lies
        j -= 1
        at = up - first[j]
    rest = 256 - gone.sum(1, keepdims=True)  # all other byte values, alike
    return np.where(gone, p, left / rest)



def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id, as text, leaves 1 when divided by 3. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, rows_per_lang: int, seed: int) -> dict[str, list[str]]:
    """Up to ``rows_per_lang`` whole texts of each language, taken by a hash of the id: a bounded sample.

    One pass counts the rows by language, the next keeps a hash range of about the rows wanted, so the rows
    that are ranked and collected are bounded by ``rows_per_lang`` whatever the size of the table.
    """
    labelled = docs.where("lang is not null and text is not null")
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.length("text"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for l, n in sizes.items() for x in (l, min(1.0, 1.5 * rows_per_lang / n + 32 / n))])
    near = labelled.select("lang", "text", key.alias("key")).where((F.pmod("key", F.lit(1 << 30)) / (1 << 30)) < share[F.col("lang")])
    top = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("rank") <= rows_per_lang)
    samples: dict[str, list[str]] = {}
    for r in top.orderBy("lang", "key", "text").collect():
        samples.setdefault(r["lang"], []).append(r["text"])
    return samples


RESULT = ("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


def identify(docs: DataFrame, *, rows_per_lang: int = 400, order: int = 4, seed: int = 20_240, keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits_per_byte`` and the columns named in ``keep`` for each row of ``docs``.

    Trained on whole texts of rows with a language whose id is not held out, at most ``rows_per_lang`` each, so the
    model, which is broadcast, is bounded by ``rows_per_lang``, the languages and the texts' lengths, not by the rows.
    ``score`` is the posterior probability of the language under equal priors; ``bits_per_byte`` the code length of
    the best language.

    Null or letterless texts are ``und`` with score 0, as are all where nothing can be learnt from (an empty table,
    no languages). Empty texts are letterless. Ties go to the language that comes first by code point. Repeated rows
    are predicted alike. A null id is not held out, and learnt from. Columns other than doc_id, text, lang and ``keep``
    are ignored, whatever their names; a kept column with the name of a result is returned as ``kept_<name>``.
    """
    own = ("doc_id", "text", "lang")
    keep = [c for c in keep if c != "doc_id"]
    return identified(docs, rows_per_lang, order, seed, keep).select(
        "doc_id", "held_out", "lang_pred", "score", "bits_per_byte", *unpacked(keep, own, RESULT)
    )


def identified(docs: DataFrame, rows_per_lang: int, order: int, seed: int, keep: Sequence[str] | None) -> DataFrame:
    """The same with doc_id, text, lang and the columns to keep (None: all) as they were, those packed."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = packed(docs, ("doc_id", "text", "lang"), keep)
    samples = training_sample(docs.where(~held_out(F.col("doc_id"))), rows_per_lang, seed)
    model = spark.sparkContext.broadcast(train(samples, order) if samples else None)
    undetermined = F.col("text").isNull() | ~F.col("text").rlike(r"\p{L}")

    @F.pandas_udf("lang string, score double, bits double")
    def score(texts: pd.Series) -> pd.DataFrame:
        if model.value is None:
            return pd.DataFrame({"lang": [UNDETERMINED] * len(texts), "score": 0.0, "bits": 0.0})
        bits = model.value.code_lengths(texts.tolist())
        best = bits.argmin(1)
        least = bits[np.arange(len(bits)), best]
        posterior = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(1)
        size = np.fromiter((max(1, len(t.encode("utf-8", "surrogatepass"))) for t in texts), np.float64, len(texts))
        return pd.DataFrame({"lang": np.array(model.value.langs, dtype=object)[best], "score": posterior, "bits": least / size})

    found = docs.withColumn("_found", F.when(~undetermined, score(F.coalesce("text", F.lit("")))))
    return found.select(
        "doc_id", "text", "lang", ROW,
        held_out(F.col("doc_id")).alias("held_out"),
        F.coalesce("_found.lang", F.lit(UNDETERMINED)).alias("lang_pred"),
        F.coalesce("_found.score", F.lit(0.0)).alias("score"),
        F.coalesce("_found.bits", F.lit(0.0)).alias("bits_per_byte"),
    )


#: Bits per byte beyond which the shortest code shows that a text is in none of the languages. Text in a learnt language takes
#: 2 to 3, rarely over 4; bytes as they are take 8.
MOST_BITS = 6.0
#: Bytes of a text from which on that is told: a key or number alone makes the code of a shorter one long.
LEAST_BYTES = 100


def select_identified(
    docs: DataFrame, *, least_score: float = 0.5, most_bits: float = MOST_BITS, least_bytes: int = LEAST_BYTES, rows_per_lang: int = 400, order: int = 4, seed: int = 20_240
) -> DataFrame:
    """The rows of ``docs``, as they are, whose language is determined, with a score of ``least_score`` or more.

    The score compares the learnt languages with each other; texts of ``least_bytes`` or more that take over
    ``most_bits`` per byte are in none of them and go as well.
    """
    found = identified(docs, rows_per_lang, order, seed, None)
    found = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score) & ((F.col("bits_per_byte") <= most_bits) | (F.octet_length("text") < least_bytes)))
    return found.select(*unpacked(docs.columns, ("doc_id", "text", "lang")))

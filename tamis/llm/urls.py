"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the URLs no rule decides.

The trees (depth 3, logistic loss, second-order gains over quantile bins) are trained on labelled URLs, a bounded sample
of them, from features of the characters alone: lengths, depth, digit and letter ratios, entropy, parameter counts, and
statistics of the host's suffix over the whole table. The trained trees become one SQL expression, so URLs are scored
without leaving the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import cut, join_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits; of equally long ones the one listed first. Null if none fits."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        own = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, own) if out is None else out.when(fits, own)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def _entropy(text: Column) -> Column:
    """Bits per character of a string of ASCII letters, digits and marks (others count as one)."""
    alphabet = LOWER + "0123456789-._~%/"
    plain = F.regexp_replace(F.lower(text), f"[^{LOWER}0-9_~%/.-]", "~")
    n = F.length(plain)
    counts = F.array(*[n - F.length(F.replace(plain, F.lit(c), F.lit(""))) for c in alphabet])
    return F.when(n > 0, F.aggregate(counts, F.lit(0.0), lambda a, c: a - F.when(c > 0, c / n * F.log2(c / n)).otherwise(0.0))).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of a URL's characters, by name."""
    u = F.coalesce(url, F.lit(""))
    count = lambda text, pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    query = F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1)
    ratio = lambda a, text: a / F.greatest(F.length(text), F.lit(1))
    last = F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)
    return {
        "length": F.length(u), "host_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query),
        "labels": count(host, r"[.]") + F.when(host != "", 1).otherwise(0), "longest_label": F.array_max(F.transform(F.split(host, "[.]"), F.length)),
        "depth": count(path, "/"), "longest_segment": F.array_max(F.transform(F.split(path, "/"), F.length)), "last_length": F.length(last),
        "digit_ratio": ratio(count(u, "[0-9]"), u), "host_digit_ratio": ratio(count(host, "[0-9]"), host), "path_digit_ratio": ratio(count(path, "[0-9]"), path),
        "hyphens": count(u, "-"), "marks": count(u, "[_~%+,;!$&'()*@]"), "upper_ratio": ratio(count(u, "[A-Z]"), u),
        "params": F.when(query == "", 0).otherwise(count(query, "&") + 1), "fragment": F.when(u.contains("#"), 1).otherwise(0), "secure": F.when(u.startswith("https"), 1).otherwise(0),
        "extension": F.when(last.rlike(r"[.][A-Za-z0-9]{1,5}$"), 1).otherwise(0), "is_address": F.when(host.rlike(r"^[0-9.]+(:[0-9]+)?$"), 1).otherwise(0),
        "host_entropy": _entropy(host), "path_entropy": _entropy(path), "vowel_ratio": ratio(count(path, "[aeiouAEIOU]"), path), "first_segment_length": F.length(F.regexp_extract(path, "^/([^/]*)", 1)),
    }


def suffix_of(host: Column) -> Column:
    """The last label of a host, without a port."""
    plain = F.regexp_replace(host, ":[0-9]*+$", "")
    return F.substring_index(F.substring_index(plain, ":", -1), ".", -1)


#: Suffixes (about 40 bytes each) up to which their statistics are broadcast whole; of more, only the frequent ones are.
BROADCAST_SUFFIXES = 50_000


# -- boosted trees


@dataclass
class Trees:
    features: list[str]
    base: float
    trees: list[dict]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += np.array([_walk(t, row) for row in x]) if len(x) else 0.0
        return out

    def column(self, of: dict[str, Column]) -> Column:
        """The log-odds as a sum of nested conditions."""
        out = F.lit(self.base)
        for t in self.trees:
            out = out + self._node(t, of)
        return out

    def _node(self, t: dict, of: dict[str, Column]) -> Column:
        if "value" in t:
            return F.lit(t["value"])
        return F.when(of[self.features[t["feature"]]] <= t["at"], self._node(t["left"], of)).otherwise(self._node(t["right"], of))


def _walk(t: dict, row: np.ndarray) -> float:
    while "value" not in t:
        t = t["left"] if row[t["feature"]] <= t["at"] else t["right"]
    return t["value"]


def train(x: np.ndarray, y: np.ndarray, features: list[str], *, trees: int = 30, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0, least: float = 1.0) -> Trees:
    """Boosted trees of labels 0 and 1 over rows of features: exact sums of gradients by quantile bins."""
    p = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    model = Trees(features, math.log(p / (1 - p)), [])
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], 1)
    margin = np.full(len(y), model.base)

    def grow(rows: np.ndarray, level: int, g: np.ndarray, h: np.ndarray) -> dict:
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, 0)
        if level < depth:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))[:-1]
                gain = gl**2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs**2 / (hs + penalty)
                gain[(hl < least) | (hs - hl < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        if best[1] < 0:
            value = float(-rate * gs / (hs + penalty))
            margin[rows] += value
            return {"value": value}
        _, f, k = best
        left = binned[rows, f] <= k
        return {"feature": f, "at": float(cuts[f][k]), "left": grow(rows[left], level + 1, g, h), "right": grow(rows[~left], level + 1, g, h)}

    every = np.arange(len(y))
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        model.trees.append(grow(every, 0, q - y, q * (1 - q)))
    return model


def judge(pages: DataFrame, rules: Sequence[Rule], *, label: Column | None = None, rows_to_learn: int = 20_000, threshold: float = 0.5, seed: int = 3, key: str = "page_id") -> DataFrame:
    """``key, host, path, rule, verdict, score`` for each row's ``url``: the rule's verdict, else the trees'.

    ``label`` (1: block, 0: allow, null: unlabelled) names the labelled URLs; without it they are those that a rule
    decides, with its verdict. At most ``rows_to_learn`` of them, those of the least hashes of URL and key, are collected
    and learnt from: a bounded sample. Suffix statistics (how many rows of the table, and what share of its labelled ones is
    blocked) are counted over all rows. They are broadcast up to BROADCAST_SUFFIXES, so that rows are scored where they
    are read; of more suffixes, the frequent ones are broadcast and the others joined by a shuffle.

    Null URLs and those without ``://`` have an empty host and path, fit no rule, and are scored like others. Where
    nothing is labelled, the trees allow. Repeated rows and ties are judged alike. Other columns are ignored, whatever
    their names. An empty table gives an empty result.
    """
    url, by_label = F.col("url"), label is not None
    label = F.lit(None) if label is None else label
    d = pages.select(F.col(key).alias("_key"), url, label.cast("int").alias("_given")).withColumns({"_host": host_of(url), "_path": path_of(url)})
    d = d.withColumns({"_match": matched(F.col("_host"), F.col("_path"), rules), "_suffix": suffix_of(F.col("_host"))})
    by_rule = F.when(F.col("_match.verdict") == "block", 1).when(F.col("_match.verdict") == "allow", 0)
    d = d.withColumn("_label", F.col("_given") if by_label else by_rule)
    stats = d.groupBy("_suffix").agg(F.count("*").alias("_rows"), F.count("_label").alias("_seen"), F.sum("_label").alias("_blocked"))
    stats = cut(stats)
    whole = stats.agg(F.sum("_seen").alias("seen"), F.sum("_blocked").alias("blocked"), F.sum("_rows").alias("rows"), F.count("*").alias("suffixes")).first()
    seen, rate = whole.seen or 0, (whole.blocked or 0) / max(1, whole.seen or 0)
    stats = stats.select("_suffix", "_rows", F.log2(1 + F.col("_rows")).alias("suffix_rows"), ((F.coalesce("_blocked", F.lit(0)) + 8 * rate) / (F.col("_seen") + 8)).alias("suffix_rate"))
    d = d.join(F.broadcast(stats.drop("_rows")), "_suffix") if whole.suffixes <= BROADCAST_SUFFIXES else join_table(d, stats, "_suffix", "_rows", whole.rows)
    of = {**lexical(url, F.col("_host"), F.col("_path")), "suffix_rows": F.col("suffix_rows"), "suffix_rate": F.col("suffix_rate"), "suffix_length": F.length("_suffix")}
    names = list(of)
    share = min(1.0, 1.2 * rows_to_learn / max(1, seen))
    draw = F.pmod(F.xxhash64(F.lit(seed), url, F.col("_key").cast("string")), F.lit(1 << 30)) / (1 << 30)
    sample = d.where(F.col("_label").isNotNull() & (draw < share)).select(draw.alias("_draw"), F.col("_label").alias("y"), *[of[n].cast("double").alias(n) for n in names])
    sample = sample.orderBy("_draw", "y", *names).limit(rows_to_learn).toPandas().sort_values(["y", *names], kind="stable")
    model = train(sample[names].to_numpy(np.float64), sample["y"].to_numpy(np.float64), names) if seen else Trees(names, -10.0, [])
    score = 1 / (1 + F.exp(-F.col("_margin")))
    d = d.select("_key", "_host", "_path", "_match", *[of[n].cast("double").alias(f"_f_{n}") for n in names])
    d = d.withColumn("_margin", model.column({n: F.col(f"_f_{n}") for n in names}))
    verdict = F.coalesce("_match.verdict", F.when(score >= threshold, "block").otherwise("allow"))
    return d.select(F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_match.rule").alias("rule"), verdict.alias("verdict"), score.alias("score"))

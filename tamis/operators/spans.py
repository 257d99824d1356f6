"""Span detectors and what is done with spans, as column expressions over arrays of ``SPAN``.

Everything is local to a row, so a scan with any of these operators is one stage without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions.rules import PRIORITY, REGEX_RULES, SEVERITY, SEVERITY_RANK, Rule
from tamis.functions.text import LINE_BREAK, is_blank, is_html, strip
from tamis.functions.validators import CHECKS

SPAN = "struct<start:int,end:int,pii_type:string,text:string,score:double,source:string,priority:int,ord:int>"
SPANS = f"array<{SPAN}>"


def empty() -> Column:
    return F.array().cast(SPANS)


#: Items that a fold works on at a time.
BLOCK = 256


def named(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _scanned(items: Column, state: Column, state_type: str, step: Callable, row: Callable, row_type: str, around: Callable | None = None) -> Column:
    """``row(state, item, c)`` for each item in order, the state going on by ``step(state, item)``.

    An accumulated list is copied by each step, so one fold over all items would cost the square of their number. Here
    a first fold finds the states at which blocks of items begin, a second the rows of each block. ``c`` is
    ``around(state, block)``, evaluated once for a block.
    """
    rows_of = lambda block, s, c: F.aggregate(
        block, F.struct(s.alias("s"), F.array().cast(f"array<{row_type}>").alias("rows")), lambda acc, x: F.struct(step(acc["s"], x).alias("s"), F.concat(acc["rows"], F.array(row(acc["s"], x, c).cast(row_type))).alias("rows")), lambda acc: acc["rows"]
    )
    of_block = lambda block, s: rows_of(block, s, None) if around is None else named(around(s, block), lambda c: rows_of(block, s, c))

    def over(blocks: Column) -> Column:
        start = F.struct(state.cast(state_type).alias("s"), F.array().cast(f"array<{state_type}>").alias("all"))
        states = F.aggregate(blocks, start, lambda acc, b: F.struct(F.aggregate(b, acc["s"], step).alias("s"), F.concat(acc["all"], F.array(acc["s"])).alias("all")), lambda acc: acc["all"])
        return F.flatten(F.zip_with(blocks, states, of_block))

    def whole(own: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int")), lambda b: F.slice(own, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(own) == 0, F.array().cast(f"array<{row_type}>")).when(F.size(own) <= BLOCK, of_block(own, state.cast(state_type))).otherwise(named(blocks, over))

    return named(items, whole)


def _hit(text: Column, rule: Rule, ord_: int) -> Column:
    """A rule's matches and the pieces between them; null in texts without a match, which cost one search."""
    pattern = "(?U)" + rule.pattern
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    own = {"pii_type": rule.pii_type, "score": rule.score, "source": rule.source, "priority": PRIORITY[rule.priority], "ord": ord_, "check": rule.check or ""}
    return F.when(text.rlike(pattern), F.struct(found.alias("found"), between.alias("between"), *[F.lit(v).alias(k) for k, v in own.items()]))


def _hit_spans(hit: Column, checks: Sequence[str]) -> Column:
    """The spans of a rule's matches, with offsets folded from the pieces between them, and its check passed."""

    def span(at: Column, p: Column, _) -> Column:
        first = at + F.length(p["b"])
        return F.struct(first.alias("start"), (first + F.length(p["m"])).alias("end"), hit["pii_type"], p["m"].alias("text"), hit["score"], hit["source"], hit["priority"], hit["ord"])

    pairs = F.filter(F.zip_with(hit["between"], hit["found"], lambda b, m: F.struct(b.alias("b"), m.alias("m"))), lambda p: p["m"].isNotNull())
    spans = _scanned(pairs, F.lit(0), "int", lambda at, p: at + F.length(p["b"]) + F.length(p["m"]), span, SPAN)
    right = lambda s: reduce(lambda w, c: w.when(hit["check"] == c, CHECKS[c](s["text"])), checks, F).otherwise(True)
    return F.filter(spans, right) if checks else spans


def _chosen(keyed: Column, state_type: str, clash: Callable, kept: Callable) -> Column:
    """The spans ``s`` of a sorted list that don't clash with the state that those kept before have left."""
    step = lambda state, k: F.when(clash(state, k), state).otherwise(kept(state, k))
    rows = _scanned(keyed, F.lit(None), state_type, step, lambda state, k, _: F.when(~clash(state, k), k["s"]), SPAN)
    return by_start(F.filter(rows, lambda s: s.isNotNull()))


def resolve_by_priority(spans: Column) -> Column:
    """Greedy choice by priority, then score, then order of detection; overlapping later ones go. By start.

    Spans fall apart into runs that overlap one after another, and each is compared with what is kept of its run only.
    """

    def chosen(own: Column) -> Column:
        new = lambda state, s: F.coalesce(s["start"] >= state["reach"], F.lit(True))
        number = lambda state, s: F.coalesce(state["n"], F.lit(0)) + F.when(new(state, s), 1).otherwise(0)
        step = lambda state, s: F.struct(F.greatest(F.coalesce(state["reach"], s["end"]), s["end"]).alias("reach"), number(state, s).alias("n"))
        runs = _scanned(by_start(own), F.lit(None), "struct<reach:int,n:int>", step, lambda state, s, _: F.struct(number(state, s).alias("n"), s.alias("s")), f"struct<n:int,s:{SPAN}>")
        keyed = F.array_sort(F.transform(runs, lambda r: F.struct(r["n"].alias("n"), (-r["s"]["priority"]).alias("p"), (-r["s"]["score"]).alias("c"), r["s"]["ord"].alias("o"), r["s"]["start"].alias("b"), r["s"].alias("s"))))
        same = lambda state, k: F.coalesce(state["n"] == k["n"], F.lit(False))
        clash = lambda state, k: same(state, k) & F.exists(state["kept"], lambda a: (a["start"] < k["s"]["end"]) & (k["s"]["start"] < a["end"]))
        place = lambda k: F.array(F.struct(k["s"]["start"].alias("start"), k["s"]["end"].alias("end")))
        kept = lambda state, k: F.struct(k["n"].alias("n"), F.when(same(state, k), F.concat(state["kept"], place(k))).otherwise(place(k)).alias("kept"))
        return _chosen(keyed, "struct<n:int,kept:array<struct<start:int,end:int>>>", clash, kept)

    return named(spans, lambda own: F.when(F.size(own) < 2, own).otherwise(chosen(own)))


def by_start(spans: Column) -> Column:
    return F.array_sort(spans)


def detect(text: Column, rules: Sequence[Rule] = REGEX_RULES, threshold: float | None = None, resolve: bool = True) -> Column:
    """Spans of all rules whose score reaches the threshold (null or 0: 0.5), validated, overlaps resolved, by start."""
    least = threshold or 0.5
    used = [(i, r) for i, r in enumerate(rules) if r.score >= least]
    if not used:
        return F.when(text.isNotNull(), empty())
    hits = F.filter(F.array(*[_hit(F.coalesce(text, F.lit("")), r, i) for i, r in used]), lambda h: h.isNotNull())
    checks = sorted({r.check for _, r in used if r.check in CHECKS})  # an unknown check keeps
    every = F.flatten(F.transform(hits, lambda h: _hit_spans(h, checks)))
    return resolve_by_priority(every) if resolve else by_start(every)


def merge_exact(spans: Column) -> Column:
    """One span for each (start, end, type, text): the best score, of equals the first."""
    keyed = lambda own: F.array_sort(F.transform(own, lambda s, i: F.struct(s["start"], s["end"], s["pii_type"], s["text"], (-s["score"]).alias("c"), i.alias("i"), s.alias("s"))))
    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & a["pii_type"].eqNullSafe(b["pii_type"]) & a["text"].eqNullSafe(b["text"])
    firsts = lambda k: F.transform(F.filter(k, lambda x, i: (i == 0) | ~same(F.get(k, i - 1), x)), lambda x: x["s"])
    return named(spans, lambda own: F.when(F.size(own) < 2, own).otherwise(named(keyed(own), firsts)))


def resolve_by_type(spans: Column) -> Column:
    """Within a type: by start, longest, best score; a span that meets a kept one of its type goes."""

    def chosen(own: Column) -> Column:
        keyed = F.array_sort(F.transform(own, lambda s, i: F.struct(s["pii_type"].alias("t"), s["start"].alias("b"), (-s["end"]).alias("e"), (-s["score"]).alias("c"), i.alias("i"), s.alias("s"))))
        clash = lambda state, k: F.coalesce(state["t"].eqNullSafe(k["t"]) & (k["b"] < state["reach"]), F.lit(False))
        return _chosen(keyed, "struct<t:string,reach:int>", clash, lambda _, k: F.struct(k["t"].alias("t"), (-k["e"]).alias("reach")))

    return named(spans, lambda own: F.when(F.size(own) < 2, own).otherwise(chosen(own)))


def merge(*detected: Column) -> Column:
    """The spans of several detectors as one list: exact duplicates, then overlaps within a type, resolved."""
    normal = F.transform(F.concat(*[F.coalesce(d, empty()) for d in detected]), lambda s: s.withField("pii_type", normal_type(s["pii_type"])))
    return resolve_by_type(merge_exact(normal))


def detect_all(text: Column, detectors: Mapping[str, Callable[[Column], Column]], enabled: Sequence[str] | None = None) -> Column:
    """``struct<spans, stats>``: the merged spans of the enabled detectors and, by detector that ran, how many spans it found.

    A detector that fails on a text, by giving null, finds nothing there and the others go on; null and empty texts are
    asked of none.
    """
    used = {n: d for n, d in detectors.items() if enabled is None or n in enabled}
    if not used:
        return F.struct(empty().alias("spans"), F.create_map().cast("map<string,int>").alias("stats"))
    found = F.struct(*[F.coalesce(d(text), empty()).alias(n) for n, d in used.items()])
    stats = lambda f: F.create_map(*[x for n in used for x in (F.lit(n), F.size(f[n]))])
    ran = named(found, lambda f: F.struct(merge(*[f[n] for n in used]).alias("spans"), stats(f).alias("stats")))
    nothing = F.struct(empty().alias("spans"), F.map_from_arrays(F.array(*map(F.lit, used)), F.array(*[F.lit(0)] * len(used))).alias("stats"))
    return F.when(F.coalesce(text, F.lit("")) != "", ran).otherwise(nothing)


def normal_type(pii_type: Column) -> Column:
    """Upper case with underscores; UNKNOWN for null or empty."""
    return F.when(F.coalesce(pii_type, F.lit("")) == "", "UNKNOWN").otherwise(F.upper(F.translate(pii_type, " -", "__")))


def token(pii_type: Column) -> Column:
    """``[TYPE]``; ``[UNKNOWN]`` for null, blank or the word null."""
    blank = is_blank(pii_type) | (F.lower(pii_type) == "null")
    return F.concat(F.lit("["), F.when(blank, "UNKNOWN").otherwise(pii_type), F.lit("]"))


def _replaced(text: Column, spans: Column, step: Callable, shown: Callable) -> Column:
    """A text with pieces of it, in place of spans by start; ``step(at, span)`` is where the text goes on, ``shown(at, span, cut)`` what stands there.

    ``cut(a, b)`` is the text between two places. It is taken from the part of the text that a block of spans spans, as
    finding a place in a text means reading it up to there.
    """

    def around(at: Column, block: Column) -> Column:
        base = F.greatest(F.least(at, F.get(block, F.lit(0))["start"]), F.lit(0))
        until = F.greatest(F.get(block, F.size(block) - 1)["start"], base)
        return F.struct(base.alias("base"), F.substr(text, base + 1, until - base).alias("text"))

    row = lambda at, p, c: shown(at, p, lambda a, b: F.substr(c["text"], a - c["base"] + 1, b - a))

    def whole(own: Column) -> Column:
        rows = _scanned(own, F.lit(0), "int", step, row, "string", around)
        return F.concat(F.array_join(F.filter(rows, lambda r: r.isNotNull()), ""), F.substr(text, F.aggregate(own, F.lit(0), step) + 1))

    return named(spans, lambda own: F.when(F.size(own) == 0, text).otherwise(whole(own)))


def mask(text: Column, spans: Column) -> Column:
    """Spans replaced by their tokens from the left; one that starts before the last end is skipped."""
    step = lambda at, p: F.when(p["start"] < at, at).otherwise(p["end"])
    return _replaced(text, by_start(spans), step, lambda at, p, cut: F.when(p["start"] >= at, F.concat(cut(at, p["start"]), token(p["pii_type"]))))


NOTICE = "[Content too large for masking]"


def service_mask(text: Column, spans: Column, longest: int = 10_000) -> Column:
    """The mask of texts up to ``longest`` characters, else a notice."""
    return F.when(F.length(text) <= longest, mask(text, spans)).otherwise(F.lit(NOTICE))


def masked_content(text: Column, spans: Column, longest: int) -> Column:
    """Overlapping spans give a token each, and a shorter end moves back; cut to ``longest`` characters with an ellipsis."""
    n = F.length(text)
    inside = lambda v, low: F.least(F.greatest(v, low), n)
    placed = F.transform(by_start(spans), lambda s: s.withField("start", inside(s["start"], F.lit(0))).withField("end", inside(s["end"], inside(s["start"], F.lit(0)))))
    shown = lambda at, p, cut: F.concat(F.when(p["start"] > at, cut(at, p["start"])).otherwise(""), token(p["pii_type"]))
    whole = _replaced(text, placed, lambda at, p: p["end"], shown)
    return named(whole, lambda w: F.when(F.lit(longest <= 0) | (F.length(w) <= longest), w).otherwise(F.concat(F.substring(w, 1, max(0, longest)), F.lit("…"))))


def line_start(text: Column, position: Column) -> Column:
    """After the last line feed before a position; in a page, after the last block tag if that is later."""
    before = F.substr(text, F.lit(1), F.least(F.greatest(position, F.lit(0)), F.length(text)))
    after_tag = F.regexp_extract(before, rf"(?s)^(?:.*(?:{LINE_BREAK}))?(.*)$", 1)
    return F.length(before) - F.length(F.when(is_html(text), after_tag).otherwise(F.substring_index(before, "\n", -1)))


def line_end(text: Column, position: Column) -> Column:
    """The next line feed at or after a position, or block tag in a page, else the end."""
    safe = F.least(F.greatest(position, F.lit(0)), F.length(text))
    at = F.position(F.lit("\n"), text, safe + 1)
    plain = F.when(at > 0, at - 1).otherwise(F.length(text))
    return F.when(is_html(text), safe + F.length(F.split(F.substr(text, safe + 1), LINE_BREAK, 2)[0])).otherwise(plain)


def sensitive_context(text: Column, span: Column) -> Column:
    """The line of a span."""
    a = line_start(text, span["start"])
    return F.substr(text, a + 1, line_end(text, span["end"]) - a)


def masked_context(text: Column, span: Column, spans: Column) -> Column:
    """The line of a span with it and all others on the line as tokens, and at most three characters after the last."""
    a, b = line_start(text, span["start"]), line_end(text, span["end"])
    n = b - a
    line = F.substr(text, a + 1, n)
    others = F.filter(spans, lambda s: (s["end"] > a) & (s["start"] < b) & ~((s["start"] == span["start"]) & (s["end"] == span["end"])))
    clamp = lambda v, low: F.least(F.greatest(v - a, low), n)
    local = F.transform(F.concat(F.array(span), others), lambda s, i: F.struct(clamp(s["start"], F.lit(0)).alias("s"), i.alias("i"), clamp(s["end"], clamp(s["start"], F.lit(0))).alias("e"), s["pii_type"].alias("t")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, p: F.struct(F.greatest(s["at"], p["e"]).alias("at"), F.concat(s["out"], F.when(p["s"] > s["at"], F.substr(line, s["at"] + 1, p["s"] - s["at"])).otherwise(""), token(p["t"])).alias("out"))
    ended = lambda s: F.concat(s["out"], F.substr(line, s["at"] + 1, F.lit(3)), F.when(n - s["at"] > 3, "…").otherwise(""))
    return F.when(~is_blank(text), F.aggregate(F.array_sort(local), start, step, ended))


def enriched(text: Column, spans: Column) -> Column:
    """Spans with ``masked_context`` and ``sensitive_context`` (fields they have already) filled in; one that has either stays as it is."""
    def fill(s: Column) -> Column:
        new = s.withField("masked_context", masked_context(text, s, spans)).withField("sensitive_context", sensitive_context(text, s))
        return F.when(is_blank(s["masked_context"]) & is_blank(s["sensitive_context"]), new).otherwise(s)

    return F.when(is_blank(text), spans).otherwise(F.transform(spans, fill))


def redact(value: Column) -> Column:
    """A value's first eight digits of SHA-256 and its length."""
    return F.when(F.coalesce(value, F.lit("")) == "", "<empty>").otherwise(F.concat(F.lit("sha256="), F.substring(F.sha2(value, 256), 1, 8), F.lit(", length="), F.length(value)))


def severity(pii_type: Column, configured: dict[str, str] | None = None) -> Column:
    """The severity of a type: a configured one first, then the static rules, else LOW."""
    of = {t: s for s, types in SEVERITY.items() for t in types} | {k.strip().upper(): v for k, v in (configured or {}).items()}
    table = F.create_map(*[F.lit(v) for kv in of.items() for v in kv])
    return F.coalesce(table[F.upper(strip(pii_type))], F.lit("LOW"))


def highest_severity(spans: Column, configured: dict[str, str] | None = None) -> Column:
    """The worst severity of a list of spans; null without spans."""
    rank = lambda s: reduce(lambda w, kv: w.when(severity(s["pii_type"], configured) == kv[0], kv[1]), SEVERITY_RANK.items(), F)
    names = F.array(*map(F.lit, SEVERITY_RANK))
    return F.when(F.size(spans) > 0, F.element_at(names, F.array_min(F.transform(spans, rank)) + 1))


def severity_counts(spans: Column, configured: dict[str, str] | None = None) -> Column:
    """``struct<high, medium, low, total>`` of a list of spans."""
    n = lambda name: F.size(F.filter(spans, lambda s: severity(s["pii_type"], configured) == name)).cast("long")
    return F.struct(n("HIGH").alias("high"), n("MEDIUM").alias("medium"), n("LOW").alias("low"), F.size(spans).cast("long").alias("total"))


def without_sensitive(spans: Column) -> Column:
    """Spans whose values are left out, for streams that go outside."""
    return F.transform(spans, lambda s: s.withField("text", F.lit(None).cast("string")))

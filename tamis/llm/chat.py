"""Chat formatting with typed content parts. DataFrame functions only.

A message is a role and a list of typed parts. A visitor has one rule for each type of part: text is escaped, an image,
an audio clip or a document becomes a placeholder with its number in the conversation, and is recorded as an attachment
with its reference, its place in the formatted text and the tokens that it will expand to. Parts stay in their order.

The template marks turns with control strings. Those, and the escape character, are escaped in texts and roles by an
escape character after their first character (or doubled, for itself), so no text can open or close a turn, and the
texts are read back exactly. ``parse`` does that from the formatted text alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """The strings that mark turns; all of them, and those in ``controls``, are escaped in texts."""

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    placeholder: str = "<|{kind}:{number}|>"
    #: Control strings of templates in use; a text that holds one must not be taken for it. All begin "<|" if not listed.
    controls: tuple[str, ...] = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    #: Roles whose text is learnt.
    learnt: tuple[str, ...] = ("assistant",)


@dataclass(frozen=True)
class Tokens:
    """What an attachment expands to: an image by its patches, audio by time, a document by pages."""

    patch: int = 28
    per_second: float = 12.5
    per_page: int = 512
    least: dict = field(default_factory=lambda: {"image": 1, "audio": 1, "document": 1})


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expanded_tokens(part: Column, tokens: Tokens) -> Column:
    """Tokens that a part's placeholder stands for; null for text."""
    side = lambda c: F.ceil(F.greatest(F.coalesce(part[c], F.lit(0)), F.lit(1)) / tokens.patch)
    by_kind = {
        "image": side("width") * side("height"),
        "audio": F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * tokens.per_second),
        "document": F.coalesce(part["pages"], F.lit(1)) * tokens.per_page,
    }
    rules = [(part["kind"] == k, F.greatest(v, F.lit(tokens.least[k])).cast("long")) for k, v in by_kind.items()]
    return reduce(lambda w, r: w.when(*r), rules[1:], F.when(*rules[0]))


def _visited(parts: Column, template: Template, tokens: Tokens) -> Column:
    """``array<struct<body, kind, ref, tokens>>``: each part by the rule of its type. An attachment's body is null until it has a number."""
    kinds = ("image", "audio", "document")
    return F.transform(
        F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()),
        lambda p: F.struct(
            F.when(~F.coalesce(p["kind"].isin(*kinds), F.lit(False)), escape(F.coalesce(p["text"], F.lit("")), template)).alias("body"),
            F.when(p["kind"].isin(*kinds), p["kind"]).alias("kind"),
            p["ref"].alias("ref"),
            expanded_tokens(p, tokens).alias("tokens"),
        ),
    )


def format_chat(messages: DataFrame, template: Template = Template(), tokens: Tokens = Tokens(), *, block: int = 256) -> DataFrame:
    """``conv_id, turn, role, parts`` -> ``conv_id, n_turns, formatted, attachments, expanded_tokens``.

    ``attachments`` is an array of ``number, kind, ref, offset, tokens``; offsets are code points of ``formatted``.
    Turns stand by turn, null first; those that share a turn by role and parts. Null roles, texts and parts are empty;
    a part of unknown type is its text. Null conversation ids are one conversation. Rows are put together in blocks of
    turns before the blocks are, so a conversation with many rows is spread over tasks until its text is joined. Other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    t = template
    m = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), _visited(F.col("parts"), t, tokens).alias("parts"))
    head = F.concat(F.lit(t.turn), escape(F.col("role"), t), F.lit(t.text))
    m = m.select("conv_id", "turn", "role", head.alias("head"), "parts")
    row = F.struct("turn", "role", "head", "parts")
    m = m.groupBy("conv_id", F.floor(F.col("turn") / block).alias("_block")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    # a block is its literal strings with the attachments between them: n attachments, n + 1 strings
    flat = F.flatten(F.transform("rows", lambda r: F.concat(F.array(_string(r["head"])), r["parts"], F.array(_string(F.lit(t.end))))))
    m = m.select("conv_id", "_block", F.size("rows").cast("long").alias("n"), F.when(F.exists("rows", lambda r: F.exists(r["parts"], lambda p: p["kind"].isNotNull())), flat).alias("items"), _plain("rows", t).alias("plain"))
    whole = m.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("_block", "plain", "items"))).alias("blocks"))
    # without attachments, which is usual, the text is joined at once; else piece by piece, numbering and placing them
    items = F.flatten(F.transform("blocks", lambda b: F.coalesce(b["items"], F.array(_string(b["plain"])))))
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<number:bigint,kind:string,ref:string,offset:bigint,tokens:bigint>>").alias("found"))
    stepped = F.aggregate(items, start, lambda s, p: F.when(p["kind"].isNull(), F.struct(F.concat(s["text"], p["body"]).alias("text"), s["found"].alias("found"))).otherwise(_placed(s, p, t)))
    has = F.exists("blocks", lambda b: b["items"].isNotNull())
    whole = whole.withColumn("_done", F.when(has, stepped).otherwise(F.struct(F.array_join(F.transform("blocks", lambda b: b["plain"]), "").alias("text"), start["found"].alias("found"))))
    total = F.aggregate(F.col("_done.found"), F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return whole.select("conv_id", "n_turns", F.col("_done.text").alias("formatted"), F.col("_done.found").alias("attachments"), total.alias("expanded_tokens"))


def _string(text: Column) -> Column:
    return F.struct(text.alias("body"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens"))


def _plain(rows: str, t: Template) -> Column:
    """The text of a block without attachments."""
    return F.array_join(F.transform(rows, lambda r: F.concat(r["head"], F.array_join(F.transform(r["parts"], lambda p: F.coalesce(p["body"], F.lit(""))), ""), F.lit(t.end))), "")


def _placed(state: Column, part: Column, t: Template) -> Column:
    """The state after an attachment: its placeholder in the text, itself recorded."""
    number = F.size(state["found"]).cast("long") + 1
    name = F.replace(F.replace(F.lit(t.placeholder), F.lit("{kind}"), part["kind"]), F.lit("{number}"), number.cast("string"))
    own = F.struct(number.alias("number"), part["kind"].alias("kind"), part["ref"].alias("ref"), F.length(state["text"]).cast("long").alias("offset"), part["tokens"].alias("tokens"))
    return F.struct(F.concat(state["text"], name).alias("text"), F.concat(state["found"], F.array(own)).alias("found"))


def parse(formatted: Column, template: Template = Template()) -> Column:
    """``array<struct<role, text, learnt>>``: the turns of a formatted text, read back from it alone.

    Placeholders stay in the texts, as they were written.
    """
    t = template
    pieces = F.split(formatted, _literal(t.end))
    bodies = F.filter(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: p.startswith(t.turn))
    split = F.transform(bodies, lambda p: F.split(F.substr(p, F.lit(len(t.turn) + 1)), _literal(t.text), 2))
    turns = F.transform(split, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))
    return F.transform(turns, lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text"), p["role"].isin(*t.learnt).alias("learnt")))


def _literal(s: str) -> str:
    return "\\Q" + s + "\\E"


def loss_spans(formatted: Column, template: Template = Template()) -> Column:
    """``array<struct<start, end>>``: where the texts that are learnt stand in a formatted text (escaped, code points)."""
    t = template
    pieces = F.split(formatted, _literal(t.end))
    bodies = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(s: Column, p: Column) -> Column:
        end = s["at"] + F.length(p)
        first = s["at"] + F.instr(p, t.text) - 1 + len(t.text)
        role = unescape(F.substring_index(F.substr(p, F.lit(len(t.turn) + 1)), t.text, 1))
        own = F.struct(first.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct((end + len(t.end)).cast("long").alias("at"), F.when(role.isin(*t.learnt), F.concat(s["spans"], F.array(own))).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(bodies, start, step, lambda s: s["spans"])


def text_part(text: Column) -> Column:
    """The parts of a message that is a text."""
    none = lambda kind: F.lit(None).cast(kind)
    part = F.struct(F.lit("text").alias("kind"), text.alias("text"), none("string").alias("ref"), none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages"))
    return F.array(part)

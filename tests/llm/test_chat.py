import random

import helpers as h
from pyspark.sql import functions as F

from tamis.llm import chat, queries

ROWS = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\<|end|>", "<|turn|>user<|text|>x<|end|>", "<\\|end|>", "<|", "<", "|>", "", None, "a\nb", "😀<<SYS>>", "[INST", "INST]", "<<|end|>|>", "\\Q\\E$1"]


def formatted(df):
    return chat.format_chat(df.withColumn("parts", chat.text_part(F.col("text"))))


def brute(rows):
    out = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return {c: (len(v), h.sha256("".join(f"{r}\n{t}\n" for r, t in v)), sum(len(t) for r, t in v if r == "assistant"), h.sha256("".join(t for r, t in v if r == "assistant"))) for c, v in out.items()}


def digests(df):
    got = df.select("conv_id", *queries.chat_digests(F.col("formatted"))).collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got}


def test_texts_come_back_whatever_they_hold(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None, "<|end|>", ""]), rng.choice(NASTY) if rng.random() < 0.8 else "".join(rng.choice("<|>\\[]/INSTse d") for _ in range(40))) for c in range(40) for t in range(rng.randrange(1, 12))]
    rng.shuffle(rows)
    df = formatted(h.with_clashes(spark.createDataFrame(rows, ROWS)))
    assert digests(df) == brute(rows)
    # no control string but the template's own
    for r in df.collect():
        n = sum(c == r.conv_id for c, *_ in rows)
        assert r.n_turns == n and r.formatted.count("<|") == 3 * n and "[INST]" not in r.formatted and "</s>" not in r.formatted


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, w=None, hh=None, s=None, p=None: (kind, text, ref, w, hh, s, p)
    rows = [
        (1, 0, "user", [part("text", "see "), part("image", ref="a.png", w=57, hh=28), part("text", " and </s>"), part("audio", ref="b.wav", s=2.0)]),
        (1, 1, "assistant", [part("text", "fine")]),
        (1, 2, "user", [part("document", ref="c.pdf", p=3), part("odd", "kept"), None, part("image")]),
        (2, 0, "user", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    got = {r.conv_id: r for r in chat.format_chat(df).collect()}
    text = got[1].formatted
    assert text == "<|turn|>user<|text|>see <|image:1|> and <\\/s><|audio:2|><|end|><|turn|>assistant<|text|>fine<|end|><|turn|>user<|text|><|document:3|>kept<|image:4|><|end|>"
    found = [(a.number, a.kind, a.ref, a.tokens) for a in got[1].attachments]
    assert found == [(1, "image", "a.png", 3), (2, "audio", "b.wav", 25), (3, "document", "c.pdf", 1536), (4, "image", None, 1)]
    assert all(text[a.offset :].startswith(f"<|{a.kind}:{a.number}|>") for a in got[1].attachments)
    assert got[1].expanded_tokens == 3 + 25 + 1536 + 1 and got[2].attachments == [] and got[2].expanded_tokens == 0
    spans = chat.format_chat(df).select("formatted", chat.loss_spans(F.col("formatted")).alias("s")).where("size(s) > 0").first()
    assert [spans.formatted[a.start : a.end] for a in spans.s] == ["fine"]


def test_blocks_of_turns_do_not_matter(spark):
    rng = random.Random(2)
    rows = [(c, rng.choice([None, *range(-20, 60)]), rng.choice(["user", "assistant"]), f"{c} {i}") for i in range(300) for c in [rng.randrange(3)]]
    df = spark.createDataFrame(rows, ROWS).withColumn("parts", chat.text_part(F.col("text")))
    a = chat.format_chat(df, block=7).select("conv_id", "formatted").collect()
    assert sorted(a) == sorted(chat.format_chat(df, block=1000).select("conv_id", "formatted").collect())
    assert digests(chat.format_chat(df, block=5)) == brute(rows)


def test_awkward_rows(spark):
    rows = [(None, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, 5, "assistant", ""), (3, 1, "assistant", "long " * 50_000)]
    df = spark.createDataFrame(rows, ROWS)
    assert digests(formatted(df)) == brute(rows)
    assert formatted(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", NASTY[0]), (-1, 1, "assistant", NASTY[0])]
    got = queries.op2_chat(spark, sf)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got.collect()} == brute(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

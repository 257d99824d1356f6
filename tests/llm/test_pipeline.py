import re

import corpus_pipeline
import helpers as h
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tamis.llm import mixing, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def near_dedup(spark, rows, parts=4, more=lambda d: d):
    docs = more(spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS).repartition(parts))
    got = corpus_pipeline.minhash_near_dedup(spark, docs, None)
    assert got.columns == docs.columns
    return sorted(((r.doc_id, r.text, r.lang) for r in got.collect()), key=str)


def test_rows_of_an_id_with_different_texts_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a, "en"), (5, b, "en"), (5, b, "de"), (5, None, "en"), (7, b + " more", "en"), (1, c, "en"), (1, c + " more", "en"), (None, a, "en"), (None, a, "en"), (-3, c, "fr")]
    want = sorted([(5, a, "en"), (5, b, "de"), (5, None, "en"), (-3, c, "fr"), (None, a, "en"), (None, a, "en")], key=str)
    for parts in (1, 2, 7):
        assert near_dedup(spark, rows, parts) == want
    # a column that has no order, and names that the stage uses
    more = lambda d: h.with_clashes(d).withColumn("_number", F.create_map(F.lit("k"), "lang"))
    assert near_dedup(spark, rows, more=more) == want


def test_the_smallest_id_stays_where_none_repeats(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a, "en"), (2, a + " more", "en"), (9, b, "en"), (4, None, "en"), (None, a, "en")]
    assert near_dedup(spark, rows) == sorted([(2, a + " more", "en"), (9, b, "en"), (4, None, "en"), (None, a, "en")], key=str)


PROSE = {
    "en": "the morning train was late again and people on the platform looked at the board with some patience because nobody knew when it would come",
    "de": "der morgenzug war schon wieder zu spät und die leute auf dem bahnsteig sahen geduldig auf die tafel weil niemand wusste wann er kommen würde",
}


def corpus(spark):
    """Documents of two languages with copies, secrets and every awkward row."""
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        w = PROSE[lang].split()
        text = " ".join(w[(i * 7 + j * (1 + i % 5)) % len(w)] for j in range(40 + i)) + f" {i}."
        rows.append((i, text, lang, "abc"[i % 3]))
    rows += [(100 + i, rows[i][1] + (" more" if i % 2 else ""), rows[i][2], "copies") for i in range(12)]
    rows += [(200, PROSE["en"] + " client_auth = 'q7Zp2mK9vX4tB8nW' and password: hunter2hunter2 end", "en", None)]
    rows += [(300, None, "en", "a"), (301, "", None, None), (302, " \t ", "fr", "b"), (303, "123 ...", "en", "b"), (None, PROSE["de"], "de", "b"), (None, None, None, None), (304, (PROSE["de"] + " ") * 400, "de", "long")]
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t)) for i, t, l, s in rows], DOCS)


def through(spark, docs):
    """What each stage makes of its predecessor's rows."""
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, out[-1], None)
        out.append(spark.createDataFrame(made.collect(), made.schema).repartition(3))
    return out


def plain(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=str)


@pytest.fixture(scope="module")
def stages(spark):
    return through(spark, corpus(spark))


def test_language_id_rejects_what_has_no_language(stages):
    before, after = stages[0].collect(), stages[1].collect()
    lettered = [r for r in before if r.text and re.search("[^\\W\\d_]", r.text)]
    assert plain(after, *DOCS.replace(",", "").split()[::2]) == plain(lettered, *DOCS.replace(",", "").split()[::2])


def test_near_dedup_is_brute_force(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    sets = {i: h.shingles(t, 5) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = h.components(ids, links)
    got = stages[2].collect()
    assert sorted(str(r.doc_id) for r in got) == sorted([str(i) for i in ids if comp[i] == i] + ["None"] * sum(i is None for i, _ in rows))
    assert len(got) < len(rows)


def test_secret_scans_mask_and_keep_every_row(stages):
    before, after = stages[2].collect(), stages[3].collect()
    assert plain(after, "doc_id", "lang", "source") == plain(before, "doc_id", "lang", "source")
    text = {r.doc_id: r.text for r in after}
    assert "q7Zp2mK9vX4tB8nW" not in text[200] and "hunter2" not in text[200] and text[200].count("[SECRET]") == 2
    assert {r.doc_id: r.text for r in before if r.doc_id != 200} == {i: t for i, t in text.items() if i != 200}
    assert all(r.n_chars == len(r.text) for r in after)


def test_mixture_holds_the_words_that_the_operator_takes(spark, stages):
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(stages[3]).collect()}
    words = {}
    for r in stages[4].collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(h.words(r.text))
        assert r.n_chars == len(r.text)
    assert {i: n for i, (n, _) in taken.items() if n} == words and all(n <= 2 * size for n, size in taken.values())


def test_ids_decode_to_the_mixed_texts(stages):
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL_FILE)
    got = sorted((str(r.doc_id), str(r.source), lib.decode(r.ids), r.n_tokens == len(r.ids)) for r in stages[5].collect())
    assert got == sorted((str(r.doc_id), str(r.source), r.text, True) for r in stages[4].collect())
    assert stages[5].columns == ["doc_id", "source", "n_tokens", "ids"]


def test_run_is_its_stages_whatever_the_columns(spark, stages, tmp_path):
    """The whole run, on documents with clashing columns, gives the rows of the stages one by one."""
    docs = h.with_clashes(corpus(spark))
    docs.select(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain(stages[5].collect(), "doc_id", "source", "n_tokens", "ids")
    assert plain(corpus_pipeline.run(spark, str(tmp_path)).collect(), "doc_id", "source", "n_tokens", "ids") == want
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        made = stage(spark, docs, None)
        assert made.columns == docs.columns, k
        rows = made.collect()
        assert rows and {tuple(r[c] for c in h.CLASHES) for r in rows} == {tuple(f"clash {c}" for c in h.CLASHES)}


def test_empty_tables_and_tables_without_a_language(spark, tmp_path):
    corpus(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, corpus(spark).limit(0), None).count() == 0
    unlabelled = corpus(spark).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, unlabelled, None).count() == 0

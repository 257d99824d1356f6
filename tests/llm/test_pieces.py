import helpers as h
import pytest
import sentencepiece

from tamis.llm import pieces, queries

ODD = ["", " ", "  a  b \n\tc ", "▁x ▁", "日本語 テスト😀", "x" * 300 + " " + "ab" * 500, "²..!² 12.5", "\n\n\n  \n", "</s><s>", "\x00", "a" * 31, "a" * 32, "a" * 33, "naïve — “café”…"]


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ODD


def test_without_dropout_as_the_library(texts):
    own, lib = pieces.PieceCodec(queries.MODEL_FILE, 0.0, 1), sentencepiece.SentencePieceProcessor(model_file=queries.MODEL_FILE)
    for t, ids in zip(texts, own.encode(texts, [0] * len(texts))):
        assert own.decode(ids.tolist()) == t
        assert pieces.MARK in t or ids.tolist() == lib.encode(t)


def test_columns_and_heaps_agree(texts, monkeypatch):
    own = pieces.PieceCodec(queries.MODEL_FILE, 0.3, 7)
    some, keys = texts[:30] + ODD, list(range(30 + len(ODD)))
    wide = own.encode(some, keys)
    monkeypatch.setattr(pieces, "WIDE", 0)
    assert [x.tolist() for x in own.encode(some, keys)] == [x.tolist() for x in wide]


def test_slices_do_not_matter(texts, monkeypatch):
    own = pieces.PieceCodec(queries.MODEL_FILE, 0.1, 7)
    whole = own.encode(texts, list(range(len(texts))))
    monkeypatch.setattr(pieces, "SLICE_CHARS", 1000)
    monkeypatch.setattr(pieces, "SLICE_UNITS", 100)
    assert [x.tolist() for x in own.encode(texts, list(range(len(texts))))] == [x.tolist() for x in whole]


def test_dropout_varies_with_seed_and_stays_lossless(texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL_FILE)
    plain = sum(map(len, lib.encode(texts)))
    out = []
    for seed in (1, 2):
        own = pieces.PieceCodec(queries.MODEL_FILE, 0.1, seed)
        got = own.encode(texts, [own.key(i, t) for i, t in enumerate(texts)])
        assert [own.decode(x.tolist()) for x in got] == texts and lib.decode([x.tolist() for x in got]) == texts
        assert 1.02 * plain < sum(map(len, got)) < 1.3 * plain
        out.append([x.tolist() for x in got])
    assert sum(a != b for a, b in zip(*out)) > 0.9 * sum(len(t) > 100 for t in texts)
    all_skipped = pieces.PieceCodec(queries.MODEL_FILE, 1.0, 1).encode(["the cat"], [3])[0]
    assert len(all_skipped) == len(" the cat")


def test_share_of_skipped_candidates():
    own = pieces.PieceCodec(queries.MODEL_FILE, 0.25, 1)
    once = [x.tolist() for x in own.encode(["th"] * 20_000, list(range(20_000)))]  # candidates: _t, then _th; or th
    merged = sum(x == own.encode(["th"], [0])[0].tolist() or len(x) == 1 for x in once)
    assert 0.4 < merged / 20_000 < 0.85


def test_operator(spark):
    docs = h.awkward_documents(spark)
    got = pieces.encode(h.with_clashes(docs), queries.MODEL_FILE, keep=("source", "ids", "a`b"))
    assert {(r["kept_ids"], r["a`b"]) for r in got.collect()} == {("clash ids", "clash a`b")}
    back = pieces.decode(got, queries.MODEL_FILE)
    assert h.rows_of(back, "doc_id", "text") == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
    assert pieces.encode(docs.limit(0), queries.MODEL_FILE).count() == 0
    one = {(r.doc_id, r.n_tokens): r.ids for r in got.collect()}
    two = {(r.doc_id, r.n_tokens): r.ids for r in pieces.encode(docs.repartition(7), queries.MODEL_FILE).collect()}
    assert one == two


def test_query_round_trip(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op1_sentencepiece(spark, sf).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: h.sha256(t) for i, t in docs.items()}
    assert all(r.n_tokens == len(r.ids) and r.decoded_chars == len(docs[r.doc_id]) for r in got)


def brute(own, text, key):
    """The ids of a text by its definition: units, then one candidate after another, every pair looked at each time."""
    kind = lambda c: own.kind[ord(c)] if ord(c) < len(own.kind) else pieces._REST
    chars, units = " " + text if text else "", []
    for i, c in enumerate(chars):
        before = kind(chars[i - 1]) if i else None
        if i == 0 or kind(c) == pieces._ALONE or before != pieces._SPACE and kind(c) != before:
            units.append("")
        units[-1] += c
    m = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * pieces._MIX1 & m
        x = (x ^ x >> 27) * pieces._MIX2 & m
        return x ^ x >> 31

    out = []
    for u, unit in enumerate(units):
        h = mixed((u * pieces._GOLDEN + key) & m)
        rank = {i: r for r, i in enumerate(sorted(own.piece_id.values(), key=lambda i: (-own.score[i], i)))}
        # symbols as their text, and whether the pair that each begins has been skipped
        symbols, skipped, came = [pieces.MARK if c == " " else c if c != pieces.MARK else None for c in unit], [False] * len(unit), 0
        while True:
            found = [(rank[own.piece_id[a + b]], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if not skipped[i] and a in own.piece_id and b in own.piece_id and a + b in own.piece_id]
            if not found:
                break
            _, i = min(found)
            draw = mixed((h + (came // 4 + 1) * pieces._GOLDEN) & m) >> (came % 4 * 16) & 0xFFFF
            came += 1
            if draw < own.limit:
                skipped[i] = True
                continue
            symbols[i : i + 2], skipped[i : i + 2] = [symbols[i] + symbols[i + 1]], [False]
            if i:
                skipped[i - 1] = False
        for s, c in zip(symbols, symbols):
            if s in own.piece_id:
                out.append(own.piece_id[s])
            else:
                out += [int(own.byte_id[b]) for b in (c or pieces.MARK).encode()]
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5])
def test_dropout_is_brute_force(texts, dropout):
    own = pieces.PieceCodec(queries.MODEL_FILE, dropout, 11)
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL_FILE)
    own.score = {i: lib.get_score(i) for i in own.piece_id.values()}
    some = [t[:300] for t in texts[:8]] + [t for t in ODD if len(t) < 200]
    keys = [own.key(i, t) for i, t in enumerate(some)]
    for t, k, ids in zip(some, keys, own.encode(some, keys)):
        assert ids.tolist() == brute(own, t, k), t

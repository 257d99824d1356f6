import base64
import gzip
import hashlib
import io
import os
import random

import helpers as h
import pytest

from tamis.llm import common, queries, warc

PAGES = "page_id long, url string, html string"


def brute(rows):
    best = {}
    for i, _, t in rows:
        t = (t or "").encode()
        if i is not None:
            best[t] = max(best.get(t, i), i)
    out = []
    for i, _, t in rows:
        t = (t or "").encode()
        first = best.get(t)
        digest = base64.b32encode(hashlib.sha1(t).digest()).decode()
        out.append((i, len(t), digest, "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=str)


def awkward_pages():
    big = "".join(random.Random(1).choice("abcdefghij") for _ in range(600_000))
    return [(1, "u", "<p>x</p>"), (2, None, "<p>x</p>"), (5, "a\r\nb", None), (9, "", ""), (3, "é", "é😀" * 50), (4, "z", "<p>x</p>"), (4, "z", "<p>x</p>"), (None, "n", "<p>x</p>"), (7, "b", big), (None, "m", "alone"), (8, "y", big), (10, "m", "\x1f\x8b\x08" * 9)]


def read_back(spark, df, folder, split):
    path = warc.fresh_path(str(folder))
    warc.archive(df, f"file://{path}")
    got = warc.read(spark, f"file://{path}", split_bytes=split)
    return path, got


@pytest.mark.parametrize("split", [100, 1000, 1 << 25])
def test_every_split_finds_each_record_once(spark, tmp_path, split):
    rows = [r for r in awkward_pages() if split > 100 or len(r[2] or "") < 500_000]
    path, got = read_back(spark, h.with_clashes(spark.createDataFrame(rows, PAGES).coalesce(2)), tmp_path, split)
    back = [(r.page, r.payload_bytes, r.digest, r.type, r.refers) for r in got.select("*", warc.page_id(got.record_id).alias("page"), warc.page_id(got.refers_to).alias("refers")).collect()]
    assert sorted(back, key=str) == brute(rows)
    html = {(i, t) for i, _, t in rows}
    for r in got.select(warc.page_id(got.record_id).alias("page"), "type", "payload").collect():
        if r.type == "response":
            assert any(i == r.page and (t or "").encode() == bytes(r.payload) for i, t in html)


def test_files_are_gzip_members_and_nothing_else(spark, tmp_path):
    path, _ = read_back(spark, spark.createDataFrame(awkward_pages(), PAGES), tmp_path, 1000)
    whole = b"".join(gzip.open(os.path.join(path, f)).read() for f in os.listdir(path) if f.startswith("part-"))
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(awkward_pages())


def test_large_records_keep_their_last_byte():
    data = os.urandom(100) * 200_000  # 20 MB: the member does not end with a zero
    member = warc.gzip_member(data)
    assert member[-1] != 0 and gzip.decompress(member + warc.EMPTY_MEMBER) == data and warc.EMPTY_MEMBER[-1] == 0


def test_false_magic_is_passed_over():
    rng = random.Random(4)
    noise = bytes(rng.randrange(256) for _ in range(5000))
    record = lambda i: warc.gzip_member(warc.record_bytes(f"<r{i}>", "response", "u", "D", 3, None, b"abc"), 0 if i % 2 else 6)
    other = gzip.compress(b"not a record")
    cut = record(99)[:-9]
    parts = [warc.MAGIC + noise, record(0), noise, other, record(1), warc.MAGIC, warc.EMPTY_MEMBER, record(2), warc.MAGIC + b"\0" * 7, record(3), cut]
    data = b"".join(parts)
    for split in (1, 7, 64, 1 << 20):
        got = [(at, f["warc-record-id"], b) for lo in range(0, len(data), split) for at, f, b in warc.scan_range(io.BytesIO(data), len(data), lo, lo + split)]
        assert [x[1] for x in got] == ["<r0>", "<r1>", "<r2>", "<r3>"] and all(x[2] == b"abc" for x in got)
        assert [data.index(record(i)) for i in range(4)] == [x[0] for x in got]


def test_headers_of_any_length():
    rng = random.Random(6)
    for n in (60_000, 66_000, 200_000, 3_000_000):
        for uri in ("u" * n, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))):
            data = b"".join(warc.gzip_member(warc.record_bytes(i, "response", uri, "D", 3, None, b"abc")) for i in ("<r0>", "<r1>"))
            got = [x for lo in range(0, len(data), 50_000) for x in warc.scan_range(io.BytesIO(data), len(data), lo, lo + 50_000)]
            assert [(f["warc-record-id"], f["warc-target-uri"] == uri, b) for _, f, b in got] == [("<r0>", True, b"abc"), ("<r1>", True, b"abc")]


def test_blank_line_across_two_reads():
    whole = warc.record_bytes("<r>", "response", "u" * 70_000, "D", 3, None, b"abc")
    end = whole.index(b"\r\n\r\n")
    for k in range(5):
        c = warc.zlib.compressobj(0, warc.zlib.DEFLATED, 31)
        data = c.compress(whole[: end + k]) + c.flush(warc.zlib.Z_FULL_FLUSH) + c.compress(whole[end + k :]) + c.flush()
        assert [b for _, _, b in warc.scan_range(io.BytesIO(data), len(data), 0, len(data))] == [b"abc"]


def test_long_urls_are_read_back(spark, tmp_path):
    rng = random.Random(7)
    long = "data:text/html," + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=200_000))
    rows = [(1, long, "<p>x</p>"), (2, long, "<p>x</p>"), (3, "u", "<p>x</p>"), (4, long, "<p>y</p>")]
    _, got = read_back(spark, spark.createDataFrame(rows, PAGES).coalesce(1), tmp_path, 1000)
    got = got.select("*", warc.page_id(got.record_id).alias("page"), warc.page_id(got.refers_to).alias("refers")).collect()
    assert sorted([(r.page, r.payload_bytes, r.digest, r.type, r.refers) for r in got], key=str) == brute(rows)
    assert {(r.page, r.uri) for r in got} == {(i, u) for i, u, _ in rows}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op8_warc(spark, sf).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_more_digests_than_are_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    monkeypatch.setattr(common, "HEAVY_KEYS", 3)
    rows = [r for r in awkward_pages() if len(r[2] or "") < 500_000] + [(100 + i, "v", "hot") for i in range(50)] + [(200 + i, "w", f"p{i % 9}") for i in range(20)] + [(None, "v", "hot"), (None, "w", "twice"), (None, "w", "twice"), (150, "other", "hot")]
    _, got = read_back(spark, spark.createDataFrame(rows, PAGES), tmp_path, 1000)
    got = got.select("*", warc.page_id(got.record_id).alias("page"), warc.page_id(got.refers_to).alias("refers"))
    assert sorted([(r.page, r.payload_bytes, r.digest, r.type, r.refers) for r in got.collect()], key=str) == brute(rows)


def test_empty_table(spark, tmp_path):
    _, got = read_back(spark, spark.createDataFrame([], PAGES), tmp_path, 1000)
    assert got.count() == 0

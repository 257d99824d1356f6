import base64
import hashlib
import hmac
import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tamis.functions import crypto
from tamis.functions import text as T
from tamis.operators import evaluation as E
from tamis.operators import logs as L
from tamis.operators import scans
from tamis.sources import files, wiki
from tamis.streaming import scan


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_html(spark):
    html = "<html><head><style>p{}</style></head><body><h1>Title</h1><p>One&nbsp;two &amp; <b>three</b></p><ul><li>a</li><li>b</li></ul><table><tr><td>x</td><td>y</td></tr></table><!-- gone --><script>1<2</script><ac:parameter ac:name='k'>v</ac:parameter>end<br/>line</body></html>"
    assert one(spark, T.clean(F.lit(html))) == "Title\n\nOne two & three\n\na\nb\n\nx y\n\nend\nline"
    assert one(spark, T.clean(F.lit("a < b and c > d"))) == "a < b and c > d"
    assert [one(spark, T.is_html(F.lit(t))) for t in ("<p>", "<p>long enough</p>", "x" * 1000 + "<p>late</p>", "<span>nope, no</span>")] == [False, True, False, False]


@pytest.mark.parametrize("text,reason", [("", "blank"), (" \n", "blank"), ("short", "too_short"), ("!" * 60, "low_alphanumeric"), ("a" * 120, "insufficient_spacing"), ("ab \x01" * 30, "control_characters"), ("ab !!!" * 20, "special_characters"), ("fine words here " * 10, None)])
def test_quality(spark, text, reason):
    assert one(spark, T.quality_reason(F.lit(text))) == reason


def test_chunks(spark):
    text = "".join(chr(97 + i % 26) for i in range(105))
    got = one(spark, T.char_chunks(F.lit(text), 5, 2, 4))
    assert [(c.start, c.end) for c in got] == [(0, 20), (12, 40), (32, 60), (52, 80), (72, 100), (92, 105)] and all(text[c.start : c.end] == c.text for c in got)
    with pytest.raises(ValueError):
        T.char_chunks(F.lit("x"), 5, 5)
    words = spark.createDataFrame([("a bb ccc dd e.",), ("  ",), ("",)], "t string").select(T.token_chunks(F.col("t"), 3, 1)).collect()
    assert [[(c.start, c.end, c.tokens) for c in r[0]] for r in words] == [[(0, 8, 3), (5, 13, 3), (12, 14, 2)], [(0, 2, 0)], []]


def test_file_names(spark):
    assert one(spark, T.file_name(F.lit("a b/c:d"), ".csv")) == "a_b_c_d.csv" and len(one(spark, T.file_name(F.lit("x" * 400), ".csv"))) == 255


def test_hkdf_and_tokens(spark):
    master, salt = bytes(range(32)), bytes(range(100, 132))
    prk = hmac.new(salt, master, hashlib.sha256).digest()
    assert bytes(one(spark, crypto.derived_key(master, F.lit(salt)))) == hmac.new(prk, crypto.INFO + b"\x01", hashlib.sha256).digest()
    d = spark.createDataFrame([("secret é", "IBAN", 3, 9), (None, "IBAN", 0, 1)], "v string, t string, a int, b int").withColumns({"s": crypto.random_bytes(32), "i": crypto.random_bytes(12)})
    d = d.withColumn("k", crypto.encrypt(F.col("v"), F.col("t"), F.col("a"), F.col("b"), master, F.col("s"), F.col("i")))
    rows = d.select("k", crypto.decrypt(F.col("k"), F.col("t"), F.col("a"), F.col("b"), master).alias("x"), crypto.decrypt(F.col("k"), F.col("t"), F.col("a") + 1, F.col("b"), master).alias("moved")).collect()
    assert rows[0].x == "secret é" and rows[0].moved is None and rows[0].k.startswith(crypto.PREFIX) and rows[1].k is None
    assert one(spark, crypto.decrypt(F.lit("plain"), F.lit("t"), F.lit(0), F.lit(1), master)) == "plain"
    assert crypto.master_key(base64.b64encode(master).decode()) == master


class Wiki(BaseHTTPRequestHandler):
    busy = 2

    def log_message(self, *a):
        pass

    def do_GET(self):
        if "/space" in self.path and Wiki.busy:
            Wiki.busy -= 1
            self.send_error(503)
            return
        if "spaceKey=BAD" in self.path:
            self.send_error(404)
            return
        start = int(self.path.rpartition("start=")[2] or 0)
        if self.path.startswith("/rest/api/space"):
            every = [{"id": i, "key": f"S{i}", "name": f"Space {i}"} for i in range(3)] + [{"id": 9, "key": "", "name": "x"}]
        elif "attachment" in self.path:
            every = [{"id": "a", "title": "Plan.PDF", "metadata": {"mediaType": "application/pdf"}, "_links": {"download": "/d"}}, {"id": "b", "title": ".hidden"}]
        else:
            every = [{"id": i, "title": f"t{i}", "body": {"storage": {"value": f"<p>{i}</p>"}}, "version": {"number": 2, "when": "2024-01-02T00:00:00Z"} if i % 2 else {}, "history": {"lastUpdated": {"when": "2023-01-01T00:00:00Z"}}} for i in range(5)]
        some = every[start : start + 2]
        answer = {"results": some, "limit": 2, "_links": {"next": "/more"} if start + 2 < len(every) else {}}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode())


def test_wiki_source(spark):
    server = HTTPServer(("127.0.0.1", 0), Wiki)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    wiki.register(spark)
    read = lambda entity, **o: spark.read.format("wiki").options(url=f"http://127.0.0.1:{server.server_port}", entity=entity, limit="2", wait="0.01", **o).load()
    try:
        assert sorted((r.key, r.type, r.status) for r in read("spaces").collect()) == [(f"S{i}", "GLOBAL", "CURRENT") for i in range(3)]
        pages = read("pages", spaces="S1,BAD,S2").cache()
        assert sorted((r.space_key, r.id) for r in pages.collect()) == [(s, str(i)) for s in ("S1", "S2") for i in range(5)]
        assert pages.where("last_modified like '2024%'").count() == 4 and wiki.pages_since(pages, "2024").count() == 4 and wiki.search(pages, "S1", "T3").count() == 1
        found = read("attachments", spaces="S1").collect()
        assert len(found) == 10 and {(r.name, r.extension) for r in found} == {("Plan.PDF", "pdf"), (".hidden", "")}
        assert wiki.refreshed(pages, pages.limit(0)) is pages
    finally:
        server.shutdown()


class Lookups(BaseHTTPRequestHandler):
    """A wiki that answers single objects, searches (by their query) and downloads."""

    asked: list[str] = []
    busy = 1

    def log_message(self, *a):
        pass

    def do_GET(self):
        path, _, query = self.path.partition("?")
        options = dict(urllib.parse.parse_qsl(query))
        body = {"body": {"storage": {"value": "<p>x</p>"}}, "space": {"key": "S7"}, "version": {"number": 1}}
        if path.startswith("/files/"):
            if Lookups.busy:
                Lookups.busy -= 1
                return self.send_error(503)
            return self.send_error(404) if path.endswith("gone") else self.answer(b"bytes of " + path.encode())
        if path == "/rest/api/content/search":
            Lookups.asked.append(options["cql"])
            if "type = attachment" in options["cql"]:
                found = [{"id": "a1", "title": "x.pdf", "container": {"id": 12}, "_links": {"download": "/files/x"}}]
            else:
                found = [{"content": {"id": 12, "title": "found", **body}}]
            return self.answer(json.dumps({"results": found, "limit": 250}).encode())
        if path in ("/rest/api/content/12", "/rest/api/content/13"):
            return self.answer(json.dumps({"id": path[-2:], "title": "one", **body}).encode())
        if path == "/rest/api/space/S7":
            return self.answer(json.dumps({"id": 7, "key": "S7", "name": "Seven"}).encode())
        return self.send_error(404)

    def answer(self, data):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)


def test_wiki_lookups_searches_and_downloads(spark):
    server = HTTPServer(("127.0.0.1", 0), Lookups)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    wiki.register(spark)
    base = f"http://127.0.0.1:{server.server_port}"
    read = lambda entity, **o: spark.read.format("wiki").options(url=base, entity=entity, wait="0.01", **o).load()
    try:
        assert sorted((r.id, r.space_key, r.body) for r in read("pages", ids="12,99,13").collect()) == [("12", "S7", "<p>x</p>"), ("13", "S7", "<p>x</p>")]
        assert [(r.id, r.key) for r in read("spaces", keys="S7,NONE").collect()] == [("7", "S7")]
        assert [(r.id, r.title) for r in read("pages", spaces="S7", query='say "hi"').collect()] == [("12", "found")]
        assert [r.id for r in read("pages", spaces="S7", since="2024-01-01").collect()] == ["12"]
        found = read("attachments", spaces="S7", since="2024-01-01")
        assert [(r.id, r.page_id, r.extension) for r in found.collect()] == [("a1", "12", "pdf")]
        assert set(Lookups.asked) == {'space = "S7" AND type = page AND text ~ "say \\"hi\\""', 'space = "S7" AND type = page AND lastModified >= "2024-01-01"', 'space = "S7" AND type = attachment AND lastModified >= "2024-01-01"'}
        more = found.unionByName(spark.createDataFrame([("b", "1", "S", "n", "", None, "/files/gone"), ("c", "1", "S", "n", "", None, None), ("d", "1", "S", "n", "", None, "/files/y")], found.schema))
        got = {r.id: r.content and bytes(r.content) for r in wiki.downloaded(more, base, wait_s=0.01).collect()}
        assert got == {"a1": b"bytes of /files/x", "b": None, "c": None, "d": b"bytes of /files/y"}
        assert {r.content for r in wiki.downloaded(more, base, wait_s=0.01, longest=3).collect()} == {None}
    finally:
        server.shutdown()


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_text("words of a text that is long enough to be taken for one, surely so")
    (tmp_path / "a/y.html").write_text("<p>words of a page that is long enough to be taken for one,</p><script>no</script><div>surely so</div>")
    (tmp_path / "a/z.txt").write_text("tiny")
    (tmp_path / "a/q.exe").write_text("x" * 100)
    got = {r.name: r.text for r in files.attachment_texts(spark, str(tmp_path / "a")).collect()}
    assert set(got) == {"x.txt", "y.html"} and "no" not in got["y.html"].split()
    s = spark.createDataFrame([("t", "l\tx", "s", "k", "p", "page", 100, 50, 2000.0, 3)], files.SAMPLE)
    files.write_samples(s, str(tmp_path / "b"))
    back = files.bench_samples(spark, str(tmp_path / "b")).first()
    assert back.label == "l x" and back.duration_ms == 50
    gold = spark.createDataFrame([("1", "d", "en", "abc", [(0, 1, "L")], [])], "id string, dataset string, lang string, text string, spans array<struct<start:int,end:int,label:string>>, ignore_spans array<struct<start:int,end:int,src_label:string>>")
    files.write_gold(gold, str(tmp_path / "g"))
    assert files.gold_documents(spark, str(tmp_path / "g")).first().spans[0].label == "L"
    lines = spark.createDataFrame([("[THROUGHPUT] phase=a request_id=1 chars=100 duration_s=2",), ("[THROUGHPUT] phase=a chars=x duration_s=2",), ("noise",)], "value string")
    d = L.parse_throughput(lines)
    assert [(r.phase, r.chars_per_s) for r in d.collect()] == [("a", 50.0)]
    assert "| a | 1 | 50.0 |" in files.throughput_report(d, d)


def test_gold_spans(spark):
    raw = '[{"start":0,"end":2,"label":"A"},{"start":2,"end":2,"label":"B"},{"start":0,"end":9,"label":"C"},{"end":1}]'
    assert [s.label for s in one(spark, E.gold_spans(F.lit(raw), F.lit("abc")))] == ["A"] and one(spark, E.gold_spans(F.lit("{broken"), F.lit("abc"))) == []
    assert E.concept_table(spark, {"d": {"a": "X", "b": "Y"}}).count() == 2


def test_owners_and_updates(spark):
    rows = [("S", "administer", "space", [("Ann", "a@x", True), ("Bob", None, True), ("Cy", "c@x", False)]), ("S", "read", "space", [("Dee", "d@x", True)]), ("S", "administer", "space", [("Ann", "a@x", True)])]
    d = spark.createDataFrame(rows, "space_key string, operation string, target string, users array<struct<name:string,email:string,active:boolean>>")
    assert [tuple(r) for r in scans.data_owners(d).collect()] == [("S", "Ann", "a@x")]
    assert one(spark, scans.has_been_updated(F.lit(2), F.lit(1))) and not one(spark, scans.has_been_updated(F.lit(2), F.lit(None)))
    assert [one(spark, scans.progress(F.lit(a), F.lit(t))) for a, t in ((1, 4), (9, 4), (0, 0))] == [25.0, 100.0, 100.0]
    assert one(spark, scans.presentation_status(F.lit(None).cast("string"), F.lit(1), F.lit(0))) == "PAUSED"


def test_paused_stays_paused(spark):
    rows = [("s", "k", 1, "RUNNING", "p1", None, 10.0), ("s", "k", 2, "PAUSED", None, None, None), ("s", "k", 3, "RUNNING", " ", "a", 20.0), ("s", "m", 1, "COMPLETED", "p", None, 100.0), ("s", "m", 2, "RUNNING", None, None, None)]
    d = spark.createDataFrame(rows, "scan_id string, space_key string, event_seq long, status string, last_page string, last_attachment string, progress double").withColumn("ts", F.timestamp_seconds("event_seq"))
    got = {r.space_key: (r.status, r.last_page, r.last_attachment, r.progress) for r in scans.checkpoints(d).collect()}
    assert got == {"k": ("PAUSED", "p1", "a", 20.0), "m": ("RUNNING", "p", None, 100.0)}


def test_checkpoint_stream(spark, tmp_path):
    schema = "scan_id string, space_key string, event_seq long, ts timestamp, event_type string, page_id string, attachment_name string, progress double"
    event = lambda n, kind, page: ("s", "k", n, kind, page, None, float(n))
    make = lambda rows: spark.createDataFrame(rows, "scan_id string, space_key string, event_seq long, event_type string, page_id string, attachment_name string, progress double").withColumn("ts", F.timestamp_seconds("event_seq")).select(*[c.split()[0] for c in schema.split(", ")])
    for k, rows in enumerate(([event(1, "start", "p1"), event(2, "pageComplete", "p1")], [event(3, "item", "p2")], [event(4, "complete", None)])):
        make(rows).write.mode("append").parquet(str(tmp_path / "in"))
        scan.keep_checkpoints(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination()
        r = spark.read.parquet(str(tmp_path / f"state/{k}")).first()
        assert (r.status, r.last_page) == ("COMPLETED" if k == 2 else "RUNNING", "p1")


def test_a_finished_stream_is_files_and_gathers_nothing_at_the_driver(spark, tmp_path):
    """Each event once, whatever its times are; the rows are files of the shared folder, the state is gone."""
    schema, provider = "scan_id string, event_seq long, ts timestamp", "spark.sql.streaming.stateStore.providerClass"
    where, store = spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), spark.conf.get(provider)
    rows = spark.range(500).selectExpr("concat('scan', id % 3) AS scan_id", "id % 250 AS event_seq", "CASE WHEN id % 7 > 0 THEN timestamp_seconds(id * 86400) END AS ts")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    got = scan.finished(scan.replay_safe(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))))
    assert got.inputFiles() and all(f.removeprefix("file://").startswith(where) for f in got.inputFiles())
    assert sorted(map(tuple, got.select("scan_id", "event_seq").collect())) == sorted({(f"scan{i % 3}", i % 250) for i in range(500)})
    assert not list(Path(where).glob("tamis_*-state")) and spark.conf.get(provider) == store
    rows.limit(0).write.parquet(str(tmp_path / "none"))
    assert scan.finished(scan.replay_safe(spark.readStream.schema(schema).parquet(str(tmp_path / "none")))).collect() == []

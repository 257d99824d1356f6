import random
import time

import helpers as h
import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import common, queries, urls

PAGES = "page_id long, url string, html string"

#: From the contract: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    verdict, *name = max(fits, key=lambda r: len(r[1] + r[2]), default=(None, None))
    return host, path, name[0] and "".join(name), verdict


ODD = [
    None, "", "example.org/es/1", "http://", "http://example.org", "http://example.org/", "HTTP://WWW.EXAMPLE.ORG/ES/1", "https://a.example.org/es/1?x#y", "https://example.org/en/12", "https://notexample.org/es/", "x://org/",
    "x://borg/", "x://com/fr/", "x://a.com/de/", "x://a.com/DE/", "x://a.com?/de/", "x://a.com#/fr/", "x://É.org/é", "x://user@example.org:8080/es/", "a://b://c.org/x", "x://example.org/es", "://org/", "x://example.org/en/1", "x://a.example.org/en/2", "x:// org/\n/es/?", "x://com/" + "a/" * 50_000,
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(ODD)], PAGES)
    got = {r.page_id: r for r in urls.judge(h.with_clashes(df), queries.URL_RULES).collect()}
    assert len(got) == len(ODD)
    for i, u in enumerate(ODD):
        host, path, rule, verdict = brute(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict in ("allow", "block") and verdict in (None, got[i].verdict)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op5_urls(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = brute(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and verdict in (None, r.verdict)
    assert {r.rule for r in got} >= {"org/", "example.org/es/", "example.org/en/1"}
    assert [tuple(r) for r in sorted(got)] == [tuple(r) for r in sorted(queries.op5_urls(spark, sf).collect())]


def test_url_of_a_megabyte(spark):
    df = spark.createDataFrame([(i, f"x://a.b.net/{u}", "h") for i, u in enumerate(("a" * 10**6, "/" * 10**6, "a/" * 500_000, "a:" * 500_000, "?" + "a=1&" * 250_000))] + [(9, "x://" + "a:1" * 300_000, "h")], PAGES)
    began = time.perf_counter()
    assert urls.judge(df, queries.URL_RULES).count() == 6
    assert urls.judge(df, queries.URL_RULES).select(F.sum("score")).first()[0] > 0
    assert time.perf_counter() - began < 60


def test_suffix_column_and_many_suffixes(spark, monkeypatch):
    want = {"a.b": "b", "a.b:80": "b", "a.b:": "b", "": "", "a": "a", "a:b": "b", "x.y.co.uk": "uk", "a.": ""}
    got = spark.createDataFrame([(h_,) for h_ in want], "h string").select("h", urls.suffix_of(F.col("h")).alias("s")).collect()
    assert {r.h: r.s for r in got} == want
    df = spark.createDataFrame([(i, f"x://h{i % 7}.s{i % 13 if i % 3 else 0}/p{i}", "h") for i in range(400)], PAGES)
    rules = [urls.Rule("block", "s0", "/p1"), urls.Rule("allow", "s3", "/")]
    one = sorted(map(tuple, urls.judge(df, rules).collect()))
    monkeypatch.setattr(urls, "BROADCAST_SUFFIXES", 2)
    monkeypatch.setattr(common, "HEAVY_KEYS", 4)
    assert sorted(map(tuple, urls.judge(df, rules).collect())) == one


def test_sample_is_bounded_where_rows_repeat(spark):
    df = spark.createDataFrame([(None, "x://a.org/x", "h")] * 300 + [(i, f"x://b{i}.com/de/", "h") for i in range(100)], PAGES)
    one = urls.judge(df, queries.URL_RULES, rows_to_learn=50).collect()
    assert len(one) == 400 and sorted(one, key=str) == sorted(urls.judge(df.repartition(3), queries.URL_RULES, rows_to_learn=50).collect(), key=str)


def test_held_out_accuracy_on_labelled_urls(spark):
    """Spammy-looking URLs are learnt from labels of two thirds and told apart on the rest."""
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for i in range(1500):
        bad = rng.random() < 0.4
        if bad:
            u = f"http://{word(3)}{rng.randrange(10**6)}-{word(14)}.{rng.choice(['top', 'xyz', 'net'])}/{word(2)}?" + "&".join(f"{word(2)}={rng.randrange(10**6)}" for _ in range(rng.randrange(2, 6)))
        else:
            u = f"https://{word(7)}.{rng.choice(['net', 'edu', 'io'])}/{word(5)}/{word(6)}-{word(4)}"
        rows.append((i, u, int(bad) if i % 3 else None, int(bad)))
    df = spark.createDataFrame(rows, "page_id long, url string, given int, truth int")
    got = {r.page_id: r.verdict for r in urls.judge(df, (), label=F.col("given")).collect()}
    held = [(got[i] == "block") == bool(t) for i, _, g, t in rows if g is None]
    assert sum(held) > 0.97 * len(held)


@pytest.mark.parametrize("seed", [1, 2])
def test_sql_trees_score_as_the_trees(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(400, 3)).round(2)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    model = urls.train(x, y, ["a", "b", "c"], trees=20)
    margin = model.margin(x)
    assert ((margin > 0) == (y > 0)).mean() > 0.95
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = [r[0] for r in df.select(model.column({n: F.col(n) for n in "abc"})).collect()]
    assert got == pytest.approx(margin.tolist())


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "x://a.b/c", "h"), (None, None, None), (1, "x://a.b/c", "h")], PAGES)
    assert {r.verdict for r in urls.judge(df, ()).collect()} == {"allow"}
    assert urls.judge(df.limit(0), queries.URL_RULES).count() == 0


def test_entropy(spark):
    got = spark.createDataFrame([("",), ("aaaa",), ("abab",), ("abcd",)], "t string").select(urls._entropy(F.col("t"))).collect()
    assert [r[0] for r in got] == pytest.approx([0, 0, 1, 2])

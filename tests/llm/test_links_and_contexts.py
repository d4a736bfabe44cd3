"""Links of pages as RFC 3986 resolves them, and the words around many spans."""

import time
from urllib.parse import urljoin

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii, url_filter

PAGES = [
    (1, "http://s.com/d/x.html", '<link rel="canonical" href="y.html">'),
    (2, "http://s.com/d/y.html", '<meta http-equiv="refresh" content="0; url=http://bad.net/z">'),
    (3, "http://t.com/p?q=1", '<meta http-equiv="refresh" content="0;url=?p=2">'),
    (4, "http://t.com/p?p=2", '<link href="//bad.net/" rel="canonical">'),
    (5, "http://u.com/a", '<link rel="canonical" href="http://u.com/b"><link rel="canonical" href="http://bad.net/c">'),
    (6, "http://v.com/a/b/c", '<link rel="canonical" href="../../w">'),
    (7, "http://v.com/w", '<link rel="canonical" href="/./en/../../bad?x=1&amp;y=2">'),
    (8, "http://v.com/bad?x=1&y=2", '<link rel="canonical" href="http://bad.net/v">'),
    (9, "http://m.com/a", '<link rel="canonical" href="mailto:x@bad.net">'),
    (10, "http://m.com/b", '<link rel="canonical" href="#top">'),
    (11, "http://n.com", '<link rel="canonical" href="one">'),
    (12, "http://n.com/one", '<link rel="canonical" href="go?to=http://bad.net/">'),
    (13, "http://O.com/k/", "<link rel=canonical href=./><meta http-equiv=refresh content='1;url=../l/'>"),
    (14, "http://o.com/l", '<link rel="canonical" href="http://x.org/fr/1">'),
    (15, "http://o.com/l/", None),
]


def test_every_link_counts(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("verdict", F.lit(0)).withColumn("node", F.lit("x"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.via) for r in url_filter.judge_pages(frame).collect()}
    assert {k for k, v in got.items() if v[3:] == ("block", "alias")} == {1, 2, 3, 4, 5, 6, 7, 8}
    assert {k for k, v in got.items() if v[3:] == ("allow", "alias")} == {13, 14, 15} and {k for k, v in got.items() if v[4] == "default"} == {9, 10, 11, 12}
    con = duckdb.connect()
    con.register("pages", frame.toPandas())
    assert {r[0]: r[1:] for r in con.execute(url_filter.ORACLE_SQL).fetchall()} == got


@pytest.mark.parametrize("base", ["http://a/b/c/d?q", "http://a/b/c/", "http://a", "https://A.b/x#f"])
def test_links_resolve_as_the_standard_says(spark, base):
    links = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "g;x", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "g/./h", "g/../h", "http://z/", "HTTPS://z/y"]
    rows = spark.createDataFrame([(x,) for x in links], "link string").select("link", url_filter.absolute(F.col("link"), F.lit(base)).alias("u")).select("link", url_filter.identity(F.col("u")).alias("got")).collect()
    want = spark.createDataFrame([(x, urljoin(base, x)) for x in links], "link string, u string").select("link", url_filter.identity(F.col("u")).alias("got")).collect()
    assert {r.link: r.got for r in rows} == {r.link: r.got for r in want}


def test_words_around_a_span_are_whole():
    long = "supercalifragilistic" * 30
    text = f"one {long} two a@b.cd, three {long}."
    (span,) = pii.base_spans(text)
    near = list(pii.Words(text).around(span[1], span[2], 2))
    assert [t for *_, t in near] == [long, "two", "three"] or [t for *_, t in near] == [long, "two", "three", long]
    assert all(text[s:e].lower() == t for s, e, t in near)
    terms = {t for _, t, *_ in pii.context_terms(text, [span], pii.Sanitising())}
    assert terms == {long, "three"}  # 'one' and 'two' have too few letters
    glued = "mail:a@b.cd;soon"
    assert [t for *_, t in pii.Words(glued).around(5, 11, 3)] == ["mail", "soon"]


def test_many_spans_take_no_pairs():
    text = "write alpha a@b.cd beta and " * 20_000
    spans = pii.base_spans(text)
    began = time.time()
    terms = pii.context_terms(text, spans, pii.Sanitising())
    assert len(spans) == 20_000 and len(terms) > 20_000 and time.time() - began < 4
    began = time.time()
    assert pii._kept([{"start": s, "end": e} for _, s, e in spans], spans, text) == [] and time.time() - began < 1

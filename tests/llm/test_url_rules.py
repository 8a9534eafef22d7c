import os

import pytest
from pyspark.sql import functions as F

from encore.llm import queries, url_rules
from tests.harness import TABLES, compare, duck

LINK = '<html><link rel="canonical" href="%s"></html>'
PAGES = [
    (0, "http://a.example.org/x", LINK % "http://b.example.net/es/1", "alias of a blocked target that is no page"),
    (1, "https://a.example.org/x/", None, "another form of page 0"),
    (2, "HTTP://Shop.EXAMPLE.com/en/9", "", "block rule"),
    (3, "http://www.example.com/en/9?utm_source=a", "", "longer allow rule"),
    (4, "http://c.org/1", "<META content='0; url=//shop.example.com/en/9' http-equiv=refresh>", "redirects to blocked"),
    (5, "http://d.org/1", LINK % "http://e.org/1", "chain, 1"),
    (6, "http://e.org/1#top", LINK % "/2", "chain, 2: root-relative"),
    (7, "http://e.org/2", LINK % "http://x.net/fr/1", "chain, 3: to a blocked target"),
    (8, "http://f.org/1", LINK % "http://y.net/fr/2", "blocked, and allowed below"),
    (9, "http://f.org/2", LINK % "http://f.org/1", "-"),
    (10, "http://z.com/", LINK % "http://f.org/2", "allow rule: its class is not blocked"),
    (11, None, LINK % "http://x.net/fr/1", "null"), (12, "no url", LINK % "http://x.net/fr/1", "none"), (13, "", None, ""),
    (14, "http://host.net", None, "no path"), (15, "http://q.net?x=/es/", None, "query, no path"),
    (16, "http://notnet/es/", None, "suffix without a dot"), (17, "x://y://net/es/", None, "first ://"),
    (18, "http://net/es/1", None, "host itself"), (19, "http://g.org/?a=1&amp;utm_x=2", LINK % "mailto:a@x.net/fr/", "another scheme: no edge"),
    (20, "http://r.net/de/a/b?q=1", LINK % "../../es/7", "relative: up twice to a blocked path"),
    (21, "http://s.org/a/b", "<base target=_top><base target=_top href='http://x.net/fr/'><base href=/z/>" + LINK % "1",
     "relative to the first base that has an address"),
    (22, "http://t.org/a/b", "<BASE HREF=/c/d/>" + LINK % "./e/../../f", "relative to a relative base: t.org/c/f"),
    (23, "http://t.org/c/f/", LINK % "//x.net/fr/1", "what page 22 names"),
    (24, "http://v.org/p?x=1", LINK % "?x=2", "query only"), (25, "http://v.org/p?x=2", LINK % "http://x.net/es/.", "what page 24 names"),
    (26, "http://w.net", LINK % "fr/1?u=http://a.org/", "relative, no path, a url in the query"),
    (27, "http://w.org/a//b/", LINK % "#top", "itself"), (28, "http://w.org/a", LINK % "../../../es", "above the root"),
    (None, "http://c.org/1", None, "null id"), (4, "http://c.org/1", None, "repeated id"),
]
WANT = {0: ("block", None), 1: ("block", None), 2: ("block", "example.com/en/"), 3: ("allow", "www.example.com/en/"),
        4: ("block", None), 5: ("block", None), 6: ("block", None), 7: ("block", None), 8: ("allow", None),
        9: ("allow", None), 10: ("allow", "com/"), 11: ("allow", None), 12: ("allow", None), 13: ("allow", None),
        14: ("allow", None), 15: ("allow", None), 16: ("allow", None), 17: ("allow", None), 18: ("block", "net/es/"),
        19: ("allow", None), 20: ("block", None), 21: ("block", None), 22: ("block", None), 23: ("block", None),
        24: ("block", None), 25: ("block", None), 26: ("block", None), 27: ("allow", None), 28: ("allow", None), None: ("block", None)}


def frame(spark):
    return spark.createDataFrame([r[:3] for r in PAGES], "page_id long, url string, html string")


def test_cases(spark):
    got = url_rules.judge(frame(spark).selectExpr("*", "1 as host", "2 as root", "3 as form")).collect()
    assert len(got) == len(PAGES)
    assert {r.page_id: (r.verdict, r.rule) for r in got} == WANT
    parts = {r.page_id: (r.host, r.path) for r in got}
    assert parts[2] == ("shop.example.com", "/en/9") and parts[12] == ("", "") and parts[15] == ("q.net", "")
    assert parts[17] == ("y:", "//net/es/")


@pytest.mark.parametrize("base,ref,want", [
    ("http://A.org/b/c/d?q", "g", "http://a.org/b/c/g"), ("http://a.org/b/c/d?q", "./g/", "http://a.org/b/c/g/"),
    ("http://a.org/b/c/d?q", "..", "http://a.org/b/"), ("http://a.org/b/c/d?q", "../..", "http://a.org/"),
    ("http://a.org/b/c/d?q", "../../../g", "http://a.org/g"), ("http://a.org/b/c/d?q", "/./g/../h", "http://a.org/h"),
    ("http://a.org/b/c/d?q", "g?y/../x", "http://a.org/b/c/g?y/../x"), ("http://a.org/b/c/d?q", "..g", "http://a.org/b/c/..g"),
    ("http://a.org/b/c/d?q#z", "#s", "http://a.org/b/c/d?q#s"), ("http://a.org/b/c/d?q", "?y", "http://a.org/b/c/d?y"),
    ("http://a.org", "g;x=1/../y", "http://a.org/y"), ("http://a.org/b/", "x//../y", "http://a.org/b/x/y"),
    ("http://a.org/b", "javascript:x", None), ("http://a.org/b", "ftp://c/d/../e", "ftp://c/d/../e")])
def test_resolve(spark, base, ref, want):
    row = spark.createDataFrame([(base, ref)], "b string, r string")
    assert row.select(url_rules.resolve(F.col("b"), F.col("r"))).first()[0] == want


def test_redirect_table_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.org/1", None)], "page_id long, url string, html string")
    moves = spark.createDataFrame([("http://a.org/1", "http://b.net/es/")], "src string, dst string")
    assert [r.verdict for r in url_rules.judge(pages, moves).collect()] == ["block"]
    assert [r.verdict for r in url_rules.judge(pages).collect()] == ["allow"]
    assert url_rules.judge(pages.limit(0), moves).count() == 0


@pytest.mark.parametrize("made", [False, True])
def test_oracle(spark, tmp_path, made):
    sf = "/root/testdata/sf0.01"
    if made:
        for t in TABLES:
            if t != "pages":
                os.symlink(f"{sf}/{t}.parquet", f"{tmp_path}/{t}.parquet")
        frame(spark).coalesce(1).toPandas().to_parquet(f"{tmp_path}/pages.parquet")
        sf = str(tmp_path)
    ok, why = compare(queries.op5_url_rules(spark, sf), url_rules.oracle(), duck(sf))
    assert ok, why

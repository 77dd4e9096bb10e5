from pyspark.sql import functions as F

from stormglass.llm import urls as U
from stormglass.llm.queries import QUERIES, URL_RULES
from stormglass.llm.sql import SQL
from tests.check_sql import compare, connect
from tests.llm import helpers as H

RULES = [("block", "bad.org/"), ("allow", "bad.org/ok/"), ("block", "site.com/x/"), ("allow", "safe.net/")]


def pages(spark, rows):
    full = [(*r, None) if len(r) == 2 else r for r in rows]
    return spark.createDataFrame(full, "page_id bigint, url string, html string")


def verdicts(df):
    return {r.page_id: (r.rule, r.verdict) for r in df.collect()}


def test_query_against_sql(spark):
    for folder in (H.SF, "/root/testdata/sf0.01"):
        assert compare(QUERIES["op8_url_filters"](spark, folder), connect(folder), SQL["op8_url_filters"]) == ""


def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "HTTP://A.Bad.ORG/Path?q#f"),
        (2, "https://notbad.org/"),
        (3, "https://bad.org"),
        (4, "https://x.bad.org/ok/1"),
        (5, "no scheme"),
        (6, None),
        (7, "a://b://c/d"),
        (8, "://h?x/y"),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages(spark, rows), RULES).collect()}
    assert got == {
        1: ("a.bad.org", "/Path", "bad.org/", "block"),
        2: ("notbad.org", "/", None, "allow"),
        3: ("bad.org", "", None, "allow"),
        4: ("x.bad.org", "/ok/1", "bad.org/ok/", "allow"),
        5: ("", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("b:", "//c/d", None, "allow"),
        8: ("h", "", None, "allow"),
    }


def test_canonical_forms(spark):
    same = [
        "http://www.Site.com/a/b.html?utm_source=x#top",
        "https://m.site.com/a/b/",
        "https://site.com/a/b?ref=1&utm_campaign=2",
        "ftp://site.com/a/b/index.html",
    ]
    other = ["https://site.com/a/b?page=2", "https://blog.site.com/a/b", "https://site.com/a"]
    df = spark.createDataFrame([(u,) for u in same + other], "u string").select(U.canonical(F.col("u")).alias("c"))
    forms = [r.c for r in df.collect()]
    assert set(forms[: len(same)]) == {"site.com/a/b"} and len(set(forms)) == 1 + len(other)


def test_block_reaches_aliases_and_allow_comes_first(spark):
    link = '<html><LINK href="{0}" rel="canonical"></html>'
    rows = [
        (1, "https://one.io/a", link.format("https://bad.org/x")),
        (2, "https://two.io/b", '<meta http-equiv="refresh" content="0; URL=https://one.io/a/">'),
        (3, "https://three.io/c", link.format("/d")),
        (4, "https://three.io/d", None),
        (5, "https://four.io/e", link.format("https://site.com/x/1")),
        (6, "https://safe.net/f", link.format("https://four.io/e?ref=9")),
        (7, "https://five.io/g", None),
        (8, "http://www.five.io/g.html", None),
        (9, "https://bad.org/ok/z", link.format("https://six.io/h")),
        (10, "https://six.io/h", link.format("https://bad.org/q")),
    ]
    redirects = spark.createDataFrame(
        [("https://five.io/g/", "https://bad.org/deep"), (None, "https://x.io/"), ("https://x.io/", "broken")], "source string, target string"
    )
    got = verdicts(U.judge(pages(spark, rows), RULES, redirects))
    assert {k for k, v in got.items() if v == (None, "block")} == {1, 2, 7, 8}
    assert {k for k, v in got.items() if v == (None, "allow")} == {3, 4, 5, 10}
    assert got[6] == ("safe.net/", "allow") and got[9] == ("bad.org/ok/", "allow")


def test_references_are_resolved(spark):
    base = "http://Site.com/a/b/c.html?q=1#f"
    expected = {
        "next.html": "http://site.com/a/b/next.html",
        "./d/../e": "http://site.com/a/b/e",
        "../de/x": "http://site.com/a/de/x",
        "../../../..": "http://site.com/",
        "..": "http://site.com/a/",
        "?page=2": "http://site.com/a/b/c.html?page=2",
        "go?u=https://x.io/../y": "http://site.com/a/b/go?u=https://x.io/../y",
        "/x/./y": "http://site.com/x/y",
        "//h.io/z": "http://h.io/z",
        "https://h.io/a/../b?c=../d": "https://h.io/b?c=../d",
        "#top": None,
        "": None,
        "mailto:a@b.c": None,
    }
    df = spark.createDataFrame([(t,) for t in expected], "t string").select("t", U.resolve(F.lit(base), F.col("t")).alias("u"))
    assert {r.t: r.u for r in df.collect()} == expected
    bare = spark.createDataFrame([("https://h.io", "x"), ("https://h.io", "?p"), ("no scheme", "x"), (None, "x")], "b string, t string")
    assert [r[0] for r in bare.select(U.resolve(F.col("b"), F.col("t"))).collect()] == ["https://h.io/x", "https://h.io?p", None, None]


def test_block_reaches_pages_with_relative_links(spark):
    link, fresh = '<link rel="canonical" href="{0}">', '<meta http-equiv="refresh" content="0; url={0}">'
    rows = [
        (1, "https://one.io/a/start", fresh.format("next.html")),
        (2, "https://one.io/b/c/d", link.format("../../a/next")),
        (3, "https://one.io/a/list", link.format("?page=2&amp;x=1")),
        (4, "https://one.io/b/", fresh.format("'/a/list?page=2&amp;x=1'")),
        (5, "https://one.io/e", '<base href="https://two.io/a/">' + link.format("next.html")),
        (6, "https://one.io/f", link.format("next.html")),
    ]
    redirects = spark.createDataFrame(
        [("https://one.io/a/next", "https://bad.org/1"), ("https://one.io/a/list?page=2&x=1", "https://bad.org/2"), ("https://two.io/a/next", "https://bad.org/3")],
        "source string, target string",
    )
    got = verdicts(U.judge(pages(spark, rows), RULES, redirects))
    assert {k for k, v in got.items() if v == (None, "block")} == {1, 2, 3, 4, 5} and got[6] == (None, "allow")


def test_long_chain(spark):
    n = 40
    rows = [(i, f"https://h{i}.io/") for i in range(n)]
    redirects = spark.createDataFrame(
        [(f"https://h{i}.io/", f"https://h{i + 1}.io/") for i in range(n - 1)] + [(f"https://h{n - 1}.io/", "https://bad.org/end")],
        "source string, target string",
    )
    assert {v for _, v in verdicts(U.judge(pages(spark, rows), RULES, redirects)).values()} == {"block"}


def test_edges(spark):
    df = pages(spark, [(None, None, None), (1, "", ""), (1, "https://bad.org/", "x" * 100_000), (1, "https://bad.org/", None)])
    for extra in (df, df.withColumns({n: F.lit(1) for n in ("host", "path", "rule", "verdict", "node", "id", "caught", "component")})):
        assert sorted(r.verdict for r in U.judge(extra, RULES).collect()) == ["allow", "allow", "block", "block"]
    assert U.judge(df.limit(0), RULES).collect() == []
    assert {r.verdict for r in U.judge(df, []).collect()} == {"allow"}
    assert len(URL_RULES) == 4


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op8_url_filters"](spark, H.SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Cartesian" not in plan

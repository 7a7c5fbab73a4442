from shelfspark.llm import url_filters as U
from shelfspark.llm.queries import URL_RULES


def verdicts(spark, pages, redirects=None):
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    edges = spark.createDataFrame(redirects, "a string, b string") if redirects is not None else None
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(df, URL_RULES, edges).collect()}


def link(href):
    return f'<html><head><link href="{href}" rel="canonical"></head></html>'


def test_rules_and_odd_urls(spark):
    got = verdicts(
        spark,
        [
            (1, "http://A.B.Example.NET/en/x?q=1#f", "", "z"),
            (2, "http://notexample.net/en/", "", None),
            (3, "https://example.com/de/1", None, None),
            (4, "https://example.com/fr/1", None, None),
            (5, None, None, None),
            (6, "mailto:x@example.net", None, None),
            (7, "http://x.net", None, None),
            (8, "http://m.org/fr/a://b/?c", None, None),
            (9, "", "", ""),
            (None, "http://q.net/", None, None),
        ],
    )
    assert got[1] == ("a.b.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("notexample.net", "/en/", "net/", "block")
    assert got[3][2:] == ("example.com/de/", "block")
    assert got[4][2:] == (None, "allow")
    assert got[5] == got[6] == got[9] == ("", "", None, "allow")
    assert got[7] == ("x.net", "", None, "allow")  # an empty path starts with no slash
    assert got[8] == ("m.org", "/fr/a://b/", "org/fr/", "allow")
    assert got[None][3] == "block"


def test_blocks_reach_aliases_unless_allowed(spark):
    pages = [
        (1, "http://a.com/1", link("http://bad.net/x"), None),  # alias of a blocked URL that is no page
        (2, "http://a.com/2#frag", link("/1"), None),  # and its alias, by a relative link
        (3, "http://b.com/1", '<meta http-equiv="refresh" content="0; url=//bad.net/y">', None),
        (4, "http://b.com/2", link("http://b.com/1"), None),
        (5, "http://c.org/fr/ok", link("http://b2.com/z"), None),
        (6, "http://b2.com/z", link("http://worse.net/"), None),  # allowed and blocked in one component
        (7, "http://worse.net/", "", None),
        (8, "http://d.com/", link("http://d.com/other"), None),
        (1, "http://a.com/1", link("http://bad.net/x"), None),
    ]
    got = verdicts(spark, pages)
    assert [got[i][3] for i in range(1, 9)] == ["block", "block", "block", "block", "allow", "allow", "block", "allow"]
    assert verdicts(spark, [(9, "http://e.com/", None, None)], [("http://e.com/", "http://bad.net/"), (None, "x")])[9][3] == "block"


def test_no_rows(spark):
    assert verdicts(spark, []) == {}

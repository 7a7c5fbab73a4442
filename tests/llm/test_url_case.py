from test_url_filters import link, verdicts


def test_alias_that_differs_only_in_host_case(spark):
    rows = [
        (1, "http://EXAMPLE.org/kept?Q=1", "", None),
        (2, "http://blocked.net/", link("HTTP://example.ORG/kept?Q=1#x"), None),
        (3, "http://example.org/KEPT?Q=1", "", None),  # paths keep their case
    ]
    got = verdicts(spark, rows)
    assert [got[i][3] for i in (1, 2, 3)] == ["block", "block", "allow"]
    assert verdicts(spark, rows[:1] + rows[2:], [("http://blocked.net/", "http://Example.org/kept?Q=1")])[1][3] == "block"


BAD = "http://bad.net/x"
#: (page's url, html, is an alias of BAD)
FORMS = [
    ("http://a.com/1", f'<link rel="nofollow canonical" href="{BAD}">', True),
    ("http://a.com/2", f"<LINK HREF={BAD} REL=Canonical>", True),
    ("http://a.com/3", f'<!-- <link rel="canonical" href="{BAD}"> -->', False),
    ("http://a.com/4", f'<!-- open <link rel="canonical" href="{BAD}">', False),
    ("http://a.com/5", f'<link rel="stylesheet" href="/s.css"><link rel="canonical" href="/5"><link rel=\'canonical\' href=\'{BAD}\'>', True),
    ("http://a.com/6", f'<link rel="canonicals" href="{BAD}">', False),
    ("http://a.com/7", f'<link data-rel="canonical" href="{BAD}">', False),
    ("http://bad.net/p/q", '<link rel="canonical" href="../r/./s/../t">', None),
    ("http://a.com/8", '<link rel="canonical" href="http://BAD.net/r/t">', True),
    ("http://a.com/9", f'<meta http-equiv="refresh" content="0;url=\'{BAD}\'">', True),
    ("http://a.com/10", f'<meta content="5, {BAD}" http-equiv=Refresh>', True),
    ("http://a.com/11", '<meta http-equiv="refresh" content="5">', False),
    ("http://a.com/12", f'<meta name="refresh" content="0; url={BAD}">', False),
    ("http://a.com/13", '<link rel="canonical" href="#top">', False),
    ("http://a.com/14", '<link rel="canonical" href="//bad.net/x/../x">', True),
    ("http://a.com/15?a=1&b=2", "", True),
    ("http://bad.net/z", '<link rel="canonical" href="http://a.com/q/../15?a=1&amp;b=2">', None),
    ("http://a.com/./16/..", f'<link rel="canonical" href="{BAD}">', True),
    ("http://a.com/", "<p>", True),
    ("http://a.com/17", "x" * 300_000 + f'<link rel="canonical" href="{BAD}">' + "y" * 300_000, True),
    (None, f'<link rel="canonical" href="{BAD}">', False),
    ("http://a.com/18", None, False),
]


def test_forms_of_links(spark):
    got = verdicts(spark, [(i, u, h, None) for i, (u, h, _) in enumerate(FORMS)])
    assert {i: got[i][3] for i in got} == {i: "allow" if bad is False else "block" for i, (_, _, bad) in enumerate(FORMS)}


def test_sql_reads_the_same_forms(spark, tmp_path):
    import oracle

    from shelfspark.llm import queries

    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(FORMS)], "page_id long, url string, html string")
    df.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert oracle.difference(queries.op1_url_redirects(spark, str(tmp_path)), con, queries.oracle_sql()["op1_url_redirects"]) == ""


def test_a_large_component_and_a_deep_chain(spark):
    """100,000 aliases of one page, and a chain 3,000 links long from its blocked end."""
    from pyspark.sql import functions as F

    from shelfspark.llm import url_filters as U
    from shelfspark.llm.queries import URL_RULES

    n, m = 100_000, 3_000
    star = spark.range(n).select(F.concat(F.lit("http://s.com/"), "id").alias("a"), F.lit("http://bad.net/hub").alias("b"))
    chain = spark.range(m).select(F.concat(F.lit("http://c.com/"), "id").alias("a"), F.concat(F.lit("http://c.com/"), F.col("id") + 1).alias("b"))
    end = spark.createDataFrame([(f"http://c.com/{m}", "http://bad.net/end")], "a string, b string")
    urls = spark.range(0, n, 997).select(F.concat(F.lit("http://s.com/"), "id").alias("url"))
    urls = urls.union(spark.range(0, m, 100).select(F.concat(F.lit("http://c.com/"), "id").alias("url"))).union(spark.createDataFrame([("http://s.com/no",)], "url string"))
    pages = urls.select(F.xxhash64("url").alias("page_id"), "url", F.lit("").alias("html"))
    got = U.filter_urls(pages, URL_RULES, star.union(chain).union(end)).select("path", "verdict").collect()
    assert {r.path for r in got if r.verdict == "allow"} == {"/no"} and len(got) > 130

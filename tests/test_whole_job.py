"""Operators and queries against the whole of what they are asked for."""

import oracle
import pytest
from test_operators import frame

from shelfspark.operators import memories, vectors
from shelfspark.plans import catalogue
from shelfspark.sources.library import Documents

MEDIUM = "/root/testdata/sf0.01"


def test_runs_count_every_rating(spark):
    # Thu-Fri-Sat of any rating; a gap; Sat-Sun too few; a gap; five days in a row, cut after four; one in the trash
    days = ["2024-06-06", "2024-06-07", "2024-06-08"] * 2 + ["2024-06-15", "2024-06-16"] + ["2024-06-21", "2024-06-22", "2024-06-23", "2024-06-24", "2024-06-25"] * 2
    rows = [{"id": str(i), "captured_at": d, "rating": i % 5} for i, d in enumerate(days)]
    t = catalogue.Orders(spark, "")
    t.assets = frame(spark, rows + [{"id": "gone", "captured_at": "2024-06-15", "rating": 5, "deleted_at": "2024-07-01"}])
    runs = [(str(r.start_day), str(r.end_day), r.total) for r in catalogue._runs(t).orderBy("start_day").collect()]
    assert runs == [("2024-06-06", "2024-06-08", 6), ("2024-06-21", "2024-06-24", 8)]


@pytest.mark.parametrize("name", ["weekend_runs", "weekend_assets"])
def test_runs_of_every_rating_equal_sql(spark, name):
    con = oracle.connect(MEDIUM)
    assert oracle.difference(catalogue.queries()[name](spark, MEDIUM), con, catalogue.oracle_sql()[name]) == ""


def test_captions_are_whole_first_lines(spark):
    con = oracle.connect(MEDIUM)
    assert max(len(r.caption) for r in Documents(spark, MEDIUM).asset_captions.collect()) > 200
    for name in ("search_text", "memory_quote"):
        assert oracle.difference(catalogue.queries()[name](spark, MEDIUM), con, catalogue.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", ["semantic_search", "blended_search"])
def test_every_query_equals_sql(spark, name):
    con, got = oracle.connect(MEDIUM), catalogue.queries()[name](spark, MEDIUM)
    assert oracle.difference(got, con, catalogue.oracle_sql()[name]) == ""
    assert {r.query_id for r in got.select("query_id").distinct().collect()} == {0, 100, 200, 300, 400}


def test_search_each_equals_single_searches(spark):
    e = spark.read.parquet(f"{MEDIUM}/embeddings.parquet").selectExpr("cast(vec_id as string) as asset_id", "embedding as vector", "vec_id as query_id").cache()
    queries = e.where("query_id % 100 = 0").select("query_id", "vector")
    odd = e.select("asset_id", "vector").union(spark.createDataFrame([("short", [1.0]), ("copy", e.where("query_id = 0").first().vector), ("none", None)], "asset_id string, vector array<float>"))
    want = {(q.query_id, r.id, r.score) for q in queries.collect() for r in vectors.semantic_search(odd, list(q.vector), 20).collect()}
    for few in (5, 4):  # sent to the tasks, or joined in tiles
        assert {(r.query_id, r.id, r.score) for r in vectors.search_each(odd, queries, 20, block=2, few=few).collect()} == want


def test_every_key_is_taken(spark):
    con, orders = oracle.connect(MEDIUM), spark.read.parquet(f"{MEDIUM}/orders.parquet").count()
    for name in ("upsert_assets", "prune_roots"):
        assert oracle.difference(catalogue.queries()[name](spark, MEDIUM), con, catalogue.oracle_sql()[name]) == ""
    assert sum(r.n for r in catalogue.queries()["upsert_assets"](spark, MEDIUM).collect()) == orders


def test_diversify_takes_the_whole_group(spark):
    # 450 near copies of the highest base, and distinct ones of lower base, which are better than a second copy
    rows = [(1, f"a{i:03d}", 10.0, [1.0, 0.0, 0.0]) for i in range(450)] + [(1, "b", 5.0, [0.0, 1.0, 0.0]), (1, "c", 4.0, [0.0, 0.0, 1.0])]
    cand = spark.createDataFrame(rows, "k int, id string, base double, vector array<double>")
    order = lambda **most: [r.id for r in memories.diversify(cand, "k", 3, **most).orderBy("pos").collect()]
    assert order() == ["a000", "b", "c"]
    assert order(most=400) == ["a000", "a001", "a002"]

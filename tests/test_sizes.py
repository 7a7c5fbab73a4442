"""A task's work and memory don't follow the size of the input."""

import oracle
from oracle import SMALL
from pyspark.sql import functions as F

from shelfspark.operators import geo, memories, people, vectors
from shelfspark.plans import catalogue
from shelfspark.sources import library
from shelfspark.sources.library import Orders


def test_coordinates_look_once(spark, monkeypatch):
    cities = spark.createDataFrame([("a", "r", "c", 10.0, 10.0), ("b", "r", "c", -40.0, 100.0)], "city string, region string, cc string, lat double, lon double")
    points = spark.range(2000).selectExpr("cast(id as string) as id", "cast(id % 5 * 9 as double) as lat", "cast(id % 5 * 30 as double) as lon")
    tables = {}
    write = geo.write_table
    monkeypatch.setattr(geo, "write_table", lambda df, name: tables.setdefault(name, []).append(write(df, name)) or tables[name][-1])
    got = {r.id: tuple(r)[1:] for r in geo.nearest_place(points, cities, per_task=2).collect()}
    assert len(got) == 2000 and tables["coordinates"][0].count() == 5 and sum(p.count() for p in tables["places"]) == 5
    assert got == {r.id: tuple(r)[1:] for r in geo.nearest_place(points, cities).collect()}
    assert geo.nearest_place(points.where("false"), cities).count() == 0 == geo.nearest_place(points, cities.where("false")).count()


def test_only_the_best_captions_are_read_as_quotes(spark, monkeypatch):
    plan = spark.range(3).select(memories.usable_quote(F.col("id").cast("string")).alias("q"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1  # stripped once, not for each length
    seen = []
    monkeypatch.setattr(memories, "quotes", lambda ranked, captions, key: seen.append(ranked) or ranked)
    catalogue.queries()["memory_quote"](spark, SMALL)
    assert "WindowGroupLimit" in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_faces_are_dealt_by_the_rows_of_the_input(spark, monkeypatch):
    """Also where persons and places meet: one shuffle by asset, whose width follows the rows."""
    monkeypatch.setattr(library, "ROWS_A_TASK", 1000)
    t = Orders(spark, SMALL)
    assert t.tasks("lineitem") > 4 and t.faces.rdd.getNumPartitions() == t.tasks("lineitem")
    for name in ("memories_person_place", "memories", "prose_cache"):
        assert oracle.difference(catalogue.queries()[name](spark, SMALL), oracle.connect(SMALL), catalogue.oracle_sql()[name]) == ""


def test_journal_is_replayed_in_tasks_by_the_rows_of_the_input(spark, monkeypatch):
    monkeypatch.setattr(library, "ROWS_A_TASK", 100)
    df = catalogue.queries()["journal_replayed"](spark, SMALL)
    assert df.rdd.getNumPartitions() == Orders(spark, SMALL).tasks("orders") > 4
    assert oracle.difference(df, oracle.connect(SMALL), catalogue.oracle_sql()["journal_replayed"]) == ""


def test_dealt_boxes_are_shuffled_once(spark):
    boxes = spark.range(3000).selectExpr("cast(id % 700 as string) as asset_id", "cast(id as string) as id", "cast(id % 5 * 9 as double) as x", "cast(id % 3 * 7 as double) as y", "40.0D as w", "if(id % 11 = 0, 0.0D, 40.0D) as h", "id * 31 % 10 / 10.0D as score")
    want = sorted(map(tuple, vectors.nms(boxes).collect()))
    dealt = vectors.nms(vectors.dealt_boxes(boxes, 3000, 100, 500))
    assert sorted(map(tuple, dealt.collect())) == want and len(want) > 700
    again = vectors.nms(vectors.dealt_boxes(boxes, 3000, 100, 500))
    assert again._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_person_stats_come_from_parts_of_a_person(spark):
    faces = spark.range(5000).selectExpr("cast(id as string) as id", "cast(pow(id % 7, 2) as string) as person_id", "id % 4 / 4.0D as score", "if(id % 3 = 0, '', '/c') as crop_path")
    got = people.person_stats(faces, 9)
    assert "hashpartitioning(person_id" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "_part" in plan and ", 9)" in plan
    rows = faces.collect()
    want = {p: (len(own), min((r.crop_path == "", -r.score, r.id) for r in own)[2]) for p in {r.person_id for r in rows} for own in [[r for r in rows if r.person_id == p]]}
    assert {r.person_id: (r.face_count, r.cover_face_id) for r in got.collect()} == want == {r.person_id: (r.face_count, r.cover_face_id) for r in people.person_stats(faces).collect()}

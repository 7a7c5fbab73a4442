"""Nearest places against all distances."""

import math
import random

import oracle
from oracle import SMALL

from shelfspark.operators import geo
from shelfspark.plans import catalogue


def km(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(x)))


def frames(spark, cities, points):
    c = spark.createDataFrame(cities, "city string, region string, cc string, lat double, lon double")
    return spark.createDataFrame(points, "id string, lat double, lon double"), c


def test_against_all_distances(spark):
    rng = random.Random(6)
    spot = lambda: (math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180))
    cities = [(f"c{i}", f"r{i % 7}", "X", *spot()) for i in range(300)] + [(f"d{i}", "", "", 48 + rng.random(), 2 + rng.random()) for i in range(200)]
    cities += [("north", "", "N", 90.0, 0.0), ("date", "", "D", 0.0, 180.0), ("line", "", "D", 0.0, -180.0), ("lost", "", "", None, 3.0), cities[0]]
    points = [(f"p{i}", *spot()) for i in range(300)] + [("pole", -90.0, 12.0), ("west", 0.0, -179.99), ("paris", 48.5, 2.5), ("none", None, 1.0), ("exact", cities[4][3], cities[4][4])]
    got = {r.id: (r.place_label, round(r.km, 5)) for r in geo.nearest_place(*frames(spark, cities, points)).collect()}
    known = [c for c in cities if c[3] is not None]
    for i, lat, lon in points:
        if lat is None:
            assert i not in got
            continue
        d, name = min((round(km(lat, lon, c[3], c[4]), 6), ", ".join(x for x in c[:2] if x)) for c in known)
        assert got[i] == (name, round(d, 5))


def test_no_nested_loop(spark):
    rng = random.Random(7)
    cities = [(f"c{i}", "", "", rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(500)]
    points, gazetteer = frames(spark, cities, [(str(i), rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(50)])
    tracked = []
    real = geo.write_table
    geo.write_table = lambda df, name: tracked.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name)
    try:
        assert geo.nearest_place(points, gazetteer).count() == 50
    finally:
        geo.write_table = real
    assert tracked and not any("NestedLoop" in p or "Cartesian" in p for p in tracked)


def test_no_places(spark):
    points, none = frames(spark, [], [("a", 1.0, 2.0)])
    assert geo.nearest_place(points, none).count() == 0 and geo.nearest_place(points.limit(0), none).count() == 0


def test_label_and_country_equal_sql(spark):
    for sf in (SMALL, "/root/testdata/sf0.01"):
        assert oracle.difference(catalogue.queries()["geo_label"](spark, sf), oracle.connect(sf), catalogue.oracle_sql()["geo_label"]) == ""

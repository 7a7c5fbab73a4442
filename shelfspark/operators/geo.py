"""Places of coordinates."""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.predicates import dms
from shelfspark.sources.work import write_table

EARTH_KM = 6371.0


def gps_normalise(raw: DataFrame) -> DataFrame:
    """(id, lat, lon) from raw(id, lat_d, lat_m, lat_s, lat_ref, lon_d, ...); out of range and (0, 0) are left out."""
    side = lambda p: dms(F.col(f"{p}_d"), F.col(f"{p}_m"), F.col(f"{p}_s"), F.col(f"{p}_ref"))
    rows = raw.select("id", side("lat").alias("lat"), side("lon").alias("lon"))
    return rows.where("lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0)")


def kilometres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def label(city: Column, region: Column) -> Column:
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    out = F.concat_ws(", ", some(city), some(region))
    return F.when(out != "", out)


FIRST_CELL, WIDER = 1 / 64, 4  # of the unit sphere: about 100 km


def _on_sphere(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """df with x, y, z of its place on the unit sphere."""
    a, b = F.radians(lat), F.radians(lon)
    return df.withColumns({"x": F.cos(a) * F.cos(b), "y": F.cos(a) * F.sin(b), "z": F.sin(a)})


def _cell(side: float) -> list[Column]:
    return [F.floor(F.col(c) / side).cast("int") for c in "xyz"]


def nearest_place(points: DataFrame, gazetteer: DataFrame, side: float = FIRST_CELL, per_task: int = 5_000) -> DataFrame:
    """(id, place_label, country, km) of the nearest of gazetteer(city, region, cc, lat, lon); of equally near ones (to the millimetre) the first label.

    Both lie on the unit sphere, which is cut into cubes.  A point meets the
    places of its cube and of the 26 around it, an equi-join; one that is at
    most a cube's side away is the nearest for sure, for all outside are
    farther.  The other points look again in cubes of four times the side,
    until a cube's side is the sphere's width; few are left for the wide cubes.
    Each pair of coordinates looks once, for all points that have it; pairs are
    dealt in tasks of about per_task, so that a task compares no more for a larger input.
    Points without coordinates are left out, and so are all if there is no place.
    """
    cities = gazetteer.select(label(F.col("city"), F.col("region")).alias("place_label"), F.when(F.trim("cc") != "", F.trim("cc")).alias("country"), F.col("lat").alias("clat"), F.col("lon").alias("clon"))
    cities = _on_sphere(cities.where("clat is not null and clon is not null").distinct(), "clat", "clon")
    points = points.where("lat is not null and lon is not null").select("id", "lat", "lon").distinct()
    left = write_table(points.select("lat", "lon").distinct(), "coordinates")
    found: list[DataFrame] = []
    while n := left.count():
        whole = side >= 2.0
        keys = ["cx", "cy", "cz"]
        placed = cities.select("place_label", "country", "clat", "clon", *[c.alias(k) for c, k in zip(_cell(side), keys)])
        around = [F.struct(*[(c + d).alias(k) for c, d, k in zip(_cell(side), step, keys)]) for step in product((-1, 0, 1), repeat=3)]
        dealt = _on_sphere(left.repartition(-(-n // per_task), "lat", "lon"), "lat", "lon")
        near = dealt.select("lat", "lon", F.explode(F.array(*around)).alias("g")).select("lat", "lon", "g.*").join(placed, keys)
        km = kilometres(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))
        best = near.groupBy("lat", "lon").agg(F.min(F.struct(F.round(km, 6).alias("km"), "place_label", "country")).alias("b")).select("lat", "lon", "b.*")
        sure = 2 * EARTH_KM * math.asin(min(1.0, side / 2)) * (1 - 1e-9)
        best = write_table(best if whole else best.where(F.col("km") <= sure), "places")
        found.append(best)
        if whole:
            break
        left = left.join(best.select("lat", "lon"), ["lat", "lon"], "left_anti")
        side = min(2.0, side * WIDER)
    if not found:
        return points.join(cities.select("place_label", "country", F.lit(0.0).alias("km")), F.lit(False)).select("id", "place_label", "country", "km")
    return points.join(reduce(DataFrame.union, found), ["lat", "lon"]).select("id", "place_label", "country", "km")

"""Versioned parts, and the catalogue in months."""

import shutil
from pathlib import Path

import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from shelfspark.operators import ingest
from shelfspark.sources.catalogue import Catalogue, month_of
from shelfspark.sources.library import Orders
from shelfspark.sources.versions import Conflict, Versions


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_change_is_seen_whole_or_not_at_all(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"))
    assert v.current() == (0, {}, {}) and v.read("n long").count() == 0
    one = lambda n: spark.createDataFrame([(n,)], "n long")
    v.begin().put("a", one(1)).put("b", one(2)).commit()
    lost = v.begin().put("a", one(9)).drop("b")  # a writer that is lost before its commit
    assert rows(v.read("n long")) == [(1,), (2,)] and rows(v.read("n long", ["b", "none"])) == [(2,)]
    v.begin().add("a", one(3)).commit()
    assert rows(v.read("n long", ["a"])) == [(1,), (3,)]
    with pytest.raises(Conflict):
        lost.commit()
    assert rows(v.read("n long")) == [(1,), (2,), (3,)]
    assert v.vacuum() == 1 and v.numbers() == [2]
    assert rows(Versions(spark, str(tmp_path / "t")).read("n long")) == [(1,), (2,), (3,)]


def test_a_failed_task_leaves_nothing_to_see(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "t"))
    v.begin().put("a", spark.range(3).toDF("n")).commit()
    bad = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("n"))
    with pytest.raises(Exception, match="lost"):
        v.begin().put("a", bad).commit()
    assert rows(v.read("n long")) == [(0,), (1,), (2,)]


@pytest.fixture
def library(spark, tmp_path):
    assets = Orders(spark, SMALL).assets
    c = Catalogue(spark, str(tmp_path / "c"), assets.schema)
    c.create(assets)
    return assets, c


def only(c, months):
    """Move away the data of all other months: what reads or needs them fails."""
    for part, paths in c.versions.current()[1].items():
        if part.startswith("month=") and part[6:] not in months:
            for p in paths:
                shutil.rmtree(Path(c.versions.folder.removeprefix("file:"), "data", p))


def test_catalogue_equals_its_assets(spark, library):
    assets, c = library
    assert rows(c.read()) == rows(assets) and len(c.months()) > 20
    some = c.months()[3]
    assert rows(c.read([some])) == rows(assets.where(month_of(F.col("captured_at"), F.col("created_at")) == some))


def test_upsert_leaves_other_months_unread(spark, library):
    assets, c = library
    month = month_of(F.col("captured_at"), F.col("created_at"))
    old = assets.where(month == c.months()[5]).orderBy("id").limit(2).collect()
    files = [(old[0].path, "newhash", "image", 5), (old[1].path, old[1].hash, "image", 6), ("/new/x.jpg", "h", "image", 7)]
    df = spark.createDataFrame(files, "path string, hash string, media_type string, file_size long").withColumn("created_at", F.lit("1777-03-04").cast("timestamp_ntz"))
    want = ingest.upsert(assets, df, "2024-03-02")
    told = ingest.import_result(want).first().asDict()
    want = rows(want.drop("outcome").where(month.isin(c.months()[5], "1777-03")))
    only(c, [c.months()[5]])
    assert c.upsert(df, "2024-03-02") == told == {"scanned": 3, "inserted": 1, "updated": 1, "skipped": 1}
    assert rows(c.read([c.months()[6], "1777-03"])) == want  # 1777 comes first now
    assert c.find("path", spark.createDataFrame([("/new/x.jpg",)], "key string")).first().month == "1777-03"


def test_trash_by_ids(spark, library):
    assets, c = library
    month = month_of(F.col("captured_at"), F.col("created_at"))
    some = c.months()[7]
    ids = assets.where((month == some) & F.col("deleted_at").isNull()).select("id").orderBy("id").limit(3)
    ids = spark.createDataFrame(ids.collect() + [("nobody",)], "id string")
    before = rows(c.read([some]))
    only(c, [some])
    c.soft_delete(ids, "2024-05-01")
    assert c.read([some]).where("deleted_at = timestamp_ntz'2024-05-01'").count() == 3
    c.restore(ids)
    assert rows(c.read([some])) == before
    c.delete(ids)
    assert c.read([some]).count() == len(before) - 3
    n = c.versions.current()[0]
    assert c.delete(spark.createDataFrame([("nobody",)], "id string")) == n
    c.delete(c.read([some]).select("id"))
    assert some not in c.months()

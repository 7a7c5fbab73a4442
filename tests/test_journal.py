"""Journal, retained history and exports as versions."""

import pytest
from pyspark.sql import functions as F
from test_operators import frame

from shelfspark.functions.actions import Journal
from shelfspark.operators import ingest
from shelfspark.sources import files
from shelfspark.sources.versions import Versions


def ratings(df):
    return {r.id: r.rating for r in df.collect()}


def test_stacks_survive_a_restart(spark, tmp_path):
    a = frame(spark, [{"id": "1", "rating": 1}, {"id": "2", "rating": 2}])
    folder = str(tmp_path / "j")
    for ids, value in ((["1"], 3), (["1", "2"], 4), (["2"], 5)):
        change = ingest.set_value(a, ids, "rating", value)
        Journal(spark, folder).record("rating", change)
        a = ingest.apply_values(a, change, "rating")
    assert ratings(a) == {"1": 4, "2": 5} and Journal(spark, folder).stacks() == ([1, 2, 3], [])
    a = Journal(spark, folder).undo(a)
    assert ratings(a) == {"1": 4, "2": 4}
    a = Journal(spark, folder).undo(a)
    assert ratings(a) == {"1": 3, "2": 2} and Journal(spark, folder).stacks() == ([1], [3, 2])
    a = Journal(spark, folder).redo(a)
    assert ratings(a) == {"1": 4, "2": 4} and Journal(spark, folder).stacks() == ([1, 2], [3])
    Journal(spark, folder).record("favorite", ingest.set_value(a, ["1"], "favorite", True))
    assert Journal(spark, folder).stacks() == ([1, 2, 4], [])  # a new entry clears what was undone
    assert set(Versions(spark, folder).current()[1]) == {"entry=1", "entry=2", "entry=4"}
    assert ratings(Journal(spark, folder).redo(a)) == ratings(a)


def test_entries_that_cannot_be_applied_are_dropped(spark, tmp_path):
    a = frame(spark, [{"id": "1", "rating": 1}, {"id": "2", "rating": 2}, {"id": "3", "rating": 3, "deleted_at": "2024-01-01"}])
    j = Journal(spark, str(tmp_path / "j"))
    j.record("rating", ingest.set_value(a, ["1"], "rating", 4))
    j.record("rating", ingest.set_value(a, ["1", "2"], "rating", 5))
    j.record("deleted_at", spark.createDataFrame([("3", None, "2024-01-01")], "id string, before string, after string"), needs="trashed")
    j.record("rating", spark.createDataFrame([], "id string, before string, after string"))
    left = a.where("id <> '2'")
    assert j.prune(left) == 2 and j.stacks() == ([1, 3], [])  # not all its assets are there; no assets
    assert j.undo(left).where("id = '3'").first().deleted_at is None
    assert ratings(j.undo(left)) == {"1": 1, "3": 3} and j.stacks() == ([], [3, 1])
    assert ratings(j.undo(left)) == {"1": 1, "3": 3}  # nothing to undo: as it is


def test_history_keeps_the_last_records(spark, tmp_path):
    folder, schema = str(tmp_path / "h"), "at long, what string"
    rec = lambda *rows: spark.createDataFrame(rows, schema)
    assert files.kept_history(spark, folder, schema).count() == 0
    files.append_history(rec(*[(i, f"r{i}") for i in range(150)]), folder)
    files.append_history(rec(*[(150 + i // 60, f"s{i:03d}") for i in range(120)]), folder)
    got = [tuple(r) for r in files.kept_history(spark, folder, schema).collect()]
    want = sorted([(i, f"r{i}") for i in range(150)] + [(150 + i // 60, f"s{i:03d}") for i in range(120)], reverse=True)[:200]
    assert got == want
    bad = rec((999, "x")).withColumn("what", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        files.append_history(bad, folder)
    assert [tuple(r) for r in files.kept_history(spark, folder, schema).collect()] == want


def test_export_counts(spark, tmp_path):
    a = frame(spark, [{"id": "1", "path": "/a"}, {"id": "2", "path": "/b"}, {"id": "3", "path": "/c", "deleted_at": "2024-01-01"}, {"id": "4", "path": "/d"}])
    there = spark.createDataFrame([("/a",), ("/a",), ("/c",), ("/d",)], "path string")
    manifest = files.export_manifest(a, spark.createDataFrame([("1",), ("2",), ("3",), ("1",), ("no",)], "id string"), there)
    assert files.export_to(manifest, str(tmp_path / "e")) == {"exported": 1, "missing": 1}
    v = Versions(spark, str(tmp_path / "e"))
    assert v.current()[2] == {"exported": 1, "missing": 1}
    assert sorted(map(tuple, v.read("id string, path string, status string").collect())) == [("1", "/a", "exported"), ("2", "/b", "missing")]
    with pytest.raises(Exception, match="lost"):
        files.export_to(manifest.withColumn("status", F.raise_error(F.lit("lost")).cast("string")), str(tmp_path / "e"))
    assert v.numbers() == [1]


def test_unsupported_file_is_an_error(spark, tmp_path):
    for n in ("a.jpg", "b.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert files.scan(spark, [str(tmp_path)]).count() == 1 == files.scan(spark, [str(tmp_path / "a.jpg")]).count()
    with pytest.raises(ValueError, match="b.txt"):
        files.scan(spark, [str(tmp_path / "a.jpg"), str(tmp_path / "b.txt")])

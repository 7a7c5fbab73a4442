import datetime as dt
import json

from oracle import SMALL
from pyspark.sql import functions as F

from shelfspark.sources import files
from shelfspark.sources.library import Orders
from shelfspark.streaming import ingest


def test_scan_and_history(spark, tmp_path):
    for name, data in (("a.jpg", b"1"), ("sub/b.MOV", b"22"), ("sub/._a.jpg", b"3"), ("c.txt", b"4"), ("skip/d.png", b"5")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data)
    got = {r.path.removeprefix(str(tmp_path)): (r.file_size, r.media_type) for r in files.scan(spark, [str(tmp_path)], ["/skip/"]).collect()}
    assert got == {"/a.jpg": (1, "image"), "/sub/b.MOV": (2, "video")}
    assert files.scan_hashed(spark, [str(tmp_path / "sub")]).count() == 1  # names with a dot first are hidden files
    log = tmp_path / "log"
    log.mkdir()
    (log / "h.json").write_text("\n".join([json.dumps({"n": i}) for i in range(5)] + ["{broken", json.dumps({"n": 9})]))
    assert [r.n for r in files.read_history(spark, str(log), "n long", 3).collect()] == [9, 4, 3]


def test_catalogue_prunes_months(spark, tmp_path):
    assets = Orders(spark, SMALL).assets
    files.write_catalogue(assets, str(tmp_path / "c"))
    back = files.read_catalogue(spark, str(tmp_path / "c"))
    assert back.count() == assets.count()
    plan = back.where("captured_ym = '1998-03'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(captured_ym" in plan


def test_change_queue(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("/a", "upsert", False, 1), ("/b", "upsert", False, 2), ("/a", "upsert", True, 3)]
    (src / "1.json").write_text("\n".join(json.dumps(dict(zip(("path", "kind", "thumb", "seq"), r))) for r in rows))
    q = ingest.queue_to(ingest.change_events(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [(r.path, r.thumb) for r in got] == [("/b", False), ("/a", True)]


def test_windows_over_a_stream_equal_the_table(spark, tmp_path):
    table = spark.read.parquet(f"{SMALL}/events.parquet")
    table.write.parquet(str(tmp_path / "e"))
    stream = ingest.tumbling(ingest.event_stream(spark, str(tmp_path / "e"), table.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination()
    want = ingest.tumbling(table.withColumn("at", F.col("ts").cast("timestamp")))
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(spark.table("daily")) == key(want)
    assert key(want)[0][0] >= dt.datetime(2023, 12, 31)


def test_progress_of_tables(spark):
    waiting, done = (spark.createDataFrame(rows, "path string, seq long") for rows in ([("/a", 3), ("/b", 4)], [("/x", 1), ("/y", 2)]))
    assert tuple(ingest.progress(waiting, done).first()) == (2, 2, True, "/y")


def test_auto_scan(spark):
    assert ingest.scan_due("on_launch", 0, 5, True) and not ingest.scan_due("on_launch", 0, 10**9, False)
    assert ingest.scan_due("hourly", 0, 3600, False) and not ingest.scan_due("hourly", 1, 3600, False) and not ingest.scan_due("never", 0, 10**9, True)
    assets = Orders(spark, SMALL).assets
    files_ = assets.select("path", "file_size", F.col("indexed_at").alias("modified")).union(spark.sql("select '/new.jpg', 5L, timestamp_ntz'2024-01-01 00:00:00'"))
    jobs = ingest.auto_scan(files_, assets.where("deleted_at is null"), 7)
    assert ("/new.jpg", "upsert", True, 7) in [tuple(r) for r in jobs.collect()] and jobs.count() < 400

"""Structured Streaming: file arrivals, change events, windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfspark.functions.predicates import media_type
from shelfspark.operators.ingest import changed_files, dedup_queue

CHANGE = "path string, kind string, thumb boolean, seq long"


def watch_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Media files that arrive in a folder: path, modified, file_size, media_type.

    File sources do not report removals; those come as change events, or from
    a snapshot compared with the catalogue (``missing_files``).
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    rows = rows.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("file_size"))
    return rows.withColumn("media_type", media_type(F.col("path"))).where("media_type is not null")


def missing_files(assets: DataFrame, files: DataFrame) -> DataFrame:
    """(path) of live assets that a snapshot files(path) does not show."""
    return assets.where("deleted_at is null").join(files.select("path"), "path", "left_anti").select("path")


def change_events(spark: SparkSession, folder: str) -> DataFrame:
    """Change events, JSON lines of (path, kind upsert or remove, thumb, seq)."""
    return spark.readStream.schema(CHANGE).json(folder)


def queue_to(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's deduplicated jobs; a batch that is replayed overwrites itself."""

    def write(batch: DataFrame, n: int) -> None:
        dedup_queue(batch).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(waiting: DataFrame, done: DataFrame) -> DataFrame:
    """(pending, processed, running, last_path) of waiting(path, seq) and done(path, seq)."""
    w = waiting.agg(F.count(F.lit(1)).alias("pending"))
    d = done.agg(F.count(F.lit(1)).alias("processed"), F.max_by("path", "seq").alias("last_path"))
    return w.crossJoin(d).select("pending", "processed", (F.col("pending") > 0).alias("running"), "last_path")  # one row each


SCAN_EVERY = {"hourly": 3600, "daily": 24 * 3600}


def scan_due(mode: str, last: int, now: int, launched: bool) -> bool:
    """Whether a library is scanned again: at launch, or hourly or daily after the last scan (seconds)."""
    if mode == "on_launch":
        return launched
    return mode in SCAN_EVERY and now - last >= SCAN_EVERY[mode]


def auto_scan(files: DataFrame, assets: DataFrame, seq: int = 0) -> DataFrame:
    """Jobs (path, kind, thumb, seq) of a scan: an upsert for each file that is new or has changed."""
    return changed_files(files, assets).select("path", F.lit("upsert").alias("kind"), F.lit(True).alias("thumb"), F.lit(seq).cast("long").alias("seq"))


# -- extensions over the events table --------------------------------------


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """events as a stream with a UTC event time."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value) of each window; works on a stream and on a table."""
    rows = events.withWatermark("at", late) if events.isStreaming else events
    out = rows.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of runs of a user's events without a longer gap."""
    rows = events.withWatermark("at", late) if events.isStreaming else events
    out = rows.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")

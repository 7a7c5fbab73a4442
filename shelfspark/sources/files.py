"""File sources and sinks: scans, JSON lines with retention, exports, the catalogue itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.predicates import media_type
from shelfspark.operators.ingest import media_files
from shelfspark.sources.versions import Versions
from shelfspark.sources.work import drop_table, write_table


def _supported(spark: SparkSession, roots: list[str]) -> None:
    """A root that is a file must be media: a folder's other files are passed over, one that is asked for by name is an error."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    paths = [hadoop.Path(r) for r in roots]
    named = [r for r, p in zip(roots, paths) if (fs := p.getFileSystem(conf)).exists(p) and fs.getFileStatus(p).isFile()]
    if named:
        kinds = spark.createDataFrame([(r,) for r in named], "path string").select("path", media_type(F.col("path")).alias("kind"))
        bad = [r["path"] for r in kinds.where("kind is null").collect()]
        if bad:
            raise ValueError(f"not a supported media file: {', '.join(sorted(bad))}")


def scan(spark: SparkSession, roots: list[str], patterns: list[str] | None = None) -> DataFrame:
    """Media files below the roots: path, file_size, modified, media_type; contents are not read."""
    _supported(spark, roots)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    rows = rows.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("file_size"), F.col("modificationTime").cast("timestamp_ntz").alias("modified"))
    return media_files(rows, patterns)


def scan_hashed(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, hash): SHA-256 of each file's content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    return rows.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.sha2("content", 256).alias("hash"))


def read_history(spark: SparkSession, path: str, schema: str, keep: int = 200) -> DataFrame:
    """The last ``keep`` records of JSON lines, newest first; broken lines are skipped."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.withColumn("_at", F.col("_metadata.file_modification_time")).withColumn("_n", F.monotonically_increasing_id())
    return rows.where("_bad is null").orderBy(F.desc("_at"), F.desc("_n")).limit(keep).drop("_bad", "_at", "_n")


def _newest(records: DataFrame, at: str) -> list:
    """Newest first; of one time by the record as JSON, so that the order is total."""
    return [F.desc(at), F.desc(F.to_json(F.struct(*records.columns)))]


def prune_history(records: DataFrame, at: str = "at", keep: int = 200) -> DataFrame:
    """The last ``keep`` records by time."""
    return records.orderBy(*_newest(records, at)).limit(keep)


def append_history(records: DataFrame, folder: str, at: str = "at", keep: int = 200) -> int:
    """Add records to a history of at most ``keep``, as one version: readers see all of them or none."""
    change = Versions(records.sparkSession, folder).begin()
    old = change.versions.read(records.schema)
    return change.put("records", prune_history(old.unionByName(records), at, keep)).commit()


def kept_history(spark: SparkSession, folder: str, schema: str, at: str = "at") -> DataFrame:
    """The records of a history, newest first."""
    rows = Versions(spark, folder).read(schema)
    return rows.orderBy(*_newest(rows, at))


def export_manifest(assets: DataFrame, ids: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, status) of an export of ids(id): exported, or missing where the file is not there."""
    rows = assets.join(ids.select("id").distinct(), "id", "left_semi").where("deleted_at is null")
    rows = rows.join(files.select("path", F.lit(True).alias("_there")).distinct(), "path", "left")
    return rows.select("id", "path", F.when(F.col("_there"), "exported").otherwise("missing").alias("status"))


def export_to(manifest: DataFrame, folder: str) -> dict:
    """Write a manifest(id, path, status, ...) as one version and count it: {exported, missing}.

    The counts are kept with the version; a job that fails leaves no version.
    """
    change = Versions(manifest.sparkSession, folder).begin()
    rows = write_table(manifest, "manifest")
    told = rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("exported", "missing")]).first().asDict()
    change.notes = told
    change.put("manifest", rows.repartitionByRange("id")).commit()
    drop_table(rows)
    return told


def write_catalogue(assets: DataFrame, path: str) -> None:
    """Parquet by month of capture, so that month listings read one folder."""
    month = F.coalesce(F.date_format(F.coalesce("captured_at", "created_at"), "yyyy-MM"), F.lit("unknown"))
    assets.withColumn("captured_ym", month).write.mode("overwrite").partitionBy("captured_ym").parquet(path)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)



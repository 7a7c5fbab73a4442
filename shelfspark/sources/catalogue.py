"""The catalogue in months of capture: changes rewrite the months that they touch.

Beside the months there are two look-up tables, (path, month) and (id, month),
in buckets by hash.  A change reads the buckets of its keys, then the months
found there and those of new rows, and writes these months anew as one version
(``versions``); all other months are neither read nor written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators import ingest
from shelfspark.sources.versions import Versions
from shelfspark.sources.work import drop_table, write_table

BUCKETS = 64
KEYS = ("path", "id")


def month_of(captured: Column, created: Column) -> Column:
    return F.coalesce(F.date_format(F.coalesce(captured, created), "yyyy-MM"), F.lit("unknown"))


class Catalogue:
    def __init__(self, spark: SparkSession, folder: str, schema):
        self.spark, self.schema, self.versions = spark, schema, Versions(spark, folder)

    def read(self, months: list[str] | None = None) -> DataFrame:
        """All assets, or those of some months."""
        _, parts, _ = self.versions.current()
        chosen = [p for p in parts if p.startswith("month=")] if months is None else [f"month={m}" for m in months]
        return self.versions.read(self.schema, chosen)

    def months(self) -> list[str]:
        return sorted(p[6:] for p in self.versions.current()[1] if p.startswith("month="))

    def create(self, assets: DataFrame) -> int:
        change = self.versions.begin()
        change.parts.clear()
        rows = self._monthly(assets)
        change.put_each(rows.repartitionByRange("month", "id"), "month")
        self._put_keys(change, rows)
        return change.commit()

    def _monthly(self, assets: DataFrame) -> DataFrame:
        return assets.withColumn("month", month_of(F.col("captured_at"), F.col("created_at")))

    def _put_keys(self, change, rows: DataFrame) -> None:
        for key in KEYS:
            own = rows.select(F.col(key).alias("key"), "month", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias(f"{key}_bucket"))
            change.put_each(own.repartition(f"{key}_bucket"), f"{key}_bucket", extend=True)

    def find(self, key: str, keys: DataFrame) -> DataFrame:
        """(key, month) of keys(key) that are known, from the buckets that they fall into."""
        buckets = [r[0] for r in keys.select(F.pmod(F.xxhash64("key"), F.lit(BUCKETS))).distinct().collect()]
        return self.versions.read("key string, month string", [f"{key}_bucket={b}" for b in buckets]).join(keys.select("key").distinct(), "key", "left_semi")

    def upsert(self, files: DataFrame, at: str) -> dict:
        """Take in files as ``ingest.upsert`` does; (scanned, inserted, updated, skipped)."""
        change = self.versions.begin()
        keys = files.select(F.col("path").alias("key"))
        known = {r["month"] for r in self.find("path", keys).select("month").distinct().collect()}
        fresh = {r["month"] for r in files.select(month_of(F.lit(None).cast("timestamp_ntz"), F.col("created_at")).alias("month")).distinct().collect()}
        old = self.read(sorted(known | fresh))
        new = write_table(ingest.upsert(old, files, at), "upserted")
        told = ingest.import_result(new).first().asDict()
        rows = self._monthly(new)
        # a month whose rows are all skipped or untouched stays as it is
        touched = [r["month"] for r in rows.where("outcome in ('inserted', 'updated')").select("month").distinct().collect()]
        rows = rows.where(F.col("month").isin(touched))
        change.put_each(rows.drop("outcome").repartitionByRange("month", "id"), "month")
        self._put_keys(change, rows.where("outcome = 'inserted'"))
        change.commit()
        drop_table(new)
        return told

    def change(self, ids: DataFrame, edit: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Rewrite the months of ids(id) as edit(assets of these months, ids) says; an edit moves no row to another month."""
        change = self.versions.begin()
        found = self.find("id", ids.select(F.col("id").alias("key")))
        months = [r["month"] for r in found.select("month").distinct().collect()]
        if not months:
            return change.base
        rows = write_table(self._monthly(edit(self.read(months), ids.select("id").distinct())), "edited")
        left = change.put_each(rows.repartitionByRange("month", "id"), "month")
        for m in months:
            if f"month={m}" not in left:  # its last asset is gone
                change.drop(f"month={m}")
        n = change.commit()
        drop_table(rows)
        return n

    def soft_delete(self, ids: DataFrame, at: str) -> int:
        return self.change(ids, lambda a, k: _marked(a, k, F.coalesce("deleted_at", F.lit(at).cast("timestamp_ntz"))))

    def restore(self, ids: DataFrame) -> int:
        return self.change(ids, lambda a, k: _marked(a, k, F.lit(None).cast("timestamp_ntz")))

    def delete(self, ids: DataFrame) -> int:
        """Remove assets for good; their keys stay in the look-up tables, where they find nothing."""
        return self.change(ids, lambda a, k: a.join(k, "id", "left_anti").select(*a.columns))


def _marked(assets: DataFrame, ids: DataFrame, deleted: Column) -> DataFrame:
    rows = assets.join(ids.withColumn("_hit", F.lit(True)), "id", "left")
    return rows.withColumn("deleted_at", F.when(F.col("_hit"), deleted).otherwise(F.col("deleted_at"))).select(*assets.columns)

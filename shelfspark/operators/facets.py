"""Counts: statistics, facets, timelines, albums, tags, places, coverage, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark import schema as S
from shelfspark.functions.predicates import blank, event_ts, live


def library_stats(assets: DataFrame, albums: DataFrame, tags: DataFrame, watched: int = 0, retention_days: int = S.TRASH_DAYS) -> DataFrame:
    """One row; one pass over assets."""
    alive = F.col("deleted_at").isNull()
    row = assets.agg(
        F.count_if(alive).alias("total_assets"),
        F.count_if(alive & (F.col("media_type") == "image")).alias("total_images"),
        F.count_if(alive & (F.col("media_type") == "video")).alias("total_videos"),
        F.count_if(alive & F.col("favorite")).alias("favorites"),
        F.count_if(~alive).alias("in_trash"),
    )
    for df, name in ((albums, "album_count"), (tags, "tag_count")):
        row = row.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))))  # one row each
    return row.withColumns({"watched_folders": F.lit(watched).cast("long"), "trash_retention_days": F.lit(retention_days).cast("long")})


def facet_ratings(assets: DataFrame) -> DataFrame:
    return live(assets).where("rating > 0").groupBy("rating").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("rating"))


def facet_colors(assets: DataFrame) -> DataFrame:
    return live(assets).where("color_label is not null and color_label <> ''").groupBy("color_label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "color_label")


def timeline_months(assets: DataFrame) -> DataFrame:
    rows = live(assets).select(F.date_format(event_ts(), "yyyy-MM").alias("ym")).where("ym is not null")
    return rows.groupBy(F.substring("ym", 1, 4).cast("int").alias("year"), F.substring("ym", 6, 2).cast("int").alias("month")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("year"), F.desc("month"))


def timeline_days(assets: DataFrame) -> DataFrame:
    day = F.coalesce(F.date_format(event_ts(), "yyyy-MM-dd"), F.lit("unknown"))
    return live(assets).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day"))


def albums_with_counts(albums: DataFrame, album_assets: DataFrame, assets: DataFrame) -> DataFrame:
    """Counts of live members; the cover is the chosen live asset's thumbnail, else the newest member's."""
    alive = live(assets).select(F.col("id").alias("asset_id"), "thumbnail_path", F.coalesce("captured_at", "indexed_at").alias("at"))
    members = album_assets.join(alive, "asset_id").groupBy("album_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("at", "asset_id", "thumbnail_path")).alias("newest"))
    cover = alive.select(F.col("asset_id").alias("cover_asset_id"), F.col("thumbnail_path").alias("cover_thumb"))
    rows = albums.join(members.withColumnRenamed("album_id", "id"), "id", "left").join(cover, "cover_asset_id", "left")
    return rows.select("id", "name", "cover_asset_id", "created_at", F.coalesce("n", F.lit(0)).alias("asset_count"), F.coalesce("cover_thumb", "newest.thumbnail_path").alias("cover_thumbnail_path")).orderBy(F.desc("created_at"), "id")


def synced_covers(albums: DataFrame, album_assets: DataFrame, assets: DataFrame) -> DataFrame:
    """albums with a cover that is a live member, the newest one where it was not."""
    alive = live(assets).select(F.col("id").alias("asset_id"), F.coalesce("captured_at", "indexed_at").alias("at"))
    members = album_assets.join(alive, "asset_id")
    newest = members.groupBy("album_id").agg(F.max_by("asset_id", F.struct("at", "asset_id")).alias("newest"))
    held = members.select(F.col("album_id").alias("id"), F.col("asset_id").alias("cover_asset_id"), F.lit(True).alias("held"))
    rows = albums.join(held, ["id", "cover_asset_id"], "left").join(newest.withColumnRenamed("album_id", "id"), "id", "left")
    return rows.select("id", "name", F.when(F.col("held"), F.col("cover_asset_id")).otherwise(F.col("newest")).alias("cover_asset_id"), "created_at")


def tags_with_counts(tags: DataFrame, asset_tags: DataFrame, assets: DataFrame) -> DataFrame:
    alive = live(assets).select(F.col("id").alias("asset_id"))
    n = asset_tags.join(alive, "asset_id").groupBy("tag_id").agg(F.count(F.lit(1)).alias("n"))
    return tags.join(n.withColumnRenamed("tag_id", "id"), "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("asset_count")).orderBy(F.lower("name"), "id")


def asset_organisation(asset_id: str, albums: DataFrame, album_assets: DataFrame, tags: DataFrame, asset_tags: DataFrame, assets: DataFrame) -> DataFrame:
    """(kind, id, name, asset_count) of the albums and tags of one asset."""
    alive = live(assets).select(F.col("id").alias("asset_id"))

    def part(kind: str, names: DataFrame, members: DataFrame, key: str) -> DataFrame:
        own = members.where(F.col("asset_id") == asset_id).select(key).distinct()
        n = members.join(own, key, "left_semi").join(alive, "asset_id").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        rows = own.join(names.select(F.col("id").alias(key), "name"), key).join(n, key, "left")
        return rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "name", F.coalesce("n", F.lit(0)).alias("asset_count"))

    return part("album", albums, album_assets, "album_id").union(part("tag", tags, asset_tags, "tag_id"))


def places(asset_places: DataFrame, assets: DataFrame) -> DataFrame:
    rows = asset_places.where(~blank(F.col("place_label"))).join(live(assets).select(F.col("id").alias("asset_id"), event_ts().alias("at"), "thumbnail_path"), "asset_id")
    out = rows.groupBy("place_label").agg(F.min("country").alias("country"), F.count(F.lit(1)).alias("asset_count"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.max(F.struct("at", "asset_id", "thumbnail_path")).getField("thumbnail_path").alias("cover_thumbnail_path"))
    return out.orderBy(F.desc("asset_count"), "place_label")


def places_bbox(asset_places: DataFrame, min_lon: float = 12.0, min_lat: float = 8.0) -> DataFrame:
    """One box around all places, at least min_lon by min_lat degrees, inside the world."""
    b = asset_places.agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e")).where("s is not null")
    half = lambda lo, hi, least: F.greatest((F.col(hi) - F.col(lo)) / 2, F.lit(least / 2))
    mid = lambda lo, hi: (F.col(lo) + F.col(hi)) / 2
    y, x = half("s", "n", min_lat), half("w", "e", min_lon)
    return b.select(F.greatest(mid("s", "n") - y, F.lit(-90.0)).alias("south"), F.least(mid("s", "n") + y, F.lit(90.0)).alias("north"), F.greatest(mid("w", "e") - x, F.lit(-180.0)).alias("west"), F.least(mid("w", "e") + x, F.lit(180.0)).alias("east"))


def coverage(assets: DataFrame, done: dict[str, DataFrame]) -> DataFrame:
    """(capability, done, total): total live images; done: distinct live assets in each frame(asset_id)."""
    total = F.broadcast(live(assets).agg(F.count_if(F.col("media_type") == "image").alias("total")))  # one row
    alive = live(assets).select(F.col("id").alias("asset_id"))
    out = None
    for name, rows in done.items():
        part = rows.select("asset_id").distinct().join(alive, "asset_id", "left_semi").agg(F.count(F.lit(1)).alias("done")).crossJoin(total).select(F.lit(name).alias("capability"), "done", "total")
        out = part if out is None else out.union(part)
    return out


def job_failures(jobs: DataFrame, attempts: int = S.MAX_ATTEMPTS) -> DataFrame:
    """(kind, failed, last_error): jobs that won't be tried again."""
    dead = jobs.where((F.col("state") == "failed") & (F.col("attempts") >= attempts))
    error = F.when(F.trim(F.coalesce("error", F.lit(""))) != "", F.struct("updated_at", "asset_id", "error"))
    return dead.groupBy("kind").agg(F.count(F.lit(1)).alias("failed"), F.max(error).getField("error").alias("last_error"))


def pending_assets(assets: DataFrame, jobs: DataFrame, kind: str, output: DataFrame | None, readmit_done: bool = False, limit: int = 500, attempts: int = S.MAX_ATTEMPTS) -> DataFrame:
    """Live images to work on: no output row, and no job, or one that failed less than so often."""
    rows = live(assets).where("media_type = 'image'")
    if output is not None:
        rows = rows.join(output.select(F.col("asset_id").alias("id")), "id", "left_anti")
    j = jobs.where(F.col("kind") == kind).select(F.col("asset_id").alias("id"), "state", "attempts")
    open_ = F.col("state").isNull() | ((F.col("state") == "failed") & (F.col("attempts") < attempts)) | (F.col("state") == "pending")
    if readmit_done:
        open_ = open_ | (F.col("state") == "done")
    return rows.join(j, "id", "left").where(open_).orderBy(F.desc("indexed_at"), "id").limit(limit).select("id", "path")


def duplicate_summary(groups: DataFrame) -> DataFrame:
    """(kind, groups, items) of groups(kind, group_key, id)."""
    return groups.groupBy("kind").agg(F.countDistinct("group_key").alias("groups"), F.count(F.lit(1)).alias("items"))

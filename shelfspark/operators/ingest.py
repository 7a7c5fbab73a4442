"""From files and changes to the catalogue: transforms of one frame into the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark import schema as S
from shelfspark.functions.predicates import ignored, live, media_type, name_of


def media_files(files: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """files(path, ...) that are media and not ignored, once each, with media_type."""
    rows = files.withColumn("media_type", media_type(F.col("path"))).where("media_type is not null")
    return rows.where(~ignored(F.col("path"), patterns or [])).dropDuplicates(["path"])


def media_type_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce(media_type(F.col("path")), F.lit("none")).alias("media_type")).agg(F.count(F.lit(1)).alias("n"))


def changed_files(files: DataFrame, assets: DataFrame) -> DataFrame:
    """files(path, file_size, modified) that are new, of another size, or modified after they were indexed."""
    known = live(assets).select("path", F.col("file_size").alias("_size"), F.col("indexed_at").alias("_at"))
    same = (F.col("file_size") == F.col("_size")) & (F.col("modified") <= F.col("_at"))
    return files.join(known, "path", "left").where(~F.coalesce(same, F.lit(False))).select(*files.columns)


def content_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("hash", F.sha2(content, 256)).drop(content)


def upsert(assets: DataFrame, files: DataFrame, at, skip_content: bool = False) -> DataFrame:
    """assets after files(path, hash, media_type, file_size, created_at), with ``outcome``.

    Same path and hash: skipped.  Same path, other hash: updated, out of the
    trash, favourite and rating kept.  New path: inserted, or with
    skip_content skipped when a live asset has the content; of several new
    files with one content the first by path is inserted then.
    Rows that no file touches have a null outcome.
    """
    new = files.groupBy("path").agg(F.max_by(F.struct(*[c for c in files.columns if c != "path"]), "hash").alias("f"))
    both = assets.withColumn("_old", F.lit(True)).join(new, "path", "full_outer")
    if skip_content:
        held = live(assets).select("hash").distinct().withColumn("_held", F.lit(True))
        first = new.join(assets.select("path"), "path", "left_anti").groupBy(F.col("f.hash").alias("hash")).agg(F.min("path").alias("_first"))
        both = both.join(held.withColumnRenamed("hash", "_h"), F.col("f.hash") == F.col("_h"), "left").join(first.withColumnRenamed("hash", "_h2"), F.col("f.hash") == F.col("_h2"), "left")
        dupe = F.coalesce(F.col("_held"), F.lit(False)) | (F.col("_first") != F.col("path"))
    else:
        dupe = F.lit(False)
    old, got = F.col("_old").isNotNull(), F.col("f").isNotNull()
    outcome = (
        F.when(~got, None)
        .when(old & (F.col("hash") == F.col("f.hash")), "skipped")
        .when(old, "updated")
        .when(F.coalesce(dupe, F.lit(False)), "skipped_content")
        .otherwise("inserted")
    )
    both = both.withColumn("outcome", outcome)
    changed = F.col("outcome").isin("updated", "inserted")
    fresh = {"id": F.sha2("path", 256), "favorite": F.lit(False), "rating": F.lit(0).cast("long"), "created_at": F.col("f.created_at")}
    cols = []
    for c in assets.columns:
        value = F.col(c)
        if c in ("hash", "media_type", "file_size"):
            value = F.when(changed, F.col(f"f.{c}")).otherwise(value)
        elif c == "indexed_at":
            value = F.when(changed, F.lit(at).cast("timestamp_ntz")).otherwise(value)
        elif c == "deleted_at":
            value = F.when(changed, F.lit(None)).otherwise(value)
        elif c in fresh:
            value = F.when(F.col("outcome") == "inserted", fresh[c]).otherwise(value)
        cols.append(value.cast(assets.schema[c].dataType).alias(c))
    return both.select(*cols, "outcome")


def import_result(upserted: DataFrame) -> DataFrame:
    """One row: scanned, inserted, updated, skipped."""
    n = lambda *k: F.count_if(F.col("outcome").isin(*k))
    return upserted.agg(F.count("outcome").alias("scanned"), n("inserted").alias("inserted"), n("updated").alias("updated"), n("skipped", "skipped_content").alias("skipped"))


def soft_delete(assets: DataFrame, ids: list[str], at) -> DataFrame:
    now = F.lit(at).cast("timestamp_ntz")
    return assets.withColumn("deleted_at", F.when(F.col("id").isin(ids) & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at")))


def restore(assets: DataFrame, ids: list[str]) -> DataFrame:
    return assets.withColumn("deleted_at", F.when(~F.col("id").isin(ids), F.col("deleted_at")))


def purge(assets: DataFrame, as_of: str, days: int = S.TRASH_DAYS) -> DataFrame:
    """(id) of the assets deleted over so many days before as_of."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return assets.where(F.col("deleted_at") < cutoff).select("id", "path", "thumbnail_path")


def permanent_delete(assets: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """(assets that stay, thumbnails to remove: those no asset that stays refers to)."""
    gone, stay = assets.where(F.col("id").isin(ids)), assets.where(~F.col("id").isin(ids))
    thumbs = gone.where("thumbnail_path is not null").select("thumbnail_path").distinct()
    return stay, thumbs.join(stay.select("thumbnail_path"), "thumbnail_path", "left_anti")


def cascade(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """rows(asset_id, ...) whose asset is still there."""
    return rows.join(assets.select(F.col("id").alias("asset_id")), "asset_id", "left_semi")


def set_value(assets: DataFrame, ids: list[str], column: str, value) -> DataFrame:
    """(id, before, after) for an undo, of the assets that are there; ratings are 0 to 5."""
    if column == "rating" and not 0 <= value <= 5:
        raise ValueError("a rating is 0 to 5")
    if column not in ("favorite", "rating", "color_label"):
        raise ValueError(column)
    kind = assets.schema[column].dataType
    return assets.where(F.col("id").isin(ids)).select("id", F.col(column).alias("before"), F.lit(value).cast(kind).alias("after"))


def apply_values(assets: DataFrame, changes: DataFrame, column: str, side: str = "after") -> DataFrame:
    """assets after changes(id, before, after); side before: undone."""
    rows = assets.join(changes.select("id", F.col(side).alias("_v"), F.lit(True).alias("_hit")), "id", "left")
    return rows.withColumn(column, F.when(F.col("_hit"), F.col("_v")).otherwise(F.col(column))).select(*assets.columns)


def add_members(members: DataFrame, added: DataFrame) -> DataFrame:
    return members.unionByName(added.select(*members.columns)).dropDuplicates()


def replace_members(members: DataFrame, key: str, added: DataFrame) -> DataFrame:
    """members with all rows of the keys in added replaced."""
    return members.join(added.select(key).distinct(), key, "left_anti").select(*members.columns).unionByName(added.select(*members.columns).distinct())


def record_views(views: DataFrame, seen: DataFrame, assets: DataFrame) -> DataFrame:
    """The last view of each live asset, from views and seen(asset_id, viewed_at)."""
    return cascade(views.unionByName(seen), live(assets)).groupBy("asset_id").agg(F.max("viewed_at").alias("viewed_at"))


def ensure_named(albums: DataFrame, names: DataFrame) -> DataFrame:
    """albums and one new album for each of names(name) that none has, whatever the case."""
    have = albums.select(F.lower("name").alias("k"))
    new = names.where("trim(name) <> ''").groupBy(F.lower("name").alias("k")).agg(F.min("name").alias("name")).join(have, "k", "left_anti")
    return albums.select("id", "name").union(new.select(F.sha2("k", 256), "name"))


def dedup_queue(jobs: DataFrame) -> DataFrame:
    """(path, kind, thumb, seq): the newest job of each path.

    The thumbnail wish of an upsert adds up over the upserts it replaced since
    the last removal.
    """
    last = jobs.groupBy("path").agg(F.max("seq").alias("seq"), F.max_by("kind", "seq").alias("kind"), F.max(F.when(F.col("kind") == "remove", F.col("seq"))).alias("cut"))
    wish = jobs.join(last.select("path", "cut"), "path").where("cut is null or seq > cut").groupBy("path").agg(F.bool_or("thumb").alias("t"))
    return last.join(wish, "path", "left").select("path", "kind", F.when(F.col("kind") == "upsert", F.coalesce("t", F.lit(False))).otherwise(False).alias("thumb"), "seq")


def job_states(events: DataFrame) -> DataFrame:
    """(asset_id, kind, state, attempts): the last state of each job and how often it was set."""
    return events.groupBy("asset_id", "kind").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.count(F.lit(1)).alias("attempts"))


def reset_failed(jobs: DataFrame, kind: str, attempts: int = S.MAX_ATTEMPTS) -> DataFrame:
    """jobs without the exhausted failures of a kind."""
    return jobs.where(~((F.col("kind") == kind) & (F.col("state") == "failed") & (F.col("attempts") >= attempts)))


def reset_unlabelled(jobs: DataFrame, labels: DataFrame, kind: str) -> DataFrame:
    """jobs without those of a kind that are done though labels(asset_id) has nothing for the asset."""
    empty = jobs.where((F.col("kind") == kind) & (F.col("state") == "done")).join(labels.select("asset_id").distinct(), "asset_id", "left_anti")
    return jobs.join(empty.select("asset_id", "kind").distinct(), ["asset_id", "kind"], "left_anti").select(*jobs.columns)


def clear_derived(derived: DataFrame, jobs: DataFrame, kind: str, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(derived rows, jobs) after what a kind of job derived is dropped, for ids(asset_id) or for all assets.

    Of an asset whose rows are dropped the job goes too, so that it runs again.
    """
    own = F.col("kind") == kind
    if ids is None:
        return derived.where(F.lit(False)), jobs.where(~own)
    gone = ids.select("asset_id").distinct()
    return derived.join(gone, "asset_id", "left_anti").select(*derived.columns), jobs.where(~own).unionByName(jobs.where(own).join(gone, "asset_id", "left_anti").select(*jobs.columns))


def recent_searches(searches: DataFrame, keep: int = S.KEEP_SEARCHES) -> DataFrame:
    """(query, last_made, n): the last of these searches(query, made), whatever the case, newest first."""
    named = searches.where("trim(query) <> ''").groupBy(F.lower("query").alias("k")).agg(F.max_by("query", F.struct("made", "query")).alias("query"), F.max("made").alias("last_made"), F.count(F.lit(1)).alias("n"))
    return named.orderBy(F.desc("last_made"), "k").limit(keep).select("query", "last_made", "n")


def evict(files: DataFrame, budget: int) -> DataFrame:
    """files(path, size, modified) to delete, oldest first, until the rest fits; budget 0: none.

    The running sum goes over the sizes summed by time, newest first, in two
    steps: within a day, and over the days, of which there are few.
    """
    if budget <= 0:
        return files.where(F.lit(False)).select("path", "size")
    day = F.to_date("modified")
    days = files.groupBy(day.alias("d")).agg(F.sum("size").alias("s"))
    after = F.coalesce(F.sum("s").over(Window.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("d", after.alias("after"))
    own = F.sum("size").over(Window.partitionBy("d").orderBy(F.desc("modified"), F.desc("path")).rowsBetween(Window.unboundedPreceding, 0))
    rows = files.withColumn("d", day).withColumn("own", own).join(days, "d")
    return rows.where(F.col("own") + F.col("after") > budget).select("path", "size")


def export_names(assets: DataFrame, naming: str = "original") -> DataFrame:
    """(id, seq, name): names in an archive; later ones of one name get -2, -3 before the extension.

    naming: original, date_filename or sequential; assets need a seq column.
    """
    name = name_of(F.col("path"))
    if naming == "date_filename":
        base = F.concat(F.coalesce(F.date_format("captured_at", "yyyy-MM-dd"), F.lit("undated")), F.lit("_"), name)
    elif naming == "sequential":
        number = F.col("seq").cast("string")
        base = F.concat(F.lpad(number, F.greatest(F.length(number), F.lit(4)), F.lit("0")), F.regexp_extract(name, r"(\.[^.]+)$", 1))
    else:
        base = name
    n = F.row_number().over(Window.partitionBy("base").orderBy("seq"))
    rows = assets.select("id", "seq", base.alias("base")).withColumn("n", n)
    stem, ext = F.regexp_extract("base", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("base", r"(\.[^.]*)$", 1)
    return rows.select("id", "seq", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat(stem, F.lit("-"), F.col("n").cast("string"), ext)).alias("name"))

"""Listings: filtered, faceted, by membership, by id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark import schema as S
from shelfspark.functions.predicates import blank, event_ts, is_raw, is_screenshot, live, page, summary


@dataclass
class Query:
    """A search box: structured tokens and the rest as text."""

    text: str | None = None
    camera: str | None = None
    min_rating: int | None = None
    before: str | None = None
    after: str | None = None
    media_type: str | None = None
    favorite_only: bool = False

    def is_browse(self) -> bool:
        return self == Query()


def parse_query(raw: str) -> Query:
    """Tokens camera: rating> rating>= before: after: type: fav:true; the last of a kind wins.

    ``rating>n`` and ``rating>=n`` both mean at least n.  An unknown type and a
    rating that is no number are dropped.
    """
    q, words = Query(), []
    for token in raw.split():
        head, colon, value = token.partition(":")
        if token.startswith("rating>"):
            try:
                q.min_rating = int(token[7:].removeprefix("="))
            except ValueError:
                pass
        elif colon and head in ("camera", "before", "after"):
            setattr(q, head, value)
        elif colon and head == "type":
            if value.lower() in ("image", "video"):
                q.media_type = value.lower()
        elif token.lower() in ("fav:true", "favorite:true"):
            q.favorite_only = True
        else:
            words.append(token)
    q.text = " ".join(words) or None
    return q


def structured(q: Query) -> list[Column]:
    out = []
    if q.camera is not None:
        out.append(F.lower(F.coalesce("camera", F.lit(""))).contains(q.camera.lower()))
    if q.min_rating is not None:
        out.append(F.col("rating") >= q.min_rating)
    for value, op in ((q.before, "<"), (q.after, ">")):
        if value is not None:
            at = F.try_to_timestamp(F.lit(value)).cast("timestamp_ntz")
            out.append(event_ts() < at if op == "<" else event_ts() > at)
    if q.media_type is not None:
        out.append(F.col("media_type") == q.media_type)
    if q.favorite_only:
        out.append(F.col("favorite"))
    return out


def list_assets(assets: DataFrame, limit: int = 500, offset: int = 0, include_deleted: bool = False) -> DataFrame:
    return summary(page(assets if include_deleted else live(assets), limit, offset))


def filtered(assets: DataFrame, q: Query) -> DataFrame:
    out = live(assets)
    for c in structured(q):
        out = out.where(c)
    return out


def search_structured(assets: DataFrame, raw: str, limit: int = 500, offset: int = 0) -> DataFrame:
    """The structured part of a query; text is the full-text operator's."""
    return summary(page(filtered(assets, parse_query(raw)), limit, offset))


def member_assets(assets: DataFrame, members: DataFrame, limit: int = 500, offset: int = 0) -> DataFrame:
    """Live assets whose id is in members(asset_id)."""
    return summary(page(live(assets).join(members.select(F.col("asset_id").alias("id")), "id", "left_semi"), limit, offset))


def browse(assets: DataFrame, asset_tags: DataFrame, tags: list[str], ratings: list[int], labels: list[str], limit: int = 500, offset: int = 0) -> DataFrame:
    """All of the tags, any of the ratings, any of the colour labels; no facet at all: nothing."""
    out = live(assets)
    if not (tags or ratings or labels):
        return summary(out.where(F.lit(False)))
    if ratings:
        out = out.where(F.col("rating").isin(ratings))
    if labels:
        out = out.where(F.col("color_label").isin(labels))
    if tags:
        have = asset_tags.where(F.col("tag_id").isin(tags)).groupBy("asset_id").agg(F.countDistinct("tag_id").alias("n"))
        out = out.join(have.where(F.col("n") == len(set(tags))).select(F.col("asset_id").alias("id")), "id", "left_semi")
    return summary(page(out, limit, offset))


def month_assets(assets: DataFrame, year: int, month: int, limit: int = 500, offset: int = 0) -> DataFrame:
    start = F.lit(f"{year:04d}-{month:02d}-01").cast("timestamp_ntz")
    end = F.lit(f"{year + month // 12:04d}-{month % 12 + 1:02d}-01").cast("timestamp_ntz")
    return summary(page(live(assets).where((event_ts() >= start) & (event_ts() < end)), limit, offset))


def recent(assets: DataFrame, limit: int = 100) -> DataFrame:
    return summary(page(live(assets), limit, order=[F.col("indexed_at").desc()]))


def recently_viewed(assets: DataFrame, views: DataFrame, limit: int = 100) -> DataFrame:
    joined = live(assets).join(views.withColumnRenamed("asset_id", "id"), "id")
    return summary(page(joined, limit, order=[F.col("viewed_at").desc()]))


def trash(assets: DataFrame, limit: int = 500, offset: int = 0) -> DataFrame:
    return summary(page(assets.where(F.col("deleted_at").isNotNull()), limit, offset, [F.col("deleted_at").desc()]))


def by_ids(assets: DataFrame, ids: list[str]) -> DataFrame:
    """Any order, trashed ones too."""
    return summary(assets.where(F.col("id").isin(ids)))


def by_ids_ordered(assets: DataFrame, ids: list[str]) -> DataFrame:
    """Live ones with their place in the caller's list; a repeated id counts at its first place."""
    place = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("id")).alias("pos")
    return live(assets).where(F.col("id").isin(ids)).select(place, *S.ASSET_SUMMARY).orderBy("pos")


def blurry(assets: DataFrame, limit: int = 500, at_most: float = S.BLURRY_AT_MOST) -> DataFrame:
    rows = live(assets).where((F.col("media_type") == "image") & (F.col("blur_score") <= at_most))
    return page(rows, limit, order=[F.col("blur_score").asc(), F.col("created_at").desc()]).select(*S.ASSET_SUMMARY, "blur_score")


def smart_predicate(kind: str) -> Column:
    """What belongs to a smart collection; those over text read the columns text and confidence."""
    image, low, text = F.col("media_type") == "image", F.lower("path"), F.col("text") if kind in ("documents", "receipts") else None
    if kind == "videos":
        return F.col("media_type") == "video"
    if kind == "raw":
        return image & is_raw(F.col("path"))
    if kind == "screenshots":
        return is_screenshot()
    if kind == "selfies":
        return image & (F.lower(F.coalesce("lens", F.lit(""))).contains("front") | low.contains("selfie"))
    if kind == "panoramas":
        short, long = F.least("width", "height"), F.greatest("width", "height")
        known = F.col("width").isNotNull() & F.col("height").isNotNull() & (short > 0)
        return image & known & (F.try_divide(long.cast("double"), short) >= S.PANORAMA_ASPECT)
    if kind == "documents":
        return image & (F.length(F.trim(text)) >= 200) & (F.col("confidence") >= 0.35)
    if kind == "receipts":
        words = F.lit(False)
        for w in S.RECEIPT_WORDS:
            words = words | F.lower(text).contains(w)
        for sign in S.CURRENCY_SIGNS:
            words = words | text.contains(sign)
        return image & (F.col("confidence") >= 0.30) & words
    raise ValueError(kind)


SMART_KINDS = ["videos", "raw", "screenshots", "selfies", "panoramas", "documents", "receipts"]


def with_text(assets: DataFrame, asset_text: DataFrame | None) -> DataFrame:
    if asset_text is None:
        return assets.withColumns({"text": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    return assets.join(asset_text.select(F.col("asset_id").alias("id"), "text", "confidence"), "id", "left")


def smart(assets: DataFrame, kind: str, asset_text: DataFrame | None = None, limit: int = 500, offset: int = 0) -> DataFrame:
    rows = live(assets)
    if kind in ("documents", "receipts"):
        rows = rows.join(asset_text.select(F.col("asset_id").alias("id"), "text", "confidence"), "id")
    return page(rows.where(smart_predicate(kind)), limit, offset)


def smart_counts(assets: DataFrame, asset_text: DataFrame | None = None) -> DataFrame:
    """(kind, n) of all collections, in one pass."""
    row = with_text(live(assets), asset_text).agg(*[F.count_if(smart_predicate(k)).alias(k) for k in SMART_KINDS])
    pairs = ", ".join(f"'{k}', {k}" for k in SMART_KINDS)
    return row.selectExpr(f"stack({len(SMART_KINDS)}, {pairs}) as (kind, n)")


def people(people: DataFrame, ignored: bool = False) -> DataFrame:
    rows = people.where((F.col("face_count") > 0) & (F.col("ignored") == ignored))
    return rows.orderBy(blank(F.col("name")).asc(), F.lower("name").asc_nulls_first(), F.col("face_count").desc(), "id")


def asset_faces(faces: DataFrame, people: DataFrame, asset_id: str) -> DataFrame:
    named = people.select(F.col("id").alias("person_id"), F.col("name").alias("person_name"))
    return faces.where(F.col("asset_id") == asset_id).join(named, "person_id", "left").select("id", "asset_id", "person_id", "person_name", "score").orderBy(F.desc("score"), "id")


def labels_of(labels: DataFrame, asset_id: str) -> DataFrame:
    return labels.where(F.col("asset_id") == asset_id).orderBy("rank", "label")


def of_asset(rows: DataFrame, asset_id: str) -> DataFrame:
    """What a table of one row an asset has of it: its caption, its text."""
    return rows.where(F.col("asset_id") == asset_id)


def without_shown(more: DataFrame, shown: DataFrame) -> DataFrame:
    """The rows of a further page whose id was not on an earlier one, each id once."""
    return more.join(shown.select("id"), "id", "left_anti").dropDuplicates(["id"])


def oldest(rows: DataFrame, at: str = "created_at") -> DataFrame:
    """All rows in the order they were made: watched roots, the user's own models."""
    return rows.orderBy(F.asc(at), "id")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by these columns."""
    cols = rows.columns
    best = rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("r"))
    return best.select(*[F.col(f"r.{c}") for c in cols])


def newest(rows: DataFrame, limit: int, at: str = "created_at") -> DataFrame:
    return rows.orderBy(F.desc(at), F.desc("id")).limit(limit)


def flag_locked(selection: DataFrame, locked: DataFrame) -> DataFrame:
    """selection(id) with vault_locked."""
    own = locked.select(F.col("asset_id").alias("id"), F.lit(True).alias("l")).distinct()
    return selection.join(own, "id", "left").select(*selection.columns, F.coalesce("l", F.lit(False)).alias("vault_locked"))


def locked_albums(albums: DataFrame, locked: DataFrame) -> DataFrame:
    """(id, created_at, n): locked albums, newest first, with how many items each holds; names stay sealed."""
    n = locked.groupBy(F.col("locked_album_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return albums.join(n, "id", "left").select("id", "created_at", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("created_at"), "id")


def locked_items(locked: DataFrame, album: str | None = None) -> DataFrame:
    """Opaque rows of a locked album, newest first; no album: the loose items."""
    own = F.col("locked_album_id").isNull() if album is None else F.col("locked_album_id") == album
    return locked.where(own).orderBy(F.desc("locked_at"), "asset_id")


def locked_by_album(locked: DataFrame) -> DataFrame:
    """Opaque rows: how many items each locked album holds; null: loose items."""
    return locked.groupBy("locked_album_id").agg(F.count(F.lit(1)).alias("n"))


def backfill(assets: DataFrame, kind: str, limit: int) -> DataFrame:
    """Live rows that lack what is derived from the pixels."""
    missing = {"phash": (F.col("media_type") == "image") & F.col("perceptual_hash").isNull(), "blur": (F.col("media_type") == "image") & F.col("blur_score").isNull(), "thumbnail": F.col("thumbnail_path").isNull()}[kind]
    return live(assets).where(missing).orderBy(F.desc("indexed_at"), "id").limit(limit).select("id", "path")


def stale_crops(faces: DataFrame, files: DataFrame) -> DataFrame:
    """Faces whose crop names a file that is not among files(path)."""
    named = faces.where(F.col("crop_path").isNotNull() & (F.col("crop_path") != ""))
    return named.join(files.select(F.col("path").alias("crop_path")), "crop_path", "left_anti")


def model_status(catalog: DataFrame, own: DataFrame, installed: DataFrame, active: DataFrame) -> DataFrame:
    """Catalogue and own models with installed and active flags."""
    rows = catalog.select("option_id", "kind").unionByName(own.select("option_id", "kind"))
    rows = rows.join(installed.select("option_id", F.lit(True).alias("i")).distinct(), "option_id", "left").join(active.select("option_id", F.lit(True).alias("a")).distinct(), "option_id", "left")
    return rows.select("option_id", "kind", F.coalesce("i", F.lit(False)).alias("installed"), F.coalesce("a", F.lit(False)).alias("active"))

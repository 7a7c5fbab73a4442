"""All queries over the library tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark import schema as S
from shelfspark.functions import formats
from shelfspark.functions import predicates as P
from shelfspark.functions.actions import Journal
from shelfspark.operators import browse, duplicates, edits, facets, geo, ingest, memories, people, search, vector_index, vectors
from shelfspark.operators.card_store import CardStore
from shelfspark.operators.search_index import SearchIndex
from shelfspark.plans.adapter_sql import sql
from shelfspark.sources import files
from shelfspark.sources.catalogue import Catalogue, month_of
from shelfspark.sources.library import AS_OF, Documents, Orders
from shelfspark.sources.versions import Versions
from shelfspark.sources.work import work_path, write_table
from shelfspark.streaming import ingest as streams

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
COLS = ", ".join(f"a.{c}" for c in S.ASSET_SUMMARY)
NEWEST = "ORDER BY a.ev DESC NULLS LAST, a.id LIMIT 500"


def query(kind, oracle: str | None = None):
    """Register a function of the library's tables under its name."""

    def keep(f):
        _queries[f.__name__] = lambda spark, sf_dir: f(kind(spark, sf_dir))
        if oracle:
            _sql[f.__name__] = oracle
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def listing(where: str, join: str = "", tables: tuple = (), order: str = NEWEST) -> str:
    return sql(f"SELECT {COLS} FROM live a {join} WHERE {where} {order}", "live", *tables)


# -- files -----------------------------------------------------------------


@query(Orders, sql(r"""SELECT media_type, count(*) AS n FROM (SELECT CASE
  WHEN regexp_matches(path, '\.(jpg|jpeg|png|gif|webp|bmp|tif|tiff|heic|heif|raw|dng|cr2|cr3|nef|nrw|arw|srf|sr2|orf|raf|rw2|pef|srw|x3f|3fr|erf|mrw|dcr|kdc)$', 'i') THEN 'image'
  WHEN regexp_matches(path, '\.(mp4|mov|m4v|avi|mkv|webm)$', 'i') THEN 'video' ELSE 'none' END AS media_type FROM assets) GROUP BY 1""", "assets"))  # fmt: skip
def media_type_counts(t):
    return ingest.media_type_counts(t.assets)


IGNORE = ["*.cr2", "selfie*", "/lib/F/"]


@query(Orders, sql("SELECT id, path FROM assets WHERE NOT (lower(path) LIKE '%.cr2' OR regexp_matches(lower(path), '/selfie[^/]*$') OR contains(lower(path), '/lib/f/'))", "assets"))
def ignore_filter(t):
    return t.assets.where(~P.ignored(F.col("path"), IGNORE)).select("id", "path")


def _snapshot(t):
    """A folder as it might be today: every 7th file touched since, every 11th grown, all under their own path."""
    k = F.col("id").cast("long")
    later = F.when(k % 7 == 0, F.expr("interval '1' day")).otherwise(F.expr("interval '-1' day"))
    return t.assets.select("path", (F.col("file_size") + (k % 11 == 0).cast("long")).alias("file_size"), (F.col("indexed_at") + later).alias("modified"))


@query(Orders, sql("SELECT path, file_size + CASE WHEN CAST(id AS BIGINT) % 11 = 0 THEN 1 ELSE 0 END AS file_size FROM assets WHERE CAST(id AS BIGINT) % 7 = 0 OR CAST(id AS BIGINT) % 11 = 0 OR deleted_at IS NOT NULL", "assets"))
def changed_files(t):
    return ingest.changed_files(_snapshot(t), t.assets).select("path", "file_size")


@query(Documents, "SELECT doc_id AS id, sha256(text) AS hash FROM documents")
def content_hash(t):
    return ingest.content_hash(t.read("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@query(Orders, """WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * ((o_orderkey % 100) + (o_orderkey % 60) / 60.0 + (o_orderkey % 7) / 3600.0) AS lat,
  CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * ((o_orderkey % 200) + (o_orderkey % 50) / 60.0 + (o_orderkey % 11) / 3600.0) AS lon FROM orders)
  SELECT id, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon FROM r WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)""")
def gps_normalise(t):
    k = "o_orderkey"
    raw = t.read("orders").selectExpr(f"cast({k} as string) as id", f"{k} % 100 as lat_d", f"{k} % 60 as lat_m", f"{k} % 7 as lat_s", f"if({k} % 2 = 0, 'S', 'N') as lat_ref", f"{k} % 200 as lon_d", f"{k} % 50 as lon_m", f"{k} % 11 as lon_s", f"if({k} % 3 = 0, 'W', 'E') as lon_ref")
    return geo.gps_normalise(raw).select("id", (F.round("lat", 6) + 0.0).alias("lat"), (F.round("lon", 6) + 0.0).alias("lon"))


@query(Orders, sql(r"""SELECT id, seq, CASE WHEN n = 1 THEN base ELSE regexp_extract(base, '^(.*?)(\.[^.]*)?$', 1) || '-' || n || regexp_extract(base, '(\.[^.]*)$', 1) END AS name
  FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seq) AS n FROM (SELECT id, CAST(id AS BIGINT) AS seq, coalesce(strftime(captured_at, '%Y-%m-%d'), 'undated') || '_' || CASE media_type WHEN 'video' THEN 'clip.mp4' ELSE 'photo.jpg' END AS base FROM live))""", "live"))  # fmt: skip
def export_names(t):
    rows = P.live(t.assets).select("id", F.col("id").cast("long").alias("seq"), "captured_at", F.when(F.col("media_type") == "video", "/x/clip.mp4").otherwise("/x/photo.jpg").alias("path"))
    return ingest.export_names(rows, "date_filename")


# -- listings --------------------------------------------------------------


@query(Orders, listing("true"))
def list_assets(t):
    return browse.list_assets(t.assets)


@query(Orders, listing("lower(coalesce(a.camera, '')) LIKE '%canon%' AND a.rating >= 2 AND a.media_type = 'image'"))
def search_filters(t):
    return browse.search_structured(t.assets, "camera:canon rating>2 type:image")


@query(Orders, listing("a.ev < TIMESTAMP '1999-01-01' AND a.ev > TIMESTAMP '1996-06-01' AND a.favorite"))
def search_dates(t):
    return browse.search_structured(t.assets, "before:1999-01-01 after:1996-06-01 fav:true")


@query(Orders, listing("a.id IN (SELECT asset_id FROM asset_tags WHERE tag_id = 'Brand#5')", tables=("asset_tags",)))
def tag_assets(t):
    return browse.member_assets(t.assets, t.asset_tags.where("tag_id = 'Brand#5'"))


@query(Orders, listing("""a.rating IN (3, 4, 5) AND a.color_label IN ('red', 'yellow', 'green') AND a.id IN
  (SELECT asset_id FROM asset_tags WHERE tag_id IN ('Brand#5', 'Brand#7') GROUP BY asset_id HAVING count(DISTINCT tag_id) = 2)""", tables=("asset_tags",)))  # fmt: skip
def browse_filter(t):
    return browse.browse(t.assets, t.asset_tags, ["Brand#5", "Brand#7"], [3, 4, 5], ["red", "yellow", "green"])


@query(Orders, listing("a.id IN (SELECT asset_id FROM album_assets WHERE album_id = '11')", tables=("album_assets",)))
def album_assets(t):
    return browse.member_assets(t.assets, t.album_assets.where("album_id = '11'"))


@query(Orders, listing("a.id IN (SELECT asset_id FROM faces WHERE person_id = '5')", tables=("faces",)))
def person_assets(t):
    return browse.member_assets(t.assets, t.faces.where("person_id = '5'"))


@query(Orders, listing("a.id IN (SELECT asset_id FROM asset_places WHERE place_label = 'NATION_3')", tables=("asset_places",)))
def place_assets(t):
    return browse.member_assets(t.assets, t.asset_places.where("place_label = 'NATION_3'"))


@query(Orders, listing("strftime(a.ev, '%Y-%m') = '1998-03'"))
def month_assets(t):
    return browse.month_assets(t.assets, 1998, 3)


@query(Orders, listing("true", order="ORDER BY a.indexed_at DESC, a.id LIMIT 100"))
def recent(t):
    return browse.recent(t.assets)


@query(Orders, listing("true", "JOIN asset_views v ON v.asset_id = a.id", ("asset_views",), "ORDER BY v.viewed_at DESC, a.id LIMIT 100"))
def recently_viewed(t):
    return browse.recently_viewed(t.assets, t.asset_views)


@query(Orders, sql(f"SELECT {COLS} FROM assets a WHERE deleted_at IS NOT NULL ORDER BY deleted_at DESC, id LIMIT 500", "assets"))
def trash(t):
    return browse.trash(t.assets)


IDS = ["25", "7", "101", "50", "7", "3"]


@query(Orders, sql(f"SELECT {COLS} FROM assets a WHERE id IN ('25', '7', '101', '50', '3')", "assets"))
def by_ids(t):
    return browse.by_ids(t.assets, IDS)


@query(Orders, sql(f"SELECT CAST(list_position(['25', '7', '101', '50', '7', '3'], a.id) AS BIGINT) AS pos, {COLS} FROM live a WHERE id IN ('25', '7', '101', '50', '3')", "live"))
def by_ids_ordered(t):
    return browse.by_ids_ordered(t.assets, IDS)


@query(Orders, sql(f"SELECT {COLS}, a.blur_score FROM live a WHERE media_type = 'image' AND blur_score <= 80 ORDER BY blur_score, created_at DESC, id LIMIT 500", "live"))
def blurry(t):
    return browse.blurry(t.assets)


RAW_SQL = r"regexp_matches(a.path, '\.(raw|dng|cr2|cr3|nef|nrw|arw|srf|sr2|orf|raf|rw2|pef|srw|x3f|3fr|erf|mrw|dcr|kdc)$', 'i')"
SMART_SQL = {
    "videos": "a.media_type = 'video'",
    "raw": f"a.media_type = 'image' AND {RAW_SQL}",
    "screenshots": "a.media_type = 'image' AND a.camera IS NULL AND (lower(a.path) LIKE '%screenshot%' OR lower(a.path) LIKE '%screen shot%')",
    "selfies": "a.media_type = 'image' AND (lower(coalesce(a.lens, '')) LIKE '%front%' OR lower(a.path) LIKE '%selfie%')",
    "panoramas": "a.media_type = 'image' AND a.width IS NOT NULL AND a.height IS NOT NULL AND least(a.width, a.height) > 0 AND greatest(a.width, a.height)::DOUBLE / least(a.width, a.height) >= 2.0",
    "documents": "a.media_type = 'image' AND length(trim(x.text)) >= 200 AND x.confidence >= 0.35",
    "receipts": "a.media_type = 'image' AND x.confidence >= 0.30 AND (" + " OR ".join([f"lower(x.text) LIKE '%{w}%'" for w in S.RECEIPT_WORDS] + [f"contains(x.text, '{c}')" for c in S.CURRENCY_SIGNS]) + ")",
}


@query(Orders, listing(SMART_SQL["videos"]))
def smart_videos(t):
    return P.summary(browse.smart(t.assets, "videos"))


@query(Orders, listing(SMART_SQL["raw"]))
def smart_raw(t):
    return P.summary(browse.smart(t.assets, "raw"))


@query(Orders, listing(SMART_SQL["screenshots"]))
def smart_screenshots(t):
    return P.summary(browse.smart(t.assets, "screenshots"))


@query(Orders, listing(SMART_SQL["selfies"]))
def smart_selfies(t):
    return P.summary(browse.smart(t.assets, "selfies"))


@query(Orders, listing(SMART_SQL["panoramas"]))
def smart_panoramas(t):
    return P.summary(browse.smart(t.assets, "panoramas"))


def _doc_smart(kind: str) -> str:
    return sql(f"SELECT a.id, a.path FROM doc_assets a JOIN asset_text x ON x.asset_id = a.id WHERE {SMART_SQL[kind]} ORDER BY a.created_at DESC, a.id LIMIT 500", "doc_assets", "asset_text")


@query(Documents, _doc_smart("documents"))
def smart_documents(t):
    return browse.smart(t.assets, "documents", t.asset_text).select("id", "path")


@query(Documents, _doc_smart("receipts"))
def smart_receipts(t):
    return browse.smart(t.assets, "receipts", t.asset_text).select("id", "path")


@query(Orders, sql(" UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER ({w}) AS n FROM live a" for k, w in SMART_SQL.items() if k not in ("documents", "receipts")) + " UNION ALL SELECT 'documents', 0 UNION ALL SELECT 'receipts', 0", "live"))
def smart_counts(t):
    return browse.smart_counts(t.assets)


@query(Orders, sql("SELECT id, name, ignored, face_count FROM people WHERE face_count > 0 AND NOT ignored", "people"))
def people_list(t):
    return browse.people(t.people)


_queries["people"], _sql["people"] = _queries.pop("people_list"), _sql.pop("people_list")


@query(Orders, sql("SELECT f.id, f.asset_id, f.person_id, p.name AS person_name, f.score FROM faces f LEFT JOIN people p ON p.id = f.person_id WHERE f.asset_id = '77'", "people"))
def asset_faces(t):
    return browse.asset_faces(t.faces, t.people, "77")


@query(Documents, sql("SELECT * FROM asset_labels WHERE asset_id = '42'", "asset_labels"))
def asset_labels(t):
    return browse.labels_of(t.asset_labels, "42")


@query(Orders, sql("SELECT * FROM activity_log ORDER BY created_at DESC, id DESC LIMIT 200", "activity_log"))
def activity(t):
    return browse.newest(t.activity_log, 200)


@query(Orders, sql("""SELECT arg_max(query, (made, query)) AS query, max(made) AS last_made, count(*) AS n FROM searches WHERE trim(query) <> '' GROUP BY lower(query) ORDER BY last_made DESC, lower(arg_max(query, (made, query))) LIMIT 30""", "searches"))
def saved_searches(t):
    return ingest.recent_searches(t.searches)


@query(Orders, "SELECT max(event_id) FILTER (TRUE) AS id, asset_id, arg_max(ops_json, (created_at, id)) AS ops_json, max(created_at) AS created_at FROM (SELECT event_id AS id, event_id, CAST(event_id % 2000 AS VARCHAR) AS asset_id, props AS ops_json, ts AS created_at FROM events) GROUP BY asset_id")
def latest_edit(t):
    return browse.latest(t.asset_edits, "asset_id", "created_at", "id")


@query(Orders, sql("SELECT id, path FROM live WHERE media_type = 'image' AND blur_score IS NULL ORDER BY indexed_at DESC, id LIMIT 100", "live"))
def backfill(t):
    return browse.backfill(t.assets, "blur", 100)


# -- counts ----------------------------------------------------------------


@query(Orders, sql("""SELECT count(*) FILTER (deleted_at IS NULL) AS total_assets, count(*) FILTER (deleted_at IS NULL AND media_type = 'image') AS total_images,
  count(*) FILTER (deleted_at IS NULL AND media_type = 'video') AS total_videos, count(*) FILTER (deleted_at IS NULL AND favorite) AS favorites, count(*) FILTER (deleted_at IS NOT NULL) AS in_trash,
  (SELECT count(*) FROM customer) AS album_count, (SELECT count(DISTINCT p_brand) FROM part) AS tag_count, CAST(0 AS BIGINT) AS watched_folders, CAST(30 AS BIGINT) AS trash_retention_days FROM assets""", "assets"))  # fmt: skip
def library_stats(t):
    return facets.library_stats(t.assets, t.albums, t.tags)


@query(Orders, sql("SELECT rating, count(*) AS n FROM live WHERE rating > 0 GROUP BY rating", "live"))
def facet_ratings(t):
    return facets.facet_ratings(t.assets)


@query(Orders, sql("SELECT color_label, count(*) AS n FROM live WHERE color_label <> '' GROUP BY color_label", "live"))
def facet_colors(t):
    return facets.facet_colors(t.assets)


@query(Orders, sql("SELECT CAST(year(ev) AS INTEGER) AS year, CAST(month(ev) AS INTEGER) AS month, count(*) AS n FROM live GROUP BY 1, 2", "live"))
def timeline_months(t):
    return facets.timeline_months(t.assets)


@query(Orders, sql("SELECT coalesce(strftime(ev, '%Y-%m-%d'), 'unknown') AS day, count(*) AS n FROM live GROUP BY 1", "live"))
def timeline_days(t):
    return facets.timeline_days(t.assets)


MEMBERS = "SELECT album_id, count(*) AS n, arg_max(asset_id, (coalesce(captured_at, indexed_at), asset_id)) AS newest FROM album_assets JOIN live ON live.id = asset_id GROUP BY album_id"


@query(Orders, sql(f"""SELECT b.id, b.name, b.cover_asset_id, b.created_at, coalesce(n, 0) AS asset_count, coalesce(c.thumbnail_path, m.thumbnail_path) AS cover_thumbnail_path
  FROM albums b LEFT JOIN ({MEMBERS}) x ON x.album_id = b.id LEFT JOIN live c ON c.id = b.cover_asset_id LEFT JOIN live m ON m.id = x.newest""", "live", "albums", "album_assets"))  # fmt: skip
def albums(t):
    return facets.albums_with_counts(t.albums, t.album_assets, t.assets)


@query(Orders, sql(f"""SELECT b.id, b.name, CASE WHEN c.id IS NOT NULL THEN b.cover_asset_id ELSE newest END AS cover_asset_id, b.created_at
  FROM albums b LEFT JOIN ({MEMBERS}) x ON x.album_id = b.id LEFT JOIN live c ON c.id = b.cover_asset_id AND EXISTS (SELECT 1 FROM album_assets z WHERE z.album_id = b.id AND z.asset_id = c.id)""", "live", "albums", "album_assets"))  # fmt: skip
def album_covers(t):
    return facets.synced_covers(t.albums, t.album_assets, t.assets)


@query(Orders, sql("SELECT t.id, t.name, count(l.id) AS asset_count FROM tags t LEFT JOIN asset_tags x ON x.tag_id = t.id LEFT JOIN live l ON l.id = x.asset_id GROUP BY t.id, t.name", "tags", "asset_tags", "live"))
def tags(t):
    return facets.tags_with_counts(t.tags, t.asset_tags, t.assets)


@query(Orders, sql("""SELECT 'album' AS kind, b.id, b.name, (SELECT count(*) FROM album_assets y JOIN live l ON l.id = y.asset_id WHERE y.album_id = b.id) AS asset_count FROM albums b WHERE b.id IN (SELECT album_id FROM album_assets WHERE asset_id = '77')
  UNION ALL SELECT 'tag', g.id, g.name, (SELECT count(*) FROM asset_tags y JOIN live l ON l.id = y.asset_id WHERE y.tag_id = g.id) FROM tags g WHERE g.id IN (SELECT tag_id FROM asset_tags WHERE asset_id = '77')""", "live", "albums", "album_assets", "tags", "asset_tags"))  # fmt: skip
def asset_organisation(t):
    return facets.asset_organisation("77", t.albums, t.album_assets, t.tags, t.asset_tags, t.assets)


@query(Orders, sql("""SELECT place_label, min(country) AS country, count(*) AS asset_count, avg(lat) AS lat, avg(lon) AS lon, arg_max(coalesce(thumbnail_path, '-'), (ev, asset_id)) AS cover_thumbnail_path
  FROM asset_places JOIN live ON live.id = asset_id WHERE trim(place_label) <> '' GROUP BY place_label""", "asset_places", "live"))  # fmt: skip
def places(t):
    return facets.places(t.asset_places, t.assets).na.fill("-", ["cover_thumbnail_path"])


@query(Orders, sql("""SELECT greatest((s + n) / 2 - greatest((n - s) / 2, 4.0), -90.0) AS south, least((s + n) / 2 + greatest((n - s) / 2, 4.0), 90.0) AS north,
  greatest((w + e) / 2 - greatest((e - w) / 2, 6.0), -180.0) AS west, least((w + e) / 2 + greatest((e - w) / 2, 6.0), 180.0) AS east
  FROM (SELECT min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM asset_places WHERE place_label IN ('NATION_3', 'NATION_4'))""", "asset_places"))  # fmt: skip
def places_bbox(t):
    return facets.places_bbox(t.asset_places.where("place_label in ('NATION_3', 'NATION_4')"))


@query(Orders, sql("""SELECT capability, done, (SELECT count(*) FROM live WHERE media_type = 'image') AS total FROM (
  SELECT 'faces' AS capability, count(DISTINCT live.id) AS done FROM faces JOIN live ON live.id = asset_id UNION ALL
  SELECT 'places', count(DISTINCT live.id) FROM asset_places JOIN live ON live.id = asset_id UNION ALL
  SELECT 'click', count(DISTINCT live.id) FROM ml_jobs JOIN live ON live.id = asset_id WHERE kind = 'click' AND state = 'done')""", "live", "faces", "asset_places", "ml_jobs"))  # fmt: skip
def coverage(t):
    return facets.coverage(t.assets, {"faces": t.faces, "places": t.asset_places, "click": t.ml_jobs.where("kind = 'click' and state = 'done'")})


@query(Orders, sql("SELECT kind, count(*) AS failed, arg_max(error, (updated_at, asset_id)) AS last_error FROM ml_jobs WHERE state = 'failed' AND attempts >= 3 GROUP BY kind", "ml_jobs"))
def job_failures(t):
    return facets.job_failures(t.ml_jobs)


@query(Orders, sql("""SELECT l.id, l.path FROM live l LEFT JOIN ml_jobs j ON j.asset_id = l.id AND j.kind = 'click' WHERE l.media_type = 'image' AND l.id NOT IN (SELECT asset_id FROM asset_views)
  AND (j.state IS NULL OR (j.state = 'failed' AND j.attempts < 3)) ORDER BY l.indexed_at DESC, l.id LIMIT 500""", "live", "ml_jobs", "asset_views"))  # fmt: skip
def pending_assets(t):
    return facets.pending_assets(t.assets, t.ml_jobs, "click", t.asset_views)


@query(Orders, sql("SELECT person_id, count(*) AS face_count, arg_min(id, (CASE WHEN crop_path IS NULL THEN 1 ELSE 0 END, -score, id)) AS cover_face_id FROM faces GROUP BY person_id", "faces"))
def person_stats(t):
    return people.person_stats(t.faces, t.tasks("lineitem"))


CENTROIDS = """, m AS (SELECT label AS person_id, i AS dim, avg(vector[i]::DOUBLE) AS m, count(*) AS n FROM asset_embeddings, range(1, 65) r(i) GROUP BY 1, 2),
  norms AS (SELECT person_id, sqrt(sum(m * m)) AS norm FROM m GROUP BY person_id)"""


@query(Documents, sql(CENTROIDS + "SELECT person_id, CAST(dim - 1 AS INTEGER) AS dim, round(CASE WHEN norm > 0 THEN m / norm ELSE m END, 6) AS value, n FROM m JOIN norms USING (person_id)", "asset_embeddings"))
def person_centroids(t):
    return vectors.group_centroids(t.asset_embeddings.withColumnRenamed("label", "person_id"), "person_id").withColumn("value", F.round("value", 6))


# -- duplicates ------------------------------------------------------------


@query(Documents, sql("SELECT hash AS group_key, id, path, CAST(row_number() OVER (PARTITION BY hash ORDER BY created_at, path, id) - 1 AS INTEGER) AS pos FROM doc_assets WHERE hash IN (SELECT hash FROM doc_assets GROUP BY hash HAVING count(*) > 1)", "doc_assets"))
def exact_duplicates(t):
    return duplicates.exact_duplicates(t.assets)


def _hashes(t):
    return t.word_bands.join(t.assets.select("id", "hash"), "id")


PAIRS = """, h AS (SELECT w.*, d.hash FROM word_bands w JOIN doc_assets d USING (id) WHERE bit_count(b0) + bit_count(b1) + bit_count(b2) + bit_count(b3) BETWEEN 4 AND 60),
  pairs AS (SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(x.b0, y.b0)) + bit_count(xor(x.b1, y.b1)) + bit_count(xor(x.b2, y.b2)) + bit_count(xor(x.b3, y.b3)) AS INTEGER) AS distance
    FROM h x JOIN h y ON x.id < y.id AND x.hash <> y.hash AND bit_count(xor(x.b0, y.b0)) + bit_count(xor(x.b1, y.b1)) + bit_count(xor(x.b2, y.b2)) + bit_count(xor(x.b3, y.b3)) <= 2)"""
REACH = """, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(n, m) AS (SELECT a, a FROM e UNION SELECT reach.n, e.b FROM reach JOIN e ON reach.m = e.a)"""


@query(Documents, sql(PAIRS + "SELECT a, b, distance FROM pairs", "word_bands", "doc_assets"))
def near_duplicate_pairs(t):
    return duplicates.near_pairs(_hashes(t))


@query(Documents, sql(PAIRS + REACH + "SELECT min(m) AS group_key, n AS id FROM reach GROUP BY n", "word_bands", "doc_assets", recursive=True))
def near_duplicates(t):
    return duplicates.near_groups(_hashes(t))


ALL_DUPLICATES = PAIRS + REACH + ", both_kinds AS (SELECT 'near' AS kind, min(m) AS group_key, n AS id FROM reach GROUP BY n UNION ALL SELECT 'exact', hash, id FROM doc_assets WHERE hash IN (SELECT hash FROM doc_assets GROUP BY hash HAVING count(*) > 1))"


@query(Documents, sql(ALL_DUPLICATES + "SELECT * FROM both_kinds", "word_bands", "doc_assets", recursive=True))
def all_duplicates(t):
    return duplicates.all_duplicates(exact_duplicates(t), near_duplicates(t))


@query(Documents, sql(ALL_DUPLICATES + "SELECT kind, count(DISTINCT group_key) AS groups, count(*) AS items FROM both_kinds GROUP BY kind", "word_bands", "doc_assets", recursive=True))
def duplicate_summary(t):
    return facets.duplicate_summary(all_duplicates(t))


@query(Orders, """WITH r AS (SELECT DISTINCT '/lib/' || o_orderstatus || CASE WHEN o_orderkey % 3 = 0 THEN '/sub' || (o_orderkey % 5) ELSE '' END AS path FROM orders)
  SELECT path FROM r WHERE NOT EXISTS (SELECT 1 FROM r q WHERE starts_with(r.path, q.path || '/'))""")
def prune_roots(t):
    return duplicates.prune_roots(t.read("orders").selectExpr("concat('/lib/', o_orderstatus, if(o_orderkey % 3 = 0, concat('/sub', o_orderkey % 5), '')) as path").distinct())


# -- vectors and signals ---------------------------------------------------


def _query_vectors(t):
    """Searches ask with every vector whose id is divisible by 100."""
    return t.read("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


EACH = """, s AS (SELECT q.vec_id AS query_id, e.asset_id AS id, list_inner_product(e.vector::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM asset_embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) q),
  each_best AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s WHERE score >= 0.15)"""


@query(Documents, sql(EACH + "SELECT query_id, id, round(score, 6) AS score FROM each_best WHERE r <= 50", "asset_embeddings"))
def semantic_search(t):
    return vectors.search_each(t.asset_embeddings, _query_vectors(t), 50, assets=t.assets).withColumn("score", F.round("score", 6))


@query(Documents)
def semantic_ann(t):
    """Over a stored index of all vectors, which is built first."""
    index = vector_index.build(t.asset_embeddings, work_path(t.spark, "vectors"))
    return vector_index.search_each(index, _query_vectors(t), 50)


@query(Documents, sql("""SELECT asset_id, 'label_' || lpad(CAST(i AS VARCHAR), 2, '0') AS label, round(p, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT asset_id, i, p, row_number() OVER (PARTITION BY asset_id ORDER BY p DESC, i) - 1 AS rank FROM (SELECT asset_id, i, exp(vector[i + 1]::DOUBLE * 8) / sum(exp(vector[i + 1]::DOUBLE * 8)) OVER (PARTITION BY asset_id) AS p FROM asset_embeddings, range(0, 64) r(i)))
  WHERE rank < 5 AND (p >= 0.05 OR rank = 0)""", "asset_embeddings"))  # fmt: skip
def label_topk(t):
    names = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.concat(F.lit("label_"), F.lpad(i.cast("string"), 2, "0")))
    rows = t.asset_embeddings.select("asset_id", names.alias("labels"), F.transform("vector", lambda x: x.cast("double") * 8).alias("logits"))
    return vectors.label_topk(rows).withColumn("score", F.round("score", 6))


@query(Documents, sql("""SELECT id, """ + " || ".join(f"lower(printf('%04x', CAST(sum(CASE WHEN i BETWEEN {48 - 16 * w} AND {63 - 16 * w} AND p >= m THEN 1 << (i - {48 - 16 * w}) ELSE 0 END) AS INTEGER)))" for w in range(4)) + """ AS hash
  FROM (SELECT asset_id AS id, CAST(i AS INTEGER) AS i, CAST(floor((vector[i + 1]::DOUBLE + 1) * 127) AS BIGINT) AS p, floor(sum(CAST(floor((vector[i + 1]::DOUBLE + 1) * 127) AS BIGINT)) OVER (PARTITION BY asset_id) / 64) AS m FROM asset_embeddings, range(0, 64) r(i)) GROUP BY id""", "asset_embeddings"))  # fmt: skip
def ahash(t):
    return vectors.ahash(t.asset_embeddings.select(F.col("asset_id").alias("id"), F.transform("vector", lambda x: F.floor((x.cast("double") + 1) * 127)).alias("pixels")))


@query(Documents, sql(""", px AS (SELECT asset_id AS id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, floor((vector[i + 1]::DOUBLE + 1) * 127) AS p FROM asset_embeddings, range(0, 64) r(i))
  SELECT c.id, round(var_pop(u.p + d.p + l.p + r.p - 4 * c.p), 6) AS blur_score FROM px c JOIN px u ON u.id = c.id AND u.x = c.x AND u.y = c.y - 1 JOIN px d ON d.id = c.id AND d.x = c.x AND d.y = c.y + 1
  JOIN px l ON l.id = c.id AND l.y = c.y AND l.x = c.x - 1 JOIN px r ON r.id = c.id AND r.y = c.y AND r.x = c.x + 1 GROUP BY c.id""", "asset_embeddings"))  # fmt: skip
def blur_score(t):
    images = t.asset_embeddings.select(F.col("asset_id").alias("id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.transform("vector", lambda x: F.floor((x.cast("double") + 1) * 127)).alias("pixels"))
    return vectors.blur_score(images).withColumn("blur_score", F.round("blur_score", 6))


@query(Orders)
def nms(t):
    k = t.read("lineitem").selectExpr("cast(l_orderkey as string) as asset_id", "l_orderkey", "l_suppkey")
    k = vectors.dealt_boxes(k, t.read("lineitem").count()).distinct()
    boxes = k.selectExpr("_g", "asset_id", "concat(l_orderkey, ':', l_suppkey) as id", "cast(l_suppkey % 7 * 10 as double) as x", "cast(l_suppkey % 3 * 10 as double) as y", "40.0D as w", "40.0D as h", "((l_orderkey * 31 + l_suppkey) % 100) / 100.0D as score")
    return vectors.nms(boxes)


# -- full text -------------------------------------------------------------


def _doc_index(t):
    return t.search_documents


BM25 = r""", toks AS (
    SELECT id, 5.0 AS w, unnest(regexp_split_to_array(lower(regexp_extract(path, '[^/]*$')), '[^\p{L}\p{N}_]+')) AS term FROM doc_assets
    UNION ALL SELECT asset_id, 12.0, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) FROM asset_text
    UNION ALL SELECT asset_id, 8.0, unnest(regexp_split_to_array(lower(caption), '[^\p{L}\p{N}_]+')) FROM asset_captions),
  d AS (SELECT id, count(*) AS len, sum(CASE WHEN starts_with(term, 'then') THEN w ELSE 0 END) AS f0, sum(CASE WHEN starts_with(term, 'ere') THEN w ELSE 0 END) AS f1 FROM toks WHERE term <> '' GROUP BY id),
  t AS (SELECT (SELECT count(*) FROM doc_assets) AS n, (SELECT sum(len) FROM d) / (SELECT count(*) FROM doc_assets) AS avg, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM d),
  hits AS (SELECT id, greatest(ln((n - n0 + 0.5) / (n0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len / avg)) + greatest(ln((n - n1 + 0.5) / (n1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / avg)) AS score
    FROM d, t WHERE f0 > 0 AND f1 > 0),
  top AS (SELECT h.id, h.score, row_number() OVER (ORDER BY h.score DESC, created_at DESC, h.id) AS r FROM hits h JOIN doc_assets USING (id))"""


@query(Documents, sql(BM25 + "SELECT id, round(score, 6) AS score FROM top WHERE r <= 50", "doc_assets", "asset_text", "asset_captions"))
def search_text(t):
    return search.search_text(t.assets, _doc_index(t), "then ere", 50).withColumn("score", F.round("score", 6))


@query(Documents, sql(BM25 + EACH + """, merged AS (SELECT query_id, id, min((src, -score)) AS r FROM (SELECT query_id, top.id, 0 AS src, top.score FROM top, (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 100 = 0) WHERE top.r <= 50 UNION ALL SELECT query_id, id, 1, score FROM each_best WHERE r <= 50) GROUP BY query_id, id)
  SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r, id) - 1 AS INTEGER) AS pos FROM merged QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r, id) <= 50""", "doc_assets", "asset_text", "asset_captions", "asset_embeddings"))  # fmt: skip
def blended_search(t):
    text = search.search_text(t.assets, _doc_index(t), "then ere", 50)
    return search.blended_each(text, vectors.search_each(t.asset_embeddings, _query_vectors(t), 50), _query_vectors(t).select("query_id"), 50)


@query(Orders, sql("""SELECT a.id AS asset_id, regexp_extract(path, '[^/]*$') AS filename, coalesce(camera, '') AS camera, coalesce(lens, '') AS lens, coalesce(t.l, '') AS tags, coalesce(p.l, '') AS people, '' AS ocr_text, '' AS auto_tags, '' AS caption
  FROM assets a LEFT JOIN (SELECT asset_id, string_agg(DISTINCT name, ' ' ORDER BY name) AS l FROM asset_tags x JOIN tags g ON g.id = x.tag_id GROUP BY asset_id) t ON t.asset_id = a.id
  LEFT JOIN (SELECT asset_id, string_agg(DISTINCT name, ' ' ORDER BY name) AS l FROM faces f JOIN people q ON q.id = f.person_id WHERE NOT ignored AND trim(name) <> '' GROUP BY asset_id) p ON p.asset_id = a.id""", "assets", "tags", "asset_tags", "people"))  # fmt: skip
def search_documents(t):
    return search.search_documents(t.assets, t.tags, t.asset_tags, t.faces, t.people)


# -- memories --------------------------------------------------------------

RANK = "CAST(favorite AS INTEGER) * 10 + rating * 2 + CASE WHEN thumbnail_path IS NOT NULL THEN 1 ELSE 0 END"
SHOT = "(media_type = 'image' AND camera IS NULL AND (lower(path) LIKE '%screenshot%' OR lower(path) LIKE '%screen shot%'))"
PAST = f"ev >= TIMESTAMP '{AS_OF}' - INTERVAL 1095 DAY AND ev < TIMESTAMP '{AS_OF}'"
DAY, THIS_YEAR = "03-17", 2001
ON_DAY = f"strftime(ev, '%m-%d') = '{DAY}' AND year(ev) < {THIS_YEAR}"
# greedy runs: from each day the longest span of up to four days, then the jump past an accepted one
RUNS = """, days AS (SELECT CAST(ev AS DATE) AS day, count(*) AS n FROM live GROUP BY 1),
  isl AS (SELECT day, n, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS island FROM days),
  pos AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY day) AS i, count(*) OVER (PARTITION BY island) AS size FROM isl),
  span AS (SELECT p.island, p.i, p.size, p.day AS start_day, max(q.day) AS end_day, max(q.i) AS j, CAST(sum(q.n) AS BIGINT) AS total, bool_or(dayofweek(q.day) IN (0, 6)) AS weekend FROM pos p JOIN pos q ON q.island = p.island AND q.i BETWEEN p.i AND p.i + 3 GROUP BY 1, 2, 3, 4),
  ok AS (SELECT *, j > i AND total >= 5 AND weekend AS good FROM span),
  walk AS (SELECT * FROM ok WHERE i = 1 UNION ALL SELECT ok.* FROM walk JOIN ok ON ok.island = walk.island AND ok.i = CASE WHEN walk.good THEN walk.j + 1 ELSE walk.i + 1 END),
  runs AS (SELECT start_day, end_day, total FROM walk WHERE good)"""


def _runs(t):
    return memories.weekend_runs(P.live(t.assets).groupBy(F.to_date(P.event_ts()).alias("day")).agg(F.count(F.lit(1)).alias("n")))


@query(Orders, sql(f"SELECT id, {RANK} AS rank_score FROM live ORDER BY {RANK} DESC, ev DESC, id LIMIT 200", "live"))
def memory_rank(t):
    return memories.rank(t.assets)


@query(Orders, sql(f"""SELECT ym, arg_min(id, (CASE WHEN {SHOT} THEN 1 ELSE 0 END, -({RANK}), -epoch(ev), id)) AS cover_id FROM (SELECT *, strftime(ev, '%Y-%m') AS ym FROM live) GROUP BY ym""", "live"))
def memory_cover(t):
    return memories.covers(P.live(t.assets).withColumn("ym", F.date_format(P.event_ts(), "yyyy-MM")), "ym").select("ym", "cover_id")


@query(Orders, sql(f"""SELECT 'on_this_day:{DAY}' AS id, 'on_this_day' AS kind, 'On this day' AS title, CASE WHEN count(DISTINCT year(ev)) <= 1 THEN count(*) || ' photos from past years' ELSE count(*) || ' photos across ' || count(DISTINCT year(ev)) || ' years' END AS subtitle,
  count(*) AS asset_count, arg_min(id, (CASE WHEN {SHOT} THEN 1 ELSE 0 END, -({RANK}), -epoch(ev), id)) AS cover_asset_id FROM live WHERE {ON_DAY} HAVING count(*) >= 3""", "live"))  # fmt: skip
def on_this_day(t):
    return memories.on_this_day(t.assets, f"{THIS_YEAR}-{DAY}")


@query(Orders, sql(f"SELECT CAST(ev AS DATE) AS day, count(*) AS n FROM live WHERE {PAST} GROUP BY 1", "live"))
def day_counts(t):
    return memories.day_counts(t.assets, AS_OF)


@query(Orders, sql(RUNS + "SELECT * FROM runs", "live", recursive=True))
def weekend_runs(t):
    return _runs(t)


@query(Orders, sql(RUNS + "SELECT start_day, id FROM live JOIN runs ON CAST(ev AS DATE) BETWEEN start_day AND end_day", "live", recursive=True))
def weekend_assets(t):
    return memories.run_assets(t.assets, _runs(t)).select("start_day", "id")


PLACE = """, placed AS (SELECT start_day, place_label, count(*) AS n FROM live JOIN runs ON CAST(ev AS DATE) BETWEEN start_day AND end_day JOIN asset_places p ON p.asset_id = live.id WHERE trim(place_label) <> '' GROUP BY 1, 2),
  dominant AS (SELECT start_day, arg_min(place_label, (-n, place_label)) AS place_label, max(n) AS n FROM placed GROUP BY start_day)"""


@query(Orders, sql(RUNS + PLACE + "SELECT * FROM dominant", "live", "asset_places", recursive=True))
def dominant_place(t):
    return memories.dominant_place(memories.run_assets(t.assets, _runs(t)), t.asset_places)


PERSON = """SELECT person_id, name, place_label, count(DISTINCT f.asset_id) AS n FROM faces f JOIN people p ON p.id = f.person_id AND NOT ignored AND trim(name) <> '' JOIN live a ON a.id = f.asset_id
  JOIN asset_places x ON x.asset_id = a.id AND trim(place_label) <> '' GROUP BY 1, 2, 3 HAVING count(DISTINCT f.asset_id) >= 5"""


@query(Orders, sql(PERSON + " ORDER BY n DESC, person_id, place_label LIMIT 20", "live", "people", "asset_places"))
def memories_person_place(t):
    return memories.person_places(t.faces, t.people, t.asset_places, t.assets)


FEED = RUNS + PLACE + f""", w AS (SELECT runs.*, place_label FROM runs LEFT JOIN dominant USING (start_day) ORDER BY total DESC, start_day DESC LIMIT 12),
  pp AS ({PERSON} ORDER BY n DESC, person_id, place_label LIMIT 20),
  feed AS (SELECT 0 AS ord, 'on_this_day:{DAY}' AS id, 'on_this_day' AS kind, 'On this day' AS title, count(*) AS asset_count, '' AS s, '' AS tie FROM live WHERE {ON_DAY} HAVING count(*) >= 3
    UNION ALL SELECT 1, 'weekend:' || strftime(start_day, '%Y-%m-%d'), 'weekend', CASE WHEN place_label IS NULL THEN 'Weekend trip' ELSE 'Weekend in ' || place_label END, total, 'weekend:' || strftime(start_day, '%Y-%m-%d'), '' FROM w
    UNION ALL SELECT 2, 'person_place:' || person_id || '|' || place_label, 'person_place', name || ' in ' || place_label, n, '', person_id || '|' || place_label FROM pp)"""


def _cards(t):
    return memories.on_this_day(t.assets, f"{THIS_YEAR}-{DAY}"), memories.weekend_cards(t.assets, _runs(t), t.asset_places), memories.person_places(t.faces, t.people, t.asset_places, t.assets)


@query(Orders, sql(FEED + "SELECT id, kind, title, asset_count, CAST(row_number() OVER (ORDER BY ord, asset_count DESC, s DESC, tie) - 1 AS INTEGER) AS pos FROM feed WHERE id <> 'weekend:1998-05-02' QUALIFY row_number() OVER (ORDER BY ord, asset_count DESC, s DESC, tie) <= 50", "live", "people", "asset_places", recursive=True))
def memory_feed(t):
    dismissed = t.spark.createDataFrame([("weekend:1998-05-02",)], "memory_id string")
    return memories.memories(*_cards(t), dismissed)


_queries["memories"], _sql["memories"] = _queries.pop("memory_feed"), _sql.pop("memory_feed")

WHEN = "strftime(start_day, '%b %d') || ' – ' || strftime(end_day, '%b %d, %Y')"


@query(Orders, sql(RUNS + PLACE + f""", w AS (SELECT runs.*, place_label FROM runs LEFT JOIN dominant USING (start_day) ORDER BY total DESC, start_day DESC LIMIT 12)
  SELECT 'weekend:' || strftime(start_day, '%Y-%m-%d') AS id, CASE WHEN place_label IS NULL THEN 'A weekend trip from ' || {WHEN} || '.' ELSE 'A weekend in ' || place_label || ', ' || {WHEN} || '.' END AS insight FROM w""", "live", "asset_places", recursive=True))  # fmt: skip
def memory_insight(t):
    w, none = memories.weekend_cards(t.assets, _runs(t), t.asset_places), F.lit(None).cast("string")
    return w.select("id", memories.insight(F.col("kind"), F.col("place_label"), none, F.col("subtitle"), none, none).alias("insight"))


CUT = "list_max(list_filter(range(0, 118), lambda i: octet_length(encode(substring(t, 1, i))) <= 117 AND i <= length(t)))"
QUOTE = f"""CASE WHEN octet_length(encode(t)) < 8 OR lower(t) IN ('caption', 'what does the image describe?') OR starts_with(lower(t), '<caption') THEN NULL
  WHEN octet_length(encode(t)) > 120 THEN substring(t, 1, {CUT}) || '…' ELSE t END"""


@query(Documents, sql(f""", r AS (SELECT source, CAST(doc_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents),
  q AS (SELECT source, pos, {QUOTE} AS quote FROM (SELECT source, pos, trim(caption) AS t FROM r JOIN asset_captions c ON c.asset_id = r.id WHERE pos < 16))
  SELECT source, arg_min(quote, pos) AS quote FROM q WHERE quote IS NOT NULL GROUP BY source""", "asset_captions"))  # fmt: skip
def memory_quote(t):
    from pyspark.sql import Window

    ranked = t.read("documents").select("source", F.col("doc_id").cast("string").alias("id"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("n"))
    ranked = ranked.where(F.col("n") <= memories.QUOTE_CANDIDATES)  # on the number itself: each task passes on only the first of a source
    return memories.quotes(ranked.select("source", "id", (F.col("n") - 1).alias("pos")), t.asset_captions, "source")


@query(Orders, sql(FEED + r", p AS (SELECT id, 'Summarize this photo memory in one warm sentence.' || chr(10) || 'Title: ' || title || chr(10) || 'Details: ' || asset_count || ' photos' || chr(10) || 'Caption: (none)' || chr(10) || 'Sentence:' AS t FROM feed) SELECT id, sha256(t || 'prose-v1') AS input_hash FROM p", "live", "people", "asset_places", recursive=True))
def prose_cache(t):
    feed = memories.memories(*_cards(t))
    text = memories.prompt(F.col("title"), F.concat(F.col("asset_count").cast("string"), F.lit(" photos")), F.lit(None).cast("string"))
    return feed.select("id", memories.prompt_hash(text).alias("input_hash"))




@query(Documents)
def diversify(t):
    rows = t.assets.join(t.asset_embeddings.withColumnRenamed("asset_id", "id"), "id", "left")
    base = F.pmod(F.col("id").cast("long"), F.lit(7)).cast("double")
    return memories.diversify(rows.select(F.coalesce("label", F.lit(-1)).alias("k"), "id", base.alias("base"), "vector"), "k", 20)


# -- people and places -----------------------------------------------------


def _face_vectors(t):
    return t.asset_embeddings.select(F.lit("library").alias("scope"), F.col("asset_id").alias("id"), F.col("asset_id").cast("long").alias("ord"), "vector", F.col("label").cast("string").alias("person_id"))


@query(Documents)
def face_clusters(t):
    return people.assign_faces(_face_vectors(t))


def _people(t):
    c = vectors.group_centroids(_face_vectors(t), "person_id").groupBy("person_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("centroid"), F.max("n").alias("face_count"))
    k = F.col("person_id").cast("int")
    return c.select(F.lit("library").alias("scope"), F.col("person_id").alias("id"), F.when(k % 3 == 0, F.concat(F.lit("Person "), "person_id")).alias("name"), "centroid", "face_count", (k % 5 == 4).alias("ignored"))


@query(Documents)
def consolidate_people(t):
    return people.consolidate(_people(t))


@query(Documents)
def recluster(t):
    return people.recluster(_face_vectors(t), _people(t))


def _scored_faces(t):
    k = F.col("asset_id").cast("long")
    return t.asset_embeddings.select(F.col("asset_id").alias("id"), F.col("label").cast("string").alias("person_id"), (k % 97 / F.lit(97.0)).alias("score"), F.when(k % 4 != 0, F.concat(F.lit("/crops/"), "asset_id")).alias("crop_path"), "vector")


@query(Documents, sql(""", f AS (
    SELECT asset_id AS id, CASE WHEN CAST(asset_id AS BIGINT) % 100 = 1 THEN 'new:' || asset_id WHEN label = 1 THEN '0' WHEN label = 7 THEN '6' ELSE CAST(label AS VARCHAR) END AS person_id,
           CAST(asset_id AS BIGINT) % 97 / 97.0::DOUBLE AS score, CAST(asset_id AS BIGINT) % 4 = 0 AS bare, vector FROM asset_embeddings),
  stats AS (SELECT person_id AS id, count(*) AS face_count, arg_min(id, (bare, -score, id)) AS cover_face_id FROM f GROUP BY person_id),
  dims AS (SELECT person_id AS id, i, avg(vector[i]::DOUBLE) AS m FROM f, range(1, 65) r(i) GROUP BY 1, 2),
  heads AS (SELECT id, round(max(m) FILTER (i = 1) / sqrt(sum(m * m)), 6) AS first FROM dims GROUP BY id)
  SELECT id, CASE WHEN id = '2' THEN 'Ada' WHEN id = '3' OR id LIKE 'new:%' THEN NULL WHEN CAST(id AS INTEGER) % 3 = 0 THEN 'Person ' || id END AS name, face_count, cover_face_id, first FROM stats JOIN heads USING (id)""", "asset_embeddings"))  # fmt: skip
def corrected_people(t):
    """Two merges, faces taken out of their people, a renaming and a name taken away: counts, covers and centroids follow."""
    faces = _scored_faces(t)
    after = people.detached(people.moved(faces, t.spark.createDataFrame([("1", "0"), ("7", "6")], "person_id string, to string")), faces.where(F.col("id").cast("long") % 100 == 1))
    named = people.renamed(_people(t).join(people.person_stats(faces).select(F.col("person_id").alias("id"), "cover_face_id"), "id"), t.spark.createDataFrame([("2", " Ada "), ("3", " ")], "id string, name string"))
    return people.rebuilt(named, faces, after).select("id", "name", "face_count", "cover_face_id", F.round(F.col("centroid")[0], 6).alias("first"))


NEAREST = """WITH cities AS (SELECT n_name || ', ' || r_name AS place_label, r_name AS country, CAST((n_nationkey * 7) % 180 - 90 AS DOUBLE) AS lat, CAST((n_nationkey * 13) % 360 - 180 AS DOUBLE) AS lon FROM nation JOIN region ON n_regionkey = r_regionkey),
  points AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CAST((c_custkey * 31) % 170 - 85 AS DOUBLE) AS lat, CAST((c_custkey * 47) % 358 - 179 AS DOUBLE) AS lon FROM customer),
  d AS (SELECT p.id, place_label, country, 2 * 6371.0 * asin(least(sqrt(pow(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - p.lon) / 2), 2)), 1.0)) AS km FROM points p, cities c)
  SELECT id, b.place_label, b.country, round(b.km, 3) AS km FROM (SELECT id, min({'km': round(km, 6), 'place_label': place_label, 'country': country}) AS b FROM d GROUP BY id)"""


@query(Orders, NEAREST)
def geo_label(t):
    n = t.read("nation").join(t.read("region"), F.expr("n_regionkey = r_regionkey"))
    cities = n.selectExpr("n_name as city", "r_name as region", "r_name as cc", "cast((n_nationkey * 7) % 180 - 90 as double) as lat", "cast((n_nationkey * 13) % 360 - 180 as double) as lon")
    points = t.read("customer").selectExpr("cast(c_custkey as string) as id", "cast((c_custkey * 31) % 170 - 85 as double) as lat", "cast((c_custkey * 47) % 358 - 179 as double) as lon")
    return geo.nearest_place(points, cities).withColumn("km", F.round("km", 3))


# -- changes ---------------------------------------------------------------


def _new_files(t):
    """The catalogue as found again, every third of it changed, and some new ones."""
    k = F.col("id").cast("long")
    path = F.when(k % 10 == 4, F.concat(F.lit("/new"), "path")).otherwise(F.col("path"))
    return t.assets.select(path.alias("path"), F.when(k % 3 == 0, F.sha2(F.concat(F.lit("v2"), "id"), 256)).otherwise(F.col("hash")).alias("hash"), "media_type", (F.col("file_size") + 1).alias("file_size"), "created_at")


@query(Orders, sql("""SELECT CASE WHEN k % 10 = 4 THEN 'inserted' WHEN k % 3 = 0 THEN 'updated' ELSE 'skipped' END AS outcome, count(*) AS n, count(*) FILTER (deleted_at IS NOT NULL AND NOT (k % 10 <> 4 AND k % 3 = 0) AND k % 10 <> 4) AS in_trash
  FROM (SELECT *, CAST(id AS BIGINT) AS k FROM assets) GROUP BY 1""", "assets"))  # fmt: skip
def upsert_assets(t):
    out = ingest.upsert(t.assets, _new_files(t), AS_OF).where("outcome is not null")
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("deleted_at").isNotNull()).alias("in_trash"))


@query(Orders, sql(f"SELECT id, path, thumbnail_path FROM assets WHERE deleted_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY", "assets"))
def retention_purge(t):
    return ingest.purge(t.assets, AS_OF)


@query(Orders, sql("SELECT id, rating AS before, CAST(4 AS BIGINT) AS after FROM assets WHERE id IN ('25', '7', '101', '50', '3')", "assets"))
def set_ratings(t):
    return ingest.set_value(t.assets, IDS, "rating", 4)


@query(Orders, "SELECT CAST(event_id % 2000 AS VARCHAR) AS asset_id, event_type AS kind, arg_max(value, (ts, event_id)) AS state, count(*) AS attempts FROM events GROUP BY 1, 2")
def job_states(t):
    return ingest.job_states(t.read("events").selectExpr("cast(event_id % 2000 as string) as asset_id", "event_type as kind", "value as state", "ts", "event_id"))


QUEUE = "SELECT CAST(user_id AS VARCHAR) AS path, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'upsert' END AS kind, event_type = 'click' AS thumb, event_id AS seq FROM events"


@query(Orders, f"""WITH q AS ({QUEUE}), l AS (SELECT path, max(seq) AS seq, arg_max(kind, seq) AS kind, max(seq) FILTER (kind = 'remove') AS cut FROM q GROUP BY path)
  SELECT l.path, l.kind, CASE WHEN l.kind = 'upsert' THEN coalesce((SELECT bool_or(thumb) FROM q WHERE q.path = l.path AND q.seq > coalesce(l.cut, -1)), false) ELSE false END AS thumb, l.seq FROM l""")
def dedup_queue(t):
    return ingest.dedup_queue(t.read("events").selectExpr("cast(user_id as string) as path", "if(event_type = 'error', 'remove', 'upsert') as kind", "event_type = 'click' as thumb", "event_id as seq"))


@query(Orders, sql("SELECT path, file_size AS size FROM (SELECT path, file_size, sum(file_size) OVER (ORDER BY indexed_at DESC, path DESC ROWS UNBOUNDED PRECEDING) AS s FROM assets) WHERE s > 20000000000", "assets"))
def cache_eviction(t):
    return ingest.evict(t.assets.selectExpr("path", "file_size as size", "indexed_at as modified"), 20_000_000_000)


@query(Orders, sql("SELECT * FROM faces WHERE asset_id IN (SELECT id FROM live)", "faces", "live"))
def cascade_delete(t):
    return ingest.cascade(t.faces, P.live(t.assets))


@query(Orders, sql("SELECT asset_id, max(viewed_at) AS viewed_at FROM (SELECT * FROM asset_views UNION ALL SELECT CAST(user_id AS VARCHAR), ts FROM events WHERE event_type = 'click') WHERE asset_id IN (SELECT id FROM live) GROUP BY asset_id", "asset_views", "live"))
def record_views(t):
    seen = t.read("events").where("event_type = 'click'").selectExpr("cast(user_id as string) as asset_id", "cast(ts as timestamp_ntz) as viewed_at")
    return ingest.record_views(t.asset_views, seen, t.assets)


# -- extensions over events ------------------------------------------------


@query(Orders, "SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def events_daily(t):
    return streams.tumbling(t.read("events").withColumn("at", F.col("ts").cast("timestamp"))).withColumn("value", F.round("value", 4))


@query(Orders, """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(t):
    return streams.sessions(t.read("events").withColumn("at", F.col("ts").cast("timestamp")))


# -- formats and export names ----------------------------------------------

_SIZE = " ".join(f"WHEN size < {1024 ** (i + 1)} THEN CASE WHEN size / {1024.0**i} < 10 THEN printf('%.1f {u}', floor(size / {1024.0**i} * 10 + 0.5) / 10) ELSE printf('%d {u}', CAST(floor(size / {1024.0**i} + 0.5) AS BIGINT)) END" for i, u in enumerate(["KB", "MB", "GB"], 1))


@query(Orders, sql(f"""SELECT id, CASE WHEN size < 1024 THEN printf('%d B', CAST(size AS BIGINT)) {_SIZE} END AS size,
  CASE WHEN duration_ms IS NULL THEN 'Not available' ELSE printf('%d:%02d', CAST(floor(duration_ms / 1000.0 + 0.5) AS BIGINT) // 60, CAST(floor(duration_ms / 1000.0 + 0.5) AS BIGINT) % 60) END AS duration
  FROM (SELECT id, file_size * (CAST(id AS BIGINT) % 1500) AS size, duration_ms + CAST(id AS BIGINT) % 1000 AS duration_ms FROM assets)""", "assets"))  # fmt: skip
def formatted(t):
    k = F.col("id").cast("long")
    return t.assets.select("id", formats.bytes_text(F.col("file_size") * (k % 1500)).alias("size"), formats.duration_text(F.col("duration_ms") + k % 1000).alias("duration"))


@query(Orders, sql(r"""SELECT id, seq, CASE WHEN seq < 1000 THEN right('000' || seq, 4) ELSE CAST(seq AS VARCHAR) END || regexp_extract(path, '(\.[^./]+)$', 1) AS name
  FROM (SELECT id, path, CAST(id AS BIGINT) * 7 AS seq FROM live)""", "live"))
def export_names_sequential(t):
    rows = P.live(t.assets).select("id", (F.col("id").cast("long") * 7).alias("seq"), "captured_at", "path")
    return ingest.export_names(rows, "sequential")


# -- edit revisions --------------------------------------------------------

EDITS = """, edits AS (SELECT event_id AS id, CAST(event_id % 2000 AS VARCHAR) AS asset_id, props AS ops_json, ts AS created_at FROM events),
  images AS (SELECT id FROM assets WHERE media_type = 'image')"""


def _image_edits(t):
    return t.asset_edits, t.assets


@query(Orders, sql(EDITS + """, firsts AS (SELECT asset_id, arg_min(ops_json, (created_at, id)) AS ops FROM edits GROUP BY asset_id), lasts AS (SELECT asset_id, arg_max(ops_json, (created_at, id)) AS ops FROM edits GROUP BY asset_id)
  SELECT lasts.asset_id, CASE WHEN images.id IS NOT NULL THEN firsts.ops ELSE lasts.ops END AS ops_json FROM lasts JOIN firsts USING (asset_id) LEFT JOIN images ON images.id = lasts.asset_id""", "assets"))
def edit_revert(t):
    """Every image goes back to its first revision."""
    rows, assets = _image_edits(t)
    asks = rows.groupBy("asset_id").agg(F.min_by("id", F.struct("created_at", "id")).alias("revision_id"), F.max("id").alias("last"))
    asks = asks.select((F.col("last") + 100_000_000).alias("id"), "asset_id", "revision_id", F.expr("timestamp_ntz'2030-01-01 00:00:00'").alias("created_at"))
    return browse.latest(edits.revert(rows, asks, assets), "asset_id", "created_at", "id").select("asset_id", "ops_json")


@query(Orders, sql(EDITS + """ SELECT id, asset_id FROM edits WHERE CAST(asset_id AS BIGINT) % 4 <> 0 OR asset_id IN (SELECT id FROM assets WHERE media_type <> 'image')
  UNION ALL SELECT CAST(id AS BIGINT) + 200000000, id FROM images WHERE CAST(id AS BIGINT) % 1000 = 1""", "assets"))
def edit_clear_append(t):
    """A quarter of the assets lose their revisions, then some images get one."""
    rows, assets = _image_edits(t)
    rows = edits.clear(rows, rows.select("asset_id").where("cast(asset_id as long) % 4 = 0"), assets)
    new = assets.where("cast(id as long) % 1000 = 1").selectExpr("cast(id as long) + 200000000 as id", "id as asset_id", "'{}' as ops_json", "timestamp_ntz'2030-01-01 00:00:00' as created_at")
    return edits.append(rows, new, assets).select("id", "asset_id")


# -- derived data and jobs -------------------------------------------------

@query(Orders, sql("SELECT asset_id, kind, state FROM ml_jobs WHERE NOT (kind = 'click' AND CAST(asset_id AS BIGINT) % 50 = 0)", "ml_jobs"))
def ocr_invalidate(t):
    _, jobs = ingest.clear_derived(t.asset_views, t.ml_jobs, "click", t.ml_jobs.where("cast(asset_id as long) % 50 = 0"))
    return jobs.select("asset_id", "kind", "state")


@query(Orders, sql("SELECT kind, count(*) AS n FROM ml_jobs WHERE kind <> 'view' GROUP BY kind UNION ALL SELECT 'derived', 0", "ml_jobs"))
def ocr_clear(t):
    rows, jobs = ingest.clear_derived(t.asset_views, t.ml_jobs, "view")
    return jobs.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).union(rows.agg(F.lit("derived"), F.count(F.lit(1))))


@query(Orders, sql("SELECT asset_id, kind FROM ml_jobs WHERE NOT (kind = 'view' AND state = 'done' AND asset_id NOT IN (SELECT asset_id FROM asset_tags WHERE tag_id < 'Brand#3'))", "ml_jobs", "asset_tags"))
def reset_unlabelled(t):
    return ingest.reset_unlabelled(t.ml_jobs, t.asset_tags.where("tag_id < 'Brand#3'"), "view").select("asset_id", "kind")


@query(Orders, sql("SELECT asset_id, kind FROM ml_jobs WHERE NOT (kind = 'click' AND state = 'failed' AND attempts >= 3)", "ml_jobs"))
def reset_failed(t):
    return ingest.reset_failed(t.ml_jobs, "click").select("asset_id", "kind")


# -- further listings ------------------------------------------------------

@query(Documents, sql("SELECT * FROM asset_captions WHERE asset_id = '42'", "asset_captions"))
def asset_caption(t):
    return browse.of_asset(t.asset_captions, "42")


@query(Documents, sql("SELECT * FROM asset_text WHERE asset_id = '42'", "asset_text"))
def asset_ocr(t):
    return browse.of_asset(t.asset_text, "42")


_EXPORTS = "SELECT event_id AS id, '/exports/' || event_id || '.zip' AS path, event_id % 90 AS asset_count, event_id % 90 - event_id % 7 % 2 AS exported_count, event_id % 7 % 2 AS missing_count, ts AS created_at FROM events WHERE event_type = '{}' ORDER BY created_at DESC, id DESC LIMIT 50"


def _archives(t, kind: str):
    rows = t.read("events").where(F.col("event_type") == kind)
    return rows.selectExpr("event_id as id", "concat('/exports/', event_id, '.zip') as path", "event_id % 90 as asset_count", "event_id % 90 - event_id % 7 % 2 as exported_count", "event_id % 7 % 2 as missing_count", "cast(ts as timestamp_ntz) as created_at")


@query(Orders, _EXPORTS.format("purchase"))
def exports(t):
    return browse.newest(_archives(t, "purchase"), 50)


@query(Orders, _EXPORTS.format("click"))
def import_runs(t):
    return browse.newest(_archives(t, "click"), 50)


LOCKED = """, albums_l AS (SELECT CAST(c_custkey AS VARCHAR) AS id, TIMESTAMP '1994-01-01' + (c_custkey % 700) * INTERVAL 1 DAY AS created_at FROM customer),
  locked AS (SELECT CAST(o_orderkey AS VARCHAR) AS asset_id, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS locked_album_id, o_orderdate AS locked_at FROM orders WHERE o_orderstatus = 'F')"""


def _locked(t):
    albums = t.read("customer").selectExpr("cast(c_custkey as string) as id", "timestamp_ntz'1994-01-01 00:00:00' + (c_custkey % 700) * interval '1' day as created_at")
    return albums, t.read("orders").where("o_orderstatus = 'F'").selectExpr("cast(o_orderkey as string) as asset_id", "case when o_orderkey % 5 <> 0 then cast(o_custkey as string) end as locked_album_id", "cast(o_orderdate as timestamp_ntz) as locked_at")


@query(Orders, sql(LOCKED + " SELECT id, created_at, (SELECT count(*) FROM locked WHERE locked_album_id = albums_l.id) AS n FROM albums_l", "assets"))
def locked_albums(t):
    return browse.locked_albums(*_locked(t))


@query(Orders, sql(LOCKED + " SELECT * FROM locked WHERE locked_album_id IS NULL", "assets"))
def locked_items(t):
    return browse.locked_items(_locked(t)[1])


@query(Orders, sql(LOCKED + " SELECT id, path, id IN (SELECT asset_id FROM locked) AS vault_locked FROM live", "live"))
def flag_locked(t):
    return browse.flag_locked(P.live(t.assets).select("id", "path"), _locked(t)[1])


@query(Orders, "SELECT CAST(s_suppkey AS VARCHAR) AS id, '/roots/' || s_name AS path, TIMESTAMP '2020-01-01' + s_suppkey * INTERVAL 1 HOUR AS created_at FROM supplier")
def watched_roots(t):
    return browse.oldest(t.read("supplier").selectExpr("cast(s_suppkey as string) as id", "concat('/roots/', s_name) as path", "timestamp_ntz'2020-01-01 00:00:00' + s_suppkey * interval '1' hour as created_at"))


@query(Orders, sql("SELECT * FROM faces WHERE crop_path IS NOT NULL AND regexp_extract(crop_path, '-([0-9]+)', 1)::BIGINT % 10 = 0", "faces"))
def stale_crops(t):
    files = t.faces.where("crop_path is not null").selectExpr("crop_path as path").where("cast(regexp_extract(path, '-([0-9]+)', 1) as long) % 10 <> 0").distinct()
    return browse.stale_crops(t.faces, files).select(*t.faces.columns)


@query(Orders, "SELECT CAST(p_partkey AS VARCHAR) AS option_id, p_brand AS kind, p_partkey % 3 = 0 AS installed, p_partkey % 30 = 0 AS active FROM part")
def model_status(t):
    p = t.read("part").selectExpr("cast(p_partkey as string) as option_id", "p_brand as kind", "p_partkey as k")
    return browse.model_status(p.where("k % 2 = 0"), p.where("k % 2 = 1"), p.where("k % 3 = 0"), p.where("k % 30 = 0"))


@query(Orders, sql("SELECT count(*) FILTER (face_count > 0) AS n FROM people", "people"))
def people_badge(t):
    return people.badge(t.people)


@query(Orders, sql("SELECT id FROM live WHERE media_type = 'video' AND id NOT IN (SELECT id FROM live a ORDER BY a.ev DESC NULLS LAST, a.id LIMIT 500)", "live"))
def next_page(t):
    videos = P.live(t.assets).where("media_type = 'video'").select("id")
    return browse.without_shown(videos.union(videos), browse.list_assets(t.assets))


# -- memberships -----------------------------------------------------------

@query(Orders, sql("SELECT * FROM album_assets UNION SELECT '1', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P'", "album_assets"))
def album_add(t):
    return ingest.add_members(t.album_assets, t.read("orders").where("o_orderstatus = 'P'").selectExpr("'1' as album_id", "cast(o_orderkey as string) as asset_id"))


@query(Orders, sql("SELECT * FROM asset_tags WHERE CAST(asset_id AS BIGINT) % 5 <> 0 UNION ALL SELECT DISTINCT asset_id, 'kept' FROM asset_tags WHERE CAST(asset_id AS BIGINT) % 5 = 0", "asset_tags"))
def tags_replace(t):
    return ingest.replace_members(t.asset_tags, "asset_id", t.asset_tags.where("cast(asset_id as long) % 5 = 0").selectExpr("asset_id", "'kept' as tag_id"))


@query(Orders, sql("SELECT name FROM albums UNION ALL SELECT min(place_label) FROM asset_places WHERE place_label <> '' AND lower(place_label) NOT IN (SELECT lower(name) FROM albums) GROUP BY lower(place_label)", "albums", "asset_places"))
def place_albums(t):
    return ingest.ensure_named(t.albums, t.asset_places.selectExpr("place_label as name")).select("name")


@query(Orders, sql("SELECT '/copies' || path AS path, hash, id AS twin_id, captured_at, camera, lens FROM live WHERE CAST(id AS BIGINT) % 9 = 0", "live"))
def skipped_copies(t):
    files = t.assets.where("cast(id as long) % 9 = 0").selectExpr("concat('/copies', path) as path", "hash").union(t.assets.select("path", "hash"))
    return duplicates.skipped_copies(files, t.assets)


# -- memories: albums, cards, prose ----------------------------------------

@query(Orders, sql("""SELECT 'album' AS kind, (SELECT id FROM live WHERE favorite ORDER BY CAST(id AS BIGINT) LIMIT 1) AS asset_id
  UNION ALL SELECT 'member', id FROM (SELECT id FROM live WHERE favorite ORDER BY CAST(id AS BIGINT) LIMIT 200)""", "live"))
def memory_album(t):
    ranked = P.live(t.assets).where("favorite").select("id", F.col("id").cast("long").alias("pos"))
    album, members = memories.save_as_album(ranked, "weekend:1998-05-02", "A weekend", "  Our trip ")
    return album.select(F.lit("album").alias("kind"), F.col("cover_asset_id").alias("asset_id")).union(members.select(F.lit("member"), "asset_id"))


@query(Orders, sql("SELECT id, CAST(row_number() OVER (ORDER BY CAST(id AS BIGINT)) - 1 AS INTEGER) AS pos, false AS stale FROM live WHERE favorite QUALIFY row_number() OVER (ORDER BY CAST(id AS BIGINT)) <= 30", "live"))
def memory_cache(t):
    """Cards are built twice; readers have the last ones, which are fresh on the day they were built."""
    cards = P.live(t.assets).where("favorite").select("id", F.col("id").cast("long").alias("k")).orderBy("k").limit(30)
    cards = cards.select("id", (F.row_number().over(Window.orderBy("k")) - 1).alias("pos"))
    folder = work_path(cards.sparkSession, "cards")
    memories.rebuild_cache(cards.where("pos < 3"), folder, "2001-08-01")
    memories.rebuild_cache(cards, folder, "2001-08-02")
    built = t.spark.sql("select date'2001-08-02' as built_on, timestamp_ntz'2001-08-02 08:00:00' as built_at")
    dirty = t.spark.sql("select timestamp_ntz'2001-08-02 07:59:00' as at")
    return memories.cached_cards(cards, folder).crossJoin(memories.cache_state(built, dirty, "2001-08-02"))


_RAW = """CASE CAST(asset_id AS BIGINT) % 6 WHEN 0 THEN '  "' || caption || '" ' || chr(10) WHEN 1 THEN chr(9) || 'Sentence: ' || caption WHEN 2 THEN 'I''m sorry, ' || caption WHEN 3 THEN left(caption, 15) WHEN 4 THEN 'Summary: ' || left(caption, 40) ELSE caption END"""


@query(Documents, sql(f""", raw AS (SELECT asset_id, trim(trim(trim({_RAW}, ' ' || chr(9) || chr(10)), '"'), ' ' || chr(9) || chr(10)) AS t, left(caption, 15) AS title FROM asset_captions),
  cut AS (SELECT *, trim(regexp_replace(t, '^(Sentence:|Memory:|Summary:)', ''), ' ' || chr(9) || chr(10)) AS c,
    list_bool_or(list_transform(['i''m sorry', 'i cannot', 'i can''t', 'as an ai', 'ethical', 'against', '<pad>', '<unk>'], lambda w: contains(lower(t), w))) AS bad FROM raw)
  SELECT asset_id, CASE WHEN octet_length(encode(t)) BETWEEN 12 AND 280 AND NOT bad AND lower(t) <> lower(title) AND octet_length(encode(c)) >= 12 THEN c END AS line FROM cut""", "asset_captions"))  # fmt: skip
def prose_sanitised(t):
    """Lines as a model might give them, made of the captions: quoted, labelled, refused, echoed, too short or too long."""
    raw = F.expr(_RAW.replace("AS BIGINT", "AS LONG").replace("''", "\\'"))
    return t.asset_captions.select("asset_id", memories.sanitised(raw, F.left("caption", F.lit(15)), F.lit("3 photos")).alias("line"))


_CARD = """SELECT asset_id, CASE k % 3 WHEN 0 THEN 'weekend' WHEN 1 THEN 'on_this_day' ELSE 'person_place' END AS kind, CASE WHEN k % 5 > 0 THEN label END AS place, CASE WHEN k % 7 > 2 THEN 'Ada' END AS person,
  CASE WHEN k % 2 = 0 THEN 'May 2 · 9 photos' ELSE '9 photos' END AS subtitle, CASE k % 4 WHEN 0 THEN ' the sea ' WHEN 1 THEN ' ' END AS quote, CASE k % 11 WHEN 0 THEN ' Prose wins. ' WHEN 1 THEN ' ' END AS prose
  FROM (SELECT asset_id, label, CAST(asset_id AS BIGINT) AS k FROM asset_labels WHERE rank = 1)"""


@query(Documents, sql(f""", card AS ({_CARD}),
  told AS (SELECT *, CASE WHEN kind = 'weekend' AND place IS NOT NULL THEN 'In ' || place || ': ' WHEN kind = 'person_place' AND person IS NOT NULL AND place IS NOT NULL THEN person || ' in ' || place || ' — ' ELSE '' END || '“the sea”' AS quoted,
    CASE WHEN subtitle LIKE 'May%' THEN 'May 2' END AS day FROM card)
  SELECT asset_id, CASE WHEN trim(prose) <> '' THEN trim(prose) WHEN trim(quote) <> '' THEN quoted
    WHEN kind = 'weekend' THEN CASE WHEN place IS NOT NULL AND day IS NOT NULL THEN 'A weekend in ' || place || ', ' || day || '.' WHEN place IS NOT NULL THEN 'A weekend spent in ' || place || '.' WHEN day IS NOT NULL THEN 'A weekend trip from ' || day || '.' ELSE 'A short trip worth remembering.' END
    WHEN kind = 'on_this_day' THEN 'Looking back at this day across the years.'
    WHEN person IS NOT NULL AND place IS NOT NULL THEN 'Moments with ' || person || ' in ' || place || '.' ELSE 'People and places that matter.' END AS line FROM told""", "asset_labels"))  # fmt: skip
def insight_branches(t):
    """Cards of every kind for the labels' places: all branches of the insight."""
    cards = t.spark.sql(_CARD.replace("asset_labels", "{labels}"), labels=t.asset_labels)
    return cards.select("asset_id", memories.insight(*[F.col(c) for c in ("kind", "place", "person", "subtitle", "quote", "prose")]).alias("line"))


# -- search box and stored postings ----------------------------------------

def _no_documents(t):
    return t.assets.select(F.col("id").alias("asset_id"), P.name_of(F.col("path")).alias("filename"))


@query(Orders, sql("SELECT id, CAST(row_number() OVER (ORDER BY ev DESC NULLS LAST, id) - 1 AS INTEGER) AS pos FROM live QUALIFY row_number() OVER (ORDER BY ev DESC NULLS LAST, id) <= 50", "live"))
def search_empty(t):
    return search.search(t.assets, _no_documents(t), "  ")


@query(Orders, sql("SELECT id, CAST(row_number() OVER (ORDER BY ev DESC NULLS LAST, id) - 1 AS INTEGER) AS pos FROM live WHERE media_type = 'image' AND rating >= 4 QUALIFY row_number() OVER (ORDER BY ev DESC NULLS LAST, id) <= 50", "live"))
def search_tokens(t):
    return search.search(t.assets, _no_documents(t), "type:image rating>4")


@query(Documents, sql(BM25 + "SELECT id, CAST(row_number() OVER (ORDER BY r) - 1 AS INTEGER) AS pos FROM top WHERE r <= 50", "doc_assets", "asset_text", "asset_captions"))
def search_box(t):
    return search.search(t.assets, _doc_index(t), "then ere", porter=False)


@query(Documents, sql(BM25 + "SELECT id, round(score, 6) AS score FROM top WHERE r <= 50", "doc_assets", "asset_text", "asset_captions"))
def search_indexed(t):
    """The same over postings: written once, then read by the prefixes alone."""
    index = SearchIndex(t.spark, work_path(t.spark, "index"), porter=False)
    index.update(_doc_index(t))
    hits = index.bm25("then ere").withColumnRenamed("asset_id", "id")
    rows = P.live(t.assets).select("id", P.event_ts().alias("at")).join(hits, "id").orderBy(F.desc("score"), F.desc("at"), "id").limit(50)
    return rows.select("id", F.round("score", 6).alias("score"))


# -- what is kept in versions ----------------------------------------------

@query(Orders, sql("""SELECT month, count(*) AS n, count(*) FILTER (taken) AS taken, count(*) FILTER (trash) AS in_trash FROM (
    SELECT strftime(coalesce(captured_at, created_at), '%Y-%m') AS month, k % 10 <> 4 AND k % 3 = 0 AS taken, deleted_at IS NOT NULL AND NOT (k % 10 <> 4 AND k % 3 = 0) AS trash FROM (SELECT *, CAST(id AS BIGINT) AS k FROM assets)
    UNION ALL SELECT strftime(created_at, '%Y-%m'), true, false FROM assets WHERE CAST(id AS BIGINT) % 10 = 4) GROUP BY month""", "assets"))  # fmt: skip
def catalogue_upserted(t):
    """The catalogue in months, after files have been taken in."""
    c = Catalogue(t.spark, work_path(t.spark, "catalogue"), t.assets.schema)
    c.create(t.assets)
    later = "2030-01-01"
    c.upsert(_new_files(t), later)
    taken = F.col("indexed_at") == F.lit(later).cast("timestamp_ntz")
    month = month_of(F.col("captured_at"), F.col("created_at"))
    return c.read().groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if(taken).alias("taken"), F.count_if(F.col("deleted_at").isNotNull()).alias("in_trash"))


@query(Orders, sql("""SELECT id, CASE WHEN k % 2 = 0 THEN 4 ELSE rating END AS rating, k % 3 = 0 OR favorite AS favorite FROM (SELECT *, CAST(id AS BIGINT) AS k FROM live)""", "live"))
def journal_replayed(t):
    """Ratings and favourites after three changes of which the last two are undone and one is done again, read from a journal each time."""
    folder = work_path(t.spark, "journal")
    k, assets = F.col("id").cast("long"), P.live(t.assets).repartition(t.tasks("orders"), "id")
    for column, some, value in (("rating", k % 2 == 0, F.lit(4).cast("long")), ("favorite", k % 3 == 0, F.lit(True)), ("rating", k % 5 == 0, F.lit(1).cast("long"))):
        change = write_table(assets.where(some).select("id", F.col(column).alias("before"), value.alias("after")), "change")
        Journal(t.spark, folder).record(column, change, needs="live")
        assets = ingest.apply_values(assets, change, column)
    for step in ("undo", "undo", "redo"):
        assets = getattr(Journal(t.spark, folder), step)(assets)
    return assets.select("id", "rating", "favorite")


@query(Orders, sql("SELECT id, CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 'missing' ELSE 'exported' END AS status FROM live WHERE favorite", "live"))
def export_statuses(t):
    """An export of the favourites, trash left out, as it stands in its version; every fifth file is not there."""
    folder = work_path(t.spark, "export")
    there = t.assets.where(F.col("id").cast("long") % 5 != 0).select("path")
    files.export_to(files.export_manifest(t.assets, t.assets.where("favorite").select("id"), there), folder)
    return Versions(t.spark, folder).read("id string, path string, status string").select("id", "status")


@query(Orders, sql(RUNS.replace("FROM live GROUP", "FROM live WHERE CAST(id AS BIGINT) % 7 > 0 GROUP") + """ SELECT 'weekend:' || strftime(start_day, '%Y-%m-%d') AS id, total AS asset_count FROM runs ORDER BY total DESC, start_day DESC LIMIT 12""", "live", recursive=True))
def weekend_cards_refreshed(t):
    """Cards built over the catalogue in months, then refreshed for the days on which assets went to the trash."""
    c = Catalogue(t.spark, work_path(t.spark, "catalogue"), t.assets.schema)
    c.create(t.assets)
    store = CardStore(c, work_path(t.spark, "cards"))
    store.rebuild(t.asset_places)
    gone = P.live(t.assets).where(F.col("id").cast("long") % 7 == 0)
    c.soft_delete(gone.select("id"), AS_OF)
    store.refresh(gone.select(F.to_date(P.event_ts()).alias("day")), t.asset_places)
    return store.cards().select("id", "asset_count")


@query(Documents, sql(BM25 + "SELECT id, round(score, 6) AS score FROM top WHERE r <= 50", "doc_assets", "asset_text", "asset_captions"))
def search_updated(t):
    """Stored postings of file names alone, of which every document is then replaced by itself with its texts, and merged."""
    index, docs = SearchIndex(t.spark, work_path(t.spark, "index"), porter=False), _doc_index(t)
    index.update(docs.select("asset_id", "filename"))
    index.update(docs)
    index.merge()
    hits = index.bm25("then ere").withColumnRenamed("asset_id", "id")
    rows = P.live(t.assets).select("id", P.event_ts().alias("at")).join(hits, "id").orderBy(F.desc("score"), F.desc("at"), "id").limit(50)
    return rows.select("id", F.round("score", 6).alias("score"))

"""Cases on tiny frames."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark import schema as S
from shelfspark.functions import actions
from shelfspark.functions.porter import stem
from shelfspark.functions.predicates import ignored, media_type
from shelfspark.operators import browse, duplicates, facets, geo, ingest, memories, people, search, vector_index, vectors
from shelfspark.sources.work import work_path


def ts(text):
    return dt.datetime.fromisoformat(text) if text else None


def frame(spark, rows):
    """Assets from dictionaries; what is left out is null, or the usual value."""
    base = {"media_type": "image", "favorite": False, "rating": 0, "created_at": ts("2024-01-01"), "indexed_at": ts("2024-01-01")}
    out = []
    for r in rows:
        r = base | {"path": f"/p/{r['id']}.jpg"} | r
        out.append(tuple(ts(v) if isinstance(v := r.get(f.name), str) and isinstance(f.dataType, T.TimestampNTZType) else v for f in S.ASSETS))
    return spark.createDataFrame(out, S.ASSETS)


def ids(df):
    return [r.id for r in df.collect()]


def test_query_language():
    q = browse.parse_query("beach camera:iphone rating>3 before:2024-01-01 type:image fav:true")
    assert q == browse.Query("beach", "iphone", 3, "2024-01-01", None, "image", True)
    assert browse.parse_query("rating>=4").min_rating == 4
    assert browse.parse_query("rating>x type:Audio lens:front").text == "lens:front"
    assert browse.parse_query("camera:a camera:b").camera == "b"
    assert browse.parse_query("  ").is_browse()


def test_facets_are_anded(spark):
    a = frame(spark, [{"id": "a", "rating": 4, "color_label": "yellow"}, {"id": "b", "rating": 4, "color_label": "red"}, {"id": "c", "rating": 5, "color_label": "yellow"}, {"id": "d", "rating": 4, "color_label": "yellow", "deleted_at": "2024-02-01"}])
    t = spark.createDataFrame([("a", "t1"), ("b", "t1"), ("d", "t1")], "asset_id string, tag_id string")
    assert ids(browse.browse(a, t, ["t1"], [4], ["yellow"])) == ["a"]
    assert sorted(ids(browse.browse(a, t, [], [4, 5], ["yellow"]))) == ["a", "c"]
    assert ids(browse.browse(a, t, [], [], [])) == []
    assert sorted(ids(browse.member_assets(a, t))) == ["a", "b"]


def test_smart_collections(spark):
    a = frame(
        spark,
        [{"id": str(i), "path": p} for i, p in enumerate(["/x/a.CR2", "/x/b.dng", "/x/c.nef", "/raw/holiday.jpg"])]
        + [{"id": "s1", "path": "/p/Screenshot 1.png"}, {"id": "s2", "path": "/p/screen shot.png"}, {"id": "s3", "path": "/p/screenshot3.png", "camera": "X"}, {"id": "l1", "lens": "iPhone front camera"}, {"id": "l2", "path": "/p/selfie-2.jpg"}, {"id": "l3", "lens": "back camera"}]
        + [{"id": f"w{i}", "width": w, "height": h} for i, (w, h) in enumerate([(12000, 3000), (2000, 6000), (4000, 2000), (1920, 1080), (4000, 0)])]
        + [{"id": "v", "media_type": "video", "width": 8000, "height": 2000}],
    )
    got = lambda k: sorted(ids(browse.smart(a, k)))
    assert got("raw") == ["0", "1", "2"] and got("screenshots") == ["s1", "s2"] and got("selfies") == ["l1", "l2"]
    assert got("panoramas") == ["w0", "w1", "w2"] and got("videos") == ["v"]
    text = spark.createDataFrame([("0", "x" * 250, 0.8), ("1", "RECEIPT total 5", 0.7), ("2", "x" * 250, 0.1)], "asset_id string, text string, confidence double")
    assert ids(browse.smart(a, "documents", text)) == ["0"] and ids(browse.smart(a, "receipts", text)) == ["1"]
    assert {r.kind: r.n for r in browse.smart_counts(a, text).collect()}["panoramas"] == 3


def test_media_types_and_ignore_patterns(spark):
    df = spark.createDataFrame([("/a/b.JPG",), ("/a/._b.jpg",), ("/a/b.mov",), ("/a/b.txt",), ("/a/Cache/x.png",), ("/a/tmp_1.heic",)], "path string")
    assert [r[0] for r in df.select(media_type(F.col("path"))).collect()] == ["image", None, "video", None, "image", "image"]
    assert [r[0] for r in df.select(ignored(F.col("path"), ["*.MOV", "tmp_*", "cache", " "])).collect()] == [False, False, True, False, True, True]


def test_exact_and_near_duplicates(spark):
    h = "a" * 64
    a = frame(spark, [{"id": "new", "hash": h, "created_at": "2024-06-01"}, {"id": "old", "hash": h, "created_at": "2020-01-01"}, {"id": "x", "hash": "short"}, {"id": "y", "hash": "short"}])
    assert [(r.id, r.pos) for r in duplicates.exact_duplicates(a).orderBy("pos").collect()] == [("old", 0), ("new", 1)]
    rows = [("a", "1", "00ff00ff00ff00ff"), ("b", "2", "00ff00ff00ff00fc"), ("c", "3", "0f0f0f0f0f0f0f0f"), ("d", "4", "f" * 16), ("e", "5", "f" * 16), ("f", "1", "00ff00ff00ff00ff"), ("g", "7", "0f0f0f0f0f0f0f0f")]
    df = spark.createDataFrame(rows, "id string, hash string, p string")
    df = df.select("id", "hash", *duplicates.hex_bands(F.col("p")))
    assert {(r.a, r.b, r.distance) for r in duplicates.near_pairs(df).collect()} == {("a", "b", 2), ("b", "f", 2), ("c", "g", 0)}
    assert {(r.group_key, r.id) for r in duplicates.near_groups(df).collect()} == {("a", "a"), ("a", "b"), ("a", "f"), ("c", "c"), ("c", "g")}
    with pytest.raises(ValueError):
        duplicates.near_pairs(df, 4)


def test_vectors(spark):
    e = spark.createDataFrame([("a1", [1.0, 0.0, 0.0, 0.0]), ("a2", [0.0, 1.0, 0.0, 0.0]), ("a3", [0.7, 0.7, 0.0, 0.0]), ("a4", [1.0])], "asset_id string, vector array<float>")
    assert ids(vectors.semantic_search(e, [1.0, 0.0, 0.0, 0.0])) == ["a1", "a3"]
    v = np.sin(np.arange(1050)[:, None] * 7919 + np.arange(64)[None] * 997)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    many = spark.createDataFrame([(f"{i:04d}", x.tolist()) for i, x in enumerate(v)], "asset_id string, vector array<float>")
    index = vector_index.build(many, work_path(spark, "vectors"))
    top = vector_index.search(index, v[42].tolist(), 5, exact=True).first()
    assert index.usable and top.id == "0042" and top.score > 0.99
    logits = spark.createDataFrame([("a", ["p", "q", "r"], [5.0, 4.0, -9.0]), ("b", ["p", "q"], [0.0, 0.0])], "asset_id string, labels array<string>, logits array<double>")
    assert {(r.asset_id, r.label) for r in vectors.label_topk(logits, 1, 0.9).collect()} == {("a", "p"), ("b", "p")}
    boxes = spark.createDataFrame([("x", "1", 0.0, 0.0, 10.0, 10.0, 0.9), ("x", "2", 1.0, 1.0, 10.0, 10.0, 0.8), ("x", "3", 50.0, 50.0, 5.0, 5.0, 0.1)], "asset_id string, id string, x double, y double, w double, h double, score double")
    assert sorted(ids(vectors.nms(boxes))) == ["1", "3"]


def test_porter():
    # Examples of the published algorithm.
    for word, want in {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "formaliti": "formal", "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "revival": "reviv", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "running": "run"}.items():
        assert stem(word) == want, word


def test_full_text(spark):
    docs = spark.createDataFrame([("1", "beach.jpg", "", ""), ("2", "x.jpg", "a day at the beach", ""), ("3", "x.jpg", "mountains", "beaches and more"), ("4", "q", "", "")] + [(f"z{i}", "z", "other words in here", "") for i in range(9)], "asset_id string, filename string, ocr_text string, caption string")
    got = {r.asset_id: r.score for r in search.bm25(docs, "beach").collect()}
    assert set(got) == {"1", "2", "3"} and got["2"] > got["3"]
    assert {r.asset_id for r in search.bm25(docs, "beach day").collect()} == {"2"}
    assert search.bm25(docs, "?!").count() == 0 and search.bm25(docs, None).count() == 0
    assert {r.asset_id for r in search.bm25(docs, "mountain", porter=True).collect()} == {"3"}
    assert search.blends("sunny beach") and not search.blends("ab") and not search.blends("beach fav:true") and not search.blends("beach", 10)
    t = spark.createDataFrame([("ocr", 2.0), ("both", 1.0)], "id string, score double")
    v = spark.createDataFrame([("both", 0.9), ("clip", 0.8)], "id string, score double")
    assert [r.id for r in search.blended(t, v).orderBy("pos").collect()] == ["ocr", "both", "clip"]


def test_memories(spark):
    days = lambda *x: spark.createDataFrame([(dt.date.fromisoformat(d), n) for d, n in x], "day date, n long")
    run = memories.weekend_runs(days(("2024-06-06", 3), ("2024-06-07", 3), ("2024-06-08", 3))).collect()
    assert [(str(r.start_day), str(r.end_day), r.total) for r in run] == [("2024-06-06", "2024-06-08", 9)]
    assert memories.weekend_runs(days(("2024-06-03", 4), ("2024-06-04", 4), ("2024-06-05", 4))).count() == 0
    assert memories.weekend_runs(days().where("false")).count() == 0
    a = frame(spark, [{"id": "fav", "captured_at": "2022-03-17", "favorite": True}, {"id": "b", "captured_at": "2023-03-17"}, {"id": "c", "captured_at": "2023-03-17"}, {"id": "now", "captured_at": "2024-03-17"}])
    m = memories.on_this_day(a, "2024-03-17").first()
    assert (m.asset_count, m.cover_asset_id, m.subtitle) == (3, "fav", "3 photos across 2 years")
    shots = frame(spark, [{"id": "s", "path": "/screenshot.png", "favorite": True}, {"id": "p", "rating": 1, "camera": "X"}]).withColumn("k", F.lit(1))
    assert memories.covers(shots, "k").first().cover_id == "p" and memories.covers(shots.where("id = 's'"), "k").first().cover_id == "s"
    assert memories.parse_memory_id("person_place:7|New York") == ("person_place", "7", "New York")
    with pytest.raises(ValueError):
        memories.parse_memory_id("other:1")
    c = spark.createDataFrame([("short",), ("<CAPTION> x y z",), ("a fine long caption",), ("é" * 80,), (None,)], "c string").select(memories.usable_quote(F.col("c")).alias("q")).collect()
    assert [r.q for r in c] == [None, None, "a fine long caption", "é" * 58 + "…", None]
    cand = spark.createDataFrame([(1, "a", 10.0, [1.0, 0.0]), (1, "b", 10.0, [0.99, 0.141]), (1, "c", 0.0, [0.0, 1.0])], "k int, id string, base double, vector array<double>")
    assert [r.id for r in memories.diversify(cand, "k", 2).orderBy("pos").collect()] == ["a", "c"]


def test_faces(spark):
    unit = lambda *x: [float(v) for v in x]
    f = spark.createDataFrame([("s", "1", 1, unit(1, 0)), ("s", "2", 2, unit(1, 0)), ("s", "3", 3, unit(0, 1))], "scope string, id string, ord int, vector array<double>")
    got = {r.id: r.person_id for r in people.assign_faces(f).collect()}
    assert got == {"1": "new:1", "2": "new:1", "3": "new:3"}
    p = spark.createDataFrame([("s", "1", None, unit(1, 0), 5, False), ("s", "2", "Ada", unit(0.9, 0.1), 1, False), ("s", "3", "Bo", unit(1, 0), 9, False), ("s", "4", None, unit(1, 0), 1, True)], "scope string, id string, name string, centroid array<double>, face_count long, ignored boolean")
    assert {r.id: r.person_id for r in people.consolidate(p).collect()} == {"1": "2", "2": "2", "3": "3"}
    faces = spark.createDataFrame([("f1", "1", None, 0.9), ("f2", "1", "/c", 0.5), ("f3", "2", None, 0.1)], "id string, person_id string, crop_path string, score double")
    assert {r.person_id: (r.face_count, r.cover_face_id) for r in people.person_stats(faces).collect()} == {"1": (2, "f2"), "2": (1, "f3")}
    assert {r.person_id for r in people.detached(faces, spark.createDataFrame([("f1",)], "id string")).collect()} == {"new:f1", "1", "2"}


def test_geo(spark):
    raw = spark.createDataFrame([("a", 48, 51, 24.0, "N", 2, 21, 3.0, "E"), ("b", 33, 0, 0.0, "S", 70, 0, 0.0, "W"), ("c", 0, 0, 0.0, "N", 0, 0, 0.0, "E"), ("d", 95, 0, 0.0, "N", 0, 0, 0.0, "E")], "id string, lat_d int, lat_m int, lat_s double, lat_ref string, lon_d int, lon_m int, lon_s double, lon_ref string")
    got = {r.id: (round(r.lat, 3), round(r.lon, 3)) for r in geo.gps_normalise(raw).collect()}
    assert got == {"a": (48.857, 2.351), "b": (-33.0, -70.0)}
    cities = spark.createDataFrame([("Paris", "IDF", "FR", 48.85, 2.35), ("", "Chile", "", -33.4, -70.6), ("Nadi", "", "FJ", -17.8, 177.4)], "city string, region string, cc string, lat double, lon double")
    pts = spark.createDataFrame([("a", 48.0, 2.0), ("b", -30.0, -70.0), ("c", -17.0, -179.0), ("d", 89.0, 0.0)], "id string, lat double, lon double")
    got = {r.id: (r.place_label, r.country) for r in geo.nearest_place(pts, cities).collect()}
    assert got == {"a": ("Paris, IDF", "FR"), "b": ("Chile", None), "c": ("Nadi", "FJ"), "d": ("Paris, IDF", "FR")}


def test_import(spark):
    a = frame(spark, [{"id": "1", "path": "/a", "hash": "h1", "rating": 3}, {"id": "2", "path": "/b", "hash": "h2", "rating": 4, "deleted_at": "2024-02-01"}])
    files = spark.createDataFrame([("/a", "h1"), ("/b", "h9"), ("/c", "h1"), ("/d", "h5"), ("/e", "h5")], "path string, hash string").selectExpr("path", "hash", "'image' as media_type", "1L as file_size", "timestamp_ntz'2024-03-01' as created_at")
    out = {r.path: r for r in ingest.upsert(a, files, "2024-03-02").collect()}
    assert {p: r.outcome for p, r in out.items()} == {"/a": "skipped", "/b": "updated", "/c": "inserted", "/d": "inserted", "/e": "inserted"}
    assert out["/b"].deleted_at is None and out["/b"].rating == 4 and out["/b"].hash == "h9"
    again = ingest.upsert(a, files, "2024-03-02", skip_content=True)
    assert {r.path: r.outcome for r in again.collect()} == {"/a": "skipped", "/b": "updated", "/c": "skipped_content", "/d": "inserted", "/e": "skipped_content"}
    r = ingest.import_result(again).first()
    assert (r.scanned, r.inserted, r.updated, r.skipped) == (5, 1, 1, 3)


def test_changes(spark, tmp_path):
    a = frame(spark, [{"id": "1", "thumbnail_path": "/t"}, {"id": "2", "thumbnail_path": "/t"}, {"id": "3", "thumbnail_path": "/u", "rating": 2}])
    gone = ingest.soft_delete(a, ["1"], "2024-05-01")
    assert ids(browse.trash(gone)) == ["1"] and ids(browse.trash(ingest.restore(gone, ["1"]))) == []
    assert ids(ingest.purge(gone, "2024-06-02")) == ["1"] and ids(ingest.purge(gone, "2024-05-20")) == []
    stay, thumbs = ingest.permanent_delete(a, ["1", "3"])
    assert ids(stay) == ["2"] and [r[0] for r in thumbs.collect()] == ["/u"]
    change = ingest.set_value(a, ["3"], "rating", 5)
    history = actions.Journal(spark, str(tmp_path / "journal"))
    history.record("rating", change)
    now = ingest.apply_values(a, change, "rating")
    assert now.where("id = '3'").first().rating == 5
    back = history.undo(now)
    assert back.where("id = '3'").first().rating == 2 and history.redo(back).where("id = '3'").first().rating == 5
    with pytest.raises(ValueError):
        ingest.set_value(a, ["3"], "rating", 6)
    jobs = spark.createDataFrame([("/a", "upsert", False, 1), ("/b", "upsert", False, 2), ("/a", "upsert", True, 3), ("/c", "upsert", True, 4), ("/c", "remove", False, 5), ("/c", "upsert", False, 6)], "path string, kind string, thumb boolean, seq long")
    assert [(r.path, r.thumb) for r in ingest.dedup_queue(jobs).orderBy("seq").collect()] == [("/b", False), ("/a", True), ("/c", False)]
    files = spark.createDataFrame([("/1", 5, dt.datetime(2024, 1, 1)), ("/2", 5, dt.datetime(2024, 1, 2)), ("/3", 5, dt.datetime(2024, 1, 2, 5))], "path string, size long, modified timestamp_ntz")
    assert sorted(r.path for r in ingest.evict(files, 10).collect()) == ["/1"] and ingest.evict(files, 0).count() == 0
    named = spark.createDataFrame([("/x/a.jpg", 1), ("/y/a.jpg", 2), ("/z/b", 3), ("/q/b", 4)], "path string, seq int").withColumn("id", F.col("path"))
    assert [r.name for r in ingest.export_names(named).orderBy("seq").collect()] == ["a.jpg", "a-2.jpg", "b", "b-2"]
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",), ("/c/",), ("/c/d/e",)], "path string")
    assert sorted(r.path for r in duplicates.prune_roots(roots).collect()) == ["/a", "/ab", "/c"]


def test_jobs_and_albums(spark):
    a = frame(spark, [{"id": "1", "thumbnail_path": "/1", "captured_at": "2020-01-01"}, {"id": "2", "thumbnail_path": "/2"}, {"id": "3"}])
    j = spark.createDataFrame([("1", "tags", "failed", 3, "boom", dt.datetime(2024, 1, 1)), ("2", "tags", "failed", 2, "", dt.datetime(2024, 1, 2)), ("3", "tags", "done", 1, None, None)], "asset_id string, kind string, state string, attempts long, error string, updated_at timestamp_ntz")
    assert ids(facets.pending_assets(a, j, "tags", None)) == ["2"]
    assert sorted(ids(facets.pending_assets(a, j, "tags", None, readmit_done=True))) == ["2", "3"]
    f = facets.job_failures(j).first()
    assert (f.failed, f.last_error) == (1, "boom")
    albums = spark.createDataFrame([("x", "X", None, dt.datetime(2024, 1, 1)), ("y", "Y", "1", dt.datetime(2024, 1, 2))], "id string, name string, cover_asset_id string, created_at timestamp_ntz")
    m = spark.createDataFrame([("x", "1"), ("x", "2")], "album_id string, asset_id string")
    got = {r.id: (r.asset_count, r.cover_thumbnail_path) for r in facets.albums_with_counts(albums, m, a).collect()}
    assert got == {"x": (2, "/2"), "y": (0, "/1")}
    assert {r.id: r.cover_asset_id for r in facets.synced_covers(albums, m, a).collect()} == {"x": "2", "y": None}


def test_actions(spark):
    @actions.register("five stars", {"rating"})
    def five(df):
        return df.select("id", F.lit("rating").alias("field"), F.col("rating").cast("string").alias("before"), F.lit("5").alias("after")).union(df.select("id", F.lit("name"), F.lit(""), F.lit("x")))

    a = frame(spark, [{"id": "1"}, {"id": "2"}])
    change = actions.preview("five stars", a, ["1"])
    assert change.count() == 1
    assert {r.id: r.rating for r in actions.apply(a, change).collect()} == {"1": 5, "2": 0}
    with pytest.raises(ValueError):
        actions.preview("five stars", a, [str(i) for i in range(501)])

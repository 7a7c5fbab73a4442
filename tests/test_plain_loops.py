"""Queries without SQL against plain loops, and texts of memory cards case by case."""

import numpy as np
from oracle import SMALL
from pyspark.sql import functions as F
from test_people import greedy

from shelfspark.operators import memories
from shelfspark.plans import catalogue

Q = catalogue.queries()


def test_nms(spark):
    got = {(r.asset_id, r.id) for r in Q["nms"](spark, SMALL).collect()}
    boxes = {}
    for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey", "l_suppkey").distinct().collect():
        o, s = r.l_orderkey, r.l_suppkey
        boxes.setdefault(str(o), []).append((-((o * 31 + s) % 100) / 100, f"{o}:{s}", s % 7 * 10.0, s % 3 * 10.0))
    want = set()
    for asset, some in boxes.items():
        kept = []
        for _, i, x, y in sorted(some):
            def iou(a, b):
                w, h = max(0.0, 40 - abs(a - x)), max(0.0, 40 - abs(b - y))  # noqa: B023
                return w * h / (3200 - w * h)

            if all(iou(a, b) <= catalogue.S.IOU_AT_MOST for _, a, b in kept):
                kept.append((i, x, y))
        want |= {(asset, i) for i, _, _ in kept}
    assert got == want and len(got) < sum(map(len, boxes.values()))


def test_diversify(spark):
    t = catalogue.Documents(spark, SMALL)
    seen = []
    real = memories.diversify
    memories.diversify = lambda df, key, *a, **k: seen.append((df, key, a, k)) or real(df, key, *a, **k)
    try:
        got = Q["diversify"](spark, SMALL)
    finally:
        memories.diversify = real
    df, key, args, options = seen[0]
    limit, lam, near, penalty = args[0], 0.65, 0.92, 12.0
    groups = {}
    for r in df.collect():
        groups.setdefault(r[key], []).append((r.id, float(r.base), None if r.vector is None else np.array(r.vector, float)))
    want = set()
    for g, rows in groups.items():
        rows, chosen = sorted(rows, key=lambda r: (-r[1], r[0])), []
        while rows and len(chosen) < limit:
            def score(r):
                if r[2] is None:
                    return r[1] - 0.5
                s = max([float(r[2] @ c[2]) for c in chosen if c[2] is not None] + [0.0])  # noqa: B023
                return r[1] - lam * s - (penalty if s >= near else 0.0)

            best = max(range(len(rows)), key=lambda i: (score(rows[i]), -i))
            chosen.append(rows.pop(best))
        want |= {(g, r[0], n) for n, r in enumerate(chosen)}
    assert {(r[key], r.id, r.pos) for r in got.select(key, "id", "pos").collect()} == want
    assert t.sf_dir == SMALL


def test_recluster(spark):
    t = catalogue.Documents(spark, SMALL)
    faces = sorted(((r.ord, r.id, r.vector, r.person_id) for r in catalogue._face_vectors(t).collect()), key=lambda r: r[:2])
    sticky = {r.id: (r.centroid, r.face_count) for r in catalogue._people(t).collect() if r.ignored or (r.name or "").strip()}
    want = {i: p for _, i, _, p in faces if p in sticky}
    want |= greedy([(i, v) for _, i, v, p in faces if p not in sticky], 0.32, [(k, *sticky[k]) for k in sorted(sticky)])
    assert {r.id: r.person_id for r in Q["recluster"](spark, SMALL).collect()} == want


PROSE = ["A warm day by the lake.", "  \"A warm day by the lake.\" \n", "\tSentence: Friends at the harbour again.", "short", "I'm sorry, I cannot do that here.", "Summer in Rome", "As an AI I would not say.", "\u00a0Memory: All of us in the old garden\u2003", "Summary: tiny", "x" * 281]
_CLEAN = ["A warm day by the lake.", "A warm day by the lake.", "Friends at the harbour again.", None, None, None, None, "All of us in the old garden", None, None]


def test_sanitised_lines(spark):
    rows = spark.createDataFrame(list(enumerate(PROSE)), "i int, raw string")
    got = rows.select("i", memories.sanitised(F.col("raw"), F.lit("Summer in Rome"), F.lit("3 photos")).alias("line")).orderBy("i").collect()
    assert [r.line for r in got] == _CLEAN


#: (kind, place, person, subtitle, quote, prose, line): every branch; blank counts as missing.
_INSIGHTS = [
    ("weekend", "Rome", None, "May 2 · 9 photos", None, None, "A weekend in Rome, May 2."),
    ("weekend", "Rome", None, "9 photos", None, None, "A weekend spent in Rome."),
    ("weekend", " ", None, "May 2 · 9 photos", "", None, "A weekend trip from May 2."),
    ("weekend", None, None, "9 photos", None, " ", "A short trip worth remembering."),
    ("on_this_day", "Rome", None, "x", None, None, "Looking back at this day across the years."),
    ("person_place", "Rome", "Ada", "x", None, None, "Moments with Ada in Rome."),
    ("person_place", "Rome", None, "x", None, None, "People and places that matter."),
    ("weekend", "Rome", None, "x", "the sea", None, "In Rome: “the sea”"),
    ("person_place", "Rome", "Ada", "x", "the sea", None, "Ada in Rome — “the sea”"),
    ("on_this_day", None, None, "x", " the sea ", None, "“the sea”"),
    ("weekend", "Rome", "Ada", "x", "the sea", " Prose wins. ", "Prose wins."),
]


def test_every_branch_of_the_insight(spark):
    rows = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(_INSIGHTS)], "i int, kind string, place string, person string, subtitle string, quote string, prose string")
    got = rows.select("i", memories.insight(*[F.col(c) for c in ("kind", "place", "person", "subtitle", "quote", "prose")]).alias("line")).orderBy("i").collect()
    assert [r.line for r in got] == [r[-1] for r in _INSIGHTS]

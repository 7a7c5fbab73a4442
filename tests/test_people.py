"""Faces and people against plain loops."""

import numpy as np
import oracle
import pytest
from oracle import SMALL

from shelfspark.operators import people as P
from shelfspark.plans import catalogue


def unit(v):
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def greedy(faces, threshold, seeds=()):
    """faces: (id, vector) in order; one loop over all people for each face."""
    held = [[name, np.array(c, float), n] for name, c, n in seeds]
    out = {}
    for face, v in faces:
        v = np.array(v, float)
        sims = [float(c @ v) if len(c) == len(v) else -9.0 for _, c, _ in held]
        best = max(range(len(held)), key=lambda i: sims[i], default=None)
        if best is None or sims[best] < threshold:
            held.append([f"new:{face}", unit(v), 1])
            out[face] = f"new:{face}"
        else:
            name, c, n = held[best]
            held[best] = [name, unit((c * n + v) / (n + 1)), n + 1]
            out[face] = name
    return out


def crowd(rng, n, people, width):
    heads = rng.standard_normal((people, width))
    return [unit(heads[rng.integers(people)] + rng.standard_normal(width) * 0.8) for _ in range(n)]


FACES = "scope string, id string, ord int, vector array<double>, person_id string"


@pytest.fixture
def rng_np():
    return np.random.default_rng(8)


def test_assignment_equals_the_loop(spark, rng_np):
    rows = [(f"lib{i % 3}", f"f{i:04d}", int(rng_np.integers(0, 50)), v.tolist(), None) for i, v in enumerate(crowd(rng_np, 900, 40, 16))]
    rows += [("lib0", "short", 7, [1.0, 0.0], None), ("lib0", "short2", 8, [1.0, 0.1], None), ("lib1", "null", 7, None, None), ("lib2", "zero", 3, [0.0] * 16, None)]
    got = {r.id: r.person_id for r in P.assign_faces(spark.createDataFrame(rows, FACES).repartition(5)).collect()}
    want = {}
    for lib in ("lib0", "lib1", "lib2"):
        want |= greedy([(r[1], r[3]) for r in sorted((r for r in rows if r[0] == lib and r[3]), key=lambda r: (r[2], r[1]))], 0.32)
    assert got == want and len(set(want.values())) > 20


def test_recluster_keeps_named_and_hidden_people(spark, rng_np):
    faces = [("lib", f"f{i:03d}", i, v.tolist(), f"p{i % 6}") for i, v in enumerate(crowd(rng_np, 200, 8, 16))]
    cents = {f"p{k}": unit(sum(np.array(f[3]) for f in faces if f[4] == f"p{k}")).tolist() for k in range(6)}
    ppl = [("lib", p, "Ada" if p == "p0" else " " if p == "p2" else None, p == "p1", c, 33) for p, c in cents.items()]
    got = {r.id: r.person_id for r in P.recluster(spark.createDataFrame(faces, FACES), spark.createDataFrame(ppl, "scope string, id string, name string, ignored boolean, centroid array<double>, face_count long")).collect()}
    pool = [(f[1], f[3]) for f in faces if f[4] not in ("p0", "p1")]
    want = {f[1]: f[4] for f in faces if f[4] in ("p0", "p1")} | greedy(pool, 0.32, [(p, cents[p], 33) for p in ("p0", "p1")])
    assert got == want and "p0" in greedy(pool, 0.32, [(p, cents[p], 33) for p in ("p0", "p1")]).values()


def merged(rows, threshold):
    """All pairs of people(id, name, centroid, face_count), in order of id."""
    rows = sorted(rows)
    counts, into = {r[0]: r[3] for r in rows}, {}
    for i, a in enumerate(rows):
        if a[0] in into:
            continue
        for b in rows[i + 1 :]:
            x, y = (a[1] or "").strip(), (b[1] or "").strip()
            if b[0] in into or float(np.dot(a[2], b[2])) < threshold or (x and y and x != y):
                continue
            keep, drop = (a, b) if x and not y else (b, a) if y and not x else (b, a) if counts[b[0]] > counts[a[0]] else (a, b)
            counts[keep[0]] += counts[drop[0]]
            into[drop[0]] = keep[0]
            if drop is a:
                break
    out = {}
    for r in rows:
        p = r[0]
        while p in into:
            p = into[p]
        out[r[0]] = p
    return out


def test_consolidation_by_components_equals_all_pairs(spark, rng_np, monkeypatch):
    rows = [(f"lib{i % 2}", f"p{i:03d}", [None, " ", "Ada", "Bo"][int(rng_np.integers(4))], v.tolist(), int(rng_np.integers(1, 9)), False) for i, v in enumerate(crowd(rng_np, 160, 60, 24))]
    df = spark.createDataFrame(rows + [("lib0", "hid", None, rows[0][3], 5, True), ("lib0", "p000", None, None, 5, False)], "scope string, id string, name string, centroid array<double>, face_count long, ignored boolean")
    want = {}
    for lib in ("lib0", "lib1"):
        want |= {(lib, k): v for k, v in merged([(r[1], r[2], r[3], r[4]) for r in rows if r[0] == lib], 0.4).items()}
    assert {(r.scope, r.id): r.person_id for r in P.consolidate(df, 0.4).collect()} == want
    assert 10 < sum(k[1] != v for k, v in want.items())
    pairs = lambda tile: {tuple(r) for r in P.near_people(df.where("centroid is not null"), 0.4, tile).collect()}
    assert pairs(2048) == pairs(7)


def test_corrections_rebuild_counts_covers_and_centroids(spark):
    faces = spark.createDataFrame([("1", "a", 0.9, None, [1.0, 0.0]), ("2", "a", 0.5, "/c2", [0.0, 1.0]), ("3", "b", 0.4, "/c3", [1.0, 0.0]), ("4", "c", 0.1, None, [0.0, 1.0]), ("5", "d", 0.1, "", [0.0, 1.0])], "id string, person_id string, score double, crop_path string, vector array<double>")
    ppl = spark.createDataFrame([("a", "Ada", False, 2, "2", [0.6, 0.8]), ("b", None, False, 1, "3", [1.0, 0.0]), ("c", None, True, 1, "4", [0.0, 1.0]), ("d", "D", False, 7, "kept", [9.0])], "id string, name string, ignored boolean, face_count long, cover_face_id string, centroid array<double>")
    after = P.detached(P.moved(faces, spark.createDataFrame([("b", "a"), ("c", "a")], "person_id string, to string")), spark.createDataFrame([("2",), ("2",), ("nobody",)], "id string"))
    got = {r.id: (r.name, r.ignored, r.face_count, r.cover_face_id, [round(x, 6) for x in r.centroid] if r.centroid else None) for r in P.rebuilt(ppl, faces, after).collect()}
    assert got == {
        "a": ("Ada", False, 3, "3", [round(2 / 5**0.5, 6), round(1 / 5**0.5, 6)]),
        "new:2": (None, False, 1, "2", [0.0, 1.0]),
        "c": (None, True, 0, None, None),  # hidden people stay
        "d": ("D", False, 7, "kept", [9.0]),  # untouched
    }
    names = {r.id: r.name for r in P.renamed(ppl, spark.createDataFrame([("a", "  "), ("b", " Bo ")], "id string, name string")).collect()}
    assert names == {"a": None, "b": "Bo", "c": None, "d": "D"}


def test_face_queries_equal_the_loops(spark):
    t = catalogue.Documents(spark, SMALL)
    faces = sorted(((r.ord, r.id, r.vector) for r in catalogue._face_vectors(t).collect()), key=lambda r: r[:2])
    got = {r.id: r.person_id for r in catalogue.queries()["face_clusters"](spark, SMALL).collect()}
    assert got == greedy([(i, v) for _, i, v in faces], 0.32)
    ppl = [r for r in catalogue._people(t).collect() if not r.ignored]
    assert {r.id: r.person_id for r in catalogue.queries()["consolidate_people"](spark, SMALL).collect()} == merged([(r.id, r.name, r.centroid, r.face_count) for r in ppl], 0.4)


def test_corrected_people_equals_sql(spark):
    con = oracle.connect("/root/testdata/sf0.01")
    assert oracle.difference(catalogue.queries()["corrected_people"](spark, "/root/testdata/sf0.01"), con, catalogue.oracle_sql()["corrected_people"]) == ""

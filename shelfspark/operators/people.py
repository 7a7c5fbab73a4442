"""Faces and people: statistics, centroids, greedy clustering, corrections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark import schema as S
from shelfspark.functions.predicates import blank
from shelfspark.operators.components import connected_components
from shelfspark.operators.vectors import group_centroids
from shelfspark.sources.work import ship, write_table


def badge(people: DataFrame) -> DataFrame:
    """(n): people that have faces, hidden ones too."""
    return people.agg(F.count_if(F.col("face_count") > 0).alias("n"))


PARTS_OF_A_PERSON = 32


def person_stats(faces: DataFrame, tasks: int | None = None) -> DataFrame:
    """(person_id, face_count, cover_face_id): best score with a crop, else best score; of equal ones the least id.

    A person's faces are dealt by id into up to 32 parts, each of which gives one
    row; tasks: in how many tasks all are dealt (None: as many as Spark makes of a shuffle).
    """
    order = F.struct((F.col("crop_path").isNull() | (F.col("crop_path") == "")).alias("c"), (-F.col("score")).alias("s"), F.col("id"))
    rows = faces.where("person_id is not null").select("person_id", order.alias("o"), F.pmod(F.xxhash64("id"), F.lit(PARTS_OF_A_PERSON)).alias("_part"))
    keys = ["person_id", "_part"]
    dealt = rows.repartition(tasks, *keys) if tasks else rows.repartition(*keys)
    parts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o"))
    return parts.groupBy("person_id").agg(F.sum("n").alias("face_count"), F.min("o").alias("o")).select("person_id", "face_count", F.col("o.id").alias("cover_face_id"))


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


class _Centroids:
    """People of one library: a matrix for each width of vectors, in the order in which people came."""

    def __init__(self):
        self.names: list[str] = []
        self.counts: list[int] = []
        self.at: list[tuple[int, int]] = []  # (width, row) of each person
        self.rows: dict[int, tuple[np.ndarray, list[int]]] = {}  # width: (matrix with room to grow, person of each row)

    def add(self, name: str, vector: np.ndarray, count: int) -> None:
        width = len(vector)
        matrix, people = self.rows.get(width, (np.zeros((16, width)), []))
        if len(people) == len(matrix):
            matrix = np.concatenate([matrix, np.zeros_like(matrix)])
        matrix[len(people)] = vector
        self.at.append((width, len(people)))
        people.append(len(self.names))
        self.rows[width] = matrix, people
        self.names.append(name)
        self.counts.append(count)

    def assign(self, face: str, v: np.ndarray, threshold: float) -> str:
        matrix, people = self.rows.get(len(v), (None, []))
        if people:
            sims = matrix[: len(people)] @ v
            i = int(np.argmax(sims))
            if sims[i] >= threshold:
                best = people[i]
                n = self.counts[best]
                matrix[i] = _unit((matrix[i] * n + v) / (n + 1))
                self.counts[best] = n + 1
                return self.names[best]
        self.add(f"new:{face}", _unit(v), 1)
        return self.names[-1]


def _assign(threshold: float):
    """Libraries one after another, each its seeds and then its faces in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scope, held = None, None
        for pdf in batches:
            out = []
            for own, kind, face, vector, n in pdf[["scope", "kind", "id", "vector", "n"]].itertuples(index=False):
                if held is None or own != scope:
                    scope, held = own, _Centroids()
                v = np.asarray(vector, dtype=float)
                if kind:
                    out.append((own, face, held.assign(face, v, threshold)))
                else:
                    held.add(face, v, int(n))
            yield pd.DataFrame(out, columns=["scope", "id", "person_id"])

    return run


def assign_faces(faces: DataFrame, threshold: float = S.MATCH_AT_LEAST, seeds: DataFrame | None = None) -> DataFrame:
    """(scope, id, person_id) of faces(scope, id, ord, vector), nearest centroid first come first served.

    Each face's result depends on all before it: a centroid of unit vectors
    that joined at the threshold t is a positive combination of weight up to
    1 / t, so only faces whose products are all under t * t (about 0.1) could be
    told apart beforehand, and in 64 dimensions hardly two faces are.  A
    library is therefore one sequence.  Libraries run side by side; a library's
    faces are sorted and streamed, and what is held is a row a person.
    seeds(scope, id, centroid, face_count) are people who are there at first.
    A new person is named after its first face; of equally near ones the
    earlier is taken.
    """
    ship(faces.sparkSession)
    kind = dict(faces.dtypes)["scope"]
    rows = faces.select("scope", F.lit(1).alias("kind"), F.col("ord").cast("long").alias("ord"), "id", F.col("vector").cast("array<double>").alias("vector"), F.lit(1).cast("long").alias("n"))
    if seeds is not None:
        rows = rows.unionByName(seeds.select("scope", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("ord"), "id", F.col("centroid").cast("array<double>").alias("vector"), F.col("face_count").cast("long").alias("n")))
    lined = rows.where("vector is not null").repartition("scope").sortWithinPartitions("scope", "kind", "ord", "id")
    return lined.mapInPandas(_assign(threshold), f"scope {kind}, id string, person_id string")


def near_people(people: DataFrame, threshold: float, tile: int = 2048) -> DataFrame:
    """(scope, a, b) with a < b: people(scope, id, centroid) whose centroids are at least threshold near.

    Centroids are dealt into tiles, and each pair of tiles is multiplied by
    itself; only near pairs come back.
    """
    ship(people.sparkSession)
    n = max(1, -(-people.count() // tile))
    own = people.select("scope", "id", F.col("centroid").cast("array<double>").alias("centroid"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("t"))
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pairs = own.withColumn("o", other).select("scope", "id", "centroid", F.least("t", "o").alias("x"), F.greatest("t", "o").alias("y"), "t")
    kind = dict(people.dtypes)["scope"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
        out = []
        for _, same in pdf.groupby(pdf["centroid"].map(len)):
            left, right = (same[same["t"] == t] for t in (x, y))
            if left.empty or right.empty:
                continue
            near = np.stack(left["centroid"].to_numpy()) @ np.stack(right["centroid"].to_numpy()).T >= threshold
            for i, j in np.argwhere(near).tolist():
                a, b = left["id"].iloc[i], right["id"].iloc[j]
                if a != b and (x != y or a < b):
                    out.append((pdf["scope"].iloc[0], min(a, b), max(a, b)))
        return pd.DataFrame(out, columns=["scope", "a", "b"])

    return pairs.groupBy("scope", "x", "y").applyInPandas(run, f"scope {kind}, a string, b string")


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merges within a component: rows are its people (b null) and its near pairs."""
    who = pdf[pdf["b"].isna()].sort_values("a").reset_index(drop=True)
    ids = who["a"].tolist()
    place = {x: i for i, x in enumerate(ids)}
    near: list[list[int]] = [[] for _ in ids]
    for a, b in pdf.loc[pdf["b"].notna(), ["a", "b"]].itertuples(index=False):
        near[place[a]].append(place[b])
    names = [None if not isinstance(n, str) or not n.strip() else n.strip() for n in who["name"]]
    counts, into = who["face_count"].tolist(), {}
    for i in range(len(ids)):
        if i in into:
            continue
        for j in sorted(near[i]):
            if j in into or (names[i] and names[j] and names[i] != names[j]):
                continue
            keep, drop = (i, j) if names[i] and not names[j] else (j, i) if names[j] and not names[i] else (j, i) if counts[j] > counts[i] else (i, j)
            counts[keep] += counts[drop]
            into[drop] = keep
            if drop == i:
                break

    def end(i: int) -> int:
        while i in into:
            i = into[i]
        return i

    return pd.DataFrame({"scope": who["scope"], "id": ids, "person_id": [ids[end(i)] for i in range(len(ids))]})


def consolidate(people: DataFrame, threshold: float = S.CONSOLIDATE_AT_LEAST) -> DataFrame:
    """(scope, id, person_id): who each of people(scope, id, name, centroid, face_count, ignored) is merged into.

    In order of id; two different names never merge, a name takes in the
    nameless, else the one with more faces stays.  Hidden people take no part.
    A merge takes a near pair, so what is not linked by near pairs is
    independent: each component is merged by itself, in order, from its pairs.
    """
    rows = write_table(people.where("not ignored and centroid is not null and face_count > 0").select("scope", "id", "name", "centroid", F.col("face_count").cast("long").alias("face_count")), "people")
    pairs = write_table(near_people(rows, threshold), "near_people")
    node = lambda c: F.to_json(F.struct("scope", F.col(c).alias("id")))  # noqa: E731  ids are a library's own
    parts = connected_components(pairs.select(node("a").alias("a"), node("b").alias("b")))
    member = rows.select("scope", F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), "name", "face_count", node("id").alias("node"))
    edge = pairs.select("scope", "a", "b", F.lit(None).cast("string").alias("name"), F.lit(0).cast("long").alias("face_count"), node("a").alias("node"))
    kind = dict(people.dtypes)["scope"]
    linked = member.unionByName(edge).join(parts, "node").drop("node")
    merged = linked.groupBy("scope", "component").applyInPandas(_merge, f"scope {kind}, id string, person_id string")
    alone = member.join(parts, "node", "left_anti").select("scope", F.col("a").alias("id"), F.col("a").alias("person_id"))
    return merged.unionByName(alone)


def recluster(faces: DataFrame, people: DataFrame, threshold: float = S.MATCH_AT_LEAST) -> DataFrame:
    """faces(scope, id, ord, vector, person_id) with nameless people's faces assigned anew.

    Named and hidden people of people(scope, id, name, ignored, centroid,
    face_count) keep theirs, and their centroids take in others.
    """
    sticky = people.where(F.col("ignored") | ~blank(F.col("name")))
    keys = sticky.select("scope", F.col("id").alias("person_id"))
    fixed = faces.join(keys, ["scope", "person_id"], "left_semi").select("scope", "id", "person_id")
    pool = faces.join(keys, ["scope", "person_id"], "left_anti")
    return fixed.union(assign_faces(pool, threshold, sticky.where("centroid is not null and face_count > 0")))


def moved(faces: DataFrame, changes: DataFrame) -> DataFrame:
    """faces after changes(person_id, to): merges and renamings of people."""
    rows = faces.join(changes.select("person_id", F.col("to").alias("_to")), "person_id", "left")
    return rows.withColumn("person_id", F.coalesce("_to", "person_id")).select(*faces.columns)


def detached(faces: DataFrame, face_ids: DataFrame) -> DataFrame:
    """faces with each of face_ids(id) a new person of its own."""
    hit = face_ids.select("id", F.lit(True).alias("_hit")).distinct()
    out = faces.join(hit, "id", "left")
    return out.withColumn("person_id", F.when(F.col("_hit"), F.concat(F.lit("new:"), "id")).otherwise(F.col("person_id"))).select(*faces.columns)


def renamed(people: DataFrame, names: DataFrame) -> DataFrame:
    """people after names(id, name); a blank name is no name."""
    out = people.join(names.select("id", F.trim("name").alias("_name"), F.lit(True).alias("_hit")), "id", "left")
    return out.withColumn("name", F.when(F.col("_hit"), F.nullif("_name", F.lit(""))).otherwise(F.col("name"))).select(*people.columns)


def rebuilt(people: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """people(id, name, ignored, face_count, cover_face_id, centroid) after their faces have changed hands.

    before and after are faces(id, person_id, score, crop_path, vector).  People
    who lost or got a face are counted anew, with cover and centroid, from
    their faces alone; those left without a face are gone unless they are
    hidden, and new ones are added without a name.
    """
    was = before.select("id", F.col("person_id").alias("was"))
    changed = after.select("id", "person_id").join(was, "id").where(~F.col("person_id").eqNullSafe(F.col("was")))
    touched = changed.select(F.explode(F.array("person_id", "was")).alias("person_id")).where("person_id is not null").distinct()
    touched = write_table(touched, "touched")
    own = write_table(after.join(touched, "person_id", "left_semi"), "touched_faces")
    stats = person_stats(own)
    cent = group_centroids(own.select("person_id", "vector"), "person_id").groupBy("person_id").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("c"))
    fresh = stats.join(cent.select("person_id", F.col("c.value").alias("centroid")), "person_id", "left")
    kept = people.join(touched.select(F.col("person_id").alias("id")), "id", "left_anti")
    old = people.select("id", "name", "ignored").join(touched.select(F.col("person_id").alias("id")), "id", "left_semi").withColumn("_old", F.lit(True))
    news = old.join(fresh.withColumnRenamed("person_id", "id"), "id", "full").where("face_count is not null or ignored")
    cols = ["id", "name", "ignored", "face_count", "cover_face_id", "centroid"]
    news = news.withColumn("ignored", F.coalesce("ignored", F.lit(False))).withColumn("face_count", F.coalesce("face_count", F.lit(0).cast("long")))
    return kept.select(*cols).unionByName(news.select(*cols))

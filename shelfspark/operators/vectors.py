"""Vector search, labels from logits, and signals of images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark import schema as S
from shelfspark.functions.predicates import dot, live
from shelfspark.sources.work import ship


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def semantic_search(embeddings: DataFrame, query: list[float], limit: int = 50, floor: float = S.SEMANTIC_FLOOR, assets: DataFrame | None = None) -> DataFrame:
    """(id, score) of the unit vectors nearest to the query, at least floor; ties by id."""
    rows = embeddings.select(F.col("asset_id").alias("id"), dot(F.col("vector"), literal(query)).alias("score")).where(F.col("score") >= floor)
    if assets is not None:
        rows = rows.join(live(assets).select("id"), "id", "left_semi")
    return rows.orderBy(F.desc("score"), "id").limit(max(1, min(limit, S.LIMIT_LIST)))


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows in double, 0 where the width differs."""
    zero = np.zeros(width)
    return np.array([v if v is not None and len(v) == width else zero for v in vectors], dtype=np.float64).reshape(-1, width)


def _each(ids: list[int], queries: np.ndarray, limit: int, floor: float, block: int):
    width, slack = queries.shape[1], 1e-9

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v, names, out = _matrix(pdf["vector"], width), pdf["id"].to_numpy(), []
            for at in range(0, len(ids), block):
                q = queries[at : at + block]
                for i, row in enumerate(q @ v.T):
                    least = max(floor, np.partition(row, -limit)[-limit]) if len(row) > limit else floor
                    some = np.flatnonzero(row >= least - slack)
                    exact = np.cumsum(v[some] * q[i], axis=1)[:, -1]  # added up in order, as semantic_search does
                    best = sorted((-x, n) for x, n in zip(exact.tolist(), names[some]) if x >= floor)[:limit]
                    out += [(ids[at + i], n, -x) for x, n in best]
            yield pd.DataFrame(out, columns=["query_id", "id", "score"])

    return run


FEW_QUERIES, SLICE = 4096, 8192


def _tiles(rows: DataFrame, queries: DataFrame, width: int, limit: int, floor: float, block: int) -> DataFrame:
    """Each block of queries with each slice of rows; no group is much larger than a block and a slice."""
    n_blocks, n_slices = (max(1, -(-df.count() // size)) for df, size in ((queries, block), (rows, SLICE)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block"), every(n_slices).alias("slice"))
    held = rows.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(n_slices)).cast("int").alias("slice"), every(n_blocks).alias("block"))

    def run(qs: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or pdf.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        return next(_each(qs["query_id"].tolist(), _matrix(qs["vector"], width), limit, floor, block)(iter([pdf])))

    return asked.groupBy("block", "slice").cogroup(held.groupBy("block", "slice")).applyInPandas(run, "query_id long, id string, score double")


def search_each(embeddings: DataFrame, queries: DataFrame, limit: int = 50, floor: float = S.SEMANTIC_FLOOR, assets: DataFrame | None = None, block: int = 512, few: int = FEW_QUERIES) -> DataFrame:
    """(query_id, id, score): for each of queries(query_id, vector) what ``semantic_search`` finds, all rows scored.

    Up to ``few`` queries go to the tasks that read the vectors and are
    multiplied a block at a time with each batch.  More are joined in blocks
    with slices of the rows.
    """
    limit = max(1, min(limit, S.LIMIT_LIST))
    rows = embeddings.select(F.col("asset_id").alias("id"), "vector")
    if assets is not None:
        rows = rows.join(live(assets).select("id"), "id", "left_semi")
    widths = [r["w"] for r in queries.select(F.size("vector").alias("w")).distinct().limit(2).collect()]
    if len(widths) > 1:
        raise ValueError("queries differ in width")
    width = widths[0] if widths else 1
    ship(embeddings.sparkSession)
    asked = queries.limit(few + 1).collect()
    if len(asked) <= few:
        run = _each([r["query_id"] for r in asked], _matrix([r["vector"] for r in asked], width), limit, floor, block)
        found = rows.mapInPandas(run, "query_id long, id string, score double")
    else:
        found = _tiles(rows, queries, width, limit, floor, block)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def label_topk(logits: DataFrame, k: int = 5, min_score: float = 0.05) -> DataFrame:
    """(asset_id, label, score, rank) from logits(asset_id, labels, logits): softmax, the best k of at least min_score, the best one always."""
    top = F.array_max("logits")
    exp = F.transform("logits", lambda x: F.exp(x - top))
    total = F.aggregate(exp, F.lit(0.0), lambda s, x: s + x)
    scored = logits.select("asset_id", "labels", exp.alias("e"), total.alias("t"))
    ranked = F.sort_array(F.zip_with("labels", "e", lambda n, e: F.struct((-e / F.col("t")).alias("m"), n.alias("label"))))
    rows = scored.select("asset_id", F.posexplode(F.slice(ranked, 1, k)).alias("rank", "r")).select("asset_id", "r.label", (-F.col("r.m")).alias("score"), "rank")
    return rows.where((F.col("score") >= min_score) | (F.col("rank") == 0))


def group_centroids(vectors: DataFrame, key: str) -> DataFrame:
    """(key, dim, value, n): unit-length means of vectors(key, vector), long form."""
    means = vectors.select(key, F.posexplode("vector").alias("dim", "v")).groupBy(key, "dim").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    norms = means.groupBy(key).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return means.join(norms, key).select(key, "dim", F.when(F.col("norm") > 0, F.col("m") / F.col("norm")).otherwise(F.col("m")).alias("value"), "n")


def ahash(luma: DataFrame) -> DataFrame:
    """(id, hash) from luma(id, pixels): 64 grey values; bit i says pixel i is at least the integer mean."""
    mean = F.floor(F.aggregate("pixels", F.lit(0).cast("long"), lambda s, p: s + p) / 64)
    rows = luma.select("id", "pixels", mean.alias("mean"))

    def word(i: int) -> Column:  # 16 bits of the hash, the first word the highest
        at = 48 - 16 * i
        return F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0), lambda s, b: s + F.when(F.element_at("pixels", b + at + 1) >= F.col("mean"), F.pow(F.lit(2), b).cast("int")).otherwise(0))

    return rows.select("id", F.concat(*[F.lower(F.lpad(F.hex(word(i)), 4, "0")) for i in range(4)]).alias("hash"))


def _laplacian(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for w, h, px in zip(pdf["width"], pdf["height"], pdf["pixels"]):
            g = np.asarray(px, dtype=np.float64).reshape(h, w) if w * h == len(px) else np.zeros((0, 0))
            if w < 3 or h < 3 or not g.size:
                out.append(0.0)
                continue
            lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
            out.append(float(lap.var()))
        yield pd.DataFrame({"id": pdf["id"], "blur_score": out})


def blur_score(images: DataFrame) -> DataFrame:
    """(id, blur_score) from images(id, width, height, pixels): variance of the 4-neighbour Laplacian."""
    ship(images.sparkSession)
    return images.select("id", "width", "height", "pixels").mapInPandas(_laplacian, "id string, blur_score double")


def _nms(limit: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values(["asset_id", "score", "id"], ascending=[True, False, True])
        x, y, w, h = (d[c].to_numpy(float) for c in "xywh")
        assets = d["asset_id"].to_numpy()
        bounds = np.append(np.flatnonzero(np.append(True, assets[1:] != assets[:-1])), len(d))
        starts, ends = bounds[:-1], bounds[1:]
        keep, gone, pivots = np.zeros(len(d), bool), np.zeros(len(d), bool), starts
        while len(pivots):  # the next box of every asset at once, against those after it
            i, e = pivots[~gone[pivots]], ends[~gone[pivots]]
            keep[i] = True
            n = e - i - 1
            of = np.repeat(i, n)
            j = of + 1 + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            iw = np.clip(np.minimum(x[j] + w[j], x[of] + w[of]) - np.maximum(x[j], x[of]), 0, None)
            ih = np.clip(np.minimum(y[j] + h[j], y[of] + h[of]) - np.maximum(y[j], y[of]), 0, None)
            union = w[j] * h[j] + w[of] * h[of] - iw * ih
            gone[j[np.divide(iw * ih, union, out=np.zeros_like(union), where=union > 0) > limit]] = True
            more = pivots + 1 < ends
            pivots, ends = pivots[more] + 1, ends[more]
        return d.iloc[keep][["asset_id", "id", "score"]]

    return run


def dealt_boxes(boxes: DataFrame, rows: int, per_group: int = 20_000, per_task: int = 300_000) -> DataFrame:
    """boxes(asset_id, ...) with _g, the group of an asset, of which there are as many as so many rows need; groups are dealt in tasks."""
    groups, tasks = max(1, -(-rows // per_group)), max(1, -(-rows // per_task))
    return boxes.withColumn("_g", F.pmod(F.xxhash64("asset_id"), F.lit(groups))).repartition(tasks, "_g")


def nms(boxes: DataFrame, iou: float = S.IOU_AT_MOST, per_group: int = 20_000) -> DataFrame:
    """Detections of boxes(asset_id, id, x, y, w, h, score) that no better one of the asset overlaps too much.

    Assets are dealt into groups of about per_group detections, so that one
    call of Python handles many; the number of groups follows the input.  Boxes
    that ``dealt_boxes`` has dealt are neither counted nor shuffled again.
    """
    ship(boxes.sparkSession)
    dealt = boxes if "_g" in boxes.columns else dealt_boxes(boxes, boxes.count(), per_group)
    return dealt.groupBy("_g").applyInPandas(_nms(iou), "asset_id string, id string, score double")

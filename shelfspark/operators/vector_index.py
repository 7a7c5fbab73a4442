"""Stored vector index: trained coarse centroids, buckets in Parquet, six-bit codes.

Centroids are fitted on a bounded sample (spherical k-means).  Every vector
goes to the folder of its nearest centroid as a code of six bits a dimension
with one scale, a fifth of its bytes.  A search orders the centroids by their
product with the query and reads the buckets that hold the nearest ``share``
of all vectors: other folders are pruned, and of those read only ids and codes.
The scores are products with decoded vectors, within about 0.01 of the exact
ones.  With ``exact`` the best four times ``limit`` are scored anew by their full
vectors, which stand in the same files: of the folders that hold one of these.

Vectors that differ in width from the others, or are null or all zero, can't
be near anything and are left out.  Below MIN_VECTORS an index is no use: then
``usable`` says no and callers take the exact search.  ``add`` appends vectors to an
index; deleted ones are left out by giving the live ids to a search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark import schema as S
from shelfspark.functions.predicates import dot
from shelfspark.operators.vectors import literal
from shelfspark.sources.work import ship

MIN_VECTORS = 1000
SAMPLE = 20_000
MAX_BUCKETS = 4096
ROUNDS = 8
SHARE = 0.75
BITS = 6
FEW_QUERIES = 4096
BLOCK, SLICE = 512, 8192
EXACT_MARGIN = 0.02
_TOP = (1 << (BITS - 1)) - 0.5


def encode(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of six bits, four in three bytes; scale) of rows that are not all zero."""
    scale = np.abs(v).max(axis=1)
    n, width = v.shape
    code = np.zeros((n, -(-width // 4) * 4), dtype=np.uint32)
    code[:, :width] = np.clip(np.floor(v / scale[:, None] * _TOP) + 32, 0, 63)
    four = code.reshape(n, -1, 4)
    whole = four[:, :, 0] | four[:, :, 1] << 6 | four[:, :, 2] << 12 | four[:, :, 3] << 18
    return whole.astype("<u4").view(np.uint8).reshape(n, -1, 4)[:, :, :3].reshape(n, -1), scale.astype(np.float32)


def decode(codes: np.ndarray, scale: np.ndarray, width: int) -> np.ndarray:
    three = codes.reshape(len(codes), -1, 3).astype(np.uint32)
    whole = three[:, :, 0] | three[:, :, 1] << 8 | three[:, :, 2] << 16
    code = np.stack([whole >> (6 * i) & 63 for i in range(4)], axis=2).reshape(len(codes), -1)[:, :width]
    return (code.astype(np.float32) - 31.5) * (scale[:, None] / np.float32(_TOP))


def _rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors that count, their matrix)."""
    lists = column.to_pylist()
    own = np.array([i for i, v in enumerate(lists) if v is not None and len(v) == width and any(v)], dtype=np.int64)
    return own, np.array([lists[i] for i in own], dtype=np.float32).reshape(-1, width)


def fit(sample: np.ndarray, buckets: int, seed: int = 0) -> np.ndarray:
    """Unit centroids of a bounded sample."""
    rng = np.random.default_rng(seed)
    v = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    cents = v[rng.choice(len(v), min(buckets, len(v)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = np.argmax(v @ cents.T, axis=1)
        for k in range(len(cents)):
            own = v[near == k]
            if len(own) and (norm := np.linalg.norm(mean := own.mean(axis=0))) > 0:
                cents[k] = mean / norm
    return cents


@dataclass
class Index:
    """Folder of an index, with what its centroid table says: bounded by MAX_BUCKETS."""

    spark: SparkSession
    folder: str

    def __post_init__(self) -> None:
        rows = self.spark.read.parquet(f"{self.folder}/centroids").orderBy("bucket").collect()
        self.centroids = np.array([r["centroid"] for r in rows], dtype=np.float32)
        counts = {r["bucket"]: r["count"] for r in self.codes.groupBy("bucket").count().collect()}
        self.counts = np.array([counts.get(i, 0) for i in range(len(rows))], dtype=np.int64)

    @property
    def codes(self) -> DataFrame:
        return self.spark.read.schema("id string, code binary, scale float, bucket int").parquet(f"{self.folder}/codes")

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema("id string, vector array<float>, bucket int").parquet(f"{self.folder}/codes")

    @property
    def usable(self) -> bool:
        return int(self.counts.sum()) >= MIN_VECTORS

    def buckets_of(self, ids: list[str], reads: np.ndarray) -> set[int]:
        """The buckets, among those read, that hold these ids."""
        rows = self.codes.where(F.col("bucket").isin(np.flatnonzero(reads).tolist()) & F.col("id").isin(ids))
        return {r["bucket"] for r in rows.select("bucket").distinct().collect()}

    def probed(self, queries: np.ndarray, share: float) -> np.ndarray:
        """(query, bucket): whether the query reads the bucket."""
        order = np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")
        before = np.cumsum(self.counts[order], axis=1) - self.counts[order]
        reads = np.zeros(order.shape, bool)
        np.put_along_axis(reads, order, before < share * self.counts.sum(), axis=1)
        return reads & (self.counts > 0)


def _write_codes(embeddings: DataFrame, centroids: np.ndarray, folder: str) -> None:
    """Each bucket's vectors sorted by range, so that a large bucket is written by several tasks."""
    ship(embeddings.sparkSession)
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, v = _rows(b.column("vector"), width)
            if not len(own):
                continue
            near = np.argmax(v @ centroids.T, axis=1).astype(np.int32)
            codes, scale = encode(v)
            ids = b.column("asset_id").take(pa.array(own))
            cols = [ids, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale, pa.float32()), pa.array(v.tolist(), pa.list_(pa.float32())), pa.array(near)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "code", "scale", "vector", "bucket"])

    rows = embeddings.select(F.col("asset_id").cast("string").alias("asset_id"), "vector").where("vector is not null")
    coded = rows.mapInArrow(run, "id string, code binary, scale float, vector array<float>, bucket int")
    coded.repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id").write.mode("append").partitionBy("bucket").parquet(f"{folder}/codes")


def build(embeddings: DataFrame, folder: str, sample: int = SAMPLE, seed: int = 0) -> Index:
    """Index of embeddings(asset_id, vector) in a folder that is not there yet; the sample are the least hashes of ids."""
    spark = embeddings.sparkSession
    rows = embeddings.where("vector is not null")
    sized = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width, n = (sized["width"], sized["count"]) if sized else (1, 0)
    some = rows.where(F.size("vector") == width).where(F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64("asset_id"), "asset_id").limit(sample)
    fitted = np.array([r["vector"] for r in some.select("vector").collect()], dtype=np.float32).reshape(-1, width)
    cents = fit(fitted, min(MAX_BUCKETS, max(1, math.isqrt(n))), seed) if len(fitted) else np.ones((1, width), np.float32)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(cents)], "bucket int, centroid array<float>").coalesce(1).write.parquet(f"{folder}/centroids")
    _write_codes(embeddings, cents, folder)
    return Index(spark, folder)


def add(index: Index, embeddings: DataFrame) -> Index:
    """The index with more vectors in the buckets that it has; their ids must be new."""
    _write_codes(embeddings, index.centroids, index.folder)
    return Index(index.spark, index.folder)


_SLACK = 1e-5  # of sums in single precision


def _best(near: np.ndarray, rows: np.ndarray, query: np.ndarray, ids: np.ndarray, limit: int, floor: float) -> list[tuple[str, float]]:
    """(id, score) of the best rows; what is near is added up again in order, so that a score depends on its row alone."""
    least = max(floor, np.partition(near, -limit)[-limit]) if len(near) > limit else floor
    some = np.flatnonzero(near >= least - _SLACK)
    exact = np.cumsum(rows[some].astype(np.float64) * query, axis=1)[:, -1]
    return sorted(((ids[i], x) for i, x in zip(some.tolist(), exact.tolist()) if x >= floor), key=lambda x: (-x[1], x[0]))[:limit]


_FOUND = "query_id long, id string, score double"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64()))], ["query_id", "id", "score"])


def _scores(queries: np.ndarray, names: list[int], reads: np.ndarray, limit: int, floor: float):
    """The best of each batch of codes, for each query that reads a row's bucket."""
    width = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes = np.array([np.frombuffer(c, np.uint8) for c in b.column("code").to_pylist()])
            rows = decode(codes, b.column("scale").to_numpy(), width)
            near = queries @ rows.T
            near[~reads[:, b.column("bucket").to_numpy()]] = -np.inf
            ids = np.array(b.column("id").to_pylist(), dtype=object)
            yield _found([(names[i], *x) for i, row in enumerate(near) for x in _best(row, rows, queries[i], ids, limit, floor)])

    return run


def _top(found: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def search(index: Index, query: list[float], limit: int = 50, floor: float = S.SEMANTIC_FLOOR, share: float = SHARE, assets: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """(id, score) of the vectors nearest to the query among the buckets read, best first; assets(id): those that may be found."""
    q = np.array([query], dtype=np.float32)
    reads = index.probed(q, share)
    rows = index.codes.where(F.col("bucket").isin(np.flatnonzero(reads[0]).tolist()))
    if assets is not None:
        rows = rows.join(assets.select("id"), "id", "left_semi")
    ship(index.spark)
    wide = 4 * limit if exact else limit
    found = rows.mapInArrow(_scores(q, [0], reads, wide, floor - EXACT_MARGIN if exact else floor), _FOUND).select("id", "score")
    if not exact:
        return found.orderBy(F.desc("score"), "id").limit(limit)
    best = [r["id"] for r in found.orderBy(F.desc("score"), "id").limit(wide).collect()]  # a few hundred at most
    near = sorted(index.buckets_of(best, reads[0]))
    full = index.vectors.where(F.col("bucket").isin(near) & F.col("id").isin(best))
    return full.select("id", dot(F.col("vector"), literal(query)).alias("score")).where(F.col("score") >= floor).orderBy(F.desc("score"), "id").limit(limit)


def search_each(index: Index, queries: DataFrame, limit: int = 50, floor: float = S.SEMANTIC_FLOOR, share: float = SHARE, few: int = FEW_QUERIES) -> DataFrame:
    """(query_id, id, score): what ``search`` finds for each of queries(query_id, vector).

    Up to ``few`` queries are sent to the tasks that read codes.  More are dealt
    into blocks of rows, buckets into slices, and each block meets the slices
    of the buckets that one of its queries reads; no group is larger than a
    block and a slice.
    """
    ship(index.spark)
    width = index.centroids.shape[1]
    asked = queries.where(F.size("vector") == width).select("query_id", "vector")
    head = asked.limit(few + 1).collect()
    if len(head) <= few:
        q = np.array([r["vector"] for r in head], dtype=np.float32).reshape(-1, width)
        reads = index.probed(q, share)
        rows = index.codes.where(F.col("bucket").isin(np.flatnonzero(reads.any(axis=0)).tolist()))
        return _top(rows.mapInArrow(_scores(q, [r["query_id"] for r in head], reads, limit, floor), _FOUND), limit)
    slices = np.maximum(1, -(-index.counts // SLICE)).tolist()
    n_blocks = max(1, -(-asked.count() // BLOCK))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, v = _rows(b.column("vector"), width)
            reads = index_probed(v)
            names, blocks = b.column("query_id").to_pylist(), b.column("block").to_pylist()
            rows = [(blocks[i], k, s, names[i], v[i].tobytes()) for i in range(len(v)) for k in np.flatnonzero(reads[i]).tolist() for s in range(slices[k])]
            cols = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["block", "bucket", "slice", "query_id", "vector"])

    centroids, counts = index.centroids, index.counts

    def index_probed(v: np.ndarray) -> np.ndarray:
        held = Index.__new__(Index)
        held.centroids, held.counts = centroids, counts
        return held.probed(v, share)

    blocked = asked.where(F.exists("vector", lambda x: x != 0)).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
    asks = blocked.mapInArrow(ask, "block long, bucket int, slice int, query_id long, vector binary")
    cut = F.element_at(F.array(*[F.lit(x) for x in slices]), F.col("bucket") + 1)
    codes = index.codes.withColumn("slice", F.pmod(F.xxhash64("id"), cut).cast("int"))
    held = codes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))

    def tile(qs: pa.Table, rows: pa.Table) -> pa.Table:
        if not qs.num_rows or not rows.num_rows:
            return pa.Table.from_batches([_found([])])
        q = np.array([np.frombuffer(x, np.float32) for x in qs.column("vector").to_pylist()])
        run = _scores(q, qs.column("query_id").to_pylist(), np.ones((len(q), len(counts)), bool), limit, floor)
        return pa.Table.from_batches(run(rows.combine_chunks().to_batches()))

    keys = ["block", "bucket", "slice"]
    return _top(asks.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(tile, _FOUND), limit)

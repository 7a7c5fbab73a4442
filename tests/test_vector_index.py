"""The stored vector index against the exact search."""

import pathlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from shelfspark.operators import vector_index as X
from shelfspark.operators import vectors
from shelfspark.sources.work import work_path


def read(spark, sf):
    return spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").selectExpr("vec_id", "cast(vec_id as string) as asset_id", "embedding as vector")


@pytest.fixture(scope="module")
def medium(spark):
    e = read(spark, "sf0.1").cache()
    return e, X.build(e.select("asset_id", "vector"), work_path(spark, "vectors"))


def queries_of(e):
    return e.where("vec_id % 100 = 0").selectExpr("vec_id as query_id", "vector")


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r.id] = r.score
    return out


def column_bytes(folder, names, only=None):
    total = 0
    top = pathlib.Path(folder)
    for f in [top] if top.is_file() else top.rglob("*.parquet"):
        if only is None or f.parent.name in only:
            m = pq.ParquetFile(f).metadata
            total += sum(c.total_compressed_size for g in range(m.num_row_groups) for i in range(m.num_columns) if (c := m.row_group(g).column(i)).path_in_schema.split(".")[0] in names)
    return total


def test_recall_and_bytes(spark, medium):
    """Recall 0.9 over all ids divisible by 100, from a fifth of the bytes at most."""
    e, index = medium
    want, got = found(vectors.search_each(e, queries_of(e), 50)), found(X.search_each(index, queries_of(e), 50))
    assert len(want) == 20
    recall = [len(want[q].keys() & got[q].keys()) / len(want[q]) for q in want]
    assert np.mean(recall) >= 0.9 and min(recall) >= 0.75
    assert max(abs(want[q][i] - got[q][i]) for q in want for i in want[q].keys() & got[q].keys()) < 0.02
    plain = column_bytes("/root/testdata/sf0.1/embeddings.parquet", {"embedding"})
    folder = index.folder.removeprefix("file://") + "/codes"
    reads = index.probed(np.array([r.vector for r in queries_of(e).collect()], np.float32), X.SHARE)
    for row in reads:
        held = {f"bucket={b}" for b in np.flatnonzero(row)}
        assert column_bytes(folder, {"id", "code", "scale"}, held) <= 0.2 * plain
        assert index.counts[row].sum() <= 0.85 * index.counts.sum()


def test_every_vector_is_in_one_bucket(spark, medium):
    e, index = medium
    assert index.codes.count() == e.count() == index.codes.select("id").distinct().count() == index.counts.sum()
    assert index.usable and len(index.centroids) == 44


def test_other_folders_are_pruned(spark, medium):
    e, index = medium
    plan = X.search(index, e.first().vector, 5)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "ReadSchema: struct<id:string,code:binary,scale:float>" in plan


def test_many_queries_equal_single_ones(spark, medium):
    e, index = medium
    queries = queries_of(e)
    sent = found(X.search_each(index, queries, 10))
    assert sent == found(X.search_each(index, queries, 10, few=3))  # joined in blocks and slices
    for r in queries.limit(4).collect():
        assert sent[r.query_id] == {x.id: x.score for x in X.search(index, list(r.vector), 10).collect()}


@pytest.fixture
def rng_np():
    return np.random.default_rng(5)


def test_codes(rng_np):
    for width in (1, 5, 64):
        v = rng_np.standard_normal((200, width)).astype(np.float32)
        codes, scale = X.encode(v)
        assert codes.shape[1] == -(-width // 4) * 3
        assert (np.abs(X.decode(codes, scale, width) - v) <= scale[:, None] / 63 + 1e-6).all()


def test_odd_rows_additions_and_deletions(spark, rng_np):
    v = rng_np.standard_normal((60, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(f"a{i}", x.tolist()) for i, x in enumerate(v)] + [("null", None), ("short", [1.0]), ("zero", [0.0] * 4), ("copy", v[0].tolist())]
    index = X.build(spark.createDataFrame(rows, "asset_id string, vector array<float>"), work_path(spark, "vectors"))
    assert index.counts.sum() == 61 and not index.usable
    near = [r.id for r in X.search(index, v[0].tolist(), 2, share=1.0).collect()]
    assert near == ["a0", "copy"]
    more = X.add(index, spark.createDataFrame([("new", (v[0] * 3).tolist())], "asset_id string, vector array<float>"))
    assert more.counts.sum() == 62 and X.search(more, v[0].tolist(), 1).first().id == "new"
    alive = spark.createDataFrame([("a0",), ("a1",)], "id string")
    assert {r.id for r in X.search(more, v[0].tolist(), 9, floor=-9.0, share=1.0, assets=alive).collect()} == {"a0", "a1"}


def test_nothing_to_index(spark):
    index = X.build(spark.createDataFrame([], "asset_id string, vector array<float>"), work_path(spark, "vectors"))
    assert X.search(index, [1.0], 3).count() == 0


def test_exact_scores(spark, medium):
    e, index = medium
    q = list(e.where("vec_id = 100").first().vector)
    want = {r.id: r.score for r in vectors.semantic_search(e, q, 50).collect()}
    got = {r.id: r.score for r in X.search(index, q, 50, exact=True).collect()}
    assert len(want.keys() & got.keys()) >= 45 and all(want[i] == got[i] for i in want.keys() & got.keys())

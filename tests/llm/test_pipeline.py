import random

from oracle import SMALL
from pyspark.sql import functions as F
from test_line_dedup import brute as brute_lines
from test_near_duplicates import brute as brute_texts
from tests_llm_tools import parts

import corpus_pipeline as C
from shelfspark.llm import decontaminate as D


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    cols, before = docs.columns, docs
    results = {}
    for name, stage in C.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, before, SMALL).write.parquet(path)
        results[name] = (before, spark.read.parquet(path))
        before = results[name][1]
        assert name == "packing" or before.columns == cols

    a, b = results["language_id"]
    assert b.count() >= 0.97 * a.count() and b.exceptAll(a).count() == 0

    a, b = results["line_dedup"]
    rows = [(r.doc_id, r.text) for r in a.collect()]
    gone = brute_lines(rows)
    want = {}
    for d, t in rows:
        g = gone.get((True, d, t), [])
        kept = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in g)
        if not g or len(g) < sum(bool(x.strip()) for x in t.split("\n")):
            want[d] = kept
    assert {r.doc_id: r.text for r in b.collect()} == want
    assert b.where(F.length("text") != F.col("n_chars")).count() == 0

    a, b = results["near_dedup"]
    rows = [(r.doc_id, r.text) for r in a.collect()]
    texts, links = brute_texts(rows)
    root = parts([(texts.index(x), texts.index(y)) for x, y in links], range(len(texts)))
    least = {}
    for d, t in rows:
        least[root[texts.index(t)]] = min(d, least.get(root[texts.index(t)], d))
    assert sorted(r.doc_id for r in b.collect()) == sorted(least.values())

    a, b = results["decontamination"]
    items = [D.normal(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    exact = {r.doc_id for r in a.collect() if any(i in D.normal(r.text) for i in items)}
    left = {r.doc_id for r in b.collect()}
    assert not exact & left and a.count() - len(left) <= len(exact) + 2

    a, b = results["packing"]
    assert {r.doc_id for r in a.collect()} == {r.doc_id for r in b.collect()}
    total = b.agg(F.sum("length")).first()[0]
    assert b.select("sequence_id").distinct().count() <= -(-total // 2048) + 2


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    for _, stage in C.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_odd_rows_run_through(spark, tmp_path):
    """Nulls, repeats, long texts, ties and columns named like the stages' own."""
    rng = random.Random(3)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang is not null and n_chars > 300").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs]
    long = max((r.text for r in docs), key=len)
    rows += [(None, None, None, None, None), (9001, None, "en", "s", None), (9002, "", None, "s", 0), (9003, long * 40, "en", None, None), rows[0], rows[0], (None, rows[1][1], None, None, None)]
    rng.shuffle(rows)
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, cols)
    for c in ("_row", "row", "_removed", "removed", "lang_pred", "score", "text_id", "id", "chunk"):
        df = df.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    df = df.withColumn("a`b.c", F.lit(1))
    folder = f"{tmp_path}/in"
    df.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    before = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        stage(spark, before, folder).write.parquet(f"{tmp_path}/{name}")
        before = spark.read.parquet(f"{tmp_path}/{name}")
        assert before.columns == df.columns
        bad = before.where("doc_id is not null and (row != concat('row', doc_id) or removed != concat('removed', doc_id) or score != concat('score', doc_id) or lang_pred != concat('lang_pred', doc_id) or _row != concat('_row', doc_id))")
        assert bad.count() == 0
    assert before.where("text is null").count() == 0 and before.count() > 30
    out = C.run(spark, folder)
    assert out.count() > 30 and out.where("length < 1 or offset < 0").count() == 0

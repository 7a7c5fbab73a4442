import oracle
from oracle import SMALL

from shelfspark.functions.porter import stem
from shelfspark.operators import search
from shelfspark.operators.search_index import SearchIndex
from shelfspark.plans import catalogue
from shelfspark.sources.library import Documents


def documents(spark):
    rows = [("1", "running shoes runs", "a"), ("2", "the runner ran", "running"), ("3", "Relational relations", ""), ("4", None, "run"), ("5", "runny nose", "relate")]
    return spark.createDataFrame(rows, "asset_id string, ocr_text string, caption string")


def test_stemmed_words_are_found(spark):
    import re

    docs = documents(spark)
    rows = {r.asset_id: [stem(w) for t in (r.ocr_text, r.caption) for w in re.findall(r"\w+", (t or "").lower())] for r in docs.collect()}
    for text in ("running", "relations", "runs shoe", "nothing"):
        want = {i for i, toks in rows.items() if all(any(t.startswith(stem(w)) for t in toks) for w in text.split())}
        assert {r.asset_id for r in search.bm25(docs, text, porter=True).collect()} == want


def scores(df):
    return {r.asset_id: round(r.score, 9) for r in df.collect()}


TEXTS = ("run", "running", "re", "run n", "zzz", "")


def test_postings_give_the_scan_s_scores(spark, tmp_path):
    docs = documents(spark)
    for porter in (True, False):
        index = SearchIndex(spark, f"{tmp_path}/{porter}", porter)
        assert scores(index.bm25("run")) == {}
        index.update(docs)
        for text in TEXTS:
            assert scores(index.bm25(text)) == scores(search.bm25(docs, text, porter=porter))
    plan = index.bm25("run")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,run)" in plan


def test_index_follows_changes(spark, tmp_path):
    """Updates, removals and merges give the scores of an index that is built anew; old segments are not written again."""
    docs = documents(spark)
    index = SearchIndex(spark, str(tmp_path / "i"))
    index.update(docs)
    first = index.versions.current()[1]["postings=1"]
    changed = spark.createDataFrame([("2", "nothing here", ""), ("6", "rerun the run", "runs"), ("3", None, None)], docs.schema)
    index.update(changed)
    now = docs.where("asset_id not in ('2', '3')").unionByName(changed)
    for text in TEXTS:
        assert scores(index.bm25(text)) == scores(search.bm25(now, text, porter=True))
    assert index.versions.current()[1]["postings=1"] == first
    index.remove(spark.createDataFrame([("6",), ("1",), ("nobody",)], "asset_id string"))
    now = now.where("asset_id not in ('6', '1')")
    for text in TEXTS:
        assert scores(index.bm25(text)) == scores(search.bm25(now, text, porter=True))
    index.update(changed.where("asset_id = '6'"))  # comes back
    now = now.unionByName(changed.where("asset_id = '6'"))
    before = {text: scores(search.bm25(now, text, porter=True)) for text in TEXTS}
    assert {text: scores(index.bm25(text)) for text in TEXTS} == before
    index.merge()
    assert len(index._segments()) == 1 and "gone" not in index.versions.current()[1]
    again = SearchIndex(spark, str(tmp_path / "i"))
    assert {text: scores(again.bm25(text)) for text in TEXTS} == before
    assert again.versions.vacuum() > 0 and scores(again.bm25("run")) == before["run"]


def test_stemmed_search_box(spark):
    t = Documents(spark, SMALL)
    stemmed, plain = (search.search(t.assets, catalogue._doc_index(t), "then ere", porter=p).count() for p in (True, False))
    assert stemmed > 0 and plain > 0
    assert oracle.connect(SMALL)


def test_postings_are_counted_in_rows_and_dealt_by_size(spark, tmp_path, monkeypatch):
    """No task holds more for a larger input: no hash table of postings, and as many tasks as the tokens need."""
    from shelfspark.operators import search_index

    docs = documents(spark)
    rows = search.postings(search.token_lists(docs).selectExpr("*", "7L as len"))
    assert "Aggregate" not in rows._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.asset_id, r.field, r.term, r.n, r.len) for r in rows.collect())
    want = search.tokens(docs).groupBy("asset_id", "field", "term").count().collect()
    assert got == sorted((r.asset_id, r.field, r.term, r["count"], 7) for r in want)
    monkeypatch.setattr(search_index, "TOKENS_A_TASK", 1)
    index = SearchIndex(spark, str(tmp_path / "i"), False)
    index.update(docs.unionByName(docs.where("asset_id = '2'")))  # a document in two rows counts as one
    files = lambda n: len(list((tmp_path / "i" / "data" / index.versions.current()[1][f"postings={n}"][0]).glob("*.parquet")))
    assert files(1) > 4 and index.versions.current()[2]["docs"] == 5
    twice = docs.selectExpr("asset_id", "if(asset_id = '2', concat(ocr_text, ' ', ocr_text), ocr_text) as ocr_text", "if(asset_id = '2', concat(caption, ' ', caption), caption) as caption")
    for text in TEXTS:
        assert scores(index.bm25(text)) == scores(search.bm25(twice, text))
    index.update(docs)
    index.merge()
    assert files(3) > 4
    for text in TEXTS:
        assert scores(index.bm25(text)) == scores(search.bm25(docs, text))


def test_tokens_of_an_update_are_made_once(spark, tmp_path, monkeypatch):
    """Not again for the lengths or for the ranges of a sort."""
    from pyspark.sql import functions as F

    from shelfspark.operators import search_index

    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def told(tokens):
        seen.add(1)
        return tokens

    monkeypatch.setattr(search_index, "token_lists", lambda d, porter: search.token_lists(d, porter).withColumn("caption", told.asNondeterministic()("caption")))
    docs = documents(spark)
    index = SearchIndex(spark, str(tmp_path / "i"), False)
    index.update(docs)
    assert seen.value == docs.count()
    for text in TEXTS:
        assert scores(index.bm25(text)) == scores(search.bm25(docs, text))


def test_merge_rewrites_no_more_than_it_must(spark, tmp_path, monkeypatch):
    """Segments that are replaced as a whole are not read, one that is left alone and whole stays; others are merged in tasks by size."""
    from shelfspark.operators import search_index

    docs = documents(spark)
    index = SearchIndex(spark, str(tmp_path / "i"), False)
    index.update(docs.select("asset_id", "caption"))
    index.update(docs)
    kept = index.versions.current()[1]
    index.merge()
    now = index.versions.current()[1]
    assert (sorted(now), now["postings=3"], now["lengths=3"]) == (["lengths=3", "postings=3"], kept["postings=2"], kept["lengths=2"])
    monkeypatch.setattr(search_index, "TOKENS_A_TASK", 1)
    index.update(docs.where("asset_id in ('2', '4')").selectExpr("asset_id", "ocr_text", "'run' as caption"))
    index.merge()
    changed = docs.selectExpr("asset_id", "ocr_text", "if(asset_id in ('2', '4'), 'run', caption) as caption")
    for text in TEXTS:
        assert scores(index.bm25(text)) == scores(search.bm25(changed, text))
    index.remove(docs.select("asset_id"))
    index.merge()
    assert index.versions.current()[1] == {} and scores(index.bm25("run")) == {}
    index.update(docs)
    assert scores(index.bm25("run")) == scores(search.bm25(docs, "run"))


def test_odd_documents_are_counted(spark, tmp_path):
    """No documents, no fields, no tokens, letters of other scripts; files are sorted by term."""
    import glob

    import pyarrow.parquet as pq

    none = documents(spark).where("false")
    bare = spark.createDataFrame([("1", None, ""), ("2", "...", " ")], none.schema)
    odd = spark.createDataFrame([("9", "ΟΔΟΣ ΟΔΟΣ İstanbul 東京 ß_1", "été Été"), ("10", "z z a", "a z"), ("3", None, "...")], none.schema)
    index = SearchIndex(spark, str(tmp_path / "i"), False)
    index.update(none)
    index.update(bare.select("asset_id"))
    assert index.versions.current()[2]["docs"] == 2
    index.update(bare)
    index.update(odd)
    index.update(none)
    for _ in range(2):
        notes = index.versions.current()[2]
        assert (notes["docs"], notes["tokens"]) == (5, search.tokens(odd).count())
        for text in ("οδος", "i", "東", "ß_", "été", "z a", "..."):
            assert scores(index.bm25(text)) == scores(search.bm25(bare.unionByName(odd), text))
        index.merge()
    for f in glob.glob(str(tmp_path / "i" / "data" / index.versions.current()[1]["postings=7"][0] / "*.parquet")):
        rows = [(r["term"].encode(), r["asset_id"].encode()) for r in pq.read_table(f).to_pylist()]
        assert rows == sorted(rows)


def test_indexed_texts_are_not_joined(spark):
    """An asset's file name, text and caption come from its one row, as the three tables joined by id would give them."""
    from shelfspark.functions.predicates import name_of

    t = Documents(spark, SMALL)
    got = catalogue._doc_index(t)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = t.assets.select("id", name_of(t.assets.path)).join(t.asset_text.selectExpr("asset_id as id", "text"), "id").join(t.asset_captions.withColumnRenamed("asset_id", "id"), "id")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)

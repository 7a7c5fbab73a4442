"""Full-text search, by a scan or over stored postings, and its blend with vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark import schema as S
from shelfspark.functions.porter import stem
from shelfspark.functions.predicates import blank, event_ts, name_of
from shelfspark.operators.browse import Query, filtered, parse_query
from shelfspark.sources.work import ship, write_table

K1, B = 1.2, 0.75
FIELDS = list(S.BM25_DOCUMENTED)
POSTINGS = "term string, field string, asset_id string, n long, len long"
BYTES_AT_ONCE = 32_000_000
ROWS_A_BATCH = 100_000


def search_documents(assets: DataFrame, tags: DataFrame, asset_tags: DataFrame, faces: DataFrame, people: DataFrame, labels: DataFrame | None = None, text: DataFrame | None = None, captions: DataFrame | None = None) -> DataFrame:
    """(asset_id, one column a field): what the index is built of.

    Tags by name; people that have a name and are not hidden; labels up to
    their first comma; lists in order, joined by spaces.
    """
    joined = lambda df, key, value, name: df.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(value)), " ").alias(name))
    t = joined(asset_tags.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id"), "asset_id", "name", "tags")
    shown = people.where(~F.col("ignored") & ~blank(F.col("name"))).select(F.col("id").alias("person_id"), "name")
    p = joined(faces.join(shown, "person_id"), "asset_id", "name", "people")
    out = assets.select(F.col("id").alias("asset_id"), name_of(F.col("path")).alias("filename"), F.coalesce("camera", F.lit("")).alias("camera"), F.coalesce("lens", F.lit("")).alias("lens"))
    out = out.join(t, "asset_id", "left").join(p, "asset_id", "left")
    if labels is not None:
        out = out.join(joined(labels.withColumn("l", F.trim(F.substring_index("label", ",", 1))), "asset_id", "l", "auto_tags"), "asset_id", "left")
    for df, source, name in ((text, "text", "ocr_text"), (captions, "caption", "caption")):
        if df is not None:
            out = out.join(df.select("asset_id", F.col(source).alias(name)), "asset_id", "left")
    return out.select("asset_id", *[(F.coalesce(F.col(f), F.lit("")) if f in out.columns else F.lit("")).alias(f) for f in FIELDS])


def query_terms(text: str | None, porter: bool = False) -> list[str]:
    """Prefixes, all of which must be found; signs split words."""
    words = "".join(c.lower() if c.isalnum() or c == "_" else " " for c in text or "").split()
    return [stem(w) for w in words] if porter else words


@F.pandas_udf(T.StringType())
def _stems(terms: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return terms.map(lambda t: known.setdefault(t, stem(t)) if t is not None else None)


def tokens(documents: DataFrame, porter: bool = False) -> DataFrame:
    """(asset_id, field, term): every token of every field."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS if f in documents.columns]))
    rows = documents.select("asset_id", pairs.alias("p")).select("asset_id", "p.field", F.explode(F.split(F.lower("p.text"), r"[^\p{L}\p{N}_]+")).alias("term")).where("term <> ''")
    if not porter:
        return rows
    ship(documents.sparkSession)
    return rows.withColumn("term", _stems("term"))


def _scored(rows: DataFrame, totals: DataFrame, n_terms: int) -> DataFrame:
    """(asset_id, score) from rows(asset_id, len, f0, ...) of hits and totals(N, avg, n0, ...), one row."""
    found = rows
    for i in range(n_terms):
        found = found.where(F.col(f"f{i}") > 0)
    found = found.crossJoin(F.broadcast(totals))
    norm = K1 * (1 - B + B * F.col("len") / F.col("avg"))
    score = F.lit(0.0)
    for i in range(n_terms):
        idf = F.greatest(F.ln((F.col("N") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(1e-6))
        score = score + idf * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + norm)
    return found.select("asset_id", score.alias("score"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stem_lists(lists: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return lists.map(lambda x: [known.setdefault(t, stem(t)) for t in x] if x is not None else None)


def token_lists(documents: DataFrame, porter: bool = False) -> DataFrame:
    """(asset_id, one array of tokens a field): each document within its own row."""
    if porter:
        ship(documents.sparkSession)
    split = lambda f: F.filter(F.split(F.lower(F.coalesce(f, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda t: t != "")
    return documents.select("asset_id", *[(_stem_lists(split(f)) if porter else split(f)).alias(f) for f in FIELDS if f in documents.columns])


def list_length(lists: DataFrame) -> Column:
    """The tokens of all fields of token_lists."""
    return sum((F.size(f) for f in lists.columns if f in FIELDS), F.lit(0)).cast("long")


def _counted(documents: DataFrame, terms: list[str], weights: dict[str, float], porter: bool) -> DataFrame:
    """(asset_id, len, f0, ...): a document is counted within its own row."""
    rows = token_lists(documents, porter)
    fields = [f for f in FIELDS if f in rows.columns]
    count = lambda f, t: F.size(F.filter(f, lambda x: x.startswith(t)))
    # one pass over the tokens of a field: they are held by the projection below
    hits = [sum((count(f, t) * float(weights[f]) for f in fields), F.lit(0.0)).alias(f"f{i}") for i, t in enumerate(terms)]
    return rows.select("asset_id", list_length(rows).alias("len"), *hits)


def _count_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The postings of a batch of postings()' rows, sorted: a number stands for a term's rank, a document's and a field."""
    ids, fields = batch.column("asset_id"), [f for f in batch.schema.names if f in FIELDS]
    lists = [batch.column(f) for f in fields]
    docs = pc.array_sort_indices(ids).to_numpy()
    place = np.empty(len(docs), np.int64)
    place[docs] = np.arange(len(docs))
    found = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    terms = pc.array_sort_indices(found.dictionary).to_numpy()
    rank = np.empty(len(terms), np.int64)
    rank[terms] = np.arange(len(terms))
    doc = np.concatenate([np.repeat(place, pc.fill_null(x.value_lengths(), 0).to_numpy(zero_copy_only=False)) for x in lists])
    field = np.repeat(np.arange(len(fields)), [len(x.flatten()) for x in lists])
    key, n = np.unique((rank[found.indices.to_numpy()] * len(docs) + doc) * len(fields) + field, return_counts=True)
    key, field = np.divmod(key, len(fields))
    term, doc = np.divmod(key, len(docs))
    at = pa.array(docs[doc])
    columns = [found.dictionary.take(pa.array(terms[term])), pa.array(fields, ids.type).take(pa.array(field)), ids.take(at), pa.array(n), batch.column("len").take(at)]
    return pa.RecordBatch.from_arrays(columns, ["term", "field", "asset_id", "n", "len"])


def _count_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted() -> Iterator[pa.RecordBatch]:
        for b in pa.Table.from_batches(held).combine_chunks().to_batches():
            rows = _count_terms(b)
            yield from (rows.slice(i, ROWS_A_BATCH) for i in range(0, len(rows), ROWS_A_BATCH))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(b.nbytes for b in held) > BYTES_AT_ONCE:
            yield from counted()
            held.clear()
    if held:
        yield from counted()


def postings(lists: DataFrame) -> DataFrame:
    """(term, field, asset_id, n, len) of token_lists with len: counted within a task, in Arrow's arrays.

    A task's rows come sorted by term and asset_id, anew after each BYTES_AT_ONCE of tokens.
    """
    fields = [f for f in lists.columns if f in FIELDS]
    if not fields:
        return lists.sparkSession.createDataFrame([], POSTINGS)
    ship(lists.sparkSession)
    return lists.select("asset_id", F.col("len").cast("long").alias("len"), *fields).mapInArrow(_count_lists, POSTINGS)


def bm25(documents: DataFrame, text: str | None, weights: dict[str, float] | None = None, porter: bool = False) -> DataFrame:
    """(asset_id, score) of the documents that hold all terms of the query as prefixes.

    score = sum over terms of idf * f (k1 + 1) / (f + k1 (1 - b + b len / avg)),
    f the weighted number of hits, len the tokens of all fields, idf =
    ln((N - n + 0.5) / (n + 0.5)), at least 1e-6.  A text without a word finds
    nothing.  Every document is read, once; a few numbers are written of those that
    hold a term, the others are only counted on the way.
    """
    weights, terms = weights or S.BM25_DOCUMENTED, query_terms(text, porter)
    if not terms:
        return documents.select("asset_id", F.lit(0.0).alias("score")).where(F.lit(False))
    seen = Observation()
    counted = _counted(documents, terms, weights, porter).observe(seen, F.count(F.lit(1)).alias("N"), F.sum("len").alias("total"))
    rows = write_table(counted.where(F.greatest(*[F.col(f"f{i}") for i in range(len(terms))], F.lit(0.0)) > 0), "hits")
    return _scored(rows, _totals(rows, seen.get["N"], seen.get["total"] or 0, len(terms)), len(terms))


def _totals(rows: DataFrame, n: int, tokens: int, n_terms: int) -> DataFrame:
    """One row: N, avg and the documents that each term hits."""
    hits = rows.agg(F.count(F.lit(1)), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(n_terms)])
    return hits.withColumns({"N": F.lit(n).cast("long"), "avg": F.lit(tokens / n if n else None).cast("double")})


def search_text(assets: DataFrame, documents: DataFrame, raw: str, limit: int = 50, offset: int = 0, weights: dict[str, float] | None = None, porter: bool = False) -> DataFrame:
    """(id, score): text hits of live assets that the structured tokens let through, best first."""
    q = parse_query(raw)
    hits = bm25(documents, q.text, weights, porter).withColumnRenamed("asset_id", "id")
    rows = filtered(assets, q).select("id", event_ts().alias("at")).join(hits, "id")
    return rows.orderBy(F.desc("score"), F.desc("at"), "id").offset(offset).limit(min(limit, S.LIMIT_LIST)).select("id", "score")


def search(assets: DataFrame, documents: DataFrame, raw: str, limit: int = 50, offset: int = 0, weights: dict[str, float] | None = None, porter: bool = True) -> DataFrame:
    """(id, pos) of a search box: nothing said is the plain listing, tokens alone filter it, words are looked up.

    Words are stemmed, as the reference's index does it, unless porter is off.
    """
    q = parse_query(raw)
    if q.text is not None:
        rows = search_text(assets, documents, raw, limit, offset, weights, porter)
        order = [F.desc("score"), F.desc("at"), "id"]
        rows = rows.join(assets.select("id", event_ts().alias("at")), "id")
    else:
        rows = filtered(assets, q).select("id", event_ts().alias("at"))
        order = [F.col("at").desc_nulls_last(), "id"]
        rows = rows.orderBy(*order).offset(offset).limit(min(limit, S.LIMIT_LIST))
    pos = F.row_number().over(Window.orderBy(*order)) - 1  # at most a page of rows
    return rows.select("id", pos.alias("pos"))


def blends(raw: str, offset: int = 0) -> bool:
    """Whether vector hits are mixed in: plain text of three characters or more, first page."""
    q = parse_query(raw)
    return offset == 0 and q == Query(text=q.text) and len((q.text or "").strip()) >= 3


def blended(text_hits: DataFrame, vector_hits: DataFrame, limit: int = 50) -> DataFrame:
    """(id, pos): text hits, then vector hits that are new; both (id, score), best first."""
    rows = text_hits.select(F.lit(0).alias("source"), "id", "score").union(vector_hits.select(F.lit(1), "id", "score"))
    best = rows.groupBy("id").agg(F.min(F.struct("source", (-F.col("score")).alias("s"))).alias("r"))
    listed = best.orderBy("r.source", "r.s", "id").limit(limit)  # at most a page of rows
    listed = listed.agg(F.sort_array(F.collect_list(F.struct("r.source", "r.s", "id"))).alias("l"))
    return listed.select(F.posexplode("l").alias("pos", "x")).select("x.id", "pos")


def blended_each(text_hits: DataFrame, vector_hits: DataFrame, queries: DataFrame, limit: int = 50) -> DataFrame:
    """(query_id, id, pos): ``blended`` for each query_id, with its hits of vector_hits(query_id, id, score)."""
    text = queries.crossJoin(F.broadcast(text_hits.select("id", "score")))  # at most a page of rows
    rows = text.select("query_id", F.lit(0).alias("source"), "id", "score").union(vector_hits.select("query_id", F.lit(1), "id", "score"))
    best = rows.groupBy("query_id", "id").agg(F.min(F.struct("source", (-F.col("score")).alias("s"))).alias("r"))
    w = Window.partitionBy("query_id").orderBy("r.source", "r.s", "id")
    return best.select("query_id", "id", (F.row_number().over(w) - 1).alias("pos")).where(F.col("pos") < limit)

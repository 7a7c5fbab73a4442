"""Stored postings that follow the documents: segments, marks of what is gone, merges.

A segment has the postings (term, field, asset_id, n, len) of the documents
that came in together.  Documents are dealt by id, a file has the postings of its
own, sorted by term, so that a prefix reads few pages of each.
A document that changes or goes is marked: postings of older segments don't
count.  Its length leaves the corpus totals, which are kept in the notes of each
version.  Scores are those of ``search.bm25`` over the documents as they are.
``merge`` writes the live postings as one segment again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark import schema as S
from shelfspark.operators.search import FIELDS, POSTINGS, _scored, _totals, list_length, postings, query_terms, token_lists
from shelfspark.sources.versions import Change, Versions
from shelfspark.sources.work import drop_table, write_table

LENGTHS = "asset_id string, len long"
GONE = "asset_id string, before long"
TOKENS_A_TASK = 1_000_000
BYTES_A_TOKEN = 6  # about; only for dealing documents by size


def _tasks(tokens: int) -> int:
    """Documents and postings are dealt in tasks whose size doesn't depend on the input's."""
    return max(1, -(-tokens // TOKENS_A_TASK))


class SearchIndex:
    def __init__(self, spark: SparkSession, folder: str, porter: bool = True):
        self.spark, self.porter, self.versions = spark, porter, Versions(spark, folder)

    def _segments(self) -> list[int]:
        return sorted(int(p.removeprefix("postings=")) for p in self.versions.current()[1] if p.startswith("postings="))

    def _live(self, schema: str, kind: str, tasks: int | None = None, segments: list[int] | None = None, marked: bool = True) -> DataFrame:
        """Rows of these segments (None: of all) that no later change has replaced, with their segment.

        tasks: in how many marks are looked up; marked: whether any of the rows may be.
        """
        found = None
        for n in self._segments() if segments is None else segments:
            rows = self.versions.read(schema, [f"{kind}={n}"]).withColumn("segment", F.lit(n).cast("long"))
            found = rows if found is None else found.unionByName(rows)
        if found is None:
            return self.spark.createDataFrame([], f"{schema}, segment long")
        if tasks:
            found = found.repartition(tasks, "asset_id")
        if not marked or "gone" not in self.versions.current()[1]:
            return found
        marks = self.versions.read(GONE, ["gone"])
        if tasks:
            marks = marks.repartition(tasks, "asset_id")
        marks = marks.groupBy("asset_id").agg(F.max("before").alias("before"))
        return found.join(marks, "asset_id", "left").where("before is null or segment >= before").drop("before")

    def _replace(self, ids: DataFrame, change: Change, n: int) -> None:
        """Mark what these documents have in older segments, and take it out of the totals."""
        old = self._live(LENGTHS, "lengths").join(ids, "asset_id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("t")).first()
        change.notes["docs"] = change.notes.get("docs", 0) - old["n"]
        change.notes["tokens"] = change.notes.get("tokens", 0) - (old["t"] or 0)
        if old["n"]:
            change.add("gone", ids.withColumn("before", F.lit(n).cast("long")))

    def update(self, documents: DataFrame) -> int:
        """Take in documents(asset_id, fields): new ones, and those that have changed. Other documents are not read.

        These are read twice: for their ids and sizes, and for their tokens, which are made and counted once.
        """
        change = self.versions.begin()
        n = change.notes["last"] = change.notes.get("last", 0) + 1
        fields = [f for f in FIELDS if f in documents.columns]
        size = sum((F.coalesce(F.octet_length(f), F.lit(0)).cast("long") for f in fields), F.lit(0))
        ids = write_table(documents.groupBy("asset_id").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows")), "ids")
        self._replace(ids.select("asset_id"), change, n)
        got = ids.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.max("rows").alias("rows")).first()
        dealt = documents.repartition(_tasks((got["bytes"] or 0) // BYTES_A_TOKEN), "asset_id")
        if (got["rows"] or 0) > 1:  # a document in several rows
            dealt = dealt.groupBy("asset_id").agg(*[F.concat_ws(" ", F.collect_list(f)).alias(f) for f in fields])
        lists = token_lists(dealt, self.porter)
        change.put(f"postings={n}", postings(lists.withColumn("len", list_length(lists))))
        lens = change.read(POSTINGS, f"postings={n}").groupBy("asset_id").agg(F.first("len").alias("len"))
        lens = ids.select("asset_id").join(lens, "asset_id", "left")  # some have no token
        change.put(f"lengths={n}", lens.select("asset_id", F.coalesce("len", F.lit(0)).cast("long").alias("len")))
        change.notes["docs"] += got["n"]
        change.notes["tokens"] += change.read(LENGTHS, f"lengths={n}").agg(F.sum("len")).first()[0] or 0
        done = change.commit()
        drop_table(ids)
        return done

    def remove(self, ids: DataFrame) -> int:
        """Take out ids(asset_id); only lengths are read."""
        change = self.versions.begin()
        change.notes["last"] = change.notes.get("last", 0) + 1
        self._replace(ids.select("asset_id").distinct(), change, change.notes["last"])
        return change.commit()

    def merge(self) -> int:
        """One segment of all live postings; marks are no longer needed.

        Of segments without a live document only lengths are read.  A segment that
        is left alone and has lost nothing is that one segment already.
        """
        change = self.versions.begin()
        n = change.notes["last"] = change.notes.get("last", 0) + 1
        live = {r["segment"]: r["n"] for r in self._live(LENGTHS, "lengths").groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
        marked = any(self.versions.read(LENGTHS, [f"lengths={s}"]).count() > live[s] for s in live)
        old, change.parts = change.parts, {}
        if len(live) == 1 and not marked:
            change.parts = {f"{kind}={n}": old[f"{kind}={s}"] for kind in ("postings", "lengths") for s in live}
        elif live:
            tasks = _tasks(self.versions.read(POSTINGS, [f"postings={s}" for s in live]).count())
            posts = self._live(POSTINGS, "postings", tasks, sorted(live), marked)
            change.put(f"postings={n}", posts.select("term", "field", "asset_id", "n", "len").sortWithinPartitions("term", "asset_id"))
            change.put(f"lengths={n}", self._live(LENGTHS, "lengths", None, sorted(live), marked).select("asset_id", "len"))
        return change.commit()

    def bm25(self, text: str | None, weights: dict[str, float] | None = None) -> DataFrame:
        """(asset_id, score) as ``search.bm25``; of each segment only the postings of the query's prefixes are read."""
        weights, terms = weights or S.BM25_DOCUMENTED, query_terms(text, self.porter)
        posts = self._live(POSTINGS, "postings")
        if not terms:
            return posts.select("asset_id", F.lit(0.0).alias("score")).where(F.lit(False))
        weight = F.create_map(*[x for f, w in weights.items() for x in (F.lit(f), F.lit(float(w)))])
        some = F.lit(False)
        for t in terms:
            some = some | F.col("term").startswith(t)
        hits = [F.sum(F.when(F.col("term").startswith(t), weight[F.col("field")] * F.col("n")).otherwise(0.0)).alias(f"f{i}") for i, t in enumerate(terms)]
        rows = posts.where(some).groupBy("asset_id").agg(F.first("len").alias("len"), *hits)
        notes = self.versions.current()[2]
        return _scored(rows, _totals(rows, notes.get("docs", 0), notes.get("tokens", 0), len(terms)), len(terms))

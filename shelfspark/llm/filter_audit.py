"""Filter interaction audit: what each of five filters removes in every order.

Failure conditions of a text (null: empty): A under 100 words, B distinct words
under 80 % of all, C more than 10 % letters A-Z of the code points, D one of
``#$%&*|``, E identical to the text of a smaller doc_id.

Sort-based duplicates.  Rows are sorted by range of (fingerprint, doc_id) and
within a task by (fingerprint, text, doc_id), so a group of copies of any size
is split over tasks and no text goes to the driver with the range samples.  A
row is compared with its predecessor; the group's first doc_id passes and later
ones fail.  Only the first fingerprint of a task can go on from another task:
the first rows of its groups are decided afterwards, with the first doc_ids of
the groups in which other tasks begin or end, a few rows a task.

Masks.  What is left of a row is its five-bit mask.  Counters by (part, mask)
are additive: any count of any order is a sum over the 32 masks of a part, so
orders are expanded from counters and never from rows.  A filter's removals
over all 120 orders are the sum of 120 / (filters that fail) over the masks it
fails in, for each of a mask's filters comes first equally often.

Defined results.  A null doc_id is neither smaller nor larger than another: its
row passes E and fails no other.  Repeated rows count each; those of one
doc_id do not make each other fail.  A document with several rows in labels is
good or toxic if one of them says so; null labels say nothing.  Other columns
are ignored.  No documents: no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import by_texts, ship, tidied, write_table

FILTERS = "ABCDE"
E = 16
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
_SYMBOL = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def text_mask(text: bytes, n_points: int) -> int:
    """Bits of the filters A to D that a text of so many code points fails."""
    words = text.split()  # bytes are split at \x20 and \x09-\x0D
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > MAX_CAPITAL_PERCENT * n_points) << 2
        | (_SYMBOL.search(text) is not None) << 3
    )


_MARKED = "kind int, doc_id long, part string, mask int, n long, fp long, text string"
_DECIDED, _PENDING, _EDGE = 0, 1, 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in _MARKED.split(", ")])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by fp, text, doc_id (nulls last): decided ones, and at the end what other tasks must know or tell."""
    first_fp, fp, text, mask, least = None, None, None, 0, None
    ends: list[tuple[str, int | None]] = []  # texts of the current fp with their least doc_id
    pending: dict[tuple[str, int, str, int], int] = {}  # (text, doc_id, part, mask) of the first fp
    for b in by_texts(batches):
        points = pc.utf8_length(b.column("text")).to_pylist()
        texts = b.column("text").cast(pa.binary()).to_pylist()
        out = []
        for own_fp, own, n_points, doc, part in zip(b.column("fp").to_pylist(), texts, points, b.column("doc_id").to_pylist(), b.column("part").to_pylist()):
            if own_fp != fp:
                first_fp = own_fp if first_fp is None else first_fp
                fp, ends, text = own_fp, [], None
            if own != text:
                text, mask, least = own, text_mask(own, n_points), doc
                ends.append((own, doc))
            if doc is None or fp != first_fp:
                out.append((_DECIDED, doc, part, mask | (E if doc is not None and doc > least else 0), 1, None, None))
            elif doc > least:
                out.append((_DECIDED, doc, part, mask | E, 1, None, None))
            else:
                key = (own, doc, part, mask)
                pending[key] = pending.get(key, 0) + 1
        if out:
            yield _batch(out)
    last = [(_PENDING, doc, part, m, n, first_fp, own.decode()) for (own, doc, part, m), n in pending.items()]
    last += [(_EDGE, doc, None, None, 0, fp, own.decode()) for own, doc in ends if doc is not None]
    if last:
        yield _batch(last)


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n) of docs(doc_id, text, lang): n rows of a document, with bit i set if they fail filter i."""
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("fp"))
    lined = rows.repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", F.asc_nulls_last("doc_id"))
    marked = write_table(lined.mapInArrow(tidied(_marked), _MARKED), "marked")
    told = marked.where(F.col("kind") != _DECIDED)
    least = told.groupBy("fp", "text").agg(F.min("doc_id").alias("least"))
    late = told.where(F.col("kind") == _PENDING).join(least, ["fp", "text"])
    late = late.select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("least"), E).otherwise(0)).alias("mask"), "n")
    return marked.where(F.col("kind") == _DECIDED).select("doc_id", "part", "mask", "n").unionByName(late)


def counters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): additive counters of documents."""
    rows = masks(docs).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    some = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return rows.join(told, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), some("good").alias("good"), some("toxic").alias("toxic"))


def _total(value: str, where) -> Column:
    """Sum of a value over a part's masks of which where says so."""
    return F.aggregate("masks", F.lit(0).cast("long"), lambda a, x: a + F.when(where(x["mask"]), x[value]).otherwise(0))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For every part, order of filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 at most
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(filters)]))
    df = parts.select("part", "masks", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    bits = F.create_map(*[c for i, f in enumerate(filters) for c in (F.lit(f), F.lit(1 << i))])
    bit = lambda x: F.element_at(bits, x)
    letter = lambda i: F.substring("filter_order", i, 1)
    df = df.withColumn("own", bit(letter(F.col("step"))))
    df = df.withColumn("before", F.aggregate(F.sequence(F.lit(1), F.lit(len(filters))), F.lit(0), lambda a, i: a + F.when(i < F.col("step"), bit(letter(i))).otherwise(0)))
    own, before = F.col("own"), F.col("before")
    has, met = lambda m: m.bitwiseAND(own) != 0, lambda m: m.bitwiseAND(before) != 0
    shares = lambda m: (F.lit(math.factorial(len(filters))) / F.bit_count(m)).cast("long")  # noqa: E731  whole up to five filters
    shapley = F.aggregate("masks", F.lit(0).cast("long"), lambda a, x: a + F.when(has(x["mask"]), x["n"] * shares(x["mask"])).otherwise(0))
    return df.select(
        "part",
        "filter_order",
        "step",
        _total("n", lambda m: ~has(m) & ~met(m)).alias("kept"),
        _total("n", lambda m: has(m) & ~met(m)).alias("removed"),
        _total("n", lambda m: has(m) & met(m)).alias("redundant"),
        _total("n", lambda m: m == own).alias("unique_fails"),
        _total("good", lambda m: has(m) & ~met(m)).alias("good_lost"),
        _total("toxic", lambda m: has(m) & ~met(m)).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters on docs(doc_id, text, lang) with labels(doc_id, quality, toxic)."""
    return interactions(counters(docs, labels))

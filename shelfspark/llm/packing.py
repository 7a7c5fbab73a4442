"""Best-two-fit packing of documents into sequences of a fixed length.

Longer documents are cut from their end, so that only the first piece may be
shorter than a sequence.  What is packed are lengths: pieces of one length are
interchangeable, so the packer works on the counts of lengths, at most one for
each length up to the sequence's, whatever the number of documents.  It fills
a sequence greedily, longest first, then replaces its smallest piece with two
unpacked ones that fit the gap so widened more tightly, as long as that helps;
the same fill is repeated while its lengths last.  Pieces then get a rank
within their length (counted in salted groups, so that a length which a third
of all pieces share is no single task) and find their place by it.

Defined results.  A null text is empty: the end id alone.  doc_id must be a whole
number or its text; another one fails.  Repeated rows and null ids are packed each.  No rows: no rows.  An empty corpus makes no sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import by_texts, ship, tidied, write_table
from shelfspark.llm.tokenizer_cache import piece_ids

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n >= 1 ids."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(tokenizer: str, end_id: int, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4").tobytes()
        for b in by_texts(batches):
            out = [[] for _ in range(6)]
            for d, data in zip(b.column("doc_id").to_pylist(), piece_ids(tokenizer, np.uint32).of(b.column("text").to_pylist())):
                data += end
                for i, (s, n) in enumerate(cut(len(data) // 4, capacity)):
                    part = data[4 * s : 4 * (s + n)]
                    for col, v in zip(out, (d, i, s, n, zlib.crc32(part), part if with_ids else None)):
                        col.append(v)
            cols = [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols[: 6 if with_ids else 5], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5])

    return tidied(run, "tokenizers", "pieces")


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pieces(tokenizer, end_id, capacity, with_ids), PIECES + (", ids binary" if with_ids else ""))


def _fill(counts: np.ndarray, capacity: int) -> list[int]:
    """Lengths of one sequence, longest first."""
    left = counts.copy()
    bin_, gap = [], capacity
    below = np.flatnonzero(left)
    while gap:
        i = np.searchsorted(below, gap, side="right") - 1
        while i >= 0 and not left[below[i]]:
            i -= 1
        if i < 0:
            break
        n = int(below[i])
        bin_.append(n)
        left[n] -= 1
        gap -= n
    while gap and len(bin_) > 1:
        small = bin_[-1]
        room = gap + small
        have = np.flatnonzero(left[: room + 1])
        if not len(have):
            break
        # for each first document the longest second one that fits with it
        at = np.searchsorted(have, room - have, side="right") - 1
        ok = at >= 0
        a, at = have[ok], at[ok]
        b = have[at]
        alone = (a == b) & (left[a] < 2)
        b = np.where(alone & (at > 0), have[at - 1], b)
        valid = ~(alone & (at == 0))
        a, b = a[valid], b[valid]
        if not len(a) or (a + b).max() <= small:
            break
        i = int(np.argmax(a + b))
        bin_.pop()
        left[small] += 1
        left[a[i]] -= 1
        left[b[i]] -= 1
        gap = room - int(a[i] + b[i])
        bin_ = sorted(bin_ + [int(a[i]), int(b[i])], reverse=True)
    return bin_


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(runs, sequences).  A run: length, first rank, pieces a sequence, first sequence, offset, repeats."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    used = np.zeros(capacity + 1, dtype=np.int64)
    runs, base = [], 0
    while left.any():
        lens, per = np.unique(_fill(left, capacity), return_counts=True)
        times = int((left[lens] // per).min())
        offset = 0
        for n, m in sorted(zip(lens.tolist(), per.tolist()), reverse=True):
            runs.append((n, int(used[n]), m, base, offset, times))
            used[n] += m * times
            left[n] -= m * times
            offset += n * m
        base += times
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 6), base


def _place(runs: np.ndarray):
    keys = runs[:, 0] * (1 << 44) + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            r = runs[np.searchsorted(keys, n * (1 << 44) + rank, side="right") - 1]
            k = rank - r[:, 1]
            cols = {c: b.column(c) for c in b.schema.names if c != "rank"}
            cols |= {"sequence_id": pa.array(r[:, 3] + k // r[:, 2]), "offset": pa.array(r[:, 4] + (k % r[:, 2]) * n)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of docs(doc_id, text) with the sequence and the offset of each."""
    pieces = write_table(token_pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    runs, _ = pack_lengths(counts, capacity)
    salts = 64 + sum(counts.values()) // 1_000_000
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("rank", within.cast("long") - 1).join(groups, ["length", "salt"])
    cols = [c for c in pieces.columns]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.select(*cols, (F.col("before") + F.col("rank")).alias("rank")).mapInArrow(_place(runs), schema)

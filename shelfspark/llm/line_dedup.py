"""Fuzzy line deduplication by MinHash.

A line is what stands between newlines.  Its set is its character shingles;
one-permutation hashing with densification gives the signature (one hash a
shingle), high-recall banding the candidates, the exact Jaccard similarity the
links, and distributed components the groups, of which the first line stays.

Band keys are packed: a batch sends each key once to the key's bucket, which
answers with the keys that two different lines hold.  Lines that share a key
within the batch are named at once and only one of them goes to the bucket, so
a key that a third of all lines hold adds one entry a batch.

Defined results.  Lines are numbered from 0 and identified by a 64-bit hash.
Lines without a character other than ASCII white space are no duplicates and stay.
Lines shorter than a shingle have one shingle, themselves.  First means: least
doc_id, nulls first, then a hash of the text, then the line number.  A null
text stays null.  Rows equal in doc_id and text are one document that is
listed more than once: each gets the same result.  Extra columns are kept as
they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import bits_for, by_texts, drop_table, mix, own_columns, quoted, row_key, runs, ship, spare, text_size, tidied, write_table
from shelfspark.llm.linking import link_components

SHINGLE = 8
WHITE = " \t\n\x0b\x0c\r"
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
BUCKET_KEYS = 1_000_000
SLICE = 1 << 20
EMPTY = np.uint32(2**32 - 1)
_A = 0x9E3779B97F4A7C15
_C = np.uint64(_A)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_A, n, 1 << 64))


def char_shingles(lines: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, line of each) of all shingles of these lines, n a power of two."""
    lens = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer(("".join(lines) + "\0" * n).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    h, step = codes, 1
    while step < n:
        h = h[:-step] * _power(step) + h[step:]
        step *= 2
    starts = np.cumsum(lens) - lens
    counts = np.maximum(lens - n + 1, 0)
    total = int(counts.sum())
    line = np.repeat(np.arange(len(lines)), counts)
    at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    got = mix(h[at])
    short = np.flatnonzero((lens > 0) & (lens < n))
    if len(short):
        own = np.fromiter((xxhash.xxh3_64_intdigest(lines[i].encode("utf-8", "surrogatepass")) for i in short), np.uint64, len(short))
        got, line = np.concatenate([got, own]), np.concatenate([line, short])
    return got, line


def signatures(lines: list[str], bins: int) -> np.ndarray:
    """One-permutation signatures, empty bins filled from the next full one."""
    got, line = char_shingles(lines)
    sig = np.full(len(lines) * bins, EMPTY)
    at = line * bins + (((got >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(sig, at, got.astype(np.uint32))
    sig = sig.reshape(len(lines), bins)
    full = sig != EMPTY
    sig = sig.astype(np.uint64)
    if not full.all():
        at = np.where(full, np.arange(bins), 2 * bins)
        at = np.concatenate([at, np.where(full, np.arange(bins) + bins, 2 * bins)], axis=1)
        at = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :bins]
        away = (at - np.arange(bins)).astype(np.uint64)
        sig = np.where(full, sig, mix(np.take_along_axis(sig, at % bins, axis=1) + away * _C))
    return sig


def line_bands(lines: list[str], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    s = signatures(lines, bands * rows).reshape(len(lines), bands, rows)
    h = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _C, (len(lines), 1))
    for j in range(rows):
        h = mix(h * _C + s[:, :, j])
    return h


def decode_lines(texts: list[bytes], _weights=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each line, sorted; each weighs 1."""
    elems, line = char_shingles([t.decode() for t in texts])
    order = np.lexsort((elems, line))
    elems, line = elems[order], line[order]
    new = np.append(True, (elems[1:] != elems[:-1]) | (line[1:] != line[:-1]))[: len(elems)]
    elems, line = elems[new], line[new]
    return elems, np.ones(len(elems)), np.bincount(line, minlength=len(texts))


def _pack(bits: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            keys, ids, seen = [], [], set()
            for b in by_texts([big], SLICE):
                new: dict[int, str] = {}
                for t in b.column("text").to_pylist():
                    for x in t.split("\n"):
                        if x.strip(WHITE):
                            new.setdefault(xxhash.xxh64_intdigest(x.encode(), 42), x)
                new = {i: x for i, x in new.items() if i not in seen}
                if new:
                    seen.update(new)
                    keys.append(line_bands(list(new.values()), bands, rows).ravel())
                    ids.append(np.repeat(np.fromiter(new, np.uint64, len(new)), bands))
            if not keys:
                continue
            k, i = np.concatenate(keys) >> np.uint64(24 - bits), np.concatenate(ids)
            order = np.argsort(k, kind="stable")
            k, i = k[order], i[order]
            same = np.append(False, k[1:] == k[:-1])
            first = ~same
            twice = same | np.append(same[1:], False)
            parts, salt = [], int(i[0] >> np.uint64(1)) % (1 << bits)
            if twice.any():  # named here; they pass through a bucket of their own
                parts.append((-1 - salt, k[twice], i[twice]))
            k, i = k[first], i[first]
            found, at = runs(k, 40)
            parts += [(p, k[x:y], i[x:y]) for p, x, y in zip(found.tolist(), at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _, _ in parts], pa.int32()), pa.array([x.astype("<u8").tobytes() if p < 0 else _low(x) for p, x, _ in parts], pa.binary()), pa.array([x.astype("<u8").tobytes() for _, _, x in parts], pa.binary())],
                ["bucket", "keys", "ids"],
            )

    return tidied(run)


def _low(keys: np.ndarray) -> bytes:
    """The low 40 bits of the keys, five bytes each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _shared(table: pa.Table) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    ids = np.concatenate([np.frombuffer(x, "<u8") for x in table.column("ids").to_pylist()])
    if bucket < 0:
        keys = np.concatenate([np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()])
    else:
        low = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("keys").to_pylist()]).reshape(-1, 5)
        wide = np.zeros((len(low), 8), dtype=np.uint8)
        wide[:, :5] = low
        keys = wide.view("<u8").ravel() | (np.uint64(bucket) << np.uint64(40))
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        twin = np.append(False, (keys[1:] == keys[:-1]) & (ids[1:] == ids[:-1]))
        keys, ids = keys[~twin], ids[~twin]
        same = np.append(False, keys[1:] == keys[:-1])
        keep = same | np.append(same[1:], False)
        keys, ids = keys[keep], ids[keep]
    return pa.table({"key": pa.array(keys.astype(np.int64)), "id": pa.array(ids.view(np.int64))})


def _lines(docs: DataFrame):
    """(doc_id, row, line_no, line, id) of each line that may be a duplicate."""
    rows = docs.where("text is not null").select("doc_id", row_key("doc_id", "text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("id", F.xxhash64("line"))


def line_groups(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, component) of lines that are linked, by their ids."""
    ship(docs.sparkSession)
    _, size = text_size(docs)
    bits = bits_for(size // 300 * bands, BUCKET_KEYS)
    packed = docs.select("text").where("text is not null").mapInArrow(_pack(bits, bands, rows), "bucket int, keys binary, ids binary")
    members = write_table(packed.groupBy("bucket").applyInArrow(_shared, "key long, id long").distinct(), "shared")
    texts = _lines(docs).select("id", F.col("line").cast("binary").alias("elems"))
    items = texts.join(members.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("elems").alias("elems"))
    items = write_table(items.withColumn("weights", F.lit(None).cast("binary")), "items")
    links, labels = link_components(members, items, threshold, decode_lines)
    for done in (members, items, links):
        drop_table(done)
    return labels


def duplicate_lines(docs: DataFrame, **options) -> DataFrame:
    """(row, removed): the sorted numbers of the lines to remove, for each row that has any."""
    labels = line_groups(docs, **options).withColumnRenamed("node", "id")
    lines = _lines(docs).select("id", F.struct(F.col("doc_id"), F.col("row"), F.col("line_no")).alias("at"))
    # one row for each distinct line, so that its instances meet no join before the last
    own = lines.groupBy("id").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
    own = write_table(own.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("group"), "at", "n"), "distinct")
    first = write_table(own.groupBy("group").agg(F.min("at").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n"), "first")
    # written tables on both sides: joins whose hot keys can be split
    named = write_table(own.join(first, "group").select("id", "first"), "named")
    drop_table(own)
    drop_table(first)
    later = lines.join(named, "id").where("at > first")
    return later.groupBy(F.col("at.row").alias("row")).agg(F.sort_array(F.collect_set("at.line_no")).alias("removed"))


def line_report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) of each row of docs."""
    gone = write_table(duplicate_lines(docs, **options), "removed")
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("row"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    rows = rows.withColumn("n_lines", F.greatest("n_lines", F.lit(0)))
    out = rows.join(gone, "row", "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup_lines(docs: DataFrame, drop_emptied: bool = False, **options) -> DataFrame:
    """docs with the duplicate lines gone from text; drop_emptied: rows that lose all their lines go."""
    gone = write_table(duplicate_lines(docs.select("doc_id", "text"), **options), "removed")
    row, removed, columns = spare(docs, "row"), spare(docs, "removed"), own_columns(docs)
    rows = docs.withColumn(row, row_key("doc_id", "text")).join(gone.toDF(row, removed), row, "left")
    lines = F.split("text", "\n", -1)
    # a flag for each line up to the last one that goes; r[j] - r[j - 1] - 1 lines before it stay
    r = F.col(quoted(removed))
    step = F.transform(r, lambda x, j: F.concat(F.array_repeat(F.lit(False), x - F.when(j > 0, r[F.greatest(j - 1, F.lit(0))]).otherwise(F.lit(-1)) - 1), F.array(F.lit(True))))
    kept = F.filter(F.zip_with(lines, F.flatten(step), lambda x, gone: F.when(F.coalesce(gone, F.lit(False)), F.lit(None)).otherwise(x)), lambda x: x.isNotNull())
    if drop_emptied:
        rows = rows.where(r.isNull() | (F.size(r) < F.size(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]")))))
    text = F.when(r.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return rows.withColumn("text", text).select(*columns)

"""Near-duplicate documents by consistent weighted sampling.

Texts become TF-IDF weighted sets of five-word shingles.  Improved consistent
weighted sampling (Ioffe, 2010) draws samples that two sets share with a
probability equal to their weighted Jaccard similarity; samples are banded,
bucket mates are verified by the exact weighted Jaccard similarity, and links
are closed to components.

Weight of a shingle: tf * (1 + strength * ln(N / df) / ln N) over all N
documents, copies included.  The inverse document frequency is damped: in a
group of thousands of near copies the shared shingles have a high df, and with
the raw ln(N / df) a copy with one changed word would fall under the threshold
for just that reason.

Document frequencies are looked up in chunks (see ``common``).  A text whose
shingles found in another text weigh less than threshold * total can't reach
the threshold with any partner (the common weight is at most that of the
shared shingles, the union at least the total), so only the others are
sampled; no pair is lost by that.

Defined results.  Words are runs of characters other than ASCII white space,
with A-Z lower-cased.  Texts with one to four words have one shingle, all
their words.  Equal texts, also empty ones, are one class.  A null text has no
partner.  A null doc_id names its class only where all others are null too.
Repeated rows get the same answer each.  Extra columns are ignored by
near_duplicates and kept as they are by drop_near_duplicates, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import CHUNK_BYTES, HASHES, RELAY, WIDE_BITS, Space, answered, asked, asked_schema, bits_for, drop_table, groups_for, lookup, mix, own_columns, ragged, row_key, ship, spare, text_size, tidied, tidy, write_table
from shelfspark.llm.linking import link_components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
IDF_STRENGTH = 0.25
BUCKET_KEYS = 2_000_000
_C = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, n: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the shingles of a text, one for each place."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    t = HASHES.of(words)
    k = min(n, len(words))
    h = np.zeros(len(t) - k + 1, dtype=np.uint64)
    for j in range(k):
        h = mix(h * _C + t[j : len(t) - k + 1 + j])
    return h


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Draws of r and ln c (Gamma(2, 1)) and beta (uniform); a hash picks one of each."""
    g = np.random.default_rng(20100901)
    r = g.gamma(2.0, 1.0, 65536)
    return r.astype(np.float64), np.log(g.gamma(2.0, 1.0, 65536)), g.random(65536)


_R, _LNC, _BETA = _tables()


def icws(elements: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """The consistent weighted samples of one weighted set, as 64-bit values."""
    out = np.empty(samples, dtype=np.uint64)
    logs = np.log(weights)
    for k in range(samples):
        h = mix(elements + np.uint64((k + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
        r = _R[h >> np.uint64(48)]
        beta = _BETA[(h >> np.uint64(32)) & np.uint64(0xFFFF)]
        t = np.floor(logs / r + beta)
        a = _LNC[(h >> np.uint64(16)) & np.uint64(0xFFFF)] - r * (t - beta) - r
        best = np.flatnonzero(a == a.min())
        i = best[np.argmin(elements[best])]
        out[k] = elements[i] ^ np.uint64(int(t[i]) & 0xFFFFFFFF)
    return out


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = samples.reshape(bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64) * _C
    for j in range(rows):
        h = mix(h * _C + s[:, j])
    return h.view(np.int64)


def expand(uniq: np.ndarray, tf: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One element for each occurrence, so that min(tf) becomes a set intersection; sorted."""
    if (tf > 1).any():
        e, w = np.repeat(uniq, tf), np.repeat(weights, tf)
        j = ragged(tf).astype(np.uint64)
        e = np.where(j > 0, mix(e + j * _C), e)
        order = np.argsort(e)
        return e[order], w[order]
    return uniq, weights


def _combine(n_chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[bytes, int] = {}
            for t in b.column("text").cast(pa.binary()).to_pylist():
                seen[t] = seen.get(t, 0) + 1
            ids = [xxhash.xxh64_intdigest(t, 42) for t in seen]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i % n_chunks for i in ids], pa.int64()),
                    pa.array([i - (i >> 63 << 64) for i in ids], pa.int64()),
                    pa.array(list(seen.values()), pa.int64()),
                    pa.array(list(seen), pa.binary()),
                ],
                ["chunk", "id", "n", "text"],
            )

    return tidied(run, "hashes")


def _chunk_sets(table: pa.Table) -> tuple[list[int], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Distinct texts of the chunk: ids, copies, and (shingle, tf) each."""
    n: dict[int, int] = {}
    texts: dict[int, bytes] = {}
    for i, c, t in zip(table.column("id").to_pylist(), table.column("n").to_pylist(), table.column("text").to_pylist()):
        n[i] = n.get(i, 0) + c
        texts.setdefault(i, t)
    ids = sorted(n)
    sets = [np.unique(shingles(texts[i]), return_counts=True) for i in ids]
    return ids, np.array([n[i] for i in ids], dtype=np.int64), sets


def _ask(space: Space):
    def run(table: pa.Table) -> pa.Table:
        _, copies, sets = _chunk_sets(table)
        keys = space.key(np.concatenate([s for s, _ in sets] or [np.empty(0, np.uint64)]))
        per = np.repeat(copies, [len(s) for s, _ in sets])
        uniq, inv, texts = np.unique(keys, return_inverse=True, return_counts=True)
        docs = np.bincount(inv, weights=per, minlength=len(uniq)).astype(np.int64)
        out = asked(table.column("chunk")[0].as_py(), [(0, space, uniq, [docs, texts])])
        tidy()
        return out

    return run


ITEMS = "id long, bands array<long>, elems binary, weights binary"


def _sample(space: Space, n_docs: int, threshold: float, bands: int, rows: int, strength: float):
    scale = strength / np.log(n_docs) if n_docs > 1 else 0.0

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = {"id": [], "bands": [], "elems": [], "weights": []}
        if docs.num_rows:
            ids, _, sets = _chunk_sets(docs)
            keys = space.key(np.concatenate([s for s, _ in sets] or [np.empty(0, np.uint64)]))
            uniq, inv = np.unique(keys, return_inverse=True)
            df, texts = answered(answers, 0, space, uniq, 2)
            shared = texts > 1
            idf = (1.0 + scale * np.log(n_docs / df))[inv]
            shared, end = shared[inv], 0
            for i, (s, tf) in zip(ids, sets):
                start, end = end, end + len(s)
                if not len(s):
                    continue
                w = idf[start:end] * tf
                if (w * shared[start:end]).sum() < (threshold - 1e-6) * w.sum():
                    continue
                e, ew = expand(s, tf, idf[start:end])
                out["id"].append(i)
                out["bands"].append(band_keys(icws(s, w, bands * rows), bands, rows).tolist())
                out["elems"].append(e.tobytes())
                out["weights"].append(ew.tobytes())
        tidy()
        return pa.table({"id": pa.array(out["id"], pa.int64()), "bands": pa.array(out["bands"], pa.list_(pa.int64())), "elems": pa.array(out["elems"], pa.binary()), "weights": pa.array(out["weights"], pa.binary())})

    return run


def sampled_texts(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, strength: float = IDF_STRENGTH, chunk_bytes: int = CHUNK_BYTES, wide: int = WIDE_BITS, relay: int = RELAY) -> DataFrame:
    """(id, bands, elems, weights) of each distinct text that can have a partner."""
    n, size = text_size(docs)
    space = Space(bits_for(size // 5, BUCKET_KEYS), wide=wide)
    texts = docs.select("text").where("text is not null").mapInArrow(_combine(groups_for(size, chunk_bytes)), "chunk long, id long, n long, text binary")
    asks = texts.groupBy("chunk").applyInArrow(_ask(space), asked_schema(2))
    answers, _ = lookup(asks, [space], 2, relay)
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_sample(space, max(n, 1), threshold, bands, rows, strength), ITEMS)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, strength: float = IDF_STRENGTH) -> DataFrame:
    """(doc_id, class_id, row, keep) of each row.

    class_id is the least doc_id of its class; keep is true for the row that
    stands for the class (and for rows equal to it).
    """
    ship(docs.sparkSession)
    own = docs.select("doc_id", F.xxhash64("text").alias("text_id"), F.col("text").isNotNull().alias("has_text"), row_key("doc_id", "text").alias("row"))
    items = write_table(sampled_texts(docs, threshold, bands, rows, strength), "items")
    members = items.select(F.explode("bands").alias("key"), "id")
    links, labels = link_components(members, items, threshold)
    drop_table(items)
    drop_table(links)
    lone = own.where(~F.col("has_text")).select("doc_id", F.col("doc_id").alias("class_id"), "row", F.lit(True).alias("keep"))
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))
    texts = own.where("has_text").groupBy("text_id").agg(F.min(at).alias("least"))
    texts = texts.join(labels.withColumnRenamed("node", "text_id"), "text_id", "left").select("text_id", F.coalesce("component", "text_id").alias("comp"), "least")
    first = texts.groupBy("comp").agg(F.min("least").alias("first"))
    named = texts.join(first, "comp").select("text_id", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("first_row"))
    found = own.where("has_text").join(named, "text_id")
    return found.select("doc_id", "class_id", "row", (F.col("row") == F.col("first_row")).alias("keep")).union(lone)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class: the one of the least doc_id; rows without text stay."""
    found = write_table(near_duplicates(docs.select("doc_id", "text"), **options), "classes")
    row, columns = spare(docs, "row"), own_columns(docs)
    gone = found.where("not keep").select(F.col("row").alias(row)).distinct()
    kept = docs.withColumn(row, row_key("doc_id", "text")).join(gone, row, "left_anti")
    again = write_table(found.where("keep").groupBy(F.col("row").alias(row)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(row), "again")
    if not again.take(1):  # no kept row is repeated
        return kept.select(*columns)
    rest = kept.join(again, row, "left_anti").union(kept.where("text is null").join(again, row, "left_semi"))
    return rest.union(kept.where("text is not null").join(again, row, "left_semi").dropDuplicates([row])).select(*columns)

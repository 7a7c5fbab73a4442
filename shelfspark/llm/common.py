"""Shared pieces: work tables, code shipping, packed arrays, chunked lookups.

Chunked lookup
--------------
Several operators need, for every document, corpus-wide numbers about the
document's own keys (n-gram counts, shingle document frequencies).  A row per
(document, key) would shuffle more bytes than the texts themselves.  Instead
documents are dealt into *chunks* of bounded bytes; a chunk sends each key
once to the key's *bucket*, packed with its neighbours in one binary value; the
bucket sums over chunks and answers in the order in which the chunk asked.
Both numbers of groups follow the input, so no group grows with it, and a key
that every document holds is sent once per chunk.

A chunk writes to at most 2**WIDE_BITS buckets, for with more of them the
values would hold a key each.  Where the corpus needs more, *relays* stand
between: a relay takes what RELAY chunks ask of one wide bucket, asks each key
once of the narrower buckets, and hands the answers back.  The answers are the
same with and without relays.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from shelfspark.sources.work import drop_table, ship, work_path, write_table  # noqa: F401  one place for the operators to import from

CHUNK_BYTES = 8 << 20
SPACE = r"[\x20\x09-\x0D]+"


def text_size(docs: DataFrame) -> tuple[int, int]:
    """(rows, bytes of text)."""
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


def groups_for(size: int, each: int) -> int:
    return max(1, math.ceil(size / each))


def bits_for(size: int, each: int) -> int:
    """Bits that number at least size/each buckets; a 64-bit key has room for 24 besides its own 40."""
    return min(24, max(0, math.ceil(math.log2(max(1.0, size / each)))))


def row_key(*cols: str) -> Column:
    """A 64-bit identity of a row; rows equal in these columns share it."""
    return F.xxhash64(*[F.col(c) for c in cols])


def settled(df: DataFrame) -> DataFrame:
    """df, or a work table of it if it comes out of a shuffle.

    A task that is tried again after a shuffle may meet its rows in another
    order; from files it meets them as before, so that what goes by a row's
    place is the same again.
    """
    return write_table(df, "settled") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def dealt(n_chunks: int) -> Column:
    """The chunk of a row of a ``settled`` frame: by doc_id, text and the row's place in its partition, so that repeated rows are dealt apart."""
    return F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(n_chunks))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names."""
    return [F.col(quoted(c)) for c in df.columns]


def spare(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_texts(docs: DataFrame, run: Callable, added: list[StructField] = []) -> DataFrame:  # noqa: B006
    """docs.mapInArrow(run) with the same columns and those added, whatever their names; run finds text by that name."""
    names = docs.columns
    plain = [c if c == "text" else f"c{i}" for i, c in enumerate(names)]
    fields = [StructField(n, f.dataType, f.nullable) for n, f in zip(plain, docs.schema.fields)]
    fields += [StructField(f"added{i}", f.dataType) for i, f in enumerate(added)]
    return docs.toDF(*plain).mapInArrow(run, StructType(fields)).toDF(*names, *[f.name for f in added])


def tidy() -> None:
    """Give the memory of a finished piece of work back to the system: the worker process stays for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: How to empty each cache that a worker process keeps between tasks.
CACHES: dict[str, Callable[[], None]] = {}


def keep_only(*names: str) -> None:
    """Empty the caches of other operators, which the process may have worked for before."""
    for name, clear in CACHES.items():
        if name not in names:
            clear()


def tidied(run: Callable, *caches: str) -> Callable:
    """A function of batches that uses these caches and tidies up after the last batch."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(*caches)
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


# -- packed arrays ---------------------------------------------------------


def pack_counts(values: np.ndarray) -> bytes:
    """Counts in one byte each; 255 and more follow as eight bytes."""
    v = np.asarray(values, dtype=np.int64)
    big = v >= 255
    return np.where(big, 255, v).astype(np.uint8).tobytes() + v[big].tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, dtype=np.uint8, count=n).astype(np.int64)
    big = out == 255
    if big.any():
        out[big] = np.frombuffer(data, dtype=np.int64, offset=n)
    return out


def pack_keys(keys: np.ndarray, width: int = 5) -> bytes:
    """The low 40 bits of each key in five bytes, 56 in seven, or all of it in eight."""
    if width > 5:
        return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + ((keys >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def unpack_keys(data: bytes, width: int = 5) -> np.ndarray:
    if width > 5:
        out = np.zeros((len(data) // width, 8), dtype=np.uint8)
        out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
        return out.view("<u8").ravel()
    n = len(data) // 5
    low = np.frombuffer(data, dtype=np.uint32, count=n).astype(np.uint64)
    return low | (np.frombuffer(data, dtype=np.uint8, offset=4 * n, count=n).astype(np.uint64) << np.uint64(32))


def runs(keys: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, bounds): the buckets that sorted keys have, without their low shift bits, and where each begins."""
    b = keys >> np.uint64(shift) if shift < 64 else np.zeros_like(keys)
    at = np.flatnonzero(np.append(True, b[1:] != b[:-1])[: len(b)])
    return b[at].astype(np.int64), np.append(at, len(keys))


# -- chunked lookup --------------------------------------------------------

WIDE_BITS = 12
RELAY = 2048


class Space(NamedTuple):
    """Keys of one kind: bits of the bucket, and bits below them that tell its keys apart; wide: bits that a chunk sees."""

    bits: int
    low: int = 40
    wide: int = WIDE_BITS

    def key(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits - self.low)


def word_space(bits: int, wide: int = WIDE_BITS) -> Space:
    """Keys hold 56 bits of the hash below the bucket's, as far as it has them: among two million words none are one."""
    return Space(bits, min(56, 64 - bits), wide)


def _layout(space: Space, level: int) -> tuple[int, int]:
    """(shift, width) of keys in buckets of so many bits."""
    return space.low + space.bits - level, (5 if space.low <= 40 else 7) if level == space.bits else 8


def asked_schema(n: int) -> str:
    return "space int, bucket int, chunk long, keys binary" + "".join(f", v{i} binary" for i in range(n))


def answer_schema(n: int) -> str:
    return "space int, bucket int, chunk long" + "".join(f", v{i} binary" for i in range(n))


def _asked(chunk: int, keys: list[tuple[int, Space, np.ndarray, list[np.ndarray]]], fine: bool) -> pa.Table:
    """A row for each bucket that these sorted distinct keys, with their values, have."""
    rows: list[tuple] = []
    n = len(keys[0][3])
    for no, space, k, values in keys:
        level = space.bits if fine else min(space.bits, space.wide)
        shift, width = _layout(space, level)
        found, at = runs(k, shift)
        for b, x, y in zip(found.tolist(), at[:-1].tolist(), at[1:].tolist()):
            rows.append((no, b, chunk, pack_keys(k[x:y], width), *[pack_counts(v[x:y]) for v in values]))
    cols = list(zip(*rows)) or [()] * (4 + n)
    types = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * (1 + n)
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=["space", "bucket", "chunk", "keys", *[f"v{i}" for i in range(n)]])


def asked(chunk: int, keys: list[tuple[int, Space, np.ndarray, list[np.ndarray]]]) -> pa.Table:
    """What a chunk asks: (number, space, sorted distinct keys, values to sum up) of each kind of keys."""
    return _asked(chunk, keys, fine=False)


def _summed(table: pa.Table, width: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct keys, index of each row's keys, keys of each row, sums of each value)."""
    keys = [unpack_keys(k, width) for k in table.column("keys").to_pylist()]
    lens = np.fromiter(map(len, keys), np.int64, len(keys))
    uniq, inv = np.unique(np.concatenate(keys), return_inverse=True)
    sums = []
    for i in range(n):
        own = np.concatenate([unpack_counts(c, m) for c, m in zip(table.column(f"v{i}").to_pylist(), lens.tolist())])
        sums.append(np.bincount(inv, weights=own, minlength=len(uniq)).astype(np.int64))
    return uniq, inv, lens, sums


def _handed_out(table: pa.Table, inv: np.ndarray, lens: np.ndarray, values: list[np.ndarray]) -> pa.Table:
    ends = np.cumsum(lens).tolist()
    cols = {c: table.column(c).combine_chunks() for c in ("space", "bucket", "chunk")}
    for i, v in enumerate(values):
        own = v[inv]
        cols[f"v{i}"] = pa.array([pack_counts(own[e - m : e]) for e, m in zip(ends, lens.tolist())], pa.binary())
    return pa.table(cols)


def _total(spaces: list[Space], n: int):
    def run(table: pa.Table) -> pa.Table:
        space = spaces[table.column("space")[0].as_py()]
        _, inv, lens, sums = _summed(table, _layout(space, space.bits)[1], n)
        return _handed_out(table, inv, lens, sums)

    return run


def sums(table: pa.Table, space: Space, n: int = 1) -> list[np.ndarray]:
    """The n sums of each key that was asked of a bucket."""
    return _summed(table, _layout(space, space.bits)[1], n)[3]


def _relay_up(spaces: list[Space], n: int):
    def run(table: pa.Table) -> pa.Table:
        no = table.column("space")[0].as_py()
        uniq, _, _, sums = _summed(table, 8, n)
        return _asked(table.column("relay")[0].as_py(), [(no, spaces[no], uniq, sums)], fine=True)

    return run


def _relay_down(spaces: list[Space], n: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.schema([("space", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), *[(f"v{i}", pa.binary()) for i in range(n)]]).empty_table()
        no = table.column("space")[0].as_py()
        uniq, inv, lens, _ = _summed(table, 8, 0)
        return _handed_out(table, inv, lens, answered(answers, no, spaces[no], uniq, n, fine=True))

    return run


def answered(table: pa.Table, no: int, space: Space, keys: np.ndarray, n: int, fine: bool = False) -> list[np.ndarray]:
    """The n values of these sorted distinct keys, from the answers to what was asked with them."""
    found, at = runs(keys, _layout(space, space.bits if fine else min(space.bits, space.wide))[0])
    place = dict(zip(found.tolist(), zip(at[:-1].tolist(), at[1:].tolist())))
    out = [np.zeros(len(keys), dtype=np.int64) for _ in range(n)]
    for row in zip(*[table.column(c).to_pylist() for c in ("space", "bucket", *[f"v{i}" for i in range(n)])]):
        if row[0] == no:
            x, y = place[row[1]]
            for v, data in zip(out, row[2:]):
                v[x:y] = unpack_counts(data, y - x)
    return out


def lookup(asks: DataFrame, spaces: list[Space], n: int, relay: int = RELAY) -> tuple[DataFrame, DataFrame]:
    """(answers, what the buckets are asked).

    Answers (space, bucket, chunk, v0, ...) are the sums over all chunks, in
    the order asked; the second frame has asks by the narrowest buckets.
    """
    direct = [no for no, s in enumerate(spaces) if s.bits <= s.wide]
    total = lambda df: df.groupBy("space", "bucket").applyInArrow(_total(spaces, n), answer_schema(n))
    if len(direct) == len(spaces):
        return total(asks), asks
    relayed = asks.where(~F.col("space").isin(direct)).withColumn("relay", F.floor(F.col("chunk") / relay))
    up = relayed.groupBy("space", "bucket", "relay").applyInArrow(_relay_up(spaces, n), asked_schema(n))
    extra = F.create_map(*[x for no, s in enumerate(spaces) for x in (F.lit(no), F.lit(1 << max(0, s.bits - s.wide)))])
    got = total(up).withColumn("wide", F.floor(F.col("bucket") / extra[F.col("space")]).cast("int"))
    down = relayed.groupBy("space", "bucket", "relay").cogroup(got.groupBy("space", "wide", "chunk")).applyInArrow(_relay_down(spaces, n), answer_schema(n))
    if not direct:
        return down, up
    near = asks.where(F.col("space").isin(direct))
    return total(near).union(down), near.union(up)


# -- hashing ---------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """Bytes to their 64-bit hash, kept up to a bound of entries."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


HASHES = Hashes()
CACHES["hashes"] = HASHES.clear


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the runs of these lengths."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths)


def by_texts(batches: Iterable[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes."""
    for b in batches:
        if not b.num_rows:
            continue
        per = max(1, int(b.num_rows * limit / max(limit, b.nbytes)))
        for i in range(0, b.num_rows, per):
            yield b.slice(i, per)


def union_find(n: int, pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (for a bounded block, inside one task)."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            forest.append((a, b))
    return forest

"""Token ids as length-delimited binary records, with an offset index.

File format, one file a shard, documents in ascending doc_id order:

    record: length of the data  (unsigned 64-bit, little-endian)
            masked CRC-32 of those eight bytes  (unsigned 32-bit)
            data: the ids, unsigned, little-endian, 16 bits each where the
                  vocabulary fits and 32 else
            masked CRC-32 of the data  (unsigned 32-bit)

The mask is ((crc >> 15 | crc << 17) + 0xA282EAD8) mod 2**32.  The index is a
separate Parquet table (doc_id, shard, file, offset, length, n_tokens,
shard_start), a row for each record, by which readers take records in any
order.  Files have names of their own for each attempt of a task, and only the
index rows of a finished attempt count; a lost executor leaves a file that
nothing points to.

Defined results.  A null text is empty: the end id alone.  doc_id must be a whole
number or its text; another one fails.  Null doc_ids come first.  Rows of one doc_id follow each other in the order of a hash of their
texts.  No rows: an index without rows and no files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import by_texts, groups_for, ship, text_size, tidied, work_path
from shelfspark.llm.tokenizer_cache import load, piece_ids

SHARD_BYTES = 24 << 20  # of text
INDEX = "doc_id long, shard int, file string, offset long, length long, n_tokens long, shard_start long"
HEAD, TAIL = 12, 4


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    n = len(data).to_bytes(8, "little")
    return n + masked(zlib.crc32(n)).to_bytes(4, "little") + data + masked(zlib.crc32(data)).to_bytes(4, "little")


def unframe(record: bytes, file: str = "") -> bytes:
    """The data of one whole record; a wrong length or checksum raises."""
    n = record[:8]
    data = record[HEAD:-TAIL]
    if int.from_bytes(n, "little") != len(data) or int.from_bytes(record[8:12], "little") != masked(zlib.crc32(n)):
        raise ValueError(f"bad length of a record in {file}")
    if int.from_bytes(record[-TAIL:], "little") != masked(zlib.crc32(data)):
        raise ValueError(f"bad checksum of a record in {file}")
    return data


def _filesystem(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def id_type(tokenizer: str, end_id: int) -> np.dtype:
    return np.dtype("<u2" if max(load(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1) <= 65536 else "<u4")


def _write(tokenizer: str, end_id: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = id_type(tokenizer, end_id)
        end = np.array([end_id], dtype=dtype).tobytes()
        shard = TaskContext.get().partitionId()
        fs, top = _filesystem(folder)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.bin"
        out, offset, start = None, 0, 0
        try:
            for b in by_texts(batches):
                if out is None:
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(f"{top}/{name}")
                data = [d + end for d in piece_ids(tokenizer, dtype).of(b.column("text").to_pylist())]
                framed = [frame(d) for d in data]
                out.write(b"".join(framed))
                lens, n = np.array([len(x) for x in framed], dtype=np.int64), np.array([len(d) // dtype.itemsize for d in data], dtype=np.int64)
                rows = len(lens)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([shard] * rows, pa.int32()), pa.array([name] * rows), pa.array(offset + np.cumsum(lens) - lens), pa.array(lens), pa.array(n), pa.array(start + np.cumsum(n) - n)],
                    ["doc_id", "shard", "file", "offset", "length", "n_tokens", "shard_start"],
                )
                offset, start = offset + int(lens.sum()), start + int(n.sum())
        finally:
            if out is not None:
                out.close()

    return tidied(run, "tokenizers", "pieces")


def write_records(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write docs(doc_id, text) as records; gives (folder, index)."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or work_path(spark, "records")
    _, size = text_size(docs)
    order = ["doc_id", "h"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange(groups_for(size, SHARD_BYTES), *order).sortWithinPartitions(*order)
    index = rows.select("doc_id", "text").mapInArrow(_write(tokenizer, end_id, f"{folder}/data"), INDEX)
    index.write.parquet(f"{folder}/index")
    return folder, spark.read.schema(INDEX).parquet(f"{folder}/index")


RECORDS = "doc_id long, shard int, shard_start long, n_tokens long, ids binary"


def _read(folder: str, width: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _filesystem(f"{folder}/data")
        name, file = None, None
        for b in batches:
            files, offsets, lens = b.column("file").to_pylist(), b.column("offset").to_pylist(), b.column("length").to_pylist()
            i = 0
            while i < len(files):
                j, end = i + 1, offsets[i] + lens[i]  # records side by side are read at once
                while j < len(files) and files[j] == files[i] and offsets[j] == end and end - offsets[i] < 4 << 20:
                    end += lens[j]
                    j += 1
                if files[i] != name:
                    name, file = files[i], fs.open_input_file(f"{top}/{files[i]}")
                data = file.read_at(end - offsets[i], offsets[i])
                parts = [unframe(data[o - offsets[i] : o - offsets[i] + n], name) for o, n in zip(offsets[i:j], lens[i:j])]
                keep = b.slice(i, j - i)
                counts = pa.array([len(p) // width for p in parts], pa.int64())
                own = [keep.column("doc_id"), keep.column("shard"), keep.column("shard_start"), counts]
                wide = [np.frombuffer(p, dtype=f"<u{width}").astype("<u4").tobytes() for p in parts]
                last = pa.array([zlib.crc32(w) for w in wide], pa.int64()) if digest else pa.array(wide, pa.binary())
                yield pa.RecordBatch.from_arrays([*own, last], ["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32" if digest else "ids"])
                i = j

    return run


def read_records(folder: str, index: DataFrame, tokenizer: str, end_id: int, digest: bool = False) -> DataFrame:
    """The records that index names, in any order, checked: ids (32-bit) or their CRC-32."""
    schema = RECORDS.replace("ids binary", "ids_crc32 long") if digest else RECORDS
    return index.mapInArrow(_read(folder, id_type(tokenizer, end_id).itemsize, digest), schema)


def starts(records: DataFrame, index: DataFrame) -> DataFrame:
    """records with start: the ids of all documents before each; a row a shard is summed up."""
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    return records.join(shards, "shard").withColumn("start", F.col("before") + F.col("shard_start")).drop("before")

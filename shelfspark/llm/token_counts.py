"""Token counts by distinct pre-token.

Each distinct pre-token of the corpus is counted once, in its bucket; the
count is joined to the pre-token frequencies of the documents, and the products
are summed.  No token id is made for a document.  Pre-tokens and counts travel
packed by chunk (see ``common``, relays included), so a pre-token that every
document holds crosses the network once a chunk.

Defined results.  A null text is empty: 0 bytes, 0 tokens.  A special string in
a text is one token, as the tokenizers library has it by default.  Repeated
rows and null ids give a row each; doc_id must be a whole number or its text.
JSON tokenizers are counted if they cut by GPT-2's pattern without a normalizer,
or at white space after one; others are refused.  For a sentencepiece model a pre-token is a
run of characters other than spaces, with one space before it; texts with
other white space or control characters, or spaces at an end or in a row, are
handed to the library as one pre-token, for its normalizer may change them.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import CACHES, CHUNK_BYTES, RELAY, WIDE_BITS, bits_for, dealt, groups_for, keep_only, pack_counts, settled, ship, text_size, tidy, unpack_counts
from shelfspark.llm.tokenizer_cache import load, tokenizer_path

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: For tokenizers that normalise texts first: nothing that a normalizer joins or cuts spans white space.
BY_SPACES = r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
LIMIT = 512
BUCKET_BYTES = 16 << 20


@lru_cache(maxsize=4)
def _tools(name: str):
    """(pre-tokens of a text, token counts of pre-tokens)."""
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        odd = regex.compile(r"[^\S ]|  |^ | $|\p{C}")
        cut = lambda t: [t] if odd.search(t) else ["▁" + w for w in t.split(" ")] if t else []
        strip = lambda p: p[1:] if p[:1] == "▁" and not odd.search(p) else p
        return cut, lambda ps: [len(x) for x in model.encode([strip(p) for p in ps], num_threads=1)]
    t = load(name)
    kind = json.loads(t.to_str())["pre_tokenizer"] or {}
    if t.normalizer is None:
        known = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
    else:
        known = bool(kind) and len(t.pre_tokenizer.pre_tokenize_str("a b\tc")) == 3
    if not known:
        raise ValueError(f"{name} cuts texts in a way that is not counted here: {kind.get('type')}")
    find = regex.compile(PATTERN if t.normalizer is None else BY_SPACES).findall
    special = [a.content for a in t.get_added_tokens_decoder().values()]
    at = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def cut(text: str) -> list[str]:
        if not text:
            return []
        if at is None or not at.search(text):
            return find(text)
        out, end = [], 0
        for m in at.finditer(text):
            out += find(text[end : m.start()])
            out.append(m[0])
            end = m.end()
        return out + find(text[end:])

    return cut, lambda ps: [len(e) for e in t.encode_batch_fast(ps, add_special_tokens=False)]


CACHES["token tools"] = _tools.cache_clear


def _frequencies(table: pa.Table, name: str) -> list[Counter]:
    cut, _ = _tools(name)
    return [Counter(cut(t)) if t else Counter() for t in table.column("text").to_pylist()]


def _bucket(token: bytes, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(token) >> (64 - bits) if bits else 0


def _ordered(uniq: Iterable[bytes], bits: int) -> dict[int, list[bytes]]:
    """Distinct pre-tokens by bucket, in a fixed order."""
    out: dict[int, list[bytes]] = {}
    for p in uniq:
        out.setdefault(_bucket(p, bits), []).append(p)
    for x in out.values():
        x.sort()
    return out


def _chunk_tokens(found: list[Counter], bits: int) -> dict[int, list[bytes]]:
    return _ordered((p.encode() for p in set().union(*found)), bits)


ASKED = "bucket int, chunk long, lens binary, n int, data binary"
ANSWERED = "bucket int, chunk long, counts binary"


def _asked(chunk: int, parts: dict[int, list[bytes]]) -> pa.Table:
    return pa.table(
        {
            "bucket": pa.array(list(parts), pa.int32()),
            "chunk": pa.array([chunk] * len(parts), pa.int64()),
            "lens": pa.array([pack_counts(np.array([len(p) for p in x])) for x in parts.values()], pa.binary()),
            "n": pa.array([len(x) for x in parts.values()], pa.int32()),
            "data": pa.array([b"".join(x) for x in parts.values()], pa.binary()),
        }
    )


def _read(table: pa.Table) -> list[list[bytes]]:
    """The pre-tokens of each row of what was asked."""
    out = []
    for lens, n, data in zip(table.column("lens").to_pylist(), table.column("n").to_pylist(), table.column("data").to_pylist()):
        ends = np.cumsum(unpack_counts(lens, n)).tolist()
        out.append([data[a:b] for a, b in zip([0] + ends, ends)])
    return out


def _handed_out(table: pa.Table, rows: list[list[bytes]], count: dict[bytes, int]) -> pa.Table:
    counts = [pack_counts(np.fromiter(map(count.__getitem__, x), np.int64, len(x))) for x in rows]
    return pa.table({"bucket": table.column("bucket").combine_chunks(), "chunk": table.column("chunk").combine_chunks(), "counts": pa.array(counts, pa.binary())})


def _known(answers: pa.Table, parts: dict[int, list[bytes]]) -> dict[bytes, int]:
    """The count of each pre-token that was asked for in these parts."""
    out: dict[bytes, int] = {}
    for b, c in zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist()):
        out.update(zip(parts[b], unpack_counts(c, len(parts[b])).tolist()))
    return out


def _ask(name: str, bits: int):
    def run(table: pa.Table) -> pa.Table:
        keep_only("token tools", "tokenizers")
        out = _asked(table.column("chunk")[0].as_py(), _chunk_tokens(_frequencies(table, name), bits))
        tidy()
        return out

    return run


def _answer(name: str):
    def run(table: pa.Table) -> pa.Table:
        keep_only("token tools", "tokenizers")
        rows = _read(table)
        uniq = list(set().union(*rows))
        count, known = _tools(name)[1], {}
        for i in range(0, len(uniq), 20_000):
            some = uniq[i : i + 20_000]
            known.update(zip(some, count([p.decode() for p in some])))
        out = _handed_out(table, rows, known)
        tidy()
        return out

    return run


def _relay_up(bits: int):
    """What the chunks of a relay ask of a wide bucket, each pre-token once, by narrower buckets."""

    def run(table: pa.Table) -> pa.Table:
        return _asked(table.column("relay")[0].as_py(), _ordered(set().union(*_read(table)), bits))

    return run


def _relay_down(bits: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = _read(table)
        return _handed_out(table, rows, _known(answers, _ordered(set().union(*rows), bits)))

    return run


def _lookup(asks: DataFrame, name: str, bits: int, wide: int, relay: int) -> DataFrame:
    """ANSWERED to all asks of min(bits, wide) bits; with relays where more bits are needed (see ``common``)."""
    count = lambda df: df.groupBy("bucket").applyInArrow(_answer(name), ANSWERED)
    if bits <= wide:
        return count(asks)
    relayed = asks.withColumn("relay", F.floor(F.col("chunk") / relay))
    got = count(relayed.groupBy("bucket", "relay").applyInArrow(_relay_up(bits), ASKED))
    got = got.withColumn("wide", F.floor(F.col("bucket") / (1 << (bits - wide))).cast("int"))
    return relayed.groupBy("bucket", "relay").cogroup(got.groupBy("wide", "chunk")).applyInArrow(_relay_down(bits), ANSWERED)


COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def _sum(name: str, bits: int, limit: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        found = _frequencies(docs, name)
        count = {p.decode(): n for p, n in _known(answers, _chunk_tokens(found, bits)).items()}
        n = [sum(f * count[p] for p, f in x.items()) for x in found]
        tidy()
        return pa.table(
            {
                "doc_id": docs.column("doc_id").combine_chunks(),
                "n_bytes": pa.array([len(t) if t else 0 for t in docs.column("text").cast(pa.binary()).to_pylist()], pa.int64()),
                "n_tokens": pa.array(n, pa.int64()),
                "over_limit": pa.array([x > limit for x in n], pa.bool_()),
            }
        )

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, chunk_bytes: int = 2 * CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, wide: int = WIDE_BITS, relay: int = RELAY) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs(doc_id, text)."""
    ship(docs.sparkSession)
    docs = settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    _, size = text_size(docs)
    bits = bits_for(size // 6, bucket_bytes)
    chunks = docs.select("doc_id", "text", dealt(groups_for(size, chunk_bytes)).alias("chunk"))
    asks = chunks.groupBy("chunk").applyInArrow(_ask(tokenizer, min(bits, wide)), ASKED)
    answers = _lookup(asks, tokenizer, bits, wide, relay)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_sum(tokenizer, min(bits, wide), limit), COUNTS)

"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage by k = error_rate * m
edits.  Cut into k + 1 pieces, at least one piece of any such passage is
intact; one Aho-Corasick pass over a document finds all intact pieces of all
items, and around each hit Myers' bit-parallel algorithm computes the least
edit distance between the item and any substring.  A document is only read, in
its own task: there is no shuffle.  The items are sent to the executors in
blocks of bounded size, one pass for each block.

Both sides are compared lower-cased, with each run of white space as one
space; spans refer to the text in that form.

Defined results.  Null and empty texts match nothing, and null or empty items
match nothing.  Items under min_chars characters are matched without edits.
Repeated rows and null ids are matched each; an item listed twice is found
twice.  The best place of an item in a document is the one of least distance,
the first of equal ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import CACHES, by_texts, groups_for, map_texts, ship, tidied

ERROR_RATE = 0.08
MIN_CHARS = 40
BLOCK_BYTES = 8 << 20

HITS = "doc_id long, item_id long, distance int, budget int, span_start long, span_end long"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(n: int, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS) -> int:
    return int(n * error_rate) if n >= min_chars else 0


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of near equal length, with their places."""
    n = len(item)
    at = [i * n // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:]) if b > a]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of pattern to any substring of text, end of the first such)."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    ones, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = ones, 0, m
    best, end = m, 0
    get = peq.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & ones)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j
        ph = ph << 1 & ones
        mh = mh << 1 & ones
        pv = mh | (~(xv | ph) & ones)
        mv = ph & xv
    return best, end


def locate(item: str, text: str, windows: list[tuple[int, int]], k: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the item's best place in these windows of the text."""
    best = None
    for a, b in windows:
        d, end = myers(item, text[a:b])
        if d <= k and (best is None or d < best[0]):
            best = (d, a, a + end)
    if best is None:
        return None
    d, a, end = best
    _, back = myers(item[::-1], text[max(0, end - len(item) - k) : end][::-1])
    return d, end - back, end


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple], error_rate: float, min_chars: int):
        import ahocorasick

        self.items = [(i, normal(t)) for i, t in items if t and t.strip()]
        self.k = [budget(len(t), error_rate, min_chars) for _, t in self.items]
        found: dict[str, list[tuple[int, int]]] = {}
        for j, ((_, t), k) in enumerate(zip(self.items, self.k)):
            for a, p in pieces(t, k):
                found.setdefault(p, []).append((j, a))
        self.automaton = None
        if found:
            self.automaton = ahocorasick.Automaton()
            for p, at in found.items():
                self.automaton.add_word(p, (len(p), at))
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> list[tuple]:
        """(item_id, distance, budget, start, end) of the items in a text."""
        if not text or self.automaton is None:
            return []
        t = normal(text)
        windows: dict[int, list[list[int]]] = {}
        for e, (n, at) in self.automaton.iter(t):
            for j, a in at:
                start = e + 1 - n - a
                lo, hi = max(0, start - self.k[j]), min(len(t), start + len(self.items[j][1]) + self.k[j])
                w = windows.setdefault(j, [])
                # the places of one passage differ by few characters: one window covers them
                if w and abs(lo - w[-1][0]) <= 2 * self.k[j]:
                    w[-1] = [min(lo, w[-1][0]), max(hi, w[-1][1])]
                else:
                    w.append([lo, hi])
        out = []
        for j, w in windows.items():
            got = locate(self.items[j][1], t, sorted(map(tuple, w)), self.k[j])
            if got:
                out.append((self.items[j][0], got[0], self.k[j], got[1], got[2]))
        return out


_matchers: dict[str, Matcher] = {}
CACHES["matchers"] = _matchers.clear


def _matcher(key: str, block, error_rate: float, min_chars: int) -> Matcher:
    """One automaton for each Python worker and block."""
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(block.value, error_rate, min_chars)
    return _matchers[key]


def _blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items in broadcast blocks of about block_bytes."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    n = groups_for(int(size), block_bytes)
    for i in range(n):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
        rows = sorted(((r[0], r[1]) for r in some.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        yield uuid.uuid4().hex, spark.sparkContext.broadcast(rows)


def contamination(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each document and item found in it."""
    ship(docs.sparkSession)
    rows, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for key, block in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], key=key, block=block) -> Iterator[pa.RecordBatch]:
            m = _matcher(key, block, error_rate, min_chars)
            for b in by_texts(batches):
                got = [(d, *h) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for h in m.hits(t)]
                cols = list(zip(*got)) or [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "distance", "budget", "span_start", "span_end"])

        part = rows.mapInArrow(tidied(run, "matchers"), HITS)
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of docs, all columns, in which no item is found."""
    ship(docs.sparkSession)
    for key, block in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], key=key, block=block) -> Iterator[pa.RecordBatch]:
            m = _matcher(key, block, error_rate, min_chars)
            for b in by_texts(batches):
                yield b.filter(pa.array([not m.hits(t) for t in b.column("text").to_pylist()], pa.bool_()))

        docs = map_texts(docs, tidied(run, "matchers"))
    return docs

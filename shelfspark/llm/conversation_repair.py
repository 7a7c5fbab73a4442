"""Conversation structure repair by dynamic programming over a shared trie.

A conversation's rows, in order of turn, become a *signature*: one symbol a
row, for its role and its fault.  The cheapest edits that give role initials
``(s?(ua)+)?`` depend on the signature alone, so distinct signatures are solved
once: sorted by range, a task walks those of its range as the paths of a
prefix trie, keeps the layer of each prefix on a stack, computes a layer once
for all signatures that begin alike, and reads the answer at terminal nodes.

A layer has, for each of the four states of the role automaton, the least
cost, the edits that lead there and the order of their audits.  Up to its last
row's edit every audit has as many letters that are not I, so none begins
another, and the order of prefixes decides ties; layers are equal up to a
constant for a few dozen shapes, whose steps are remembered.

Long conversations.  Light rows (no text) are sorted by range of (conv_id,
turn, role, digest), which splits a conversation of any length over tasks.  A
conversation that may go on in another task, or has more than SEGMENT rows, is
cut into segments; each is solved for all four states before it, and a fold
over segments puts them together.  Texts are moved once, for the result.
SHA-256 of a whole conversation is sequential, so that ``repaired_digest``
streams a conversation through one task, in bounded memory but for its audit.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (required where blank or
duplicate), Insert an empty user or assistant row 5; a truncated row that stays
adds 5.  Of the cheapest audits the ASCII-least is taken; it determines all
roles.

Defined results.  Nulls in role and text count as one space, so does an empty
role for the role initials.  A null conv_id is a conversation of its own; null
turns come first.  Rows of one turn are ordered by role and by the MD5 of their
text, equal rows stand together.  A conversation of which no row is left has
zeros, an empty audit and the hash of the empty string.  No rows: no rows.
Other columns are ignored.  A conversation has at most 2**31 edits, for its
audit is one string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shelfspark.llm.common import drop_table, ship, tidied, write_table

SEGMENT = 4096
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

# states: 0 nothing yet, 1 system, 2 user, 3 assistant
_USER, _ASSISTANT = {0: 2, 1: 2, 3: 2}, {2: 3}
_KEEP = {"s": {0: 1}, "u": _USER, "a": _ASSISTANT, "o": {}}
_NEXT = _USER | _ASSISTANT  # of an inserted row
_FITS = ("su", "ua", "au")
_INFINITE = 1 << 60

Layer = tuple[tuple[int, int], ...]  # of each state: cost over the least, place in the order of audits
START: Layer = ((0, 0), (_INFINITE, 0), (_INFINITE, 0), (_INFINITE, 0))


def entry(state: int) -> Layer:
    return tuple((0 if t == state else _INFINITE, 0) for t in range(4))


def _edits(symbol: str) -> list[tuple[str, int, dict[int, int]]]:
    """(letter, cost, transitions): symbol is a role's initial, in upper case if truncated, or x for a row that must go."""
    stay = ("D", DELETE, {t: t for t in range(4)})
    if symbol == "x":
        return [stay]
    extra = TRUNCATED if symbol.isupper() else 0
    return [("K", extra, _KEEP[symbol.lower()]), ("R", REROLE + extra, _NEXT), stay]


_steps: dict[tuple[Layer, str], tuple[Layer, int, tuple]] = {}


def step(layer: Layer, symbol: str) -> tuple[Layer, int, tuple]:
    """(next layer, what its costs are over, of each state (state before, letters))."""
    known = _steps.get((layer, symbol))
    if known:
        return known
    best: list[tuple | None] = [None] * 4
    for p, (cost, order) in enumerate(layer):
        if cost >= _INFINITE:
            continue
        at, paid, letters = p, cost, ""
        for _ in range(3):
            for letter, price, to in _edits(symbol):
                t = to.get(at)
                if t is not None:
                    found = (paid + price, order, letters + letter, p)
                    if best[t] is None or found < best[t]:
                        best[t] = found
            at, paid, letters = _NEXT[at], paid + INSERT, letters + "I"
    out = _ranked(best)
    if len(_steps) > 100_000:
        _steps.clear()
    _steps[layer, symbol] = out
    return out


def _ranked(best: list[tuple | None]) -> tuple[Layer, int, tuple]:
    """Layer, least cost and ways back from (cost, order of the prefix, letters, state before) of each state."""
    least = min(b[0] for b in best if b)
    order = {b[1:3]: i for i, b in enumerate(sorted((b for b in best if b), key=lambda b: b[1:3]))}
    layer = tuple((b[0] - least, order[b[1:3]]) if b else (_INFINITE, 0) for b in best)
    return layer, least, tuple((b[3], b[2]) if b else None for b in best)


def last(layer: Layer) -> tuple[int, int, str]:
    """(cost, state, letters to add): the best end."""
    found = []
    for p, (cost, order) in enumerate(layer):
        if cost < _INFINITE:
            at, k = p, 0
            while at not in (0, 3):
                at, k = _NEXT[at], k + 1
            found.append((cost + INSERT * k, order, "I" * k, p))
    cost, _, letters, p = min(found)
    return cost, p, letters


def solve_sorted(keys: Iterator[str]) -> Iterator[tuple[str, list[int | None], list[str | None]]]:
    """(key, cost and audit of each state after it) of sorted keys: the state before a signature, then the signature.

    The stack is the path from the trie's root to the current node.
    """
    path, stack = "", []  # a node: (layer, cost up to it, ways back)
    for key in keys:
        same = 0
        while same < min(len(path), len(key)) and path[same] == key[same]:
            same += 1
        del stack[same:]
        for symbol in key[same:]:
            if not stack:
                stack.append((entry(int(symbol)), 0, None))
            else:
                layer, over, back = step(stack[-1][0], symbol)
                stack.append((layer, stack[-1][1] + over, back))
        path = key
        costs, audits = [], []
        for t, (cost, _) in enumerate(stack[-1][0]):
            if cost >= _INFINITE:
                costs.append(None)
                audits.append(None)
                continue
            letters, at = [], t
            for node in reversed(stack[1:]):
                at, some = node[2][at]
                letters.append(some)
            costs.append(stack[-1][1] + cost)
            audits.append("".join(reversed(letters)))
        yield key, costs, audits


# -- rows to signatures ------------------------------------------------------

_KEYS = ("turn", "role", "digest")
_WHITE = " \t\n\x0b\x0c\r"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows damaged by crc32 of ``conv_id:turn``; n is how often a row stands there, 0 if it is dropped."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    d = F.crc32(key) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(d == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(d == 1, "").when(d == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(d == 0, 0).when(d == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, fault) of rows(conv_id, turn, role, text, n): equal rows once, n times; fault is blank, duplicate, truncated or null.

    Of a row that stands n times the first has this fault and the others are
    duplicates, or all are blank.
    """
    bare = F.btrim("text", F.lit(_WHITE))
    light = rows.select(
        "conv_id", "turn", "role", "n", F.unhex(F.md5("text")).alias("digest"), (F.length(bare) == 0).alias("empty"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut")
    )
    light = light.groupBy("conv_id", *_KEYS, "empty", "cut").agg(F.sum("n").alias("n"))
    firsts = light.where("n > 0 and not empty").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("turns"))
    again = firsts.where("turns > 1")
    met = light.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    seen = F.col("first").isNotNull() & ~F.struct("turn").eqNullSafe(F.col("first"))
    return met.select("conv_id", *_KEYS, "n", F.when(F.col("empty"), "blank").when(seen, "duplicate").when(F.col("cut"), "truncated").alias("fault"))


_SUMMED = ("blank", "duplicate", "truncated", "illegal", "turns")
_SEGMENTS = "part int, no long, open boolean, signature string, first string, final string, low long, high long, " + ", ".join(f"{c} long" for c in _SUMMED)


class _Segment:
    """Symbols and statistics of successive rows of a conversation."""

    def __init__(self, conv, no: int):
        self.conv, self.no, self.symbols, self.first, self.final = conv, no, [], None, None
        self.low = self.high = None
        self.sums = dict.fromkeys(_SUMMED, 0)

    def add(self, turn: int | None, initial: str, fault: str | None) -> None:
        self.symbols.append("x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
        if fault:
            self.sums[fault] += 1
        if self.final is None:
            self.first = initial
        elif self.final + initial not in _FITS:
            self.sums["illegal"] += 1
        self.final = initial
        if turn is not None and turn != self.high:  # turns come sorted
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.sums["turns"] += 1

    def row(self, part: int, is_open: bool) -> tuple:
        return (self.conv, part, self.no, is_open, "".join(self.symbols), self.first, self.final, self.low, self.high, *self.sums.values())


def _segmented(conv_type: pa.DataType, size: int):
    names = [x.split()[0] for x in ("conv_id _, " + _SEGMENTS).split(", ")]
    types = [conv_type, pa.int32(), pa.int64(), pa.bool_()] + [pa.string()] * 3 + [pa.int64()] * (2 + len(_SUMMED))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now, n_convs, out = None, 0, []
        for b in batches:
            for conv, turn, role, n, fault in zip(*[b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "n", "fault")]):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.row(part, n_convs == 1 or now.no > 0))
                    now, n_convs = _Segment(conv, 0), n_convs + 1
                initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
                for copy in range(n):
                    if len(now.symbols) == size:
                        out.append(now.row(part, True))
                        now = _Segment(conv, now.no + 1)
                    now.add(turn, initial, fault if not copy or fault == "blank" else "duplicate")
                    if len(out) >= 1000:
                        yield batch(out)
                        out = []
        if now is not None:
            out.append(now.row(part, True))
        if out:
            yield batch(out)

    return tidied(run)


def segments(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Signatures and statistics: one row a conversation, or more (open) where it spans tasks or is long; ordered by part and no."""
    df = faults(rows).repartitionByRange("conv_id", *_KEYS).sortWithinPartitions("conv_id", *_KEYS)
    kind = df.schema["conv_id"].dataType
    schema = StructType([StructField("conv_id", kind), *StructType.fromDDL(_SEGMENTS).fields])
    from pyspark.sql.pandas.types import to_arrow_type

    return df.mapInArrow(_segmented(to_arrow_type(kind), size), schema)


# -- answers and their fold --------------------------------------------------


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = (k for b in batches for k in b.column("key").to_pylist())
    out, held = [], 0
    for row in solve_sorted(keys):
        out.append(row)
        held += len(row[0])
        if held > 1 << 20:
            yield _answer_batch(out)
            out, held = [], 0
    if out:
        yield _answer_batch(out)


def _answer_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["key", "costs", "audits"])


def solve(keys: DataFrame) -> DataFrame:
    """(key, costs, audits) of distinct keys; tasks hold ranges of the sorted keys, each the paths of a trie."""
    ranges = keys.distinct().repartitionByRange("key").sortWithinPartitions("key")
    return ranges.mapInArrow(tidied(_solved), "key string, costs array<bigint>, audits array<string>")


class _Fold:
    """The segments of one conversation, in order."""

    def __init__(self, conv):
        self.conv, self.layer, self.cost, self.ways = conv, START, 0, [()] * 4  # ways: (ways of the segment before, audit) of each state
        self.at, self.found = None, {}
        self.sums, self.final, self.low, self.high = dict.fromkeys(_SUMMED, 0), None, None, None

    def add(self, r: dict) -> None:
        if (r["part"], r["no"]) != self.at:
            self.close()
            self.at = (r["part"], r["no"])
            for c in _SUMMED:
                self.sums[c] += r[c]
            if r["first"] is not None:
                if self.final is not None and self.final + r["first"] not in _FITS:
                    self.sums["illegal"] += 1
                self.final = r["final"]
            if r["low"] is not None:
                if self.high == r["low"]:
                    self.sums["turns"] -= 1
                self.low = r["low"] if self.low is None else self.low
                self.high = r["high"]
        self.found[int(r["key"][0])] = (r["costs"], r["audits"])

    def close(self) -> None:
        """Carry the states over the segment that has been read."""
        if not self.found:
            return
        best: list[tuple | None] = [None] * 4
        for p, (costs, audits) in self.found.items():
            cost, order = self.layer[p]
            if cost < _INFINITE:
                for t in range(4):
                    if costs[t] is not None and (best[t] is None or (cost + costs[t], order, audits[t], p) < best[t]):
                        best[t] = (cost + costs[t], order, audits[t], p)
        self.layer, over, back = _ranked(best)
        self.cost += over
        self.ways = [(self.ways[b[0]], b[1]) if b else () for b in back]
        self.found = {}

    def row(self) -> tuple:
        self.close()
        cost, state, letters = last(self.layer)
        audit, way = [letters], self.ways[state]
        while way:
            audit.append(way[1])
            way = way[0]
        s = self.sums
        gaps = 0 if self.low is None else self.high - self.low + 1 - s["turns"]
        return (self.conv, gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], self.cost + cost, "".join(reversed(audit)))


def _folded(conv_type: pa.DataType):
    types = [conv_type] + [pa.int64()] * len(STATS) + [pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            out = []
            for r in (r for i in range(0, b.num_rows, 500) for r in b.slice(i, 500).to_pylist()):
                if now is None or r["conv_id"] != now.conv:
                    if now is not None:
                        out.append(now.row())
                    now = _Fold(r["conv_id"])
                now.add(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["conv_id", *STATS, "audit"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(now.row(), types)], ["conv_id", *STATS, "audit"])

    return tidied(run)


def audits(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of rows(conv_id, turn, role, text, n)."""
    ship(rows.sparkSession)
    parts = write_table(segments(rows, size), "segments")
    before = F.when(F.col("open"), F.array(*[F.lit(str(t)) for t in range(4)])).otherwise(F.array(F.lit("0")))
    asked = parts.select("*", F.explode(before).alias("before")).withColumn("key", F.concat("before", "signature")).drop("before", "signature")
    told = asked.join(solve(asked.select("key")), "key")
    kind = rows.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = StructType([StructField("conv_id", kind), *[StructField(c, LongType()) for c in STATS], StructField("audit", StringType())])
    lined = told.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no", "key")
    out = write_table(lined.mapInArrow(_folded(to_arrow_type(kind)), schema), "audits")
    drop_table(parts)
    return out


# -- applying the edits ------------------------------------------------------


class _Repair:
    """Walks an audit: roles follow from the state."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._next(), "", "I"

    def _next(self) -> str:
        self.state = _NEXT[self.state]
        return "user" if self.state == 2 else "assistant"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(role, text, edit) of the rows inserted before this one and of it, if it stays."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _KEEP[role[0]][self.state]
            yield role, text, edit
        elif edit == "R":
            yield self._next(), text, edit


def _lined(rows: DataFrame, found: DataFrame) -> DataFrame:
    """A conversation's head, with what was found, then its rows in order, in one task."""
    digest = F.unhex(F.md5("text"))
    texts = rows.where("n > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", digest.alias("digest"), "text", "n")
    heads = found.withColumn("kind", F.lit(0))
    return heads.unionByName(texts, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_KEYS)


def _digested(conv_type: pa.DataType):
    names = ["conv_id", *STATS, "audit", "repaired_sha256"]
    types = [conv_type] + [pa.int64()] * len(STATS) + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, walk, h, some = None, None, None, False

        def put(rows: Iterator[tuple[str, str, str]]) -> None:
            nonlocal some
            for role, text, _ in rows:
                h.update((("\n" if some else "") + role + ":" + text).encode())
                some = True

        def done() -> tuple:
            put(walk.inserted())
            return (*head, h.hexdigest())

        for b in batches:
            out = []
            cols = [b.column(c).to_pylist() for c in ("kind", "role", "text", "n")]
            heads = [b.column(c).to_pylist() for c in ("conv_id", *STATS, "audit")]
            for i, (kind, role, text, n) in enumerate(zip(*cols)):
                if not kind:
                    if head is not None:
                        out.append(done())
                    head, some = tuple(c[i] for c in heads), False
                    walk, h = _Repair(head[-1]), hashlib.sha256()
                else:
                    for _ in range(n):
                        put(walk.row(role, text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if head is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(done(), types)], names)

    return tidied(run)


def repaired_digest(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found, with the SHA-256 of each repaired conversation (``role:text`` of its rows, joined by newlines)."""
    from pyspark.sql.pandas.types import to_arrow_type

    schema = StructType([*found.schema.fields, StructField("repaired_sha256", StringType())])
    return _lined(rows, found).mapInArrow(_digested(to_arrow_type(found.schema["conv_id"].dataType)), schema)


def _repaired(conv_type: pa.DataType):
    names = ["conv_id", "place", "role", "text", "edit"]
    types = [conv_type, pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, walk, place = None, None, 0
        for b in batches:
            out = []

            def put(rows: Iterator[tuple[str, str, str]]) -> None:
                nonlocal place
                for row in rows:
                    out.append((conv, place, *row))  # noqa: B023
                    place += 1

            for own, kind, role, text, n, audit in zip(*[b.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "n", "audit")]):
                if not kind:
                    if walk is not None:
                        put(walk.inserted())
                    conv, walk, place = own, _Repair(audit), 0
                else:
                    for _ in range(n):
                        put(walk.row(role, text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if walk is not None and (rest := list(walk.inserted())):
            cols = zip(*[(conv, place + i, *r) for i, r in enumerate(rest)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return tidied(run)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the repaired conversations, edit is K, R or I."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = found.schema["conv_id"].dataType
    schema = StructType([StructField("conv_id", kind), *StructType.fromDDL("place long, role string, text string, edit string").fields])
    return _lined(rows, found).mapInArrow(_repaired(to_arrow_type(kind)), schema)


def repair(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Statistics, audit and digest of each conversation of rows(conv_id, turn, role, text, n)."""
    return repaired_digest(rows, audits(rows, size))

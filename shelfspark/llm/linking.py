"""From shared band keys to verified links and components, without all pairs.

Members of a band bucket are first compared with one representative, the
member that shares most buckets (in a group of near copies: the original).
That star is linear in the bucket.  Only where a bucket still spans several
components are its other members compared with those outside the largest one,
in blocks of bounded size dealt over the cluster; a block returns a spanning
forest of its links, never its pairs.  Every pair of a bucket is so either
compared, or already in one component: no component is lost.

Where more than OUTSIDE members are outside the largest component (lines from
one template, say, that are not near each other), the bucket is first split by
prefixes.  In any fixed order of elements, two sets whose similarity reaches
the threshold t share an element among the leading ones that weigh just over
1 - t of each set; with the elements that a sample of the bucket shares most at
the end of the order, strangers share none there.  Members are then compared
only within (bucket, prefix element).  The order is chosen by a sample; that no
pair is lost does not depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import drop_table, mix, tidied, union_find, write_table
from shelfspark.operators.components import connected_components

BLOCK = 512
EPS = 1e-9
OUTSIDE = 2048
SAMPLE = 256
LISTED = 1 << 16
FEW_PAIRS = 64


#: Edges that one task joins up at most.
EDGE_BLOCK = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each component of this block as a star around its least node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
            p, q = root(parent.setdefault(x, x)), root(parent.setdefault(y, y))
            if p != q:
                parent[max(p, q)] = min(p, q)
    rows = [(x, r) for x in parent if (r := root(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], ["a", "b"])


def linked_components(links: DataFrame, edge_block: int = EDGE_BLOCK) -> DataFrame:
    """(node, component) of links(a, b).

    Blocks of bounded size are joined up in a task each; the blocks' stars,
    fewer edges than links, go through the distributed rounds.
    """
    blocks = -(-links.count() // edge_block) or 1
    stars = write_table(links.select("a", "b").repartition(blocks).mapInArrow(_forest, "a long, b long"), "stars")
    out = connected_components(stars)
    drop_table(stars)
    return out


def decode(elems: list[bytes], weights: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements, weights, elements of each set) of packed sets, each sorted."""
    sets = [np.frombuffer(e or b"", dtype=np.uint64) for e in elems]
    w = [np.frombuffer(x, dtype=np.float64) if x is not None else np.ones(len(e)) for e, x in zip(sets, weights)]
    lens = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate([*sets, np.empty(0, np.uint64)]), np.concatenate([*w, np.empty(0)]), lens


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two sorted element arrays; an element weighs the same in both."""
    (ea, wa), (eb, wb) = a, b
    if not len(ea) or not len(eb):
        return 0.0
    at = np.searchsorted(eb, ea)
    at[at == len(eb)] = len(eb) - 1
    common = wa[eb[at] == ea].sum()
    return float(common / (wa.sum() + wb.sum() - common))


def block_links(elems: np.ndarray, weights: np.ndarray, lens: np.ndarray, n_left: int, threshold: float) -> np.ndarray:
    """Index pairs (left, right) at or above the threshold; the first n_left sets are the left ones."""
    n = len(lens)
    if not lens.sum() or n_left == n:
        return np.empty((0, 2), dtype=np.int64)
    rows = np.repeat(np.arange(n), lens)
    uniq, first, inv, counts = np.unique(elems, return_index=True, return_inverse=True, return_counts=True)
    w = weights[first]
    shared = np.flatnonzero(counts > 1)  # only these can be common to two sets
    new = np.full(len(uniq), -1)
    new[shared] = np.arange(len(shared))
    col = new[inv]
    keep = col >= 0
    total = np.bincount(rows, weights=weights, minlength=n)
    rows, col, w = rows[keep], col[keep], w[shared]
    common = np.zeros((n_left, n - n_left))
    order = np.argsort(col, kind="stable")
    rows, col = rows[order], col[order]
    for lo in range(0, len(shared), 2048):
        hi = min(lo + 2048, len(shared))
        a, b = np.searchsorted(col, [lo, hi])
        m = np.zeros((n, hi - lo))
        m[rows[a:b], col[a:b] - lo] = 1.0
        common += (m[:n_left] * w[lo:hi]) @ m[n_left:].T
    sim = common / (total[:n_left, None] + total[None, n_left:] - common + 1e-300)
    return np.argwhere(sim >= threshold - EPS)


def _verify(threshold: float, decode):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 2000):
                b = big.slice(i, 2000)
                left, right = b.column("a").to_pylist(), b.column("b").to_pylist()
                packed = dict(zip(left, zip(b.column("ea").to_pylist(), b.column("wa").to_pylist())))
                packed.update(zip(right, zip(b.column("eb").to_pylist(), b.column("wb").to_pylist())))
                elems, weights, lens = decode([x for x, _ in packed.values()], [x for _, x in packed.values()])
                ends = np.cumsum(lens).tolist()
                at = {k: slice(e - n, e) for k, e, n in zip(packed, ends, lens.tolist())}
                own = lambda k: (elems[at[k]], weights[at[k]])  # noqa: E731, B023
                out = [(x, y) for x, y in zip(left, right) if similarity(own(x), own(y)) >= threshold - EPS]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return tidied(run)


def verified_pairs(pairs: DataFrame, items: DataFrame, threshold: float, decode=decode) -> DataFrame:
    """The pairs (a, b) whose items are similar enough."""
    left = items.select(F.col("id").alias("a"), F.col("elems").alias("ea"), F.col("weights").alias("wa"))
    right = items.select(F.col("id").alias("b"), F.col("elems").alias("eb"), F.col("weights").alias("wb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(_verify(threshold, decode), "a long, b long")


def _common(decode):
    """The elements that several of these sampled members of a bucket hold, the most frequent last."""

    def run(table: pa.Table) -> pa.Table:
        elems, _, _ = decode(table.column("elems").to_pylist(), table.column("weights").to_pylist())
        found, n = np.unique(elems, return_counts=True)
        found, n = found[n > 1], n[n > 1]
        found = found[np.argsort(n, kind="stable")][-LISTED:]
        return pa.table({"key": pa.array([table.column("key")[0].as_py()], pa.int64()), "common": pa.array([found.tobytes()], pa.binary())})

    return run


def prefix_of(elems: np.ndarray, weights: np.ndarray, lens: np.ndarray, common: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(elements, set of each) of the prefixes: those in common come last, in its order."""
    owner = np.repeat(np.arange(len(lens)), lens)
    rank = np.zeros(len(elems), dtype=np.int64)
    if len(common):
        by = np.argsort(common)
        listed = common[by]
        at = np.minimum(np.searchsorted(listed, elems), len(listed) - 1)
        hit = listed[at] == elems
        rank[hit] = by[at[hit]] + 1
    order = np.lexsort((elems, rank, owner))
    w = weights[order]
    before = np.append(0.0, np.cumsum(w))[:-1]
    before -= np.repeat(before[(np.cumsum(lens) - lens)[lens > 0]], lens[lens > 0])
    total = np.bincount(owner, weights=weights, minlength=len(lens))
    keep = before <= (1 - threshold + 1e-6) * total[owner]
    return elems[order][keep], owner[keep]


MEMBERS = "key long, id long, comp long"


def _prefixes(threshold: float, decode):
    def run(table: pa.Table, common: pa.Table) -> pa.Table:
        ids, comp, key2 = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        if table.num_rows:
            key = np.array([table.column("key")[0].as_py()], dtype=np.int64).view(np.uint64)
            listed = np.frombuffer(common.column("common")[0].as_py(), np.uint64) if common.num_rows else np.empty(0, np.uint64)
            elems, owner = prefix_of(*decode(table.column("elems").to_pylist(), table.column("weights").to_pylist()), listed, threshold)
            ids, comp, key2 = table.column("id").to_numpy()[owner], table.column("comp").to_numpy()[owner], mix(elems ^ mix(key))
        return pa.table({"key": pa.array(key2.view(np.int64)), "id": pa.array(ids, pa.int64()), "comp": pa.array(comp, pa.int64())})

    return run


def _split_by_prefix(rows: DataFrame, held: DataFrame, threshold: float, decode) -> DataFrame:
    """MEMBERS of the narrower buckets of rows(key, id, comp, members)."""
    one_in = F.greatest(F.ceil(F.col("members") / SAMPLE), F.lit(1))
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit(1)), one_in) == 0).select("key", "id").join(held, "id")
    common = sample.groupBy("key").applyInArrow(_common(decode), "key long, common binary")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    spread = common.join(rows.select("key", blocks.alias("nb")).distinct(), "key").select("key", "common", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("blk"))
    dealt = rows.select("key", "id", "comp", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("blk")).join(held, "id")
    return dealt.groupBy("key", "blk").cogroup(spread.groupBy("key", "blk")).applyInArrow(_prefixes(threshold, decode), MEMBERS)


def _blocks(threshold: float, decode):
    def run(table: pa.Table) -> pa.Table:
        key, side = table.column("key").to_numpy(), table.column("side").to_numpy()
        order = np.lexsort((side, key))
        key, side, table = key[order], side[order], table.take(pa.array(order))
        ids, comp = table.column("id").to_numpy(), table.column("comp").to_numpy()
        elems, weights, lens = decode(table.column("elems").to_pylist(), table.column("weights").to_pylist())
        ends = np.append(0, np.cumsum(lens))
        own = lambda i: (elems[ends[i] : ends[i + 1]], weights[ends[i] : ends[i + 1]])
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        # nodes are the components met here: one link for each union is enough
        nodes, at = np.unique(comp, return_inverse=True)
        seen: dict[tuple, tuple] = {}
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(key)).tolist()):
            n = int((side[a:b] == 0).sum())
            if not 0 < n < b - a:
                continue
            if n * (b - a - n) <= FEW_PAIRS:
                pairs = [(x, y) for x in range(a, a + n) for y in range(a + n, b) if comp[x] != comp[y] and (at[x], at[y]) not in seen and similarity(own(x), own(y)) >= threshold - EPS]
            else:
                part = slice(ends[a], ends[b])
                hit = block_links(elems[part], weights[part], lens[a:b], n, threshold)
                x, y = a + hit[:, 0], a + n + hit[:, 1]
                other = comp[x] != comp[y]
                pairs = zip(x[other].tolist(), y[other].tolist())
            for p, q in pairs:
                seen.setdefault((at[p], at[q]), (ids[p], ids[q]))
        out = [seen[k] for k in union_find(len(nodes), list(seen))]
        return pa.table({"a": pa.array([int(p) for p, _ in out], pa.int64()), "b": pa.array([int(q) for _, q in out], pa.int64())})

    return run


def _open(rows: DataFrame) -> DataFrame:
    """(key, members, outside, big): buckets of MEMBERS that span components, and their largest one."""
    parts = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    keys = parts.groupBy("key").agg(F.sum("n").alias("members"), F.max(F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    return keys.select("key", "members", (F.col("members") - F.col("top.n")).alias("outside"), F.col("top.comp").alias("big"))


def link_components(members: DataFrame, items: DataFrame, threshold: float, decode=decode) -> tuple[DataFrame, DataFrame]:
    """(links, labels) from members(key, id) of shared keys and items(id, elems, weights).

    links(a, b): verified links that span the components; labels(node,
    component): component is the least id in it.  Ids without a link have no
    label.  decode turns (elems, weights) of an item into sorted elements and
    their weights.  members may hold a key once or more for an id; both inputs may be
    empty.
    """
    members = write_table(members.distinct(), "members")
    # what is counted by key is written first: a join of two exchanges is one whose hot keys can be split
    size = write_table(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "size")
    rows = members.join(size, "key")
    degree = rows.groupBy("id").agg(F.sum("n").alias("degree"))
    ranked = rows.join(degree, "id").select("key", "id", "n", F.struct("degree", (-F.col("id")).alias("low")).alias("r"))
    rep = write_table(ranked.groupBy("key").agg((-F.max("r").getField("low")).alias("rep")), "rep")
    starred = write_table(rows.join(rep, "key"), "starred")
    pairs = starred.where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    links = write_table(verified_pairs(pairs, items, threshold, decode), "links")
    labels = linked_components(links)

    rest = starred.where("id != rep and n > 2").select("key", "id")
    rest = rest.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    rest = write_table(rest, "rest")
    held = items.select("id", "elems", "weights")
    spanning = write_table(rest.join(_open(rest), "key"), "spanning")
    split = _split_by_prefix(spanning.where(F.col("outside") > OUTSIDE).select("key", "id", "comp", "members"), held, threshold, decode)
    narrow = write_table(spanning.where(F.col("outside") <= OUTSIDE).select("key", "id", "comp").union(split), "narrow")
    open_rows = narrow.join(_open(narrow), "key").withColumn("nm", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("ns", F.ceil(F.col("outside") / BLOCK).cast("int"))
    open_rows = write_table(open_rows, "open")
    bins = open_rows.count() // BLOCK + 1  # buckets of one block share tasks and batches
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    group = F.when((F.col("nm") == 1) & (F.col("ns") == 1), F.pmod(F.xxhash64("key"), F.lit(bins))).otherwise(F.col("key")).alias("group")
    small = open_rows.where("comp != big").select(group, "key", own("ns").alias("sb"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("mb"), "id", "comp", F.lit(0).alias("side"))
    every = open_rows.select(group, "key", F.explode(F.sequence(F.lit(0), F.col("ns") - 1)).alias("sb"), own("nm").alias("mb"), "id", "comp", F.lit(1).alias("side"))
    more = small.union(every).join(held, "id").groupBy("group", "sb", "mb").applyInArrow(_blocks(threshold, decode), "a long, b long")
    more = write_table(more, "more")
    if more.take(1):
        links = write_table(links.union(more), "links")
        labels = linked_components(links)
    for done in (members, size, rep, starred, rest, spanning, narrow, open_rows):
        drop_table(done)
    return links, labels

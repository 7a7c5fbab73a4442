"""Distributed connected components with DataFrame operations only.

Alternating large-star and small-star steps (Kiveris et al., 2014).  A step is
a minimum per node, which combines before the shuffle, and an equi-join, whose
hot keys adaptive execution splits; a node with a third of all edges is never
gathered in one task.  Every round is written to the shared folder, so a lost
executor costs no more than the round at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.sources.work import drop_table, write_table

MAX_ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
    return e.join(low, "v").select("u", F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the least node.

    Edges may repeat and may point both ways; those with a null end and loops
    say nothing and are left out.  No edges: no rows.
    """
    e = (
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = write_table(e, "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        state = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state[0] == 0 or tuple(state) == seen:
            break
        seen = tuple(state)
        new = write_table(_small_star(_large_star(e)), "edges")
        drop_table(e)
        e = new
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    out._work_path = e._work_path
    return out

"""Exact and near duplicates of assets."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark import schema as S
from shelfspark.functions.predicates import event_ts, live
from shelfspark.operators.components import connected_components
from shelfspark.sources.work import write_table

BANDS = 4


def exact_duplicates(assets: DataFrame) -> DataFrame:
    """(group_key, id, path, pos): live assets with one SHA-256; oldest first, then by path."""
    rows = live(assets).where(F.length("hash") == 64)
    groups = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    members = rows.join(groups, "hash").select("hash", event_ts().alias("at"), "path", "id")
    pos = F.row_number().over(Window.partitionBy("hash").orderBy("at", "path", "id")) - 1
    return members.select(F.col("hash").alias("group_key"), "id", "path", pos.alias("pos"))


def hex_bands(value: Column) -> list[Column]:
    """A hash of 16 hex digits as four 16-bit numbers."""
    return [F.conv(F.substring(value, 1 + 4 * i, 4), 16, 10).cast("int").alias(f"b{i}") for i in range(BANDS)]


def distance(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}"))) for i in range(1, BANDS)), F.bit_count(F.col(f"{a}.b0").bitwiseXOR(F.col(f"{b}.b0"))))


BLOCKS = 6


def _telling(hashes: DataFrame, bits: tuple[int, int] | None) -> DataFrame:
    set_bits = sum((F.bit_count(f"b{i}") for i in range(1, BANDS)), F.bit_count("b0"))
    return hashes.where(set_bits.between(*bits)) if bits else hashes


def _triples() -> Column:
    """Keys of a hash b0..b3: which three of the six blocks, and their bits."""
    whole = F.lit(0).cast("long")
    for i in range(BANDS):
        whole = F.shiftleft(whole, 16).bitwiseOR(F.col(f"b{i}").cast("long"))
    cuts = [i * 64 // BLOCKS for i in range(BLOCKS + 1)]
    block = [F.shiftrightunsigned(whole, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    return F.array(*[F.xxhash64(F.lit(n), *[block[i] for i in three]) for n, three in enumerate(combinations(range(BLOCKS), 3))])


def near_pairs(hashes: DataFrame, at_most: int = S.NEAR_DUPLICATE_BITS, bits: tuple[int, int] | None = S.BITS_SET) -> DataFrame:
    """(a, b, distance) with a < b, from hashes(id, hash, b0..b3).

    The 64 bits are cut into six blocks.  Up to three bits apart, three blocks
    at least are equal, so the pair shares one of the twenty keys that three
    blocks make, of some 32 bits: chance meetings stay few where sixteen bits
    would gather 1 of 65,536 of all hashes.  Hashes that are nearly all 0 or
    all 1 say nothing and are left out, as are pairs of one content.
    """
    if at_most > BLOCKS - 3:
        raise ValueError("no pair more than three bits apart is found for sure")
    rows = _telling(hashes, bits).select("id", "hash", *[f"b{i}" for i in range(BANDS)], F.explode(_triples()).alias("k"))
    pairs = rows.alias("x").join(rows.alias("y"), F.expr("x.k = y.k and x.id < y.id"))
    d = distance("x", "y")
    same = F.col("x.hash") != F.col("y.hash")
    return pairs.where((d <= at_most) & same).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), d.cast("int").alias("distance")).distinct()


def near_groups(hashes: DataFrame, at_most: int = S.NEAR_DUPLICATE_BITS, bits: tuple[int, int] | None = S.BITS_SET) -> DataFrame:
    """(group_key, id): components of near pairs; the key is the least id.

    Ids of one perceptual hash stand together behind the least of them, so a
    hash that many share makes no pairs among them.
    """
    bands = [f"b{i}" for i in range(BANDS)]
    rows = write_table(_telling(hashes, bits).select("id", "hash", *bands), "hashes")
    reps = rows.groupBy(*bands).agg(F.min("id").alias("rep"), F.countDistinct("hash").alias("contents"))
    reps = write_table(reps, "reps")
    pairs = near_pairs(reps.select(F.col("rep").alias("id"), F.col("rep").alias("hash"), *bands), at_most, None)
    labels = connected_components(pairs.select("a", "b")).select(F.col("node").alias("rep"), "component")
    members = rows.join(reps, bands).join(labels, "rep", "left").where("component is not null or contents > 1")
    return members.select(F.coalesce("component", "rep").alias("group_key"), "id")


def all_duplicates(exact: DataFrame, near: DataFrame) -> DataFrame:
    return exact.select(F.lit("exact").alias("kind"), "group_key", "id").unionByName(near.select(F.lit("near").alias("kind"), "group_key", "id"))


def skipped_copies(files: DataFrame, assets: DataFrame) -> DataFrame:
    """Files on disk, files(path, hash), whose content is catalogued under another path: rows to add."""
    alive = live(assets)
    new = files.join(assets.select("path"), "path", "left_anti")
    twin = alive.groupBy("hash").agg(F.min_by(F.struct(*[c for c in alive.columns if c not in ("path", "hash")]), "id").alias("t"))
    return new.join(twin, "hash").select("path", "hash", F.col("t.id").alias("twin_id"), "t.captured_at", "t.camera", "t.lens")


def prune_roots(roots: DataFrame) -> DataFrame:
    """roots(path) without those under another root."""
    norm = roots.select(F.regexp_replace("path", "/+$", "").alias("path")).distinct()
    # each root looks itself up by its own parents: an equi-join, not a pair of all roots
    parts = F.split("path", "/")
    parents = norm.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))).alias("parent"))
    nested = parents.where("parent <> path and parent <> ''").join(norm.select(F.col("path").alias("parent")), "parent", "left_semi").select("path").distinct()
    return norm.join(nested, "path", "left_anti")

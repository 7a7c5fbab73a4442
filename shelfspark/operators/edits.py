"""Edit revisions of images: appended, never changed; the last one of an asset holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["id", "asset_id", "ops_json", "created_at"]


def _images(assets: DataFrame) -> DataFrame:
    return assets.where("media_type = 'image'").select(F.col("id").alias("asset_id"))


def append(edits: DataFrame, new: DataFrame, assets: DataFrame) -> DataFrame:
    """edits and those of new(id, asset_id, ops_json, created_at) whose asset is an image."""
    return edits.select(*COLUMNS).unionByName(new.join(_images(assets), "asset_id", "left_semi").select(*COLUMNS))


def revert(edits: DataFrame, asks: DataFrame, assets: DataFrame) -> DataFrame:
    """edits and a copy of an older revision for each of asks(id, asset_id, revision_id, created_at).

    A revision that is not the asset's own is not found and appends nothing.
    """
    old = edits.select(F.col("id").alias("revision_id"), "asset_id", "ops_json")
    return append(edits, asks.join(old, ["revision_id", "asset_id"]), assets)


def clear(edits: DataFrame, ids: DataFrame, assets: DataFrame) -> DataFrame:
    """edits without those of ids(asset_id); assets that are there and no images keep theirs."""
    kept = assets.where("media_type <> 'image'").select(F.col("id").alias("asset_id"))
    return edits.join(ids.join(kept, "asset_id", "left_anti").select("asset_id").distinct(), "asset_id", "left_anti").select(*COLUMNS)

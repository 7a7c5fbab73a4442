"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark import schema as S


def event_ts() -> Column:
    return F.coalesce(F.col("captured_at"), F.col("created_at"))


def live(assets: DataFrame) -> DataFrame:
    return assets.where(F.col("deleted_at").isNull())


def summary(assets: DataFrame) -> DataFrame:
    return assets.select(*S.ASSET_SUMMARY)


def page(assets: DataFrame, limit: int, offset: int = 0, order: list[Column] | None = None) -> DataFrame:
    """A page in a total order: newest first unless told otherwise, then by id."""
    order = order or [event_ts().desc_nulls_last()]
    return assets.orderBy(*order, F.col("id").asc()).offset(offset).limit(min(limit, S.LIMIT_LIST))


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def media_type(path: Column) -> Column:
    ext = extension(path)
    return F.when(name_of(path).startswith("._"), None).when(ext.isin(S.IMAGE_EXTENSIONS + S.RAW_EXTENSIONS), "image").when(ext.isin(S.VIDEO_EXTENSIONS), "video")


def is_raw(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(S.RAW_EXTENSIONS) + ")$")


def is_screenshot() -> Column:
    low = F.lower("path")
    return (F.col("media_type") == "image") & F.col("camera").isNull() & (low.contains("screenshot") | low.contains("screen shot"))


def rank_score() -> Column:
    return F.col("favorite").cast("int") * 10 + F.col("rating") * 2 + F.col("thumbnail_path").isNotNull().cast("int")


def rank_order() -> list[Column]:
    return [rank_score().desc(), event_ts().desc_nulls_last(), F.col("id").asc()]


def ignored(path: Column, patterns: list[str]) -> Column:
    """True for paths that one of the ignore patterns names."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = name_of(low)
    out = F.lit(False)
    for raw in patterns:
        p = raw.strip().lower()
        if not p:
            continue
        if p.startswith("*."):
            out = out | (extension(low) == p[2:])
        elif "*" in p:
            like = "^" + "".join(".*" if c == "*" else "\\" + c if not c.isalnum() else c for c in p) + "$"
            out = out | name.rlike(like) | low.rlike(like)
        else:
            out = out | low.contains(p) | (name == p)
    return out


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double; 0 where the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.lit(0.0))


def dms(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    sign = F.when(F.upper(hemisphere).isin("S", "W"), -1.0).otherwise(1.0)
    return sign * (degrees + minutes / 60.0 + seconds / 3600.0)

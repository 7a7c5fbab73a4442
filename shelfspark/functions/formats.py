"""Sizes and durations as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ["KB", "MB", "GB", "TB"]


def bytes_text(size: Column) -> Column:
    """512 B, 1.5 KB, 12 MB: one digit after the point below ten; terabytes at most; null stays null."""
    out = F.lit(None).cast("string")
    for i, unit in reversed(list(enumerate(UNITS, 1))):
        value = size / (1024**i)
        said = F.when(value < 10, F.format_string(f"%.1f {unit}", F.floor(value * 10 + 0.5) / 10)).otherwise(F.format_string(f"%d {unit}", F.floor(value + 0.5)))
        out = said if i == len(UNITS) else F.when(size < 1024 ** (i + 1), said).otherwise(out)
    return F.when(size < 1024, F.format_string("%d B", size)).when(size.isNotNull(), out)


def duration_text(ms: Column) -> Column:
    """Minutes and seconds, rounded: 61499 is 1:01; null is "Not available"."""
    s = F.floor(ms / 1000 + 0.5)
    return F.when(ms.isNull(), "Not available").otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))

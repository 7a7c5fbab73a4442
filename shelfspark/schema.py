"""Types, enums and constants of the library."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values, all of this module: they must equal the library's for equal results.

#: The columns of every asset listing, in order.
ASSET_SUMMARY = [
    "id", "path", "hash", "perceptual_hash", "media_type", "width", "height", "duration_ms", "created_at",
    "captured_at", "indexed_at", "favorite", "rating", "color_label", "thumbnail_path", "camera", "lens", "deleted_at",
]

_S, _L, _B, _D, _N = T.StringType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.TimestampNTZType()

ASSETS = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("id", _S), ("path", _S), ("hash", _S), ("perceptual_hash", _S), ("media_type", _S), ("width", _L), ("height", _L), ("duration_ms", _L),
            ("file_size", _L), ("created_at", _N), ("captured_at", _N), ("indexed_at", _N), ("favorite", _B), ("rating", _L), ("color_label", _S),
            ("thumbnail_path", _S), ("camera", _S), ("lens", _S), ("deleted_at", _N), ("blur_score", _D),
        )
    ]
)

IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tif", "tiff", "heic", "heif"]
RAW_EXTENSIONS = ["raw", "dng", "cr2", "cr3", "nef", "nrw", "arw", "srf", "sr2", "orf", "raf", "rw2", "pef", "srw", "x3f", "3fr", "erf", "mrw", "dcr", "kdc"]
VIDEO_EXTENSIONS = ["mp4", "mov", "m4v", "avi", "mkv", "webm"]
RECEIPT_WORDS = ["receipt", "invoice", "subtotal", "total", "tax", "amount"]
CURRENCY_SIGNS = ["$", "€", "£", "₹"]
LIMIT_LIST, LIMIT_DUPLICATE_SCAN, LIMIT_MEMORIES, LIMIT_CANDIDATES = 500, 5000, 50, 400
PANORAMA_ASPECT, BLURRY_AT_MOST, SEMANTIC_FLOOR = 2.0, 80.0, 0.15
NEAR_DUPLICATE_BITS, BITS_SET = 2, (4, 60)
MIN_ON_THIS_DAY, MIN_WEEKEND, MIN_PERSON_PLACE = 3, 5, 5
MAX_WEEKENDS, MAX_PERSON_PLACES = 12, 20
MATCH_AT_LEAST, CONSOLIDATE_AT_LEAST, IOU_AT_MOST = 0.32, 0.40, 0.4
MAX_ATTEMPTS, TRASH_DAYS, KEEP_SEARCHES = 3, 30, 30
BM25_DOCUMENTED = {"filename": 5.0, "tags": 4.0, "camera": 1.0, "lens": 1.0, "ocr_text": 12.0, "people": 6.0, "auto_tags": 3.0, "caption": 8.0}
BM25_POSITIONAL = {"filename": 4.0, "tags": 1.0, "camera": 1.0, "lens": 12.0, "ocr_text": 6.0, "people": 3.0, "auto_tags": 8.0, "caption": 1.0}

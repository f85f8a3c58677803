"""The scalar functions under names that SQL text can use."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sightline.functions.geometry import SIZE_BUCKETS
from sightline.functions.identity import CLIP_PATTERNS, EXPORT_SUFFIX
from sightline.functions.text import NO_PLATE, STRIP

# Each is a SQL expression of its arguments, so that calls are inlined and optimised like any other expression.
_BASE = f"regexp_replace(name, r'{EXPORT_SUFFIX}', '')"
_CASES = " ".join(f"WHEN width_px >= {a} AND width_px < {b} THEN '{n}'" for (n, a), (_, b) in zip(SIZE_BUCKETS, SIZE_BUCKETS[1:]))
FUNCTIONS = {
    "clip_id": ("name STRING", "STRING", "coalesce(" + ", ".join(f"nullif(regexp_extract({_BASE}, r'{p}', 1), '')" for p in CLIP_PATTERNS) + ")"),
    "hamming": ("a BIGINT, b BIGINT", "INT", "bit_count(a ^ b)"),
    "size_bucket": ("width_px DOUBLE", "STRING", f"CASE {_CASES} ELSE '{SIZE_BUCKETS[-1][0]}' END"),
    "box_iou": (
        "a STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>, b STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>",
        "DOUBLE",
        "CASE WHEN least(a.x2, b.x2) <= greatest(a.x1, b.x1) OR least(a.y2, b.y2) <= greatest(a.y1, b.y1) THEN 0.0D ELSE coalesce(try_divide("
        "(least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)), "
        "(a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))), 0.0D) END",
    ),
    "error_rate": ("reference STRING, hypothesis STRING", "DOUBLE", "CASE WHEN reference = '' THEN CASE WHEN hypothesis = '' THEN 0.0D ELSE 1.0D END ELSE levenshtein(reference, hypothesis) / length(reference) END"),
    "normalize_plate": ("raw STRING", "STRING", f"regexp_replace(regexp_replace(upper(raw), r'{NO_PLATE}', ''), r'{STRIP}', '')"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    for name, (arguments, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")
    return sorted(FUNCTIONS)

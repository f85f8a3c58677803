"""A labelling sample spread over buckets, round robin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions.geometry import size_bucket


def round_robin(df: DataFrame, bucket: str, ident: str, limit: int, seed: int = 0) -> DataFrame:
    """``limit`` rows, one from each bucket in turn (in order of buckets' names), each bucket in order of a hash of seed and ``ident``.

    Gives ``bucket``, ``ident`` and ``round``.  Rows without ident or bucket
    are left out and repeated ones count once.  No bucket can give more than
    ``limit`` rows, so each task passes on that many at most.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    rows = df.select(F.col(bucket).alias("bucket"), F.col(ident).cast("string").alias("ident")).where("bucket IS NOT NULL AND ident IS NOT NULL").distinct()
    rows = rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), "ident")))
    rows = rows.withColumn("round", F.row_number().over(W.partitionBy("bucket").orderBy("_h", "ident"))).where(F.col("round") <= limit)
    return rows.orderBy("round", "bucket").limit(limit).select(F.col("bucket").alias(bucket), F.col("ident").alias(ident), "round")


def crop_refs(records: DataFrame, limit: int, seed: int = 0) -> DataFrame:
    """A labelling sample of a manifest's boxes, spread over size buckets: crop_id, image_id, file_name (numbered from 0000 in order of drawing), width_px, bucket.

    Images without boxes give none; repeated boxes count once; a null pixel
    width counts as large.
    """
    wide = F.col("b.w") * F.col("width")
    boxes = records.where("image_id IS NOT NULL").select("image_id", "width", F.posexplode("boxes").alias("i", "b"))
    boxes = boxes.select(F.concat_ws("#", "image_id", F.col("i").cast("string")).alias("crop_id"), "image_id", wide.cast("int").alias("width_px"), size_bucket(wide).alias("bucket"))
    boxes = boxes.groupBy("crop_id").agg(F.min(F.struct("image_id", "width_px", "bucket")).alias("x")).select("crop_id", "x.*")
    drawn = round_robin(boxes, "bucket", "crop_id", limit, seed)
    number = F.row_number().over(W.orderBy("round", "bucket")) - 1  # over the sample, of at most ``limit`` rows
    drawn = drawn.withColumn("file_name", F.format_string("%04d.png", number)).drop("round", "bucket")
    return boxes.join(drawn, "crop_id").select("crop_id", "image_id", "file_name", "width_px", "bucket")

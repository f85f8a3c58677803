"""Dataset statistics, exact medians, exit criteria, expectations and fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline import runtime
from sightline.functions.geometry import MIN_READABLE_PX, primary_region
from sightline.functions.identity import group_key

#: Bins in which the values around a median are looked for, and distinct values that are ranked in one task.
MEDIAN_BINS, RANKED = 512, 1_000_000


def exact_medians(df: DataFrame, *values: str) -> tuple[float | None, ...]:
    """The median of each column, the mean of the middle two for an even number; null if there are no values.

    Nulls and NaN are left out.  Values are counted once for all columns; an
    approximate histogram tells the range that holds the middle, and is
    refined until the range has few distinct values, which alone are ranked.
    """
    entries = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values)))).alias("e")
    counted = df.select(entries).select("e.c", "e.v").where("v IS NOT NULL AND NOT isnan(v)").groupBy("c", "v").agg(F.count("*").alias("n"))
    counted = runtime.Workspace(df.sparkSession, "medians").cut(counted, "counted")
    totals = {r.c: r.n for r in counted.groupBy("c").agg(F.sum("n").alias("n")).collect()}  # a row for each column
    out = []
    for i in range(len(values)):
        own, n = counted.where(F.col("c") == i), totals.get(i)
        out.append(None if not n else (_ranked(own, (n - 1) // 2) + _ranked(own, n // 2)) / 2 if n % 2 == 0 else _ranked(own, n // 2))
    return tuple(out)


def _ranked(counted: DataFrame, k: int) -> float:
    """The value of rank ``k``, from 0, of values ``v`` that stand ``n`` times."""
    while True:
        head = counted.agg(F.count("*").alias("rows"), F.percentile_approx("v", [j / MEDIAN_BINS for j in range(1, MEDIAN_BINS)], 10 * MEDIAN_BINS).alias("q")).first()
        if head.rows <= RANKED:
            upto = F.sum("n").over(W.orderBy("v"))
            return counted.withColumn("upto", upto).where(F.col("upto") > k).agg(F.min("v")).first()[0]
        edges = sorted(set(head.q))
        number = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("v")))
        bins = {r.b: r.n for r in counted.groupBy(number.alias("b")).agg(F.sum("n").alias("n")).collect()}  # MEDIAN_BINS rows at most
        for b in sorted(bins):
            if k < bins[b]:
                break
            k -= bins[b]
        if b:
            counted = counted.where(F.col("v") > edges[b - 1])
        if b < len(edges):
            counted = counted.where(F.col("v") <= edges[b])


def exact_median(df: DataFrame, value: str) -> float | None:
    """The median of one column, as ``exact_medians`` gives it."""
    return exact_medians(df, value)[0]


def with_group_key(records: DataFrame) -> DataFrame:
    """Manifest records with ``group_key`` and ``region`` (their primary region)."""
    return records.withColumn("group_key", group_key(F.col("image_id"), F.col("split_group"))).withColumn("region", primary_region(F.col("boxes")))


def box_rows(records: DataFrame) -> DataFrame:
    """A row per box: image_id, box_index, box fields, pixel_width, pixel_height; images without boxes give none."""
    rows = records.select("image_id", "width", "height", F.posexplode("boxes").alias("box_index", "b"))
    return rows.select("image_id", "box_index", "b.*", (F.col("b.w") * F.col("width")).alias("pixel_width"), (F.col("b.h") * F.col("height")).alias("pixel_height"))


def dataset_stats(records: DataFrame) -> DataFrame:
    """One row: images, plates, images_without_plates, groups, with_text, tiny_plates, plates_per_image, median_width, median_height.

    ``records`` has the manifest's columns.  A null list of boxes is an image
    without plates; an empty text is no text; medians are null without boxes.
    """
    spark = records.sparkSession
    rows = with_group_key(records)
    n = F.coalesce(F.size("boxes"), F.lit(0))
    images = rows.agg(F.count("*").alias("images"), F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0)).alias("plates"), F.count_if(n <= 0).alias("images_without_plates"), F.count_distinct("group_key").alias("groups"))
    boxes = box_rows(records)
    per_box = boxes.agg(F.count_if(F.col("text") != "").alias("with_text"), F.count_if(F.col("pixel_width") < MIN_READABLE_PX).alias("tiny_plates"))
    medians = spark.createDataFrame([exact_medians(boxes, "pixel_width", "pixel_height")], "median_width double, median_height double")
    one = lambda df: df.withColumn("_one", F.lit(1))  # each side is a single row
    out = one(images).join(one(per_box), "_one").join(one(medians), "_one").drop("_one")
    return out.withColumn("plates_per_image", F.when(F.col("images") > 0, F.col("plates") / F.col("images")).otherwise(0.0))


def counts_by(records: DataFrame, *names: str) -> DataFrame:
    """Rows per value of ``names``; empty and null values are skipped."""
    rows = records
    for n in names:
        rows = rows.where(F.col(n).isNotNull() & (F.col(n).cast("string") != ""))
    return rows.groupBy(*names).agg(F.count("*").alias("images"))


def exit_criteria(stats: DataFrame, regions: DataFrame, min_plates: int = 1000, required: tuple[str, ...] = ("IN", "EU"), splits: DataFrame | None = None) -> DataFrame:
    """``criterion`` and ``passed``: enough plates, plates of every required region, and no empty split where splits are given.

    ``stats`` is the one row of ``dataset_stats``; ``regions`` has region and
    plates; ``splits`` has split and images.
    """
    spark = stats.sparkSession
    out = stats.select(F.lit(f"plates >= {min_plates}").alias("criterion"), (F.col("plates") >= min_plates).alias("passed"))
    wanted = spark.createDataFrame([(r,) for r in required], "region string").join(regions, "region", "left")
    out = out.unionByName(wanted.select(F.concat(F.lit("region "), "region").alias("criterion"), (F.coalesce("plates", F.lit(0)) > 0).alias("passed")))
    if splits is not None:
        out = out.unionByName(splits.select(F.concat(F.lit("split "), "split").alias("criterion"), (F.col("images") > 0).alias("passed")))
    return out


def expectations(facts: dict[str, object], wanted: dict[str, object]) -> list[str]:
    """All differences between what was measured and what was expected; wishes that are None aren't checked."""
    return [f"{k} {facts.get(k)!r}, expected {v!r}" for k, v in wanted.items() if v is not None and facts.get(k) != v]


def verify_dataset(facts: dict[str, object], wanted: dict[str, object]) -> None:
    """Raise with all differences at once."""
    if found := expectations(facts, wanted):
        raise ValueError("the dataset isn't the expected one: " + "; ".join(found))


def fingerprint(df: DataFrame, order: list[Column], body: Column) -> str:
    """The SHA-256 of all bodies in the given order.

    A digest of a whole sequence has no parallel form, so the sorted rows
    stream through one task, which holds a batch at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = hashlib.sha256()
        for f in frames:
            for b in f["body"]:
                digest.update(bytes(b))
        yield pd.DataFrame({"sha256": [digest.hexdigest()]})

    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    rows = df.select(*keys, body.cast("binary").alias("body"))
    rows = rows.repartition(1).sortWithinPartitions(*(f"k{i}" for i in range(len(order))))
    return rows.select("body").mapInPandas(run, "sha256 string").first()[0]


def export_fingerprint(labels: DataFrame) -> str:
    """The digest of a tree of labels (split, name, body): split order, then name; each entry is ``split/name`` and its bytes."""
    place = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    return fingerprint(labels.where(F.col("split").isin("train", "val", "test")), [place, F.col("name")], F.concat(F.concat("split", F.lit("/"), "name").cast("binary"), F.col("body").cast("binary")))

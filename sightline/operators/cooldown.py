"""One log row per passage: sightings within a cooldown of the one before are suppressed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.runs import with_previous

COOLDOWN_US = 300_000_000
CHUNK_US = 3_600_000_000


def cooldown(df: DataFrame, key: str, ts_us: str, ties: list[str], cooldown_us: int = COOLDOWN_US) -> DataFrame:
    """``df`` with ``accepted`` and ``sighting``, the running number of the key's sightings.

    A sighting is accepted if its key was never seen before, or last seen at
    least ``cooldown_us`` ago; a suppressed one still renews the cooldown.
    Order is event time, then ``ties``.  Rows without key or time are dropped;
    a cooldown of 0 accepts all; an empty table stays empty.
    """
    if cooldown_us < 0:
        raise ValueError("cooldown must not be negative")
    rows = with_previous(df.where(F.col(key).isNotNull()), [key], ts_us, ties, CHUNK_US, "_prev", "sighting")
    return rows.withColumn("accepted", F.col("_prev").isNull() | (F.col(ts_us) - F.col("_prev") >= cooldown_us)).drop("_prev")


def history(df: DataFrame, key: str, ts_us: str) -> DataFrame:
    """First and last sighting and their number, for each key."""
    rows = df.where(F.col(key).isNotNull() & F.col(ts_us).isNotNull())
    return rows.groupBy(key).agg(F.min(ts_us).alias("first_us"), F.max(ts_us).alias("last_us"), F.count("*").alias("sightings"))


def continued(df: DataFrame, seen: DataFrame, key: str, ts_us: str, ties: list[str], cooldown_us: int = COOLDOWN_US) -> DataFrame:
    """``df`` with ``accepted``, as if the sightings of ``seen`` (``key``, last_us) had come before: one for each key, of which those that ``df`` has are looked at.

    A stored sighting comes before new ones of its instant.
    """
    keys = df.where(F.col(key).isNotNull()).select(key).distinct()
    old = seen.groupBy(key).agg(F.max("last_us").alias(ts_us)).join(keys, key, "left_semi").withColumn("_old", F.lit(True))
    both = df.withColumn("_old", F.lit(False)).unionByName(old, allowMissingColumns=True).withColumn("_fresh", ~F.col("_old"))
    return cooldown(both, key, ts_us, ["_fresh", *ties], cooldown_us).where("NOT _old").drop("_old", "_fresh", "sighting")

"""Grouped, stratified, deterministic splits, and checks of an assignment."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline import runtime

# The splits in their order, and the default shares.
SPLITS = ("train", "val", "test")
RATIOS = {"train": 0.70, "val": 0.15, "test": 0.15}


def normalize_ratios(ratios: dict[str, float]) -> dict[str, float]:
    """Shares scaled to a sum of 1; an empty, negative or all-zero set is an error."""
    if not ratios or min(ratios.values()) < 0 or sum(ratios.values()) <= 0:
        raise ValueError("ratios need shares of at least 0 and a positive sum")
    return {k: v / sum(ratios.values()) for k, v in ratios.items()}


#: What ranks are taken from; the first is the default.
DIGESTS = {"blake2b": lambda b: hashlib.blake2b(b, digest_size=8).digest(), "md5": lambda b: hashlib.md5(b).digest()[:8]}


def rank(text: str, seed: int, digest: str = "blake2b") -> int:
    """A stable pseudorandom rank: 64 bits of a digest of seed and text."""
    return int.from_bytes(DIGESTS[digest](f"{seed}:{text}".encode()), "big")


def owned_groups(records: DataFrame, group: str = "group_key", region: str = "region") -> DataFrame:
    """``group_key``, ``region`` and ``size``: each group belongs to its lowest region and counts the images of that region only."""
    sizes = records.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("group_key"), F.coalesce(F.col(region), F.lit("XX")).alias("region")).agg(F.count("*").alias("size"))
    return sizes.groupBy("group_key").agg(F.min(F.struct("region", "size")).alias("o")).select("group_key", "o.region", "o.size")


def grouped_split(records: DataFrame, ratios: dict[str, float] | None = None, seed: int = 0, group: str = "group_key", region: str = "region", digest: str = "blake2b") -> DataFrame:
    """``group_key`` and ``split``: every group in one split, shares met within each region.

    Within a region groups are placed largest first (equal sizes by rank),
    each where most is missing from the target (ties by rank of group and
    split).  Records without a group key are left out, a null region is XX;
    empty input gives no rows.

    The placing is a fold over a region's groups in order, and so runs in one
    task per region; it streams over sorted rows, one per group, and holds no
    more than the splits' counts.
    """
    shares = normalize_ratios(ratios or RATIOS)
    groups = owned_groups(records, group, region)
    totals = groups.groupBy("region").agg(F.sum("size").alias("total"))
    groups = runtime.lookup(groups, totals, ["region"])

    def ranked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(rank=[f"{rank(g, seed, digest):016x}" for g in f["group_key"]])

    names, parts = list(shares), np.array(list(shares.values()))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, goal, filled = None, parts, np.zeros(len(parts))
        for f in frames:
            chosen = []
            for row in f.itertuples():
                if row.region != here:
                    here, goal, filled = row.region, parts * row.total, np.zeros(len(parts))
                gap = goal - filled
                open_ = np.flatnonzero(gap == gap.max())
                if len(open_) > 1:  # ranks are only asked for where splits tie
                    open_ = sorted(open_, key=lambda i: rank(f"{row.group_key}:{names[i]}", seed, digest))
                filled[open_[0]] += row.size
                chosen.append(names[open_[0]])
            yield pd.DataFrame({"group_key": f["group_key"], "split": chosen})

    rows = groups.mapInPandas(ranked, "group_key string, region string, size long, total long, rank string")
    rows = rows.repartition("region").sortWithinPartitions("region", F.desc("size"), "rank", "group_key")
    return rows.mapInPandas(place, "group_key string, split string")


def assign(records: DataFrame, assignment: DataFrame, group: str = "group_key") -> DataFrame:
    """``records`` with their ``split``; a record whose group has none gets null (see ``coverage``)."""
    plan = assignment.select(F.col("group_key").alias("_g"), "split")
    return runtime.lookup(records.withColumn("_g", F.col(group)), plan, ["_g"], how="left").drop("_g")


def coverage(records: DataFrame, assignment: DataFrame, ratios: dict[str, float] | None = None, group: str = "group_key") -> DataFrame:
    """Problems of an assignment, a row each: ``problem`` (unassigned, stale or empty) and ``name`` of the group or split."""
    shares = normalize_ratios(ratios or RATIOS)
    have = records.select(F.col(group).alias("name")).where("name IS NOT NULL").distinct()
    plan = assignment.select(F.col("group_key").alias("name")).distinct()
    used = assign(records, assignment, group).where("split IS NOT NULL").select("split").distinct()
    wanted = records.sparkSession.createDataFrame([(s,) for s, v in shares.items() if v > 0], "name string")
    empty = wanted.limit(0) if records.isEmpty() else wanted.join(used, wanted["name"] == used["split"], "left_anti")
    parts = ((have.join(plan, "name", "left_anti"), "unassigned"), (plan.join(have, "name", "left_anti"), "stale"), (empty, "empty"))
    out = [p.select(F.lit(what).alias("problem"), "name") for p, what in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def verify(records: DataFrame, assignment: DataFrame, ratios: dict[str, float] | None = None, group: str = "group_key") -> None:
    """Raise if the assignment doesn't fit the records, naming a few problems of each kind."""
    found = coverage(records, assignment, ratios, group)
    top = found.withColumn("r", F.row_number().over(W.partitionBy("problem").orderBy("name"))).where("r <= 3").collect()
    if top:
        raise ValueError("the split doesn't fit the records: " + ", ".join(f"{r.problem} {r.name}" for r in top))


def split_counts(records: DataFrame) -> DataFrame:
    """``split`` and ``images`` for all three splits, zeros included."""
    names = records.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    n = records.groupBy("split").agg(F.count("*").alias("images"))
    return names.join(n, "split", "left").select("split", F.coalesce("images", F.lit(0)).alias("images"))

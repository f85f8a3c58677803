"""Samples of given category shares, by the cube method on category indicators.

The balancing variables are the indicators of a plan's buckets, so the kernel
of the balancing equations is spanned by moves between two records of one
bucket: a flight step lets two undecided records of a bucket trade inclusion
probability until one of them is decided.  Steps on disjoint pairs commute and
are done many at a time.  At the end, at most one record of each bucket is
undecided; landing then gives up the buckets' shares, but not the size of the
plan: undecided records of different buckets trade, and chance decides the last
one, if the plan's total isn't whole.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline import runtime

#: The buckets' names and their lower bounds in pixels.
BUCKETS = (("tiny (<32px)", 0), ("small (32-64px)", 32), ("medium (64-128px)", 64), ("large (>=128px)", 128))
#: Records of a cell, the unit of the first flight; a cell is solved in one task.
CELL_ROWS = 20_000
#: Cells merged into one at each level upward.
FAN_IN = 64
#: About how many rows of plans are handed to the tasks at a time.
PLAN_ROWS = 100_000
_EPS = 1e-9


def _rng(*parts) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big"))


def flight(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Trade probabilities within one bucket until at most one record is undecided; the sum is kept."""
    p = p.astype(float).copy()
    open_ = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    while len(open_) > 1:
        half = len(open_) // 2
        i, j = open_[:half], open_[half : 2 * half]
        a, b, u = p[i], p[j], rng.random(half)
        total = a + b
        low = total < 1
        first = np.where(low, u * total < a, u * (2 - total) < 1 - b)
        win, lose = np.where(low, total, 1.0), np.where(low, 0.0, total - 1)
        p[i], p[j] = np.where(first, win, lose), np.where(first, lose, win)
        open_ = np.concatenate([i, j, open_[2 * half :]])
        open_ = open_[(p[open_] > _EPS) & (p[open_] < 1 - _EPS)]
        open_.sort()
    p[p <= _EPS], p[p >= 1 - _EPS] = 0.0, 1.0
    return p


def _merge(seed: int, level: int):
    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("crop_id", kind="stable")
        done = flight(pdf["p"].to_numpy(), _rng(seed, *key, level))
        pdf = pdf.assign(p=done, cell=key[2])
        return pdf[pdf["p"] > 0]

    return merge


def _land(seed: int):
    def land(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "crop_id"], kind="stable")
        rng = _rng(seed, *key, "landing")
        done = flight(pdf["p"].to_numpy(), rng)
        last = (done > 0) & (done < 1)
        done[last] = rng.random(last.sum()) < done[last]
        pdf = pdf.assign(p=done)
        return pdf[pdf["p"] > 0]

    return land


def bucket_of(width, recorded):
    """The bucket of a crop: by its width where that is positive, else as recorded."""
    by_width = F.when(width < BUCKETS[1][1], BUCKETS[0][0]).when(width < BUCKETS[2][1], BUCKETS[1][0]).when(width < BUCKETS[3][1], BUCKETS[2][0]).otherwise(BUCKETS[3][0])
    return F.when(width > 0, by_width).otherwise(recorded)


def balanced_samples(crops: DataFrame, plans: DataFrame, seed: int = 7, cell_rows: int = CELL_ROWS, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """For every plan a sample of crops, and a report.

    ``plans`` has plan_id, bucket, target_pct, min_rows and sample_rows; a
    bucket's quota is greatest(min_rows, target_pct x sample_rows / 100), at
    most what there is.  A quota that isn't whole is rounded up or down by
    chance, with the quota as expectation; a plan's size is the sum of its
    quotas, rounded up or down only if that isn't whole.

    Gives (sample, report): plan_id, bucket, crop_id; and plan_id, bucket,
    wanted, available, drawn, residual (drawn - wanted) and short (fewer
    distinct crops than wanted).

    A crop delivered again counts once per bucket.  Rows without crop_id or
    without any bucket aren't drawn.  Plan rows without plan_id or bucket are
    left out, nulls in their numbers count as 0, and of plan rows repeated for
    one bucket the largest wish holds.  An empty crop table gives empty
    samples and a report in which every bucket that wants rows is short.
    Other columns are ignored.  Reruns and other partitionings draw alike.

    Cells are cut by a hash of crop_id and hold about ``cell_rows`` crops;
    each leaves at most one undecided crop per plan and bucket, and these
    merge upward ``fan_in`` cells at a time.
    """
    spark = crops.sparkSession
    space = runtime.Workspace(spark, "cube")
    n0 = lambda c: F.coalesce(F.col(c), F.lit(0))
    want = F.greatest(n0("min_rows").cast("double"), n0("target_pct").cast("double") * n0("sample_rows") / 100)
    plans = plans.where("plan_id IS NOT NULL AND bucket IS NOT NULL").groupBy("plan_id", "bucket").agg(F.max(want).alias("wanted"))
    units = crops.select("crop_id", bucket_of(F.col("width_px"), F.col("bucket")).alias("bucket")).where("crop_id IS NOT NULL AND bucket IS NOT NULL")
    units = space.cut(units.join(runtime.broadcast_if_small(plans.select("bucket").distinct()), "bucket", "left_semi").distinct(), "units")
    sizes = units.groupBy("bucket").agg(F.count("*").alias("available"))
    quota = space.cut(plans.join(sizes, "bucket", "left").select("plan_id", "bucket", "wanted", F.coalesce("available", F.lit(0)).alias("available")), "quota")
    rates = quota.where("available > 0 AND wanted > 0").select("plan_id", "bucket", F.least(F.lit(1.0), F.col("wanted") / F.col("available")).alias("p"))
    total = units.count()
    cells = max(1, -(-total // cell_rows))
    # Plans come in portions, so that what a task is told of them has a bound.
    portions = max(1, -(-rates.count() // PLAN_ROWS))

    def flights(portion: int):
        listed: dict[str, list] = {}
        for r in rates.where(F.pmod(F.xxhash64("plan_id"), F.lit(portions)) == portion).collect():
            listed.setdefault(r.bucket, []).append((r.plan_id, r.p))

        def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, out = pdf.sort_values(["bucket", "crop_id"], kind="stable"), []
            for bucket, part in pdf.groupby("bucket", sort=True):
                ids = part["crop_id"].to_numpy()
                for plan, p in listed.get(bucket, ()):
                    done = flight(np.full(len(ids), p), _rng(seed, plan, bucket, key[0], 0))
                    at = np.flatnonzero(done)
                    out.append(pd.DataFrame({"plan_id": plan, "bucket": bucket, "crop_id": ids[at], "p": done[at], "cell": key[0]}))
            return pd.concat(out) if out else pd.DataFrame(columns=["plan_id", "bucket", "crop_id", "p", "cell"])

        return first

    types = dict(quota.dtypes)
    schema = f"plan_id {types['plan_id']}, bucket string, crop_id string, p double, cell long"
    cell = F.pmod(F.xxhash64(F.lit(seed), "crop_id"), F.lit(cells))
    in_cells = units.withColumn("cell", cell)
    state = reduce(DataFrame.unionByName, (space.cut(in_cells.groupBy("cell").applyInPandas(flights(i), schema), f"flight0-{i}") for i in range(portions)))
    sure, open_ = [state.where("p = 1")], state.where("p < 1")
    level = 0
    while cells > 1:
        level, cells = level + 1, -(-cells // fan_in)
        up = open_.withColumn("cell", F.floor(F.col("cell") / fan_in)).groupBy("plan_id", "bucket", "cell").applyInPandas(_merge(seed, level), schema)
        up = space.cut(up, f"flight{level}")
        sure.append(up.where("p = 1"))
        open_ = up.where("p < 1")
    # One record of each of a plan's buckets at most is left.
    sure.append(space.cut(open_.groupBy("plan_id").applyInPandas(_land(seed), schema), "landed"))
    sample = sure[0]
    for x in sure[1:]:
        sample = sample.unionByName(x)
    sample = sample.select("plan_id", "bucket", "crop_id")
    drawn = sample.groupBy("plan_id", "bucket").agg(F.count("*").alias("drawn"))
    report = quota.join(drawn, ["plan_id", "bucket"], "left").select(
        "plan_id", "bucket", "wanted", "available", F.coalesce("drawn", F.lit(0)).alias("drawn"), (F.coalesce("drawn", F.lit(0)) - F.col("wanted")).alias("residual"), (F.col("available") < F.col("wanted")).alias("short")
    )
    return sample, report

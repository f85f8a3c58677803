"""The n best items of every group, taken from the top in bands of score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline import runtime


def top_n(df: DataFrame, keys: list[str], score: str, ties: list[str], n: int = 3, low: float | None = None, high: float | None = None, bands: int = 3) -> DataFrame:
    """Up to ``n`` items per group, highest score first, then by ``ties`` ascending (nulls first).

    An item is told by ``keys`` and ``ties``: rows that repeat it count once,
    with the highest of their scores.  Rows with a null in ``keys[-1]``, or a
    score that is null, NaN or outside ``low``..``high``, don't count; nulls
    in the other keys and in ties are values like any other.  Gives ``keys``,
    ``ties`` and ``score``; other columns are ignored; an empty table gives no
    rows.

    Scores are cut into ranges by quantiles of all rows, so that equal scores
    share a band, and written once by range.  From the top, each band drops the groups already filled,
    removes repeats (combined before the shuffle), and ranks what is left, of
    which each task passes on at most ``2n - 1`` items per group: a group of
    any size never meets in one task.
    """
    if n < 1:
        raise ValueError("n must be positive")
    spark, names = df.sparkSession, [*keys, *ties]
    clean = {c: f"c{i}" for i, c in enumerate(names)}
    k, t = [clean[c] for c in keys], [clean[c] for c in ties]
    rows = df.select(*(F.col(c).alias(clean[c]) for c in names), F.col(score).alias("s"))
    rows = rows.where(F.col(k[-1]).isNotNull() & F.col("s").isNotNull() & ~F.isnan(F.col("s").cast("double")))
    if low is not None:
        rows = rows.where(F.col("s") >= low)
    if high is not None:
        rows = rows.where(F.col("s") <= high)
    grid = 64
    stats = rows.agg(F.count("*").alias("rows"), F.approx_count_distinct(F.struct(*k)).alias("groups"), F.percentile_approx("s", [i / grid for i in range(1, grid)], 2000).alias("q")).first()
    # The first band holds about twice what the groups need, each next one four times as much.
    edges, share = [], 2 * n * stats.groups / max(1, stats.rows)
    while stats.rows and len(edges) < bands - 1 and (share < 1 or not edges):
        edges.append(stats.q[min(grid - 2, max(0, round((1 - share) * grid) - 1))])
        share *= 4
    edges = sorted(set(edges), reverse=True)
    space, picked = runtime.Workspace(spark, "top"), []
    order = [F.desc("s"), *(F.asc_nulls_first(c) for c in t)]
    same = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    # Bands are counted from the top; each is a folder of its own, so that the table is cut into ranges once.
    number = reduce(lambda n, e: n + F.when(F.col("s") < e, 1).otherwise(0), edges, F.lit(0))
    rows = space.cut(rows.withColumn("band", number), "bands", ["band"])
    for i in range(len(edges) + 1):
        band = rows.where(F.col("band") == i).drop("band")
        if picked:
            taken = reduce(DataFrame.unionByName, picked)
            have = taken.groupBy(*k).agg(F.count("*").alias("have"))
            band = band.alias("a").join(have.where(F.col("have") >= n).alias("b"), same("a", "b", k), "left_anti")
        band = band.groupBy(*k, *t).agg(F.max("s").alias("s"))
        rank = F.row_number().over(W.partitionBy(*k).orderBy(*order))
        if not picked:
            best = band.withColumn("r", rank).where(F.col("r") <= n)
        else:
            # An item taken in a higher band may stand here again with a lower score.
            best = band.withColumn("r", rank).where(F.col("r") <= 2 * n - 1)
            best = best.alias("a").join(taken.alias("b"), same("a", "b", [*k, *t]), "left_anti").select("a.*")
            best = best.alias("a").join(have.alias("b"), same("a", "b", k), "left").select("a.*", F.coalesce("have", F.lit(0)).alias("have"))
            best = best.withColumn("r", rank).where(F.col("r") + F.col("have") <= n)
        picked.append(space.cut(best.select(*k, *t, "s"), "band"))
    out = reduce(DataFrame.unionByName, picked)
    return out.select(*(F.col(clean[c]).alias(c) for c in names), F.col("s").alias(score))

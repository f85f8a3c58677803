"""One group identifier for all records linked directly or through others.

Low-diameter decomposition: every vertex draws an exponential shift; clusters
grow breadth first from the vertices whose shifted start time has come, and a
vertex joins the cluster that reaches it first.  After a few rounds every
vertex lies in a cluster of small diameter; clusters become the vertices of
the next level, edges inside them vanish, and the levels' assignments are
composed from the last one back.  Once the graph of a level is counted to be
small, one task takes the same way with what is left of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline import runtime
from sightline.operators.components import TASK_BYTES, TASK_EDGES

MAX_LEVELS = 200


def match_groups(pairs: DataFrame, left: str, right: str, beta: float = 0.5, rounds: int = 3, seed: int = 1) -> DataFrame:
    """``id`` and ``group_id`` of every record in a group of two or more.

    ``group_id`` is the group's smallest id.  Pairs with a null side and self
    pairs link nothing; repeated pairs and pairs in either order count once;
    other columns are ignored; no pairs give no rows.

    Within a level, work follows the edges that still join different clusters;
    proposals to a vertex are combined before the shuffle, and edges of a hub
    collapse at the first contraction (the splitting of skewed join partitions
    spreads them until then).
    """
    space = runtime.Workspace(pairs.sparkSession, "groups")
    a, b = F.col(left), F.col(right)
    edges = pairs.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), (a.isNotNull() & b.isNotNull() & (a != b)).alias("ok")).where("ok").select("x", "y").distinct()
    edges = space.cut(edges, "edges")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        if len(levels) == MAX_LEVELS:
            raise RuntimeError(f"edges are left after {MAX_LEVELS} levels")
        clusters = _decompose(space, edges, beta, rounds, seed + len(levels))
        levels.append(clusters)
        cx, cy = clusters.select(F.col("v").alias("x"), F.col("c").alias("cx")), clusters.select(F.col("v").alias("y"), F.col("c").alias("cy"))
        between = edges.join(cx, "x").join(cy, "y").where("cx <> cy").select(F.least("cx", "cy").alias("x"), F.greatest("cx", "cy").alias("y")).distinct()
        smaller = space.cut(between, "edges")
        space.drop(edges)
        edges = smaller
        if runtime.is_small(edges, TASK_EDGES, TASK_BYTES):
            kind = dict(edges.dtypes)["x"]
            levels.append(space.cut(edges.coalesce(1).mapInPandas(_finish(beta, rounds, seed), f"v {kind}, c {kind}"), "finished"))
            break
    if not levels:
        return edges.select(F.col("x").alias("id"), F.col("y").alias("group_id"))
    root = levels.pop()
    while levels:
        above = root.select(F.col("v").alias("c"), F.col("c").alias("root"))
        root = levels.pop().join(above, "c", "left").select("v", F.coalesce("root", "c").alias("c"))
    root = space.cut(root, "roots")
    names = space.cut(root.groupBy("c").agg(F.min("v").alias("group_id")), "names")
    return runtime.lookup(root, names, ["c"]).select(F.col("v").alias("id"), "group_id")


def grouped(x: np.ndarray, y: np.ndarray, n: int, beta: float, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """A group number for each of ``n`` vertices of the edges x-y, by the same decomposition, level by level."""
    group = np.arange(n)
    while len(x):
        start = np.maximum(0.0, rounds + np.log(rng.random(n)) / beta)
        now = np.floor(start).astype(int)
        part, centre, at = start - now, np.arange(n), np.where(now == 0, 0, -1)
        src, dst = np.concatenate([x, y]), np.concatenate([y, x])
        for r in range(1, rounds + 1):
            free = at < 0
            e = (at[src] == r - 1) & free[dst]
            own = np.flatnonzero(free & (now == r))
            to, by = np.concatenate([dst[e], own]), np.concatenate([centre[src[e]], own])
            share = np.concatenate([part[src[e]], part[own]])
            order = np.lexsort((by, share, to))
            to, by, share = to[order], by[order], share[order]
            first = np.concatenate([[True], to[1:] != to[:-1]]) if len(to) else np.zeros(0, bool)
            at[to[first]], centre[to[first]], part[to[first]] = r, by[first], share[first]
        group = centre[group]
        a, b = centre[x], centre[y]
        apart = a != b
        pairs = np.unique(np.stack([np.minimum(a, b)[apart], np.maximum(a, b)[apart]], 1), axis=0)
        x, y = pairs[:, 0], pairs[:, 1]
    return group


def _finish(beta: float, rounds: int, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        if not parts:
            return
        edges = pd.concat(parts)
        codes, names = pd.factorize(np.concatenate([edges["x"].to_numpy(object), edges["y"].to_numpy(object)]), sort=True)
        group = grouped(codes[: len(edges)], codes[len(edges) :], len(names), beta, rounds, np.random.default_rng(seed))
        yield pd.DataFrame({"v": names, "c": names[group]})

    return run


def _decompose(space: runtime.Workspace, edges: DataFrame, beta: float, rounds: int, seed: int) -> DataFrame:
    """A cluster ``c`` for every vertex ``v`` of ``edges``; clusters are named by their centres."""
    both = edges.select(F.col("x").alias("src"), F.col("y").alias("dst")).unionByName(edges.select(F.col("y").alias("src"), F.col("x").alias("dst")))
    # The seed goes in as text: numbers are compiled into the code, which would then be compiled anew for every level.
    u = (F.pmod(F.xxhash64(F.lit(f"level {seed}"), "v"), F.lit(2**52)) + 0.5) / float(2**52)
    start = F.greatest(F.lit(0.0), F.lit(float(rounds)) + F.log(u) / beta)
    state = both.select(F.col("src").alias("v")).distinct().withColumn("start", start)
    now = F.floor("start")
    mine = F.struct((F.col("start") - now).alias("part"), F.col("v").alias("c"))
    state = state.select("v", "start", F.when(now == 0, mine).alias("won"), F.when(now == 0, 0).alias("at"))
    state = space.cut(state, "state0")
    for r in range(1, rounds + 1):
        front = state.where(F.col("at") == r - 1).select(F.col("v").alias("src"), "won")
        best = both.join(front, "src").groupBy(F.col("dst").alias("v")).agg(F.min("won").alias("offer"))
        offer = F.least(F.col("offer"), F.when(now == r, mine))  # least skips nulls
        fresh = F.col("won").isNull() & offer.isNotNull()
        after = state.join(best, "v", "left").select("v", "start", F.coalesce("won", offer).alias("won"), F.when(fresh, r).otherwise(F.col("at")).alias("at"))
        after = space.cut(after, f"state{r}")
        space.drop(state)
        state = after
    return state.select("v", F.col("won.c").alias("c"))

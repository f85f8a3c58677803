"""Connected components by hooking and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline import runtime

#: Edges, and bytes of their names, that one task finishes by the same steps.
TASK_EDGES, TASK_BYTES = 500_000, 64 << 20


def rooted(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """A root for each of ``n`` vertices of the edges x-y, by hooking and pointer jumping: the smallest vertex that it is linked to."""
    root = np.arange(n)
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped


def _finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(frames)
    if not parts:
        return
    edges = pd.concat(parts)
    codes, names = pd.factorize(np.concatenate([edges["x"].to_numpy(object), edges["y"].to_numpy(object)]), sort=True)
    root = rooted(codes[: len(edges)], codes[len(edges) :], len(names))
    yield pd.DataFrame({"node": names, "root": names[root]})


def components(space: runtime.Workspace, edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` of every node of ``edges`` (columns x, y).

    Every node hooks onto its smallest neighbour if that is smaller; pointers
    are then doubled until they rest at roots, edges are contracted to the
    roots, and what is left is hooked again.  Once the edges left are counted
    to be few, one task takes the same steps with them.  ``root`` is some node
    of the component, alike for all.  Self loops and rows with nulls give no
    node; repeated edges count once; no edges give no rows.
    """
    levels = []
    edges = space.cut(edges.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    kind = dict(edges.dtypes)["x"]
    while not edges.isEmpty():
        if runtime.is_small(edges, TASK_EDGES, TASK_BYTES):
            levels.append(space.cut(edges.coalesce(1).mapInPandas(_finish, f"node {kind}, root {kind}"), "finished"))
            break
        up = edges.groupBy(F.col("y").alias("node")).agg(F.min("x").alias("root"))
        low = edges.select(F.col("x").alias("node")).distinct().join(up, "node", "left_anti")
        ptr = space.cut(up.unionByName(low.select("node", F.col("node").alias("root"))), "pointers")
        while True:
            step = ptr.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = space.cut(ptr.select("node", "root").join(step, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "jumped")
            moved = not jumped.where("moved").isEmpty()
            space.drop(ptr)
            ptr = jumped
            if not moved:
                break
        roots = ptr.select("node", "root")
        levels.append(roots)
        rx, ry = roots.select(F.col("node").alias("x"), F.col("root").alias("rx")), roots.select(F.col("node").alias("y"), F.col("root").alias("ry"))
        edges = space.cut(edges.join(rx, "x").join(ry, "y").where("rx <> ry").select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).distinct(), "edges")
    if not levels:
        return edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
    out = levels.pop()
    while levels:
        above = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        out = levels.pop().join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return space.cut(out, "components")


def named_by_smallest(space: runtime.Workspace, parts: DataFrame) -> DataFrame:
    """``parts`` with ``root`` changed to the smallest node of each component."""
    names = parts.groupBy("root").agg(F.min("node").alias("name"))
    return runtime.lookup(parts, names, ["root"]).select("node", F.col("name").alias("root"))

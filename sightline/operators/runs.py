"""The row before, and runs of rows, along hot keys: solved in chunks, carried across them.

Rows of one key are cut by their position (a time, a frame number) into
chunks; what a chunk needs of the earlier ones is a single value, found from
one summary row per key and chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline import runtime


def _same(a: str, b: str, cols: list[str]):
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]


def with_previous(df: DataFrame, keys: list[str], at: str, ties: list[str], chunk: int, out: str = "previous", number: str | None = None) -> DataFrame:
    """``df`` with ``out``, the value of ``at`` in the row before in order of (``at``, ``ties``); null in a key's first row.

    ``number``, if given, names a column for the row's number within its key,
    from 1.  Rows with a null ``at`` are dropped; null keys are a key.  ``ties``
    must order rows of one instant fully, or equal rows are numbered freely.
    """
    rows = df.where(F.col(at).isNotNull()).withColumn("_chunk", F.floor(F.col(at) / chunk))
    part = W.partitionBy(*keys, "_chunk").orderBy(at, *ties)
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_chunk").agg(F.max(at).alias("_top"), F.count("*").alias("_n"))
    sums = sums.select(*keys, "_chunk", F.max("_top").over(earlier).alias("_before"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_count"))
    rows = rows.alias("r").join(sums.alias("s"), _same("r", "s", [*keys, "_chunk"])).select("r.*", "_before", "_count")
    rows = rows.withColumn(out, F.coalesce(F.lag(at).over(part), F.col("_before")))
    if number:
        rows = rows.withColumn(number, F.col("_count") + F.row_number().over(part))
    return rows.drop("_chunk", "_before", "_count")


def with_run(df: DataFrame, keys: list[str], at: str, gap: int, chunk: int, out: str = "run") -> DataFrame:
    """``df`` with ``out``: the first ``at`` of the row's run, where a run ends when the next row is at least ``gap`` further on."""
    rows = df.where(F.col(at).isNotNull()).withColumn("_chunk", F.floor(F.col(at) / chunk))
    part = W.partitionBy(*keys, "_chunk").orderBy(at)
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    tops = rows.groupBy(*keys, "_chunk").agg(F.max(at).alias("_top"))
    tops = tops.select(*keys, "_chunk", F.max("_top").over(earlier).alias("_before"))
    rows = rows.alias("r").join(tops.alias("s"), _same("r", "s", [*keys, "_chunk"])).select("r.*", "_before")
    last = F.coalesce(F.lag(at).over(part), F.col("_before"))
    rows = rows.withColumn("_last", last).withColumn("_opens", F.when(F.col("_last").isNull() | (F.col(at) - F.col("_last") >= gap), F.col(at)))
    rows = rows.withColumn("_own", F.last("_opens", True).over(part.rowsBetween(W.unboundedPreceding, 0)))
    opened = rows.groupBy(*keys, "_chunk").agg(F.max("_opens").alias("_opened"))
    opened = opened.select(*keys, "_chunk", F.last("_opened", True).over(earlier).alias("_carried"))
    rows = rows.alias("r").join(opened.alias("s"), _same("r", "s", [*keys, "_chunk"])).select("r.*", "_carried")
    return rows.withColumn(out, F.coalesce("_own", "_carried")).drop("_chunk", "_before", "_last", "_opens", "_own", "_carried")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with a running number from 0 in ``order``, rows equal in it in any order.

    Rows are sorted over range partitions, counted there, and numbered from
    what the partitions before hold: no task sees more than its range.
    """
    space = runtime.Workspace(df.sparkSession, "numbered")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = space.cut(rows.withColumn("_id", F.monotonically_increasing_id()), "sorted")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = {r.p: r.n for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row for each partition
    base, table = 0, []
    for p in sorted(sizes):
        table.append((p, base))
        base += sizes[p]
    offsets = df.sparkSession.createDataFrame(table, "_p long, _base long")
    return rows.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_base") + place).drop("_p", "_base", "_id")

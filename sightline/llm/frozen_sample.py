"""A sample that never loses a member: bottom-k of salted hashes, frozen batch by batch."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline import runtime


def frozen_sample(df: DataFrame, id_col: str, batch_col: str, rate: Fraction, salt: str = "label") -> DataFrame:
    """Of each arrival batch exactly ceil(rate x size) ids, those of the smallest salted hashes.

    An id belongs to the first batch that delivers it and is decided there,
    however often it comes again; a batch's size is its number of ids.  As
    batches are immutable, rows of later batches change nothing that was
    chosen.  The hash is the hexadecimal MD5 of salt and id; equal hashes are
    ordered by id, so reruns and other partitionings choose alike.

    Gives ``id_col`` and ``batch_col``.  Rows without an id or, in all their
    deliveries, without a batch are left out; an empty table gives no rows;
    other columns are ignored.

    The k-th smallest hash of a batch is found without sorting it: hashes are
    counted in 65,536 bins per batch, and only the one bin that holds the k-th
    is ranked.
    """
    rate = Fraction(rate)
    if not 0 <= rate <= 1:
        raise ValueError("rate must lie in 0..1")
    rows = df.select(F.col(id_col).alias("id"), F.col(batch_col).alias("batch")).where("id IS NOT NULL AND batch IS NOT NULL")
    rows = rows.groupBy("id").agg(F.min("batch").alias("batch"))
    digest = F.md5(F.concat(F.lit(salt + ":"), F.col("id").cast("string")))
    rows = runtime.Workspace(df.sparkSession, "sample").cut(rows.withColumn("hash", digest).withColumn("bin", F.conv(F.substring("hash", 1, 4), 16, 10).cast("int")), "first")
    bins = rows.groupBy("batch", "bin").count()
    whole = W.partitionBy("batch")
    bins = bins.select("batch", "bin", "count", F.sum("count").over(whole.orderBy("bin")).alias("upto"), F.sum("count").over(whole).alias("size"))
    k = F.expr(f"(size * {rate.numerator} + {rate.denominator - 1}) div {rate.denominator}")
    cut = bins.withColumn("k", k).where("upto - count < k AND k <= upto").select("batch", F.col("bin").alias("last"), (F.col("k") - F.col("upto") + F.col("count")).alias("need"))
    rows = runtime.lookup(rows, cut, ["batch"])
    rank = F.row_number().over(W.partitionBy("batch", "bin").orderBy("hash", "id"))
    edge = rows.where("bin = last").withColumn("rank", rank).where("rank <= need")
    return rows.where("bin < last").select("id", "batch").unionByName(edge.select("id", "batch")).select(F.col("id").alias(id_col), F.col("batch").alias(batch_col))

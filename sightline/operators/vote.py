"""Many readings of one track to one string: the length first, then each character, by confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MIN_READS = 2
#: Confidences are summed as decimals, so that sums don't depend on the order of rows.
WEIGHT = "decimal(18,9)"


def vote(reads: DataFrame, keys: list[str], text: str = "text", confidence: str = "confidence", min_reads: int = MIN_READS) -> DataFrame:
    """A row per track with enough readings.

    Gives ``keys``, text, confidence, reads, agreement, per_character,
    runner_up, unanimous and weakest_position.  Empty and null texts, and
    confidences that are null, NaN or outside 0..1, are no readings; a track
    with fewer than ``min_reads`` is left out (readings of other lengths count
    here).  The length of most confidence wins (ties: the longer), then at
    each position the character of most confidence (ties: the smaller).
    ``confidence`` is mean agreement times the mean confidence of the readings
    of that length; ``runner_up`` is the heaviest other string of the length;
    ``weakest_position`` counts from 0 and is null when all agree.  Null keys
    are tracks of their own; empty input gives no rows.

    All sums are combined before the shuffle; a track of any size comes down
    to a row per length, position and character.
    """
    k = {c: f"k{i}" for i, c in enumerate(keys)}
    ks = list(k.values())
    rows = reads.select(*(F.col(c).alias(a) for c, a in k.items()), F.col(text).alias("t"), F.col(confidence).cast("double").alias("c"))
    rows = rows.where("t <> '' AND c BETWEEN 0 AND 1 AND NOT isnan(c)").withColumn("w", F.col("c").cast(WEIGHT)).withColumn("len", F.length("t"))
    texts = rows.groupBy(*ks, "len", "t").agg(F.sum("w").alias("w"), F.count("*").alias("n"))

    lengths = texts.groupBy(*ks, "len").agg(F.sum("w").alias("lw"), F.sum("w").cast("double").alias("lc"), F.sum("n").alias("ln"))
    whole = W.partitionBy(*ks)
    lengths = lengths.withColumn("reads", F.sum("ln").over(whole)).withColumn("r", F.row_number().over(whole.orderBy(F.desc("lw"), F.desc("len")))).where(f"r = 1 AND reads >= {int(min_reads)}")
    best = texts.alias("a").join(lengths.alias("b"), [F.col(f"a.{x}").eqNullSafe(F.col(f"b.{x}")) for x in (*ks, "len")]).select("a.*", "b.lc", "b.ln")

    chars = best.select(*ks, "w", F.posexplode(F.split("t", "")).alias("pos", "ch")).where("ch <> ''").groupBy(*ks, "pos", "ch").agg(F.sum("w").alias("w"))
    at = W.partitionBy(*ks, "pos")
    chars = chars.withColumn("total", F.sum("w").over(at)).withColumn("r", F.row_number().over(at.orderBy(F.desc("w"), "ch"))).where("r = 1")
    agreed = F.when(F.col("total") > 0, F.col("w").cast("double") / F.col("total").cast("double")).otherwise(0.0)
    line = F.array_sort(F.collect_list(F.struct("pos", "ch", agreed.alias("a"))))  # a plate's few characters
    voted = chars.groupBy(*ks).agg(line.alias("line"))
    voted = voted.select(*ks, F.array_join(F.transform("line", lambda x: x["ch"]), "").alias("text"), F.transform("line", lambda x: x["a"]).alias("a"))

    pair = lambda a, b: [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}")) for x in ks]
    rest = best.alias("a").join(voted.alias("b"), pair("a", "b")).select("a.*", "b.text", "b.a")
    first = F.struct(F.when(F.col("t") != F.col("text"), F.col("w")).alias("w"), F.col("t"))
    out = rest.withColumn("other", F.when(F.col("t") != F.col("text"), first)).withColumn("r", F.row_number().over(whole.orderBy(F.desc_nulls_last("other.w"), "t"))).where("r = 1")
    mean = F.aggregate("a", F.lit(0.0), lambda s, x: s + x, lambda s: s / F.size("a"))
    rounded = F.transform("a", lambda x: F.round(x, 3))
    return out.select(
        *(F.col(a).alias(c) for c, a in k.items()),
        "text",
        # To nine digits first, so that the last bits of a sum don't decide a tie.
        F.round(F.round(mean * F.col("lc") / F.col("ln"), 9), 3).alias("confidence"),
        F.col("ln").alias("reads"),
        F.round(mean, 3).alias("agreement"),
        rounded.alias("per_character"),
        F.col("other.t").alias("runner_up"),
        (F.round(mean, 3) >= 1.0).alias("unanimous"),
        F.when(F.round(mean, 3) < 1.0, F.array_position(rounded, F.array_min(rounded)) - 1).alias("weakest_position"),
    )

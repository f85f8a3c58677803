"""The same or nearly the same picture on both sides of a split, by an array of suffixes.

A picture's text is its 64-bit difference hash, and an array of its suffixes
is sorted (``suffix_array``): suffixes that share a long prefix lie in one run,
and runs with both sides of the split give the candidates, which are then
compared bit by bit.  Plain suffixes don't find every pair, as two hashes a few
bits apart may share no long run of bits, so the array also holds turned
texts: every suffix once more with one bit of its prefix turned.  With three
starting points and turned texts of the held-out side, no pair of up to five
bits escapes (three blocks with two differing bits each would make six); with
two starting points, turned texts of both sides do (two halves with three
each would make six).  The second has longer prefixes and so fewer chance hits, but more
texts: the number of hashes decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import runtime
from sightline.functions.text import split_side
from sightline.llm.suffix_array import cross_runs
from sightline.operators.duplicates import HALVES, HALVES_FROM, THIRDS, block_keys, hamming

#: Bits that may differ; the same across known, differing regions; range of brightness up to which a picture is blank.
MAX_BITS = 5
MAX_BITS_ACROSS = 2
BLANK_CONTRAST = 4


def near_hash_pairs(hashes: DataFrame, max_bits: int = MAX_BITS, turned: bool = True, many: bool | None = None) -> DataFrame:
    """``train``, ``held`` and ``bits`` of all pairs of distinct hashes, one used in train and one held out, that differ in 1..``max_bits`` bits.

    ``hashes`` has ``dhash`` and ``in_train``, ``in_held``; every hash once.
    Without ``turned`` the array holds plain suffixes only, and finds the pairs
    that share a block.  ``many`` says which starting points to take; if it
    isn't given the number of hashes does.
    """
    if not 0 <= max_bits <= 5:
        raise ValueError("these texts find all pairs of up to five bits")
    train, held = hashes.where("in_train").select("dhash"), hashes.where("in_held").select("dhash")
    if many is None:
        many = hashes.limit(HALVES_FROM).count() >= HALVES_FROM
    blocks = HALVES if many else THIRDS
    side = lambda df, t: df.select("block", "prefix", F.col("dhash").alias("text"), F.lit(t).alias("train"), F.lit(not t).alias("held"))
    of_train, of_held = side(block_keys(train, blocks, turned and many), True), side(block_keys(held, blocks, turned), False)
    runs = runtime.Workspace(hashes.sparkSession, "runs").cut(cross_runs(of_train.unionByName(of_held), tuple(size for _, size in blocks)), "runs")
    # Only suffixes of runs across the split go on.
    few = runtime.broadcast_if_small(runs)
    t, h = of_train.join(few, ["block", "prefix"], "left_semi").alias("t"), of_held.join(few, ["block", "prefix"], "left_semi").alias("h")
    bits = hamming(F.col("t.text"), F.col("h.text"))
    # The planner sizes the suffixes by the hashes they are made from, too small for a choice to broadcast them.
    met = t.join(h.hint("merge"), (F.col("t.block") == F.col("h.block")) & (F.col("t.prefix") == F.col("h.prefix")))
    return met.select(F.col("t.text").alias("train"), F.col("h.text").alias("held"), bits.alias("bits")).where(F.col("bits").between(1, max_bits)).distinct()


def cross_split_ends(hashes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of ``cross_split_pairs`` with ``held_id``, the end that is held out, and its ``split`` (val or test), each once.

    The split is that of the row that makes the pair: the recorded one, or the
    image's hash row.  A pair has several rows if rows of either end disagree.

    Hashes are compared once each: rows of one hash, region, blankness and
    split are gathered only where a pair is given out.
    """
    space = runtime.Workspace(hashes.sparkSession, "cross")
    region = F.when(F.col("region") != "XX", F.col("region"))
    rows = hashes.select("image_id", "dhash", (F.col("contrast") <= BLANK_CONTRAST).alias("blank"), region.alias("region"), split_side(F.col("split")).alias("split"))
    rows = rows.where("image_id IS NOT NULL AND dhash IS NOT NULL AND blank IS NOT NULL AND split IS NOT NULL").distinct()
    rows = space.cut(rows, "rows")

    t, h = rows.where("split = 'train'").alias("t"), rows.where("split <> 'train'").alias("h")
    ends = [F.least("t.image_id", "h.image_id").alias("left_id"), F.greatest("t.image_id", "h.image_id").alias("right_id"), F.col("h.image_id").alias("held_id"), F.col("h.split").alias("split")]
    equal = t.join(h, (F.col("t.dhash") == F.col("h.dhash")) & (F.col("t.blank") == F.col("h.blank"))).where("t.image_id <> h.image_id").select(*ends)

    train = F.col("split") == "train"
    distinct = rows.where("NOT blank").groupBy("dhash").agg(F.max(train).alias("in_train"), F.max(~train).alias("in_held"))
    near = space.cut(near_hash_pairs(distinct), "near")
    close = (
        near.alias("n").join(t.where("NOT t.blank"), F.col("n.train") == F.col("t.dhash"))
        .join(h.where("NOT h.blank"), F.col("n.held") == F.col("h.dhash"))
        .where(f"t.image_id <> h.image_id AND (bits <= {MAX_BITS_ACROSS} OR t.region IS NULL OR h.region IS NULL OR t.region = h.region)")
        .select(*ends)
    )
    a, b = split_side(F.col("left_split")), split_side(F.col("right_split"))
    said = pairs.where(f"left_id <> right_id AND distance BETWEEN 0 AND {MAX_BITS}").where((a == "train") != (b == "train"))
    said = said.select(
        F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"),
        F.when(a == "train", F.col("right_id")).otherwise(F.col("left_id")).alias("held_id"), F.when(a == "train", b).otherwise(a).alias("split"),
    )
    return equal.unionByName(close).unionByName(said).distinct()


def cross_split_pairs(hashes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``left_id``, ``right_id`` (smaller first) of different images, one in train and one in val or test, that are nearly the same.

    Either a recorded pair says so (distance 0..5 and both splits), or the
    image hashes do: equal hashes of two blank pictures or of two that aren't,
    or hashes 1..5 bits apart of pictures that aren't blank, 2 bits at most if
    both regions are known (not null, not XX) and differ.

    Rows with a null id, hash, split or contrast don't count (a recorded pair
    needs no contrast); splits are read without case and outer blanks; an
    image with several rows pairs by any of them; empty tables give no rows.
    """
    return cross_split_ends(hashes, pairs).select("left_id", "right_id").distinct()


def _source_of(image_id: Column, sources: DataFrame) -> Column:
    """``source_tag`` of the longest ``id_prefix`` that an id begins with; null if none does."""
    rows = sources.where("id_prefix IS NOT NULL AND source_tag IS NOT NULL").groupBy("id_prefix").agg(F.min("source_tag").alias("source_tag")).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("the source registry is a small table; this one isn't")
    longest = sorted(rows, key=lambda r: (-len(r.id_prefix), r.id_prefix))
    return F.coalesce(*(F.when(image_id.startswith(r.id_prefix), r.source_tag) for r in longest), F.lit(None).cast("string"))


def coverage(found: DataFrame, hashes: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Held-out images that are also in train: ``split``, ``source_tag``, ``pairs``, ``images``, for each held-out split and source.

    ``found`` is what ``cross_split_ends`` gives; only held-out ends count, an
    image of two held-out splits under each.  The source_tag is that of the
    image's hash rows (the smallest, if they differ), else that of the longest
    ``id_prefix`` in ``sources`` (id_prefix, source_tag) that its id has, else
    null.

    Bare pairs (``cross_split_pairs``) don't say which end is held out: there,
    the splits of the hash rows do, and an end without any counts under null.
    """
    known = hashes.where("image_id IS NOT NULL")
    if "held_id" not in found.columns:
        sides = known.select(F.col("image_id").alias("held_id"), split_side(F.col("split")).alias("split")).where("split IS NOT NULL").distinct()
        found = found.select("left_id", "right_id", F.explode(F.array("left_id", "right_id")).alias("held_id")).join(sides, "held_id", "left").where("split IS NULL OR split <> 'train'")
    n = found.groupBy(F.col("held_id").alias("image_id"), "split").agg(F.count("*").alias("pairs"))
    n = n.join(known.groupBy("image_id").agg(F.min("source_tag").alias("source_tag")), "image_id", "left")
    if sources is not None:
        n = n.withColumn("source_tag", F.coalesce("source_tag", _source_of(F.col("image_id"), sources)))
    return n.groupBy("split", "source_tag").agg(F.sum("pairs").alias("pairs"), F.count("*").alias("images"))

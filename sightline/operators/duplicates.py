"""Near-duplicate pictures: pairs by perceptual hash, clusters, and what they do to splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import runtime
from sightline.operators.components import components, named_by_smallest

# Bits that may differ, the same for pictures of different known regions, and the brightness range of a blank picture.
MAX_BITS, MAX_BITS_ACROSS, BLANK_RANGE = 5, 2, 4
GROUP_PREFIX = "dup:"
#: First bit and length of the blocks of a hash: three, of which the second side turns a bit, or two halves, of which both do.
THIRDS, HALVES = ((0, 21), (21, 21), (42, 22)), ((0, 32), (32, 32))
#: Hashes on the smaller side from which on chance hits on thirds cost more than the keys of halves.
HALVES_FROM = 2_000_000


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def block_keys(hashes: DataFrame, blocks: tuple[tuple[int, int], ...], turned: bool) -> DataFrame:
    """``hashes`` (with dhash), a row per ``block`` and ``prefix``; ``turned`` adds every prefix with one bit turned."""
    entries = []
    for k, (at, size) in enumerate(blocks):
        prefix = F.shiftrightunsigned(F.col("dhash"), at).bitwiseAND((1 << size) - 1)
        for flip in [0] + ([1 << i for i in range(size)] if turned else []):
            entries.append(F.struct(F.lit(k).alias("block"), prefix.bitwiseXOR(F.lit(flip).cast("long")).alias("prefix")))
    return hashes.withColumn("_e", F.explode(F.array(*entries))).select("*", "_e.block", "_e.prefix").drop("_e")


def near_hashes(left: DataFrame, right: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``left_hash``, ``right_hash``, ``bits`` of all pairs of hashes from two tables (dhash, each once) that differ in 1..``max_bits`` bits.

    Of two hashes within five bits, one of three blocks differs in one bit at
    most, so keys turned on one side meet keys as they are on the other: 70
    keys for both sides of a hash, and 2.6e-5 chance hits for each pair of
    hashes.  One of two halves differs in two bits at most, so halves with one
    bit turned on both sides meet as well: 132 keys, and 5e-7 chance hits.
    Both find all pairs; the number of hashes decides which is cheaper.
    """
    if not 0 <= max_bits <= 5:
        raise ValueError("these blocks find all pairs of up to five bits")
    many = min(left.limit(HALVES_FROM).count(), right.limit(HALVES_FROM).count()) >= HALVES_FROM
    blocks = HALVES if many else THIRDS
    a = block_keys(left.select("dhash"), blocks, many).withColumnRenamed("dhash", "left_hash")
    b = block_keys(right.select("dhash"), blocks, True).withColumnRenamed("dhash", "right_hash")
    bits = hamming(F.col("left_hash"), F.col("right_hash"))
    # The planner sizes the keys by the hashes they are made from, far too small for a choice to broadcast them.
    return a.join(b.hint("merge"), ["block", "prefix"]).withColumn("bits", bits).where(F.col("bits").between(1, max_bits)).select("left_hash", "right_hash", "bits").distinct()


def _clean(hashes: DataFrame) -> DataFrame:
    region = F.when(F.col("region") != "XX", F.col("region"))
    return hashes.select("image_id", "dhash", (F.col("contrast") <= BLANK_RANGE).alias("blank"), region.alias("region")).where("image_id IS NOT NULL AND dhash IS NOT NULL AND blank IS NOT NULL").distinct()


def _close(max_bits: int, across: int) -> str:
    return f"bits <= {min(max_bits, across)} OR (bits <= {max_bits} AND (a.region IS NULL OR b.region IS NULL OR a.region = b.region))"


def duplicate_pairs(hashes: DataFrame, max_bits: int = MAX_BITS, across: int = MAX_BITS_ACROSS) -> DataFrame:
    """``left_id``, ``right_id`` (smaller first) and ``distance`` of all near-duplicate pictures.

    Equal hashes pair among blank pictures and among others; hashes a few bits
    apart pair among pictures that aren't blank, up to ``max_bits``, or
    ``across`` where both regions are known and differ.  Rows without id, hash
    or contrast take no part; an image of several rows pairs by any of them,
    with the smallest distance.

    Copies are expanded into pairs here, for tables known to have few.  For
    others ``duplicate_class_pairs`` and ``duplicate_classes`` say the same
    without expanding them, and ``duplicate_clusters`` gives each image its
    cluster.
    """
    rows = runtime.Workspace(hashes.sparkSession, "pairs").cut(_clean(hashes), "rows")
    a, b = rows.alias("a"), rows.alias("b")
    ids = [F.col("a.image_id").alias("x"), F.col("b.image_id").alias("y")]
    equal = a.join(b, (F.col("a.dhash") == F.col("b.dhash")) & (F.col("a.blank") == F.col("b.blank"))).where("a.image_id < b.image_id").select(*ids, F.lit(0).alias("bits"))
    open_ = rows.where("NOT blank").select("dhash").distinct()
    near = near_hashes(open_, open_, max_bits).where("left_hash < right_hash").alias("n")
    close = near.join(a, F.col("n.left_hash") == F.col("a.dhash")).join(b, F.col("n.right_hash") == F.col("b.dhash")).where("NOT a.blank AND NOT b.blank AND a.image_id <> b.image_id").where(_close(max_bits, across)).select(*ids, "bits")
    both = equal.unionByName(close)
    return both.groupBy(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id")).agg(F.min("bits").alias("distance"))


def duplicate_classes(hashes: DataFrame, max_bits: int = MAX_BITS, across: int = MAX_BITS_ACROSS) -> DataFrame:
    """``image_id``, ``class_id`` and ``links`` of every picture: the pictures that look the same to the hash, and how many others are near it.

    A class is one (hash, blank, region), named by its smallest image.
    ``links`` counts pictures of the own class and of near ones, as
    ``duplicate_pairs`` pairs them, without expanding them into pairs: at each
    class, counts of classes are added.  A picture of several rows has a row,
    and links, for each of its classes.
    """
    space = runtime.Workspace(hashes.sparkSession, "classes")
    rows = space.cut(_clean(hashes), "rows")
    cls = F.concat_ws("|", F.col("dhash").cast("string"), F.col("blank").cast("string"), F.coalesce("region", F.lit("-")))
    rows = rows.withColumn("cls", cls)
    classes = space.cut(rows.groupBy("cls", "dhash", "blank", "region").agg(F.count("*").alias("n"), F.min("image_id").alias("class_id")), "classes")
    same = classes.groupBy("dhash", "blank").agg(F.sum("n").alias("same"))
    open_ = classes.where("NOT blank")
    near = near_hashes(open_.select("dhash").distinct(), open_.select("dhash").distinct(), max_bits).alias("p")
    a, b = open_.alias("a"), open_.alias("b")
    close = near.join(a, F.col("p.left_hash") == F.col("a.dhash")).join(b, F.col("p.right_hash") == F.col("b.dhash")).where(_close(max_bits, across))
    close = close.groupBy(F.col("a.cls").alias("cls")).agg(F.sum("b.n").alias("near"))
    links = F.col("same") - 1 + F.coalesce("near", F.lit(0))
    counted = classes.join(same, ["dhash", "blank"]).join(close, "cls", "left").select("cls", "class_id", links.alias("links"))
    return runtime.lookup(rows.select("image_id", "cls"), counted, ["cls"]).select("image_id", "class_id", "links")


def duplicate_class_pairs(hashes: DataFrame, max_bits: int = MAX_BITS, across: int = MAX_BITS_ACROSS) -> DataFrame:
    """``left_class``, ``right_class`` (smaller first), ``left_images``, ``right_images`` and ``distance`` of all pairs of classes whose pictures are near duplicates.

    A class is one (hash, blank, region), written with bars between; its
    pictures are near duplicates of each other, and ``duplicate_classes`` says
    which they are.  Every near-duplicate pair of ``duplicate_pairs`` lies in a
    class or between two classes of a row.
    """
    rows = _clean(hashes)
    name = F.concat_ws("|", F.col("dhash").cast("string"), F.col("blank").cast("string"), F.coalesce("region", F.lit("-")))
    classes = runtime.Workspace(hashes.sparkSession, "classes").cut(rows.groupBy("dhash", "blank", "region").agg(F.count("*").alias("n")).withColumn("cls", name), "classes")
    a, b = classes.alias("a"), classes.alias("b")
    both = [F.col("a.cls").alias("x"), F.col("b.cls").alias("y"), F.col("a.n").alias("m"), F.col("b.n").alias("n")]
    equal = a.join(b, (F.col("a.dhash") == F.col("b.dhash")) & (F.col("a.blank") == F.col("b.blank"))).where("a.cls < b.cls").select(*both, F.lit(0).alias("bits"))  # classes of one hash: a few regions
    open_ = classes.where("NOT blank").select("dhash").distinct()
    near = near_hashes(open_, open_, max_bits).where("left_hash < right_hash").alias("p")
    close = near.join(a, F.col("p.left_hash") == F.col("a.dhash")).join(b, F.col("p.right_hash") == F.col("b.dhash")).where("NOT a.blank AND NOT b.blank").where(_close(max_bits, across)).select(*both, "bits")
    first = F.col("x") < F.col("y")
    return equal.unionByName(close).select(
        F.least("x", "y").alias("left_class"), F.greatest("x", "y").alias("right_class"), F.when(first, F.col("m")).otherwise(F.col("n")).alias("left_images"), F.when(first, F.col("n")).otherwise(F.col("m")).alias("right_images"), F.col("bits").alias("distance")
    )


def duplicate_clusters(hashes: DataFrame, max_bits: int = MAX_BITS, across: int = MAX_BITS_ACROSS) -> DataFrame:
    """``image_id`` and ``cluster_id`` (prefix and smallest image_id) of every picture with a near duplicate.

    Links run between classes of equal (hash, blank, region), not between
    copies: classes of one hash are tied in a star.
    """
    space = runtime.Workspace(hashes.sparkSession, "clusters")
    rows = _clean(hashes)
    name = F.concat_ws("|", F.col("dhash").cast("string"), F.col("blank").cast("string"), F.coalesce("region", F.lit("-")))
    rows = space.cut(rows.withColumn("cls", name), "rows")
    classes = space.cut(rows.groupBy("cls", "dhash", "blank", "region").agg(F.count("*").alias("n")), "classes")
    hub = F.concat(F.lit("h|"), F.col("dhash").cast("string"), F.lit("|"), F.col("blank").cast("string"))
    star = classes.select(F.col("cls").alias("x"), hub.alias("y"))
    open_ = classes.where("NOT blank").select("dhash").distinct()
    near = near_hashes(open_, open_, max_bits).where("left_hash < right_hash").alias("n")
    a, b = classes.where("NOT blank").alias("a"), classes.where("NOT blank").alias("b")
    close = near.join(a, F.col("n.left_hash") == F.col("a.dhash")).join(b, F.col("n.right_hash") == F.col("b.dhash")).where(_close(max_bits, across)).select(F.col("a.cls").alias("x"), F.col("b.cls").alias("y"))
    # An image of several rows ties its classes together.
    own = rows.groupBy("image_id").agg(F.min("cls").alias("x"), F.max("cls").alias("top")).where("x <> top").select("image_id", "x")
    own = rows.join(own, "image_id").select("x", F.col("cls").alias("y"))
    parts = components(space, star.unionByName(close).unionByName(own))
    tagged = runtime.lookup(rows.select("image_id", "cls"), parts.select(F.col("node").alias("cls"), "root"), ["cls"]).select(F.col("image_id").alias("node"), "root").distinct()
    tagged = space.cut(tagged, "tagged")
    sizes = tagged.groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("name")).where("n > 1").select("root", "name")
    return runtime.lookup(tagged, sizes, ["root"]).select(F.col("node").alias("image_id"), F.concat(F.lit(GROUP_PREFIX), "name").alias("cluster_id"))


def regroup(records: DataFrame, clusters: DataFrame, key: str = "group_key") -> DataFrame:
    """``records`` (image_id, ``key``) with ``new_group``: a duplicate group where hashing reaches, else null.

    The closure runs over both relations, near duplicates and equal keys; a
    component is renamed only if hashing touched one of its images.  Equal
    keys are a star around the key, not pairs.  Clustered images that aren't
    among the records play no part.
    """
    space = runtime.Workspace(records.sparkSession, "regroup")
    clusters = clusters.join(records.select("image_id").distinct(), "image_id", "left_semi")
    img, grp = F.concat(F.lit("i:"), "image_id"), F.concat(F.lit("k:"), F.col(key))
    by_key = records.select(img.alias("x"), grp.alias("y"))
    by_hash = clusters.select(img.alias("x"), F.concat(F.lit("h:"), "cluster_id").alias("y"))
    parts = space.cut(named_by_smallest(space, components(space, by_key.unionByName(by_hash)).where("node LIKE 'i:%' OR node LIKE 'h:%'")), "parts")
    touched = parts.where("node LIKE 'h:%'").select("root").distinct()
    members = parts.where("node LIKE 'i:%'")
    names = members.join(touched, "root").groupBy("root").agg(F.min("node").alias("name"))
    new = runtime.lookup(members, names, ["root"]).select(F.expr("substr(node, 3)").alias("image_id"), F.concat(F.lit(GROUP_PREFIX), F.expr("substr(name, 3)")).alias("new_group"))
    return records.join(new, "image_id", "left")


def contaminating(left_split: Column, right_split: Column) -> Column:
    """Whether a pair lies across splits with train on one side."""
    return F.coalesce((left_split != right_split) & ((left_split == "train") | (right_split == "train")), F.lit(False))


def duplicate_report(pairs: DataFrame) -> DataFrame:
    """One row over pairs (left_split, right_split): pairs, within, across, contaminating."""
    across = F.col("left_split") != F.col("right_split")
    return pairs.agg(
        F.count("*").alias("pairs"), F.count_if(~across).alias("within"), F.count_if(across).alias("across"), F.count_if(contaminating(F.col("left_split"), F.col("right_split"))).alias("contaminating")
    )


def affected_images(pairs: DataFrame) -> DataFrame:
    """``split`` and ``image_id`` of the held-out images of contaminating pairs, each once."""
    hit = pairs.where(contaminating(F.col("left_split"), F.col("right_split")))
    ends = hit.select(F.explode(F.array(F.struct(F.col("left_split").alias("split"), F.col("left_id").alias("image_id")), F.struct(F.col("right_split").alias("split"), F.col("right_id").alias("image_id")))).alias("e")).select("e.*")
    return ends.where("split <> 'train'").distinct()


def clean_subset(records: DataFrame, pairs: DataFrame, split: str) -> DataFrame:
    """Records (image_id) of a split without those that a contaminating pair taints; ``records`` are the split's own."""
    return records.join(affected_images(pairs).where(F.col("split") == split).select("image_id"), "image_id", "left_anti")


def largest_clusters(clusters: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` largest clusters: cluster_id, images."""
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("images")).orderBy(F.desc("images"), "cluster_id").limit(n)


def with_splits(pairs: DataFrame, splits: DataFrame) -> DataFrame:
    """``pairs`` (left_id, right_id) with left_split and right_split from a table of image_id and split."""
    a, b = splits.select(F.col("image_id").alias("left_id"), F.col("split").alias("left_split")), splits.select(F.col("image_id").alias("right_id"), F.col("split").alias("right_split"))
    return pairs.join(a, "left_id").join(b, "right_id")

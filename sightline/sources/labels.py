"""Scans of annotated images: label files, export trees, manifests, crop labels."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.geometry import valid_box
from sightline.functions.identity import UPSTREAM_DIRS, clip_id

# File types of images.
IMAGE_TYPES = ("jpg", "jpeg", "png", "bmp", "webp")
#: Bytes of an image file that are read for its size at first; the whole file only if they don't tell.
HEADER_BYTES = 1 << 16
BOX = "struct<cx: double, cy: double, w: double, h: double, text: string, region: string>"
MANIFEST = f"image_id string, width int, height int, boxes array<{BOX}>, file_name string, split_group string, source string, meta map<string, string>"
#: In files the group goes by its plain name.
_JSON = MANIFEST.replace("split_group", "`group`")


def parse_label(body: Column, keep: tuple[int, ...] | None = None, region: str = "XX") -> Column:
    """A label file's text taken apart: struct(boxes, dropped, error).

    A line is ``class cx cy w h`` and may go on; blank lines are skipped.
    Boxes of classes not in ``keep`` are counted in ``dropped`` and not looked
    at further.  ``error`` tells the first bad line (too few fields, no
    numbers, a box outside the image), and is null if all are good; boxes are
    those of the good lines.  A null body gives null.
    """
    lines = F.transform(F.split(body, "\r\n|\r|\n"), lambda line, i: F.struct((i + 1).alias("no"), F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ").alias("f")))
    lines = F.filter(lines, lambda x: x["f"] != F.array(F.lit("")))
    number = lambda x, i: F.try_element_at(x["f"], F.lit(i)).try_cast("double")

    def entry(x: Column) -> Column:
        cls, box = number(x, 1).cast("int"), F.struct(*(number(x, i).alias(k) for i, k in ((2, "cx"), (3, "cy"), (4, "w"), (5, "h"))))
        short = F.size(x["f"]) < 5
        bad = cls.isNull() | box["cx"].isNull() | box["cy"].isNull() | box["w"].isNull() | box["h"].isNull()
        drop = ~cls.isin(list(keep)) if keep is not None else F.lit(False)
        why = F.when(short, F.concat(F.lit("expected 5 fields, got "), F.size(x["f"]).cast("string"))).when(bad, "not a number").when(drop, F.lit(None)).when(~valid_box(box), "box outside the image")
        full = F.struct(box["cx"].alias("cx"), box["cy"].alias("cy"), box["w"].alias("w"), box["h"].alias("h"), F.lit(None).cast("string").alias("text"), F.lit(region).alias("region"))
        return F.struct(full.alias("box"), (~short & ~bad & F.coalesce(drop, F.lit(False))).alias("dropped"), F.when(why.isNotNull(), F.concat(F.lit("line "), x["no"].cast("string"), F.lit(": "), why)).alias("error"))

    done = F.transform(lines, entry)
    boxes = F.transform(F.filter(done, lambda e: ~e["dropped"] & e["error"].isNull()), lambda e: e["box"])
    errors = F.filter(F.transform(done, lambda e: e["error"]), lambda e: e.isNotNull())
    return F.when(body.isNotNull(), F.struct(boxes.alias("boxes"), F.size(F.filter(done, lambda e: e["dropped"])).alias("dropped"), F.try_element_at(errors, F.lit(1)).alias("error")))


def header_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, JPEG, BMP, GIF or WebP; None if it isn't one."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return w, abs(h)
        if data[:4] == b"GIF8":
            return struct.unpack("<HH", data[6:10])
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if data[12:16] == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if data[:2] == b"\xff\xd8":
            i = 2
            while i + 9 < len(data):
                if data[i] != 0xFF:
                    return None
                if data[i + 1] in (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
                    h, w = struct.unpack(">HH", data[i + 5 : i + 9])
                    return w, h
                i += 2 + struct.unpack(">H", data[i + 2 : i + 4])[0]
    except struct.error:
        pass
    return None


def _file_system(path: str):
    """(file system, path there) of an address as Spark gives it."""
    from urllib.parse import quote

    from pyarrow import fs

    plain = re.sub("^file:/*", "/", path)
    return (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(quote(path, safe=":/@"))


def _size_at(path: str) -> tuple[int | None, int | None]:
    """(width, height) of the image at an address, from as little of it as will do; nulls if it is none."""
    own, at = _file_system(path)
    with own.open_input_file(at) as f:
        head = f.read(HEADER_BYTES)
        size = header_size(head)
        if size is None and head[:2] == b"\xff\xd8" and len(head) == HEADER_BYTES:
            size = header_size(head + f.read())
    return size or (None, None)


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """Images below ``folder``, by path: path, file (relative), stem, width, height; sizes are null where the header can't be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.lit(spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/")
    plain = F.regexp_replace("path", "^[a-z]+:/*", "/")
    # Without the content column the scan only lists the files.
    rows = files.select("path", F.substring(plain, F.length(root) + 1, F.length(plain)).alias("file"))
    rows = rows.where(F.lower(F.substring_index("file", ".", -1)).isin(list(IMAGE_TYPES)))
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("file", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sizes = [_size_at(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s[0] for s in sizes], pa.int32()), pa.array([s[1] for s in sizes], pa.int32())], names=["path", "file", "width", "height"])

    stem = F.regexp_replace(F.regexp_extract("file", "([^/]*)$", 1), r"\.[^.]*$", "")
    return rows.mapInArrow(run, schema).withColumn("stem", stem)


def label_files(spark: SparkSession, folder: str) -> DataFrame:
    """Label files directly in ``folder``: stem and body."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.txt$", "").alias("stem")
    read = files.select(stem, F.decode("content", "UTF-8").alias("body"))
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()

    # Readers skip empty files, which are labels without boxes; a task lists the folder for them.
    def empty(batches):
        import pyarrow as pa
        from pyarrow.fs import FileSelector

        for _ in batches:
            own, place = _file_system(at)
            names = [f.base_name[:-4] for f in own.get_file_info(FileSelector(place)) if f.base_name.endswith(".txt") and not f.size]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([""] * len(names), pa.string())], names=["stem", "body"])

    return read.unionByName(spark.range(0, 1, 1, 1).mapInArrow(empty, "stem string, body string"))


@dataclass
class Ingest:
    """Records of a scan, and what was left out: ``unlabelled`` (image_id), ``bad`` (image_id, error); ``dropped`` boxes are a column of ``seen``."""

    records: DataFrame
    unlabelled: DataFrame
    bad: DataFrame
    seen: DataFrame

    def report(self) -> DataFrame:
        """One row: images, plates, unlabelled, bad, dropped_boxes."""
        good = F.col("label").isNotNull() & F.col("label.error").isNull()
        zero = lambda c: F.coalesce(c, F.lit(0))
        return self.seen.agg(
            F.count_if(good).alias("images"), zero(F.sum(F.when(good, F.size("label.boxes")))).alias("plates"), F.count_if(F.col("label").isNull()).alias("unlabelled"),
            F.count_if(F.col("label.error").isNotNull()).alias("bad"), zero(F.sum(F.when(good, F.col("label.dropped")))).alias("dropped_boxes"),
        )


def yolo_tree(images: DataFrame, labels: DataFrame, source: str | None = None, region: str = "XX", keep: tuple[int, ...] | None = None, id_prefix: str = "", strict: bool = False, group: Column | None = None, meta: Column | None = None) -> Ingest:
    """Images (stem, file, width, height) with their labels (stem, body), as manifest records.

    An image without a label file, or with a bad one, isn't a record; with
    ``strict`` a bad label is an error that names the image and the line.
    """
    seen = images.join(labels, "stem", "left").withColumn("label", parse_label(F.col("body"), keep, region)).withColumn("image_id", F.concat(F.lit(id_prefix), "stem"))
    seen = seen.select("image_id", "file", "width", "height", "label", (group if group is not None else F.lit(None).cast("string")).alias("split_group"), (meta if meta is not None else F.create_map().cast("map<string, string>")).alias("meta"))
    boxes = F.col("label.boxes")
    if strict:
        boxes = F.when(F.col("label.error").isNotNull(), F.raise_error(F.concat("image_id", F.lit(": "), "label.error")).cast(f"array<{BOX}>")).otherwise(boxes)
    good = seen.where("label IS NOT NULL") if strict else seen.where("label IS NOT NULL AND label.error IS NULL")
    records = good.select("image_id", "width", "height", boxes.alias("boxes"), F.col("file").alias("file_name"), "split_group", F.lit(source).cast("string").alias("source"), "meta")
    return Ingest(records, seen.where("label IS NULL").select("image_id"), seen.where("label.error IS NOT NULL").select("image_id", F.col("label.error").alias("error")), seen)


def export_tree(spark: SparkSession, root: str, source: str, region: str = "XX", id_prefix: str = "", keep: tuple[int, ...] | None = None, by_clip: bool = True, strict: bool = False) -> Ingest:
    """A tree of train, valid, val and test folders, each with images and labels, pooled.

    Ids are ``<id_prefix><folder>-<stem>``; the folder stays in meta only, and
    frames of a clip share a group that doesn't tell the folder.  A tree with
    none of the folders is an error.
    """
    from sightline.runtime import exists

    parts = []
    for d in UPSTREAM_DIRS:
        if not (exists(spark, f"{root}/{d}/images") and exists(spark, f"{root}/{d}/labels")):
            continue
        images = image_files(spark, f"{root}/{d}/images").withColumn("file", F.concat(F.lit(f"{d}/images/"), "file"))
        own = F.concat(F.lit(f"{id_prefix}{d}-"), "stem")
        group = F.coalesce(F.concat(F.lit(id_prefix), clip_id(F.col("stem"))), own) if by_clip else own
        parts.append(yolo_tree(images, label_files(spark, f"{root}/{d}/labels"), source, region, keep, f"{id_prefix}{d}-", strict, group, F.create_map(F.lit("upstream_split"), F.lit(d))))
    if not parts:
        raise FileNotFoundError(f"{root} has none of the folders {', '.join(UPSTREAM_DIRS)} with images and labels")
    out = parts[0]
    for p in parts[1:]:
        out = Ingest(out.records.unionByName(p.records), out.unlabelled.unionByName(p.unlabelled), out.bad.unionByName(p.bad), out.seen.unionByName(p.seen))
    return out


def _manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of manifest files with ``path``, ``at`` (block and place, in the order of the file), ``r`` (the record) and ``error`` (null for good and blank lines)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")).withColumn("place", F.monotonically_increasing_id())
    known = F.from_json("value", "image_id string, width int, height int")
    made, blank = F.from_json("value", _JSON), F.trim("value") == ""
    bad_box = F.exists(F.coalesce(made["boxes"], F.array().cast(f"array<{BOX}>")), lambda b: ~valid_box(b))
    small = (F.coalesce(known["width"], F.lit(0)) <= 0) | (F.coalesce(known["height"], F.lit(0)) <= 0)
    why = F.when(blank, None).when(F.coalesce(known["image_id"], F.lit("")) == "", "malformed manifest line").when(small, "width and height must be positive").when(bad_box, "a box outside the image")
    return lines.select("path", F.struct("block", "place").alias("at"), "value", made.alias("r"), why.alias("error"), blank.alias("blank"))


def manifest_problems(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``line`` (from 1) and ``error`` of every line of manifest files that is no record; lines are numbered in files that have one only."""
    lines = _manifest_lines(spark, path).select("path", "at", "error")
    own = lines.join(lines.where("error IS NOT NULL").select("path").distinct(), "path", "left_semi")
    return own.withColumn("line", F.row_number().over(W.partitionBy("path").orderBy("at"))).where("error IS NOT NULL").select("path", "line", "error")


def read_manifest(spark: SparkSession, path: str, unique: bool = False) -> DataFrame:
    """Manifest records of JSON lines; blank lines are skipped, a malformed line is an error that names its file, absent fields get their defaults.

    With ``unique``, all lines are looked at beforehand: a bad one is an error
    with file and line, and so is an id that comes twice.
    """
    if unique:
        for r in manifest_problems(spark, path).orderBy("path", "line").limit(1).collect():
            raise ValueError(f"{r.path}:{r.line}: {r.error}")
    broken = F.raise_error(F.concat("path", F.lit(": "), F.col("error"), F.lit(": "), F.substring("value", 1, 80)))
    rows = _manifest_lines(spark, path).where("NOT blank").select(F.coalesce(F.when(F.col("error").isNotNull(), broken.cast(made_type(_JSON))), F.col("r")).alias("r")).select("r.*").withColumnRenamed("group", "split_group")
    boxes = F.transform(F.coalesce("boxes", F.array().cast(f"array<{BOX}>")), lambda b: b.withField("region", F.coalesce(b["region"], F.lit("XX"))))
    rows = rows.withColumn("boxes", boxes).withColumn("meta", F.coalesce("meta", F.create_map().cast("map<string, string>")))
    if unique:
        twice = repeated_ids(rows).limit(1).collect()
        if twice:
            raise ValueError(f"duplicate image_id {twice[0].image_id!r}")
    return rows


def made_type(schema: str) -> str:
    return "struct<" + schema + ">"


def repeated_ids(records: DataFrame) -> DataFrame:
    """image_id and count of ids that come more than once."""
    return records.groupBy("image_id").agg(F.count("*").alias("records")).where("records > 1")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """crop_id and text of a JSON file, a bare map or one under ``labels``; texts trimmed, in upper case, blanks dropped."""
    body = spark.read.option("wholetext", "true").text(path)
    nested = F.from_json("value", "labels map<string, string>")["labels"]
    rows = body.select(F.explode(F.coalesce(nested, F.from_json("value", "map<string, string>"))).alias("crop_id", "text"))
    return rows.select("crop_id", F.upper(F.trim("text")).alias("text")).where("text <> ''")

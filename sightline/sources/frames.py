"""What a source name stands for, and frame sources as tables."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.runs import numbered

# File types of stills.
STILL_TYPES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")


@dataclass(frozen=True)
class FrameSource:
    """A source by kind: camera, stream, stills or video; live ones may drop frames, stills share nothing between frames."""

    kind: str
    spec: str

    @property
    def live(self) -> bool:
        return self.kind in ("camera", "stream")

    @property
    def still(self) -> bool:
        return self.kind == "stills"


def open_source(spec: str | int, is_dir: bool = False) -> FrameSource:
    """A number is a camera, rtsp and http addresses are streams, a folder or an image file is stills, anything else a video."""
    text = str(spec)
    if isinstance(spec, int) or text.isdigit():
        return FrameSource("camera", text)
    if text.lower().startswith(("rtsp://", "rtsps://", "http://", "https://")):
        return FrameSource("stream", text)
    if is_dir or PurePosixPath(text).suffix.lower() in STILL_TYPES:
        return FrameSource("stills", text)
    return FrameSource("video", text)


def stills(spark: SparkSession, folder: str) -> DataFrame:
    """Images of a folder as frames: frame (by path, also for files that can't be decoded), source, width, height, and the image; undecodable files are left out."""
    files = spark.read.format("image").option("dropInvalid", "false").load(folder)
    rows = files.select(F.col("image.origin").alias("source"), "image").where(F.lower(F.regexp_extract("source", r"(\.[^.]*)$", 1)).isin(list(STILL_TYPES)))
    # Only names are ordered as a whole; the pictures stay where they are.
    numbers = numbered(rows.select("source"), ["source"], "frame").withColumn("frame", F.col("frame").cast("int"))
    return rows.where("image.width > 0").join(numbers, "source").select("source", "frame", F.col("image.width").alias("width"), F.col("image.height").alias("height"), "image")


def newest_only(frames: DataFrame, reader_ts: str = "read_us", capture_ts: str = "ts_us") -> DataFrame:
    """Load shedding of a live source: of the frames captured between two readings only the newest stays, with the number ``dropped``.

    ``frames`` has source, frame, ``capture_ts`` and ``reader_ts``, the instant of the reading that could take it.
    """
    return frames.groupBy("source", reader_ts).agg(F.max(F.struct(capture_ts, "frame")).alias("f"), (F.count("*") - 1).alias("dropped")).select("source", "f.frame", F.col(f"f.{capture_ts}").alias(capture_ts), "dropped")

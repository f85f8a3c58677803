"""The whole way from detections to the log: tracks, readings, votes, grammar, cooldown."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline import runtime
from sightline.functions import grammar
from sightline.operators import cooldown, tracker
from sightline.operators.vote import MIN_READS, vote
from sightline.sources.journal import accepted_times


@dataclass(frozen=True)
class Options:
    """How a run reads, votes and logs."""

    tracking: tracker.Settings = field(default_factory=tracker.Settings)
    ocr_every: int = 1
    min_reads: int = MIN_READS
    region: str | None = None
    max_edits: int = grammar.MAX_EDITS
    min_confidence: float = grammar.MIN_CONFIDENCE
    cooldown_us: int = cooldown.COOLDOWN_US

    def for_stills(self) -> Options:
        """The same for unrelated pictures: one hit and one reading are enough."""
        return Options(self.tracking.for_stills(), 1, 1, self.region, self.max_edits, self.min_confidence, self.cooldown_us)


def plate_log(tracks: DataFrame, reads: DataFrame, options: Options = Options(), journal: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(log, stats) of finished tracks and their readings.

    ``tracks`` has source, track_id, first_frame and ts_us, the instant at
    which the track ended; ``reads`` has source, track_id, text, confidence.
    A track with too few readings, or a vote that no grammar takes, isn't
    logged.  The log has plate, display, region, confidence (the weaker of
    vote and grammar), edits, track_id, frame (the track's first), source and
    ts_us; of one plate's rows within the cooldown the first stays.  With a
    ``journal`` (plate, ts, line) of an interrupted run, cooldowns go on from
    its events.

    ``stats`` is one row: tracks_completed, too_few_reads, rejected,
    suppressed, logged.
    """
    keys = ["source", "track_id"]
    voted = vote(reads, keys, min_reads=options.min_reads).select(*keys, F.col("text").alias("voted"), F.col("confidence").alias("vote_confidence"))
    rows = tracks.select(*keys, "first_frame", "ts_us").join(voted, keys, "left")
    rows = grammar.parse_plates(rows, "voted", "match", options.region, options.max_edits, options.min_confidence)
    rows = runtime.Workspace(tracks.sparkSession, "log").cut(rows, "voted")  # log and counts are taken from the same table
    good = rows.where("match IS NOT NULL").select(
        F.col("match.text").alias("plate"), grammar.display(F.col("match")).alias("display"), F.col("match.region").alias("region"), F.round(F.least("vote_confidence", "match.confidence"), 3).alias("confidence"),
        F.col("match.edits").alias("edits"), "track_id", F.col("first_frame").alias("frame"), "source", "ts_us",
    )
    if journal is None:
        cooled = cooldown.cooldown(good, "plate", "ts_us", ["source", "track_id"], options.cooldown_us).drop("sighting")
    else:
        cooled = cooldown.continued(good, accepted_times(journal), "plate", "ts_us", ["source", "track_id"], options.cooldown_us)
    stats = rows.agg(F.count("*").alias("tracks_completed"), F.count_if(F.col("voted").isNull()).alias("too_few_reads"), F.count_if(F.col("voted").isNotNull() & F.col("match").isNull()).alias("rejected"))
    logged = cooled.agg(F.count_if(~F.col("accepted")).alias("suppressed"), F.count_if("accepted").alias("logged"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # each side is a single row
    return cooled.where("accepted").drop("accepted"), one(stats).join(one(logged), "_one").drop("_one")


@dataclass(frozen=True)
class Run:
    """What a run did: ``log``, ``stats`` (one row), ``tracks`` (the confirmed ones, with ts_us), and one row of ``counts``: frames, detections, ocr_calls and the stats."""

    log: DataFrame
    stats: DataFrame
    tracks: DataFrame
    counts: DataFrame


def full_run(detections: DataFrame, texts: DataFrame, frames: DataFrame, options: Options = Options(), max_frames: int | None = None, journal: DataFrame | None = None, stop: DataFrame | None = None) -> Run:
    """From detections, a reader's texts, and frame times to the log.

    ``texts`` has source, frame, det_index, text and confidence: what the
    reader says of a detection; ``frames`` has source, frame and ts_us, frames
    numbered from 0.  A track is dated by the frame in which it ended, or the
    last one.  With ``max_frames``, a source's frames from that number on are
    as if they had never been; with ``stop`` (source, frame), those after a
    source's frame there.  A reader is called for every confirmed track
    alive in a frame that is read; where the frame doesn't show it there is no
    detection to have a text.
    """
    if max_frames is not None:
        detections, texts, frames = (df.where(F.col("frame") < max_frames) for df in (detections, texts, frames))
    if stop is not None:
        ends = stop.groupBy("source").agg(F.min("frame").alias("_stop"))
        detections, texts, frames = (runtime.lookup(df, ends, ["source"], "left").where("_stop IS NULL OR frame <= _stop").drop("_stop") for df in (detections, texts, frames))
    space = runtime.Workspace(detections.sparkSession, "run")
    live = space.cut(tracker.follow(detections, options.tracking, frames.groupBy("source").agg((F.max("frame") + 1).alias("frames"))), "live")
    requests = tracker.reading_requests(live, options.ocr_every)
    reads = requests.where("det_index IS NOT NULL").join(texts, ["source", "frame", "det_index"]).select("source", "track_id", "text", "confidence")
    tracks = tracker.track_table(live).where("confirmed")
    last = frames.groupBy("source").agg(F.max("frame").alias("_last"))
    tracks = tracks.join(last, "source").withColumn("frame", F.least("ended_at", "_last")).join(frames.select("source", "frame", "ts_us"), ["source", "frame"])
    log, stats = plate_log(tracks, reads, options, journal)
    shown = detections.select("source", "frame", "det_index").dropna().distinct()
    one = [df.agg(F.count("*").alias(n)).withColumn("_one", F.lit(1)) for df, n in ((frames.select("source", "frame").distinct(), "frames"), (shown, "detections"), (requests, "ocr_calls"))]  # single rows
    counts = one[0].join(one[1], "_one").join(one[2], "_one").join(stats.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return Run(log, stats, tracks, counts)


def run(detections: DataFrame, texts: DataFrame, frames: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(log, stats) of ``full_run``."""
    done = full_run(detections, texts, frames, options)
    return done.log, done.stats

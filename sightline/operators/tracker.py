"""Boxes of successive frames joined to tracks: greedy by overlap with each track's last box.

A sequence is a fold over its frames, but one that a long enough quiet
stretch resets: when no frame of more than ``max_age`` in a row has a
detection, every track has ended.  Sequences are cut there, and the pieces are
followed independently, each a stream over sorted rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline import runtime
from sightline.operators.runs import with_run

IOU, MAX_AGE, MIN_HITS = 0.3, 15, 3
#: Frames of a chunk, in looking for quiet stretches.
CHUNK_FRAMES = 10_000


@dataclass(frozen=True)
class Settings:
    """Least overlap, frames a track may miss, and hits that confirm it."""

    iou: float = IOU
    max_age: int = MAX_AGE
    min_hits: int = MIN_HITS

    def __post_init__(self) -> None:
        if not 0 < self.iou <= 1:
            raise ValueError("iou must lie in (0, 1]")
        if self.max_age < 0 or self.min_hits < 1:
            raise ValueError("max_age must be at least 0 and min_hits at least 1")

    def for_stills(self) -> Settings:
        """The same for unrelated pictures: one hit is enough."""
        return Settings(self.iou, self.max_age, 1)


def overlap(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda x: max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1])
    union = area(a) + area(b) - w * h
    return w * h / union if union > 0 else 0.0


@dataclass
class Live:
    """A track that may still be seen again."""

    ident: int
    box: tuple
    first: int
    last: int
    hits: int = 1
    age: int = 0
    confirmed: bool = False


@dataclass
class Sequence:
    """The tracks of one sequence, frame by frame."""

    settings: Settings
    live: list[Live] = field(default_factory=list)
    made: int = 0

    def advance(self, frame: int, boxes: list[tuple]) -> tuple[dict[int, Live], list[Live]]:
        """Take a frame's boxes; gives the track of each box (by place), and the confirmed tracks that ended."""
        s = self.settings
        offers = []
        for i, t in enumerate(self.live):
            x1, y1, x2, y2 = t.box
            for j, b in enumerate(boxes):
                if b[0] < x2 and b[2] > x1 and b[1] < y2 and b[3] > y1 and (v := overlap(t.box, b)) >= s.iou:
                    offers.append((-v, i, j))
        taken: dict[int, Live] = {}
        seen: set[int] = set()
        for _, i, j in sorted(offers):
            if i not in seen and j not in taken:
                seen.add(i)
                taken[j] = self.live[i]
        for j, t in taken.items():
            t.box, t.last, t.hits, t.age = boxes[j], frame, t.hits + 1, 0
        for i, t in enumerate(self.live):
            if i not in seen:
                t.age += 1
            t.confirmed = t.confirmed or t.hits >= s.min_hits
        for j, b in enumerate(boxes):
            if j not in taken:
                self.made += 1
                taken[j] = Live(self.made, b, frame, frame, confirmed=s.min_hits <= 1)
                self.live.append(taken[j])
        ended = [t for t in self.live if t.age > s.max_age]
        if ended:
            self.live = [t for t in self.live if t.age <= s.max_age]
        return taken, [t for t in ended if t.confirmed]


_SCHEMA = "source string, piece long, frame long, local_id long, det_index long, x1 double, y1 double, x2 double, y2 double, hits long, age long, confirmed boolean"


def _follow(settings: Settings, last_frame: bool):
    names = [p.split()[0] for p in _SCHEMA.split(", ")]

    def rows(key, frame, seq, taken, det):
        place = {id(t): j for j, t in taken.items()}
        for t in seq.live:
            j = place.get(id(t))
            if j is None and not t.confirmed:
                continue  # nothing reads it, and it may never be seen again
            yield (*key, frame, t.ident, None if j is None else det[j], *t.box, t.hits, t.age, t.confirmed)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, seq, at, boxes, det, end, out = None, None, None, [], [], None, []

        def flush():
            taken, _ = seq.advance(at, boxes)
            out.extend(rows(key, at, seq, taken, det))

        def quiet(upto):
            f = at + 1
            while f < upto and seq.live:
                taken, _ = seq.advance(f, [])
                out.extend(rows(key, f, seq, taken, []))
                f += 1

        for pdf in frames:
            for r in pdf.itertuples(index=False):
                k = (r.source, r.piece)
                if k != key or r.frame != at:
                    if key is not None:
                        flush()
                        quiet(r.frame if k == key else end + 1)
                    if k != key:
                        key, seq = k, Sequence(settings)
                    at, boxes, det, end = r.frame, [], [], r.last
                boxes.append((r.x1, r.y1, r.x2, r.y2))
                det.append(r.det_index)
            if out:
                yield pd.DataFrame(out, columns=names).astype({"det_index": "Int64"})
                out.clear()
        if key is not None:
            flush()
            quiet(end + 1)
        if out:
            yield pd.DataFrame(out, columns=names).astype({"det_index": "Int64"})

    return run


def follow(detections: DataFrame, settings: Settings = Settings(), lengths: DataFrame | None = None) -> DataFrame:
    """A row for every frame and every track that it shows or that is confirmed and alive: source, frame, track_id, det_index (null where the frame didn't show it), its box, hits, age, confirmed.

    ``detections`` has source, frame, det_index and x1, y1, x2, y2; frames are
    numbered without gaps, and those without rows have no detections.
    ``lengths`` has source and ``frames``, for sequences that go on after
    their last detection.  Rows with a null in any of these columns are left
    out; repeated rows count once; an empty table gives no rows.

    track_id counts 1, 2, 3... in order of creation within a source.
    """
    cols = ["source", "frame", "det_index", "x1", "y1", "x2", "y2"]
    rows = detections.select(*cols).dropna().distinct()
    pieces = with_run(rows, ["source"], "frame", settings.max_age + 2, CHUNK_FRAMES, "piece")
    # The quiet frames after a piece belong to it as far as its tracks can last.
    if lengths is None:
        ends = rows.groupBy("source").agg(F.max("frame").alias("last"))
    else:
        ends = lengths.groupBy("source").agg((F.max("frames") - 1).alias("last"))
    pieces = runtime.lookup(pieces, ends, ["source"], how="left").withColumn("last", F.greatest("last", "frame"))
    pieces = pieces.repartition("source", "piece").sortWithinPartitions("source", "piece", "frame", "det_index")
    space = runtime.Workspace(detections.sparkSession, "tracks")
    live = space.cut(pieces.mapInPandas(_follow(settings, lengths is not None), _SCHEMA), "live")
    made = live.groupBy("source", "piece").agg(F.max("local_id").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = made.select("source", "piece", before.alias("offset"))
    out = runtime.lookup(live, offsets, ["source", "piece"])
    return out.select("source", "frame", (F.col("local_id") + F.col("offset")).alias("track_id"), "det_index", "x1", "y1", "x2", "y2", "hits", "age", "confirmed")


def track_table(live: DataFrame) -> DataFrame:
    """A row per track: source, track_id, first_frame, last_frame, hits, duration, confirmed, and of confirmed ones ended_at (the first frame in which it was alive no more)."""
    out = live.groupBy("source", "track_id").agg(
        F.min("frame").alias("first_frame"), F.max(F.when(F.col("det_index").isNotNull(), F.col("frame"))).alias("last_frame"), F.max("hits").alias("hits"), F.max("confirmed").alias("confirmed"), F.when(F.max("confirmed"), F.max("frame") + 1).alias("ended_at")
    )
    return out.withColumn("duration", F.col("last_frame") - F.col("first_frame") + 1)


def reading_requests(live: DataFrame, every: int = 1) -> DataFrame:
    """Which boxes to read: those of confirmed live tracks in every ``every``-th frame, also where the box is from an earlier frame."""
    if every < 1:
        raise ValueError("every must be at least 1")
    return live.where(F.col("confirmed") & (F.pmod("frame", F.lit(every)) == 0)).select("source", "frame", "track_id", "det_index", "x1", "y1", "x2", "y2")


def best_sightings(history: DataFrame, keys: list[str] = ["source", "track_id"]) -> DataFrame:
    """Each track's detection of highest confidence (ties: the earliest frame, then det_index); null and NaN confidences don't count."""
    rows = history.where("confidence IS NOT NULL AND NOT isnan(confidence)")
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    top = F.max(F.struct("confidence", (-F.col("frame")).alias("f"), (-F.col("det_index")).alias("d")))
    return rows.groupBy(*keys).agg(top.alias("b")).select(*keys, "b.confidence", (-F.col("b.f")).alias("frame"), (-F.col("b.d")).alias("det_index"))

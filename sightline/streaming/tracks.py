"""The pipeline on streams: tracks, votes and cooldowns in keyed state, the log in an idempotent sink."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sightline import runtime
from sightline.functions import grammar
from sightline.operators.cooldown import continued
from sightline.operators.sessions import SessionTable
from sightline.operators.tracker import Sequence, Settings
from sightline.operators.vote import vote
from sightline.plans.pipeline import Options

READS = "source string, track_id long, first_frame long, ended_at long, ts_us long, hits long, texts array<struct<text: string, confidence: double>>"


def finished_tracks(frames: DataFrame, settings: Settings = Settings(), ocr_every: int = 1, idle: str = "10 minutes") -> DataFrame:
    """Each confirmed track once, when it ends, with its readings: source, track_id, first_frame, ended_at, ts_us, hits, texts.

    ``frames`` is a stream of source, frame, ts (its watermark column), and
    ``boxes``, an array of x1, y1, x2, y2, text, confidence; a frame without
    detections has an empty array and still ages tracks.  Frames of a source
    are taken in order within a trigger; one at or before the last taken is
    late and left out.  A source silent for ``idle`` beyond the watermark ends
    with all its tracks.  The state holds live tracks only.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, at, ts, texts = pickle.loads(state.get[0]) if state.exists else (Sequence(settings), -1, 0, {})
        out = []

        def end(tracks, frame, when):
            for t in tracks:
                out.append((key[0], t.ident, t.first, frame, when, t.hits, texts.pop(t.ident, [])))

        if state.hasTimedOut:
            end([t for t in seq.live if t.confirmed], at + 1, ts)
            state.remove()
        else:
            rows = pd.concat(list(batches))
            for r in rows.sort_values("frame").drop_duplicates("frame").itertuples():
                if r.frame <= at:
                    continue
                boxes = [] if r.boxes is None else list(r.boxes)
                taken, ended = seq.advance(int(r.frame), [(b["x1"], b["y1"], b["x2"], b["y2"]) for b in boxes])
                at, ts = int(r.frame), int(r.ts_us)
                if at % ocr_every == 0:
                    for j, t in taken.items():
                        if t.confirmed and boxes[j]["text"]:
                            texts.setdefault(t.ident, []).append({"text": boxes[j]["text"], "confidence": boxes[j]["confidence"]})
                end(ended, at, ts)
                alive = {t.ident for t in seq.live}
                texts = {k: v for k, v in texts.items() if k in alive}
            state.update((pickle.dumps((seq, at, ts, texts)),))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, ts // 1000) + idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in READS.split(", ")[:6]] + ["texts"])

    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = frames.select("source", "frame", "ts", F.unix_micros("ts").alias("ts_us"), "boxes").where("source IS NOT NULL AND frame IS NOT NULL AND ts IS NOT NULL")
    return rows.groupBy("source").applyInPandasWithState(step, READS, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def cooled(sightings: DataFrame, cooldown_us: int, ttl: str = "1 day") -> DataFrame:
    """A stream of plate and ts (its watermark column) with ``accepted``: plates last seen less than ``cooldown_us`` before are suppressed.

    Within a trigger sightings go by event time; one older than the plate's
    last is suppressed and changes nothing.  A plate unseen for ``ttl`` beyond
    the watermark is forgotten.
    """
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = state.get[0] if state.exists else None, []
        for t in sorted(int(x) for b in batches for x in b["ts_us"]):
            out.append((key[0], t, last is None or t - last >= cooldown_us))
            last = t if last is None else max(last, t)
        state.update((last,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, last // 1000) + ttl_ms)
        yield pd.DataFrame(out, columns=["plate", "ts_us", "accepted"])

    rows = sightings.select("plate", "ts", F.unix_micros("ts").alias("ts_us")).where("plate IS NOT NULL AND ts IS NOT NULL")
    return rows.groupBy("plate").applyInPandasWithState(step, "plate string, ts_us long, accepted boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


LOGGED = "plate string, display string, region string, confidence double, edits int, track_id long, frame long, source string, ts_us long, accepted boolean"


class PlateLog:
    """A log of plates that takes finished tracks trigger by trigger.

    Every trigger's rows lie in a folder named by its number, written whole
    and replaced if the trigger runs again, so a restart adds nothing twice.
    Beside them lies each plate's last sighting, suppressed ones included; one
    that lies ``keep`` before all of a trigger's rows is forgotten.
    ``compact`` gathers the rows of all triggers so far in one folder.
    """

    def __init__(self, spark: SparkSession, path: str, options: Options = Options(), keep: str = "30 days"):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self.keep_us = int(pd.Timedelta(keep).total_seconds() * 1_000_000)

    def _numbers(self, kind: str) -> list[int]:
        names = runtime.list_names(self.spark, f"{self.path}/done")
        return sorted(int(n.split("-")[1]) for n in names if n.startswith(f"{kind}-") and n.split("-")[1].isdigit())

    def _before(self, batch: int) -> list[int]:
        return [b for b in self._numbers("trigger") if b < batch]

    def _gathered(self) -> int:
        """The last trigger that is gathered; -1 if none is."""
        return max(self._numbers("upto"), default=-1)

    def __call__(self, tracks: DataFrame, batch: int) -> None:
        """The function for ``foreachBatch``."""
        if batch <= self._gathered():
            return
        with runtime.scope():
            self._take(tracks, batch)

    def _take(self, tracks: DataFrame, batch: int) -> None:
        keys = ["source", "track_id"]
        reads = tracks.select(*keys, F.explode("texts").alias("t")).select(*keys, "t.text", "t.confidence")
        voted = vote(reads, keys, min_reads=self.options.min_reads).select(*keys, F.col("text").alias("voted"), F.col("confidence").alias("vote_confidence"))
        rows = tracks.select(*keys, "first_frame", "ts_us").join(voted, keys)
        rows = grammar.parse_plates(rows, "voted", "match", self.options.region, self.options.max_edits, self.options.min_confidence).where("match IS NOT NULL")
        rows = rows.select(
            F.col("match.text").alias("plate"), grammar.display(F.col("match")).alias("display"), F.col("match.region").alias("region"), F.round(F.least("vote_confidence", "match.confidence"), 3).alias("confidence"),
            F.col("match.edits").alias("edits"), "track_id", F.col("first_frame").alias("frame"), "source", "ts_us",
        )
        seen = self._last(batch)
        kept = continued(rows, seen, "plate", "ts_us", ["source", "track_id"], self.options.cooldown_us)
        at = f"{self.path}/rows/trigger-{batch:012d}"
        kept.write.mode("overwrite").parquet(at)
        written = self.spark.read.schema(kept.schema).parquet(at)
        first = written.agg(F.min("ts_us")).first()[0]
        now = seen.unionByName(written.select("plate", F.col("ts_us").alias("last_us"))).groupBy("plate").agg(F.max("last_us").alias("last_us"))
        if first is not None:
            now = now.where(F.col("last_us") >= first - self.keep_us)
        now.write.mode("overwrite").parquet(f"{self.path}/seen/trigger-{batch:012d}")
        runtime.delete(self.spark, f"{self.path}/done/trigger-{batch:012d}")
        runtime.write_json(self.spark, f"{self.path}/done/trigger-{batch:012d}", {"trigger": batch})
        for b in self._before(batch)[:-1]:
            runtime.delete(self.spark, f"{self.path}/seen/trigger-{b:012d}")

    def _last(self, batch: int) -> DataFrame:
        done = self._before(batch)
        if not done:
            return self.spark.createDataFrame([], "plate string, last_us long")
        return self.spark.read.schema("plate string, last_us long").parquet(f"{self.path}/seen/trigger-{done[-1]:012d}")

    def _folders(self) -> list[str]:
        upto = self._gathered()
        own = [f"{self.path}/rows/upto-{upto:012d}"] if upto >= 0 else []
        return own + [f"{self.path}/rows/trigger-{b:012d}" for b in self._numbers("trigger") if b > upto]

    def compact(self) -> None:
        """Gather what all finished triggers wrote; the last trigger's number stays, as do the last sightings."""
        done = self._before(1 << 62)
        if len(self._folders()) < 2:
            return
        before, at = self._gathered(), f"{self.path}/rows/upto-{done[-1]:012d}"
        self.spark.read.schema(LOGGED).parquet(*self._folders()).hint("rebalance").write.mode("overwrite").parquet(at)
        runtime.write_json(self.spark, f"{self.path}/done/upto-{done[-1]:012d}", {"trigger": done[-1]})
        for b in done:
            runtime.delete(self.spark, f"{self.path}/rows/trigger-{b:012d}")
            if b != done[-1]:
                runtime.delete(self.spark, f"{self.path}/done/trigger-{b:012d}")
        if before >= 0:
            runtime.delete(self.spark, f"{self.path}/rows/upto-{before:012d}")
            runtime.delete(self.spark, f"{self.path}/done/upto-{before:012d}")

    def rows(self) -> DataFrame:
        """The log as far as triggers are done: accepted rows."""
        folders = self._folders()
        if not folders:
            return self.spark.createDataFrame([], LOGGED).drop("accepted")
        return self.spark.read.schema(LOGGED).parquet(*folders).where("accepted").drop("accepted")


def stream_log(frames: DataFrame, log: PlateLog, checkpoint: str, idle: str = "10 minutes"):
    """Start the stream from frames to the log; returns the query."""
    tracks = finished_tracks(frames, log.options.tracking, log.options.ocr_every, idle)
    return tracks.writeStream.foreachBatch(log).outputMode("append").option("checkpointLocation", checkpoint).start()


def stream_sessions(sightings: DataFrame, store: SessionTable, checkpoint: str, ts_us: str = "ts_us"):
    """Keep a session table up to date from a stream; a trigger that runs again finds its sightings in the table's ledger."""
    return sightings.writeStream.foreachBatch(lambda df, _: store.apply(df, ts_us)).outputMode("append").option("checkpointLocation", checkpoint).start()

"""Sessions of activity per key, in one pass or kept up to date batch by batch.

A sighting opens a new session when at least ``gap_us`` microseconds have
passed since the one before at the same key.  Hot keys never meet in one task:
rows are cut into time chunks, each chunk is solved where it lies, and only
one summary row per (key, chunk) is looked at along the whole key.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline import runtime

GAP_US = 300_000_000
CHUNK_US = 3_600_000_000
DAY_US = 86_400_000_000


def merge_intervals(df: DataFrame, keys: list[str], gap_us: int = GAP_US, chunk_us: int = CHUNK_US) -> DataFrame:
    """Merge intervals of one key that lie less than ``gap_us`` apart.

    ``df`` has ``keys``, ``start_us``, ``end_us`` and ``n``; the result has the
    same columns, with ``n`` summed.  Points are intervals with equal ends.

    Nulls in ``start_us`` or ``end_us`` drop the row; a null key is a key like
    any other.  An empty input gives an empty result; repeated rows add up in
    ``n``.  Other columns are ignored.  The order of rows and their
    partitioning don't matter.
    """
    rows = df.select(*keys, "start_us", "end_us", "n").where("start_us IS NOT NULL AND end_us IS NOT NULL")
    rows = rows.withColumn("_chunk", F.floor(F.col("start_us") / chunk_us))
    in_chunk = W.partitionBy(*keys, "_chunk").orderBy("start_us", "end_us")
    before = in_chunk.rowsBetween(W.unboundedPreceding, -1)
    along = W.partitionBy(*keys).orderBy("_chunk")
    earlier = along.rowsBetween(W.unboundedPreceding, -1)
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in (*keys, "_chunk")]

    # How far the intervals of earlier chunks reach: one row per key and chunk.
    reach = rows.groupBy(*keys, "_chunk").agg(F.max("end_us").alias("_reach"))
    reach = reach.select(*keys, "_chunk", F.max("_reach").over(earlier).alias("_reached"))
    r = rows.alias("r").join(reach.alias("s"), same("r", "s")).select("r.*", "_reached")
    last_end = F.greatest(F.max("end_us").over(before), F.col("_reached"))
    r = r.withColumn("_last", last_end).withColumn("_opens", F.when(F.col("_last").isNull() | (F.col("start_us") - F.col("_last") >= gap_us), F.col("start_us")))
    r = r.withColumn("_own", F.last("_opens", True).over(in_chunk.rowsBetween(W.unboundedPreceding, 0)))

    # Rows before a chunk's first opening belong to the session opened last in an earlier chunk.
    opened = r.groupBy(*keys, "_chunk").agg(F.max("_opens").alias("_opened"))
    opened = opened.select(*keys, "_chunk", F.last("_opened", True).over(earlier).alias("_carried"))
    r = r.alias("r").join(opened.alias("s"), same("r", "s")).select("r.*", "_carried")
    return (
        r.groupBy(*keys, F.coalesce("_own", "_carried").alias("_session"))
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n"))
        .drop("_session")
    )


def sessionize(df: DataFrame, keys: list[str], ts_us: str = "ts_us", identity: list[str] | None = None, gap_us: int = GAP_US, chunk_us: int = CHUNK_US) -> DataFrame:
    """Sessions of the sightings in ``df``: ``keys``, ``start_us``, ``end_us``, ``n``.

    ``identity`` names further columns that tell apart sightings of one key at
    one instant; rows equal in keys, instant and identity count once in ``n``.
    Rows without ``ts_us`` take no part; null keys and identities are values
    like any other.  Empty input gives no sessions.
    """
    identity = identity or []
    rows = df.select(*keys, F.col(ts_us).alias("_t"), *identity).where(F.col("_t").isNotNull())
    rows = rows.withColumn("_chunk", F.floor(F.col("_t") / chunk_us))
    part = W.partitionBy(*keys, "_chunk")
    w = part.orderBy("_t", *identity)
    again = F.lit(True)
    for c in ("_t", *identity):
        again = again & F.lag(c).over(w).eqNullSafe(F.col(c))
    rows = rows.withColumn("_prev", F.lag("_t").over(w)).withColumn("_one", F.when(F.col("_prev").isNotNull() & again, 0).otherwise(1))
    rows = rows.withColumn("_sid", F.sum(F.when(F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") >= gap_us), 1).otherwise(0)).over(w))
    local = rows.groupBy(*keys, "_chunk", "_sid").agg(F.min("_t").alias("start_us"), F.max("_t").alias("end_us"), F.sum("_one").alias("n"))
    # Only a chunk's first and last session can touch another chunk: two rows per key and chunk at most.
    local = local.withColumn("_edge", (F.col("_sid") == 1) | (F.col("_sid") == F.max("_sid").over(part)))
    along = W.partitionBy(*keys, "_edge").orderBy("_chunk", "_sid")
    apart = F.lag("end_us").over(along).isNull() | (F.col("start_us") - F.lag("end_us").over(along) >= gap_us)
    edges = local.where("_edge").withColumn("_run", F.sum(F.when(apart, 1).otherwise(0)).over(along))
    edges = edges.groupBy(*keys, "_run").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n")).drop("_run")
    return edges.unionByName(local.where("NOT _edge").select(*keys, "start_us", "end_us", "n"))


def near_stored(stored: DataFrame, local: DataFrame, keys: list[str], gap_us: int = GAP_US, chunk_us: int = CHUNK_US) -> DataFrame:
    """Rows of ``stored`` less than ``gap_us`` away from an interval of ``local`` at their key.

    Intervals meet in the chunks of time that they lie in, so that a hot key
    is spread over its chunks.
    """
    spans = lambda df, pad: df.withColumn("_chunk", F.explode(F.sequence(F.floor((F.col("start_us") - pad) / chunk_us), F.floor((F.col("end_us") + pad) / chunk_us))))
    s, n = spans(stored, 0).alias("s"), spans(local.select(*keys, "start_us", "end_us"), gap_us).alias("n")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in keys] + [F.col("s._chunk") == F.col("n._chunk")]
    close = (F.col("s.start_us") - F.col("n.end_us") < gap_us) & (F.col("n.start_us") - F.col("s.end_us") < gap_us)
    return s.join(n, [*same, close], "left_semi").drop("_chunk").distinct()


@dataclass
class SessionTable:
    """A stored session table that takes batches of sightings in any order of arrival.

    Sessions lie in folders by the day of their start.  A batch's own sessions
    are compared with the stored ones of the days within ``gap_us`` of it;
    components that it bridges are merged.  Only what changes is written: the
    new sessions, and marks that withdraw those they take the place of.  One
    small manifest, renamed into place, puts both in force together.  A reader
    sees the table before a batch or after it; a writer that dies leaves the
    table as it was, and of two writers at once one fails and can try again.  A
    day that has gathered more than ``pieces`` folders is written anew.

    ``ledger`` keeps the sightings seen, by day, so that one delivered again in
    a later batch isn't counted twice.
    """

    spark: SparkSession
    path: str
    keys: list[str]
    identity: list[str] = field(default_factory=list)
    gap_us: int = GAP_US
    chunk_us: int = CHUNK_US
    pieces: int = 16

    def _version(self) -> int:
        names = runtime.list_names(self.spark, f"{self.path}/manifests")
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def _manifest(self, version: int) -> dict:
        """For each day ``rows`` and ``dead``, folders of sessions and of withdrawn ones, and ``lo`` and ``hi``, the instants that its sessions lie between; and the ledger's folders by day."""
        return runtime.read_json(self.spark, f"{self.path}/manifests/{version}.json") if version else {"days": {}, "ledger": {}}

    def _read(self, folders: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _live(self, days: list[dict], schema) -> DataFrame:
        """The sessions of days that no later version withdrew."""
        dated = self.spark.createDataFrame([], schema).withColumn("version", F.lit(0).cast("long")).schema
        rows = self._read([f for d in days for f in d["rows"]], dated)
        if dead := [f for d in days for f in d["dead"]]:
            gone = self._read(dead, dated).select(*self.keys, "start_us", "version").alias("g")
            same = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in (*self.keys, "start_us")]
            rows = rows.alias("r").join(gone, [*same, F.col("r.version") < F.col("g.version")], "left_anti")
        return rows.drop("version")

    def _by_day(self, rows: DataFrame, version: int, at: str) -> list[str]:
        """Write sessions by the day of their start; gives the days written."""
        day = F.floor(F.col("start_us") / DAY_US)
        rows.withColumn("version", F.lit(version).cast("long")).withColumn("day", day).hint("rebalance", "day").write.partitionBy("day").parquet(at)
        return [n[4:] for n in runtime.list_names(self.spark, at) if n.startswith("day=")]

    def apply(self, batch: DataFrame, ts_us: str = "ts_us") -> int:
        """Merge a batch of sightings; returns the new version.

        Rows without ``ts_us`` take no part; an empty batch, or one of nothing
        but rows seen before, changes no session.
        """
        version = self._version()
        manifest = self._manifest(version)
        at = f"{self.path}/data/{version + 1:06d}"
        runtime.delete(self.spark, at)
        rows = batch.select(*self.keys, F.col(ts_us).alias("ts_us"), *self.identity).where("ts_us IS NOT NULL").withColumn("day", F.floor(F.col("ts_us") / DAY_US))
        if manifest["ledger"]:
            # Days are calendar days, so the list is bounded by the data's time span.
            days = [r.day for r in rows.select("day").distinct().collect()]
            old = [f for d in days for f in manifest["ledger"].get(str(d), [])]
            if old:
                ident = [*self.keys, "ts_us", *self.identity]
                seen = self._read(old, rows.drop("day").schema)
                rows = rows.alias("r").join(seen.alias("s"), [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ident], "left_anti")
        rows.distinct().hint("rebalance", "day").write.partitionBy("day").parquet(f"{at}/ledger")
        fresh_days = [n[4:] for n in runtime.list_names(self.spark, f"{at}/ledger") if n.startswith("day=")]
        rows = self.spark.read.schema(rows.schema).parquet(f"{at}/ledger")
        local = sessionize(rows, self.keys, "ts_us", self.identity, self.gap_us, self.chunk_us)

        # Stored days whose sessions reach within the gap of a day of the batch.
        new_days = sorted(map(int, fresh_days))

        def near(v: dict) -> bool:
            i = bisect_left(new_days, (v["lo"] - self.gap_us) // DAY_US - 1)
            return i < len(new_days) and new_days[i] * DAY_US <= v["hi"] + self.gap_us

        days = dict(manifest["days"])
        space = runtime.Workspace(self.spark, "sessions")
        if touched := [v for v in days.values() if near(v)]:
            local = space.cut(local, "local")
            met = space.cut(near_stored(self._live(touched, local.schema), local, self.keys, self.gap_us, self.chunk_us), "met")
            for d in self._by_day(met, version + 1, f"{at}/dead"):
                days[d] = days[d] | {"dead": [*days[d]["dead"], f"{at}/dead/day={d}"]}
            local = merge_intervals(met.unionByName(local), self.keys, self.gap_us, self.chunk_us)
        if self._by_day(local, version + 1, f"{at}/sessions"):
            written = self.spark.read.parquet(f"{at}/sessions")
            for r in written.groupBy("day").agg(F.min("start_us").alias("lo"), F.max("end_us").alias("hi")).collect():
                old = days.get(str(r.day), {"rows": [], "dead": [], "lo": r.lo, "hi": r.hi})
                days[str(r.day)] = {"rows": [*old["rows"], f"{at}/sessions/day={r.day}"], "dead": old["dead"], "lo": min(old["lo"], r.lo), "hi": max(old["hi"], r.hi)}
        days = self._compact(days, version + 1, local.schema)
        space.close()
        ledger = dict(manifest["ledger"])
        for d in fresh_days:
            ledger[d] = [*ledger.get(d, []), f"{at}/ledger/day={d}"]
        if not runtime.write_json(self.spark, f"{self.path}/manifests/{version + 1}.json", {"days": days, "ledger": ledger}):
            raise RuntimeError(f"another writer made version {version + 1}; apply the batch again")
        return version + 1

    def _compact(self, days: dict, version: int, schema) -> dict:
        many = [d for d, v in days.items() if len(v["rows"]) + len(v["dead"]) > self.pieces]
        if not many:
            return days
        at = f"{self.path}/data/{version:06d}/whole"
        written = set(self._by_day(self._live([days[d] for d in many], schema), version, at))
        whole = {d: days[d] | {"rows": [f"{at}/day={d}"] if d in written else [], "dead": []} for d in many}
        return days | whole

    def vacuum(self) -> None:
        """Remove what no longer counts: call it when no reader of an earlier version is left."""
        manifest = self._manifest(self._version())
        kept = {f for v in manifest["days"].values() for f in (*v["rows"], *v["dead"])} | {f for v in manifest["ledger"].values() for f in v}
        for name in runtime.list_names(self.spark, f"{self.path}/data"):
            for kind in runtime.list_names(self.spark, f"{self.path}/data/{name}"):
                at = f"{self.path}/data/{name}/{kind}"
                for day in runtime.list_names(self.spark, at):
                    if day.startswith("day=") and f"{at}/{day}" not in kept:
                        runtime.delete(self.spark, f"{at}/{day}")

    def sessions(self, schema) -> DataFrame:
        """The sessions now in force; ``schema`` gives the columns' types, for a table that is still empty."""
        return self._live(list(self._manifest(self._version())["days"].values()), schema)


def sighting_keys(plate_events: DataFrame) -> DataFrame:
    """Sightings with comparable plates: ``plate``, ``source``, ``ts_us``, ``track_id``, ``frame``, ``logged_at``.

    Plates keep A-Z and 0-9 only, in upper case.  Rows with no such character,
    or without ts or source, are left out.
    """
    plate = F.regexp_replace(runtime.ascii_upper(F.col("plate")), "[^A-Z0-9]", "")
    return plate_events.select(plate.alias("plate"), "source", F.unix_micros("ts").alias("ts_us"), "track_id", "frame", "logged_at").where("plate <> '' AND source IS NOT NULL AND ts_us IS NOT NULL")


def incremental_sessions(plate_events: DataFrame, batches: int = 3, gap_us: int = GAP_US, path: str | None = None) -> DataFrame:
    """Sessions of all plate sightings, built by applying ``batches`` batches in order of ``logged_at``.

    Rows without ``logged_at`` belong to the first batch.  Gives plate, source,
    start_us, end_us, duration_us and sightings.
    """
    spark = plate_events.sparkSession
    rows = sighting_keys(plate_events)
    store = SessionTable(spark, path or runtime.Workspace(spark, "sessions").path, ["plate", "source"], ["track_id", "frame"], gap_us)
    at = F.unix_micros("logged_at")
    edges = rows.select(F.percentile_approx(at, [i / batches for i in range(1, batches)], 1000).alias("q")).first().q or []
    edges = [None, *sorted(set(edges)), None]
    for lo, hi in zip(edges, edges[1:]):
        here = F.lit(True) if hi is None else at <= hi
        if lo is not None:
            here = here & (at > lo)
        store.apply(rows.where(F.coalesce(here, F.lit(lo is None))).drop("logged_at"))
    schema = rows.select("plate", "source", F.lit(0).cast("long").alias("start_us"), F.lit(0).cast("long").alias("end_us"), F.lit(0).cast("long").alias("n")).schema
    return store.sessions(schema).select("plate", "source", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), F.col("n").alias("sightings"))

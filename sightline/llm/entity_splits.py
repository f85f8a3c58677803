"""Train, validation and test splits that keep related records together, as records keep coming.

Records and what they share (a clip, a group) form a graph of keys.  Its
components are kept in stored tables; a batch adds keys and may bridge stored
components.  A stored component keeps its split for good; new ones fill the
splits' deficits; a component made of stored ones in different splits is
quarantined, as any split would leak.

A batch touches only what it reaches: stored rows are picked by its records,
keys and components, and only rows that change are written, beside the old
ones.  Small versions are merged into larger ones as they gather.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline import runtime
from sightline.operators.components import components

QUARANTINE = "quarantine"
#: A new component of more than 1/BIG of a batch is placed one by one; there are fewer than BIG of them.
BIG = 2000
#: Stored versions of like size that are merged into one.
MERGED = 8

_RECORDS = "record_id string, node string"
_NODES = "node string, comp string"
_COMPS = "comp string, root string, split string, size long, version long"


class EntitySplits:
    """The stored component table.  Each batch adds rows beside the old ones; a manifest renamed into place puts them in force together."""

    def __init__(self, spark: SparkSession, path: str, targets: dict[str, float], seed: int = 11):
        """``targets``: a share for each split; they are scaled to a sum of 1."""
        if not targets or min(targets.values()) < 0 or sum(targets.values()) <= 0:
            raise ValueError("targets need shares of at least 0 and a positive sum")
        self.spark, self.path, self.seed = spark, path, seed
        self.targets = {k: v / sum(targets.values()) for k, v in sorted(targets.items())}

    def _version(self) -> int:
        return max((int(n[:-5]) for n in runtime.list_names(self.spark, f"{self.path}/manifests") if n.endswith(".json")), default=0)

    def _manifest(self, version: int) -> dict:
        """``folders``, with how often each was merged, oldest first; ``sizes``, the records of each split."""
        return runtime.read_json(self.spark, f"{self.path}/manifests/{version}.json") if version else {"folders": [], "sizes": {}}

    def _read(self, name: str, schema: str, folders: list[str] | None = None) -> DataFrame:
        if folders is None:
            folders = [f for f, _ in self._manifest(self._version())["folders"]]
        paths = [f"{self.path}/data/{f}/{name}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _of(self, name: str, schema: str, keys: DataFrame) -> DataFrame:
        """Stored rows that have one of ``keys`` (of columns of their own)."""
        if not self._version():
            return self._read(name, schema)
        return self._read(name, schema).join(runtime.broadcast_if_small(keys.distinct()), keys.columns, "left_semi")

    def _newest(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("comp").agg(F.max_by(F.struct("root", "split", "size"), "version").alias("s")).select("comp", "s.*")

    def _comps(self) -> DataFrame:
        """The newest row of every component ever named."""
        return self._newest(self._read("comps", _COMPS))

    def _merge(self, folders: list[list], version: int) -> list[list]:
        """``folders`` with the newest ones merged, as long as MERGED of them were merged equally often."""
        while len(folders) >= MERGED and len({n for _, n in folders[-MERGED:]}) == 1:
            level = folders[-1][1] + 1
            last, name = [f for f, _ in folders[-MERGED:]], f"{version}-{level}"
            at = f"{self.path}/data/{name}"
            runtime.delete(self.spark, at)
            newest = F.max_by(F.struct("root", "split", "size", "version"), "version").alias("s")
            self._read("comps", _COMPS, last).groupBy("comp").agg(newest).select("comp", "s.*").write.parquet(f"{at}/comps")
            self._read("nodes", _NODES, last).hint("rebalance").write.parquet(f"{at}/nodes")
            self._read("records", _RECORDS, last).hint("rebalance").write.parquet(f"{at}/records")
            folders = [*folders[:-MERGED], [name, level]]
        return folders

    def vacuum(self) -> None:
        """Remove folders that no longer count: call it when no reader of an earlier version is left."""
        kept = {f for f, _ in self._manifest(self._version())["folders"]}
        for name in runtime.list_names(self.spark, f"{self.path}/data"):
            if name not in kept:
                runtime.delete(self.spark, f"{self.path}/data/{name}")

    def apply(self, batch: DataFrame) -> int:
        """Add records: ``record_id`` and ``keys``, the strings that each shares with its relatives.

        Rows without record_id are left out; null keys are skipped; a record
        without keys stands alone; a record seen before keeps its place, and
        new keys of it link; repeated rows change nothing.  An empty batch adds
        an empty version.
        """
        version = self._version()
        space = runtime.Workspace(self.spark, "splits")
        at = f"{self.path}/data/{version + 1}"
        runtime.delete(self.spark, at)
        rows = batch.select(F.col("record_id").cast("string").alias("record_id"), F.explode_outer("keys").alias("key")).where("record_id IS NOT NULL")
        rows = rows.withColumn("key", F.when(F.col("key").isNotNull(), F.concat(F.lit("k:"), "key"))).distinct()
        firsts = space.cut(rows.groupBy("record_id").agg(F.coalesce(F.min("key"), F.concat(F.lit("r:"), "record_id")).alias("first")), "records")
        known = self._of("records", _RECORDS, firsts.select("record_id")).withColumnRenamed("node", "old")
        firsts = space.cut(firsts.join(known, "record_id", "left"), "firsts") if version else firsts.withColumn("old", F.lit(None).cast("string"))
        links = rows.where("key IS NOT NULL").join(firsts, "record_id").select(F.col("first").alias("x"), F.col("key").alias("y"))
        links = links.unionByName(firsts.where("old IS NOT NULL").select(F.col("first").alias("x"), F.col("old").alias("y"))).where("x <> y").distinct()
        links = space.cut(links, "links")
        nodes = space.cut(firsts.select(F.col("first").alias("node")).union(links.select("x")).union(links.select("y")).distinct(), "keys")

        # Nodes of stored components stand for those; from here on, labels.
        stored = self._of("nodes", _NODES, nodes.select("node"))
        if version:
            stored = space.cut(stored, "stored")
        named = self._newest(self._of("comps", _COMPS, stored.select("comp"))).select("comp", F.col("root").alias("label"))
        if version:
            named = space.cut(named, "named")
        held = self._newest(self._of("comps", _COMPS, named.select(F.col("label").alias("comp")))).select(F.col("comp").alias("label"), "split", "size")
        stored = stored.join(named, "comp").select("node", "label")
        nodes = space.cut(nodes.join(stored, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.col("label").isNull().alias("new")), "nodes")
        lx, ly = nodes.select(F.col("node").alias("x"), F.col("label").alias("lx")), nodes.select(F.col("node").alias("y"), F.col("label").alias("ly"))
        parts = components(space, links.join(lx, "x").join(ly, "y").select(F.col("lx").alias("x"), F.col("ly").alias("y")))
        labels = nodes.select("label").distinct().join(parts.withColumnRenamed("node", "label"), "label", "left").select("label", F.coalesce("root", "label").alias("part"))
        labels = space.cut(labels.join(held, "label", "left"), "labels")

        fresh = firsts.where("old IS NULL").groupBy("first").agg(F.count("*").alias("more"))  # a key may hold most records, so they are counted first
        fresh = fresh.join(nodes.select(F.col("node").alias("first"), "label"), "first").groupBy("label").agg(F.sum("more").alias("more"))
        kept, splits = F.min(F.when(F.col("split").isNotNull(), F.col("label"))), F.collect_set("split")  # a set of split names: a handful
        whole = labels.join(fresh, "label", "left").groupBy("part").agg(
            F.coalesce(kept, F.min("label")).alias("root"), splits.alias("splits"), (F.coalesce(F.sum("size"), F.lit(0)) + F.coalesce(F.sum("more"), F.lit(0))).alias("size")
        )
        kind = F.when(F.size("splits") == 0, None).when(F.size("splits") == 1, F.col("splits")[0]).otherwise(QUARANTINE)
        whole = space.cut(whole.select("part", "root", "size", kind.alias("split")), "whole")
        manifest = self._manifest(version)
        # Of the stored sizes, what this batch touched counts as it leaves it.
        size = lambda df, sign: df.where("split IS NOT NULL").select("split", (F.col("size") * sign).alias("size"))
        change = lambda a, b: {r.split: r.n for r in size(a, 1).unionByName(size(b, -1)).groupBy("split").agg(F.sum("size").alias("n")).collect()}
        left = Counter(manifest["sizes"])
        left.update(change(whole, labels))
        placed = space.cut(whole.where("split IS NOT NULL").unionByName(self._place(whole.where("split IS NULL"), left)), "placed")
        left.update(change(placed, whole))

        # A stored name that has a new root takes all names along that pointed to it.
        moved = labels.where("split IS NOT NULL").join(placed.select("part", "root"), "part").where("label <> root").select(F.col("label").alias("root"), F.col("root").alias("now"))
        if version:
            moved = space.cut(moved, "moved")
        pointing = self._newest(self._of("comps", _COMPS, self._of("comps", _COMPS, moved.select("root")).select("comp")))
        aliases = pointing.select("comp", "root").join(moved, "root").select("comp", F.col("now").alias("root"), F.lit(None).cast("string").alias("split"), F.lit(0).cast("long").alias("size"))
        out = placed.select(F.col("root").alias("comp"), "root", "split", "size").unionByName(aliases).withColumn("version", F.lit(version + 1).cast("long"))
        out.write.parquet(f"{at}/comps")
        new_nodes = runtime.lookup(nodes.where("new").join(labels.select("label", "part"), "label"), placed.select("part", F.col("root").alias("comp")), ["part"]).select("node", "comp")
        new_nodes.write.parquet(f"{at}/nodes")
        firsts.where("old IS NULL").select("record_id", F.col("first").alias("node")).write.parquet(f"{at}/records")
        folders = self._merge([*manifest["folders"], [str(version + 1), 0]], version + 1)
        if not runtime.write_json(self.spark, f"{self.path}/manifests/{version + 1}.json", {"folders": folders, "sizes": left}):
            raise RuntimeError(f"another writer made version {version + 1}; apply the batch again")
        space.close()
        return version + 1

    def _place(self, new: DataFrame, sizes: dict[str, int]) -> DataFrame:
        """Splits for new components: the large ones one by one where most is missing, the many small ones by hash in the proportions then missing.

        ``sizes`` are those of the splits as this batch leaves the stored components; quarantined ones count for no split.
        """
        total = new.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
        have = {s: sizes.get(s, 0) for s in self.targets}
        goal = {s: t * (sum(have.values()) + total) for s, t in self.targets.items()}
        big_from = total // BIG + 1
        rank = F.xxhash64(F.lit(self.seed), "root")
        fixed = []
        for r in new.where(F.col("size") >= big_from).orderBy(F.desc("size"), rank, "root").collect():  # fewer than BIG rows
            best = max(self.targets, key=lambda s: (goal[s] - have[s], self.targets[s], s))
            have[best] += r.size
            fixed.append((r.root, best))
        gaps = {s: max(0.0, goal[s] - have[s]) for s in self.targets}
        if not sum(gaps.values()):
            gaps = self.targets
        u = F.pmod(rank, F.lit(1 << 30)) / float(1 << 30)
        upto, case = 0.0, None
        for s in [s for s, g in gaps.items() if g]:
            upto += gaps[s] / sum(gaps.values())
            case = F.when(u < upto, s) if case is None else case.when(u < upto, s)
            last = s
        case = case.otherwise(last)
        big = F.broadcast(self.spark.createDataFrame(fixed, "root string, split string"))
        return new.drop("split").join(big, "root", "left").select("part", "root", "size", F.coalesce("split", case).alias("split"))

    def records(self) -> DataFrame:
        """``record_id``, ``comp`` and ``split`` of every record."""
        comps = self._comps()
        tops = comps.where("comp = root").select("root", "split")
        nodes = self._read("nodes", _NODES).join(comps.select("comp", "root"), "comp").join(tops, "root").select("node", F.col("root").alias("comp"), "split")
        return runtime.lookup(self._read("records", _RECORDS), nodes, ["node"]).select("record_id", "comp", "split")

    def entities(self) -> DataFrame:
        """``entity_id`` (the smallest record_id of the set), ``record_id`` and ``split`` of every record with relatives."""
        rows = runtime.Workspace(self.spark, "entities").cut(self.records(), "records")
        sets = rows.groupBy("comp").agg(F.min("record_id").alias("entity_id"), F.count("*").alias("n")).where("n > 1").select("comp", "entity_id")
        return runtime.lookup(rows, sets, ["comp"]).select("entity_id", "record_id", "split")

    def report(self) -> DataFrame:
        """Records, share and target share of each split, quarantine included."""
        n = self.records().groupBy("split").agg(F.count("*").alias("records"))
        targets = self.spark.createDataFrame([*self.targets.items(), (QUARANTINE, 0.0)], "split string, target_share double")
        both = targets.join(n, "split", "left").select("split", "target_share", F.coalesce("records", F.lit(0)).alias("records"))
        return both.withColumn("share", F.col("records") / F.sum("records").over(W.partitionBy()))

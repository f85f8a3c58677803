"""From exports to a dataset: ingest, regroup duplicates, manifest, split, label tree, statistics; and its provenance."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import runtime
from sightline.functions.images import picture_hash
from sightline.operators import duplicates, splits, stats
from sightline.sinks import files
from sightline.sources import labels


@dataclass(frozen=True)
class Source:
    """A registered export: its folder below the raw data, and what its images are tagged with."""

    directory: str
    source_tag: str
    region: str
    id_prefix: str


def registry(sources: DataFrame) -> list[Source]:
    """Sources of a registry table (directory, source_tag, region, id_prefix), a small one: at most 10,000 rows."""
    rows = sources.select("directory", "source_tag", "region", "id_prefix").where("directory IS NOT NULL").distinct().orderBy("directory").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("the source registry is a small table; this one isn't")
    return [Source(*r) for r in rows]


def attribution(sources: DataFrame) -> DataFrame:
    """The sources to name, each with licence and address, those that may be passed on first."""
    from sightline.functions.text import redistributable

    return sources.select("source_tag", "licence", "url", redistributable(F.col("licence")).alias("redistributable")).orderBy(F.desc("redistributable"), "source_tag")


def ingest_sources(spark: SparkSession, raw_dir: str, sources: list[Source]) -> labels.Ingest:
    """All registered exports pooled; a missing folder, or no image at all, is an error."""
    out = None
    for s in sources:
        at = f"{raw_dir}/{s.directory}"
        if not runtime.exists(spark, at):
            raise FileNotFoundError(f"{at} is missing")
        one = labels.export_tree(spark, at, s.source_tag, s.region, s.id_prefix)
        one.records = one.records.withColumn("file_name", F.concat(F.lit(s.directory + "/"), "file_name"))
        out = one if out is None else labels.Ingest(out.records.unionByName(one.records), out.unlabelled.unionByName(one.unlabelled), out.bad.unionByName(one.bad), out.seen.unionByName(one.seen))
    if out is None or out.records.isEmpty():
        raise ValueError(f"no images found under {raw_dir}")
    return out


def hash_images(spark: SparkSession, raw_dir: str, records: DataFrame) -> DataFrame:
    """image_id, dhash, contrast and region of records' pictures; nulls where one can't be decoded or found."""
    pictures = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").option("pathGlobFilter", "*.{jpg,jpeg,png,bmp,webp}").load(raw_dir)
    root = raw_dir.rstrip("/") + "/"
    plain = F.regexp_replace("image.origin", "^[a-z]+:/*", "/")
    hashed = pictures.select(F.substring(plain, F.lit(len(root) + 1), F.length(plain)).alias("file_name"), picture_hash(F.col("image")).alias("h")).select("file_name", "h.*")
    keyed = stats.with_group_key(records).select("image_id", "file_name", "region")
    return keyed.join(hashed, "file_name", "left").select("image_id", "dhash", "contrast", "region")


@dataclass
class Dataset:
    """A built dataset: its records with group_key and split, and the paths written."""

    records: DataFrame
    manifest: str
    tree: str
    stats: DataFrame
    clusters: DataFrame | None


def build_dataset(spark: SparkSession, raw_dir: str, out_dir: str, sources: list[Source], seed: int = 0, ratios: dict[str, float] | None = None, check_duplicates: bool = True) -> Dataset:
    """The whole build.  The manifest, once written, is read back, and everything after it follows from it alone."""
    found = runtime.Workspace(spark, "build").cut(ingest_sources(spark, raw_dir, sources).records, "ingested")
    clusters = None
    if check_duplicates:
        clusters = duplicates.duplicate_clusters(hash_images(spark, raw_dir, found))
        keyed = stats.with_group_key(found).select("image_id", "group_key")
        new = duplicates.regroup(keyed, clusters).select("image_id", "new_group")
        found = found.join(new, "image_id").withColumn("split_group", F.coalesce("new_group", "split_group")).drop("new_group")
    manifest, tree = f"{out_dir}/manifest", f"{out_dir}/export"
    files.write_manifest(found, manifest)
    records = stats.with_group_key(labels.read_manifest(spark, manifest, unique=True))
    plan = splits.grouped_split(records, ratios, seed)
    splits.verify(records, plan, ratios)
    records = splits.assign(records, plan)
    files.write_tree(records, tree, image_root=raw_dir)
    return Dataset(records, manifest, tree, stats.dataset_stats(records), clusters)


def inspect_tree(spark: SparkSession, root: str) -> dict[str, object]:
    """What a written tree holds: labels of each split, annotations, and the fingerprint; a split without a label folder is an error."""
    parts = []
    for s in splits.SPLITS:
        at = f"{root}/labels/{s}"
        if not runtime.exists(spark, at):
            raise FileNotFoundError(f"missing label folder {at}")
        if runtime.list_names(spark, at):
            parts.append(labels.label_files(spark, at).select(F.lit(s).alias("split"), F.concat("stem", F.lit(".txt")).alias("name"), "body"))
    if not parts:
        rows = spark.createDataFrame([], "split string, name string, body string")
    else:
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
    counts = {r.split: r.images for r in splits.split_counts(rows).collect()}
    lines = F.size(F.filter(F.split("body", "\n"), lambda x: F.trim(x) != ""))
    return {"labels": counts, "annotations": rows.agg(F.coalesce(F.sum(lines), F.lit(0))).first()[0], "export_sha256": stats.export_fingerprint(rows)}


#: Parts of a provenance record.
PROVENANCE = ("dataset", "training", "resolved_optimizer", "checkpoint", "metrics", "evaluation", "environment", "code", "timestamps", "notes")


def provenance(facts: dict[str, object], paths: dict[str, str], records: DataFrame | None = None, metrics: dict[str, object] | None = None, **parts: object) -> dict[str, object]:
    """The parts of a provenance record from what was measured: ``facts`` of ``inspect_tree``, paths, and metrics (validation, test, test_by_region; those not given are null).

    ``records`` (with region) add the number of images of each region.
    """
    known = ("validation", "test", "test_by_region")
    if unknown := set(metrics or ()) - set(known):
        raise ValueError(f"unknown metrics: {', '.join(sorted(unknown))}")
    dataset: dict[str, object] = {"paths": paths, "split": facts["labels"], "images": sum(facts["labels"].values()), "annotations": facts["annotations"], "export_sha256": facts["export_sha256"]}
    if records is not None:
        dataset["regions"] = {r.region: r.images for r in records.groupBy("region").agg(F.count("*").alias("images")).orderBy("region").collect()}  # a handful of codes
    return {**parts, "dataset": dataset, "metrics": {k: (metrics or {}).get(k) for k in known}}


def write_provenance(path: str, **parts: object) -> dict[str, object]:
    """Write what was measured in a run; parts not given are null, other names are an error."""
    if unknown := set(parts) - set(PROVENANCE):
        raise ValueError(f"unknown parts: {', '.join(sorted(unknown))}")
    record = {k: parts.get(k) for k in PROVENANCE}
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(record, f, indent=2)
        f.write("\n")
    os.replace(path + ".tmp", path)
    return record

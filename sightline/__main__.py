"""python -m sightline: run a registered query, build a dataset, run the pipeline over tables, list crops to label, rebuild a workbook."""

from __future__ import annotations

import argparse
import json
import sys

from sightline.operators import sampling, stats
from sightline.plans import core_queries, dataset, pipeline
from sightline.runtime import session
from sightline.sinks import files
from sightline.sources import config, labels
from sightline.sources.journal import read_journal


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("sightline", description=__doc__)
    p.add_argument("--master", help="where Spark runs, if not set by spark-submit")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the registered queries")
    q = sub.add_parser("query", help="run a query over a folder of Parquet tables")
    q.add_argument("name")
    q.add_argument("--data", required=True)
    q.add_argument("--out", required=True)
    q.add_argument("--format", choices=("parquet", "orc", "json", "csv"), default="parquet")
    b = sub.add_parser("build", help="ingest exports, regroup duplicates, split, write manifest and label tree")
    b.add_argument("--raw", required=True)
    b.add_argument("--sources", required=True, help="Parquet table of directory, source_tag, region, id_prefix")
    b.add_argument("--out", required=True)
    b.add_argument("--seed", type=int, default=0)
    b.add_argument("--no-duplicate-check", action="store_true")
    u = sub.add_parser("run", help="from detections, texts and frames to the log; goes on from a journal if there is one")
    for name in ("detections", "texts", "frames"):
        u.add_argument(f"--{name}", required=True, help="Parquet table")
    u.add_argument("--out", required=True, help="folder for the log, as Parquet")
    u.add_argument("--options", help="YAML file of pipeline options")
    u.add_argument("--journal", help="journal of an interrupted run")
    u.add_argument("--max-frames", type=int)
    u.add_argument("--stills", action="store_true", help="frames are unrelated pictures")
    c = sub.add_parser("label", help="choose crops to label, as many of each size as of the others")
    c.add_argument("--manifest", required=True, help="manifest, as JSON lines")
    c.add_argument("--out", required=True, help="folder for the index, as JSON")
    c.add_argument("--count", type=int, default=200)
    r = sub.add_parser("recover", help="write a workbook anew from its journal")
    r.add_argument("--journal", required=True)
    r.add_argument("--workbook", required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(core_queries.QUERIES)))
        return 0
    if args.command == "query" and args.name not in core_queries.QUERIES:
        print(f"no query {args.name!r}; see list", file=sys.stderr)
        return 2
    spark = session("sightline", args.master)
    if args.command == "query":
        core_queries.QUERIES[args.name](spark, args.data).write.format(args.format).save(args.out)
    elif args.command == "build":
        built = dataset.build_dataset(spark, args.raw, args.out, dataset.registry(spark.read.parquet(args.sources)), args.seed, check_duplicates=not args.no_duplicate_check)
        print(json.dumps(built.stats.first().asDict()))
    elif args.command == "run":
        options = config.read_options(args.options) if args.options else pipeline.Options()
        done = pipeline.full_run(*(spark.read.parquet(getattr(args, n)) for n in ("detections", "texts", "frames")), options.for_stills() if args.stills else options, args.max_frames, read_journal(spark, args.journal) if args.journal else None)
        done.log.write.parquet(args.out)
        print(json.dumps(done.counts.first().asDict()))
    elif args.command == "label":
        refs = sampling.crop_refs(labels.read_manifest(spark, args.manifest, unique=True), args.count)
        refs.write.json(args.out)
        print(json.dumps({r.bucket: r.images for r in stats.counts_by(spark.read.schema(refs.schema).json(args.out), "bucket").collect()}))
    else:
        print(files.recover(spark, args.journal, args.workbook))
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Command line: process, analyze, augment, checkpoints, upload and download."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession

from loamworks import __version__


def _llm(name: str):
    """module:function"""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loamworks")
    p.add_argument("--version", version=__version__, action="version")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("process")
    a.add_argument("input"), a.add_argument("output")
    a.add_argument("--llm", required=True, help="module:function from prompt to reply")
    a.add_argument("--model", default="gpt-4"), a.add_argument("--extractors", default="qa rules facts".split(), nargs="+")
    a.add_argument("--format", default="openai"), a.add_argument("--chunk-size", default=3000, type=int), a.add_argument("--max-items", default=10, type=int)
    a.add_argument("--workers", type=int, default=5), a.add_argument("--rate-limit", type=float), a.add_argument("--jobs"), a.add_argument("--no-quality-filter", default=False, action="store_true")
    a = sub.add_parser("analyze")
    a.add_argument("input"), a.add_argument("--input-field", default="input"), a.add_argument("--output-field", default="output"), a.add_argument("--markdown", action="store_true"), a.add_argument("--output")
    a = sub.add_parser("augment")
    a.add_argument("input"), a.add_argument("output"), a.add_argument("--factor", type=float, default=2.0), a.add_argument("--field", default="output"), a.add_argument("--llm")
    a = sub.add_parser("checkpoints")
    a.add_argument("action", choices=["delete", "list", "cleanup"]), a.add_argument("--dir", required=True), a.add_argument("--max-age", type=float, default=7), a.add_argument("--job-id")
    a = sub.add_parser("upload")
    a.add_argument("inputs", nargs="+"), a.add_argument("--repo", required=True), a.add_argument("--hub", required=True), a.add_argument("--splits", nargs="+"), a.add_argument("--name"), a.add_argument("--description", default=""), a.add_argument("--private", action="store_true")
    a = sub.add_parser("download")
    a.add_argument("repo"), a.add_argument("output"), a.add_argument("--hub", required=True), a.add_argument("--split", default="train")
    return p


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.command == "process":
        from loamworks.plans.pipeline import process

        n = process(spark, args.input, args.output, _llm(args.llm), args.format, model=args.model, extractors=tuple(args.extractors), chunk_size=args.chunk_size, max_items_per_chunk=args.max_items, threads=args.workers, rate_limit=args.rate_limit, use_quality_filter=not args.no_quality_filter, jobs_path=args.jobs)
        print(f"{n} items")
    elif args.command == "analyze":
        from loamworks.operators.analytics import report

        text = report(spark.read.json(args.input), (args.input_field, args.output_field), args.markdown)
        if args.output:
            with open(args.output, "w", encoding="utf-8") as out:
                out.write(text)
        else:
            print(text)
    elif args.command == "augment":
        from loamworks.operators.augmentation import augment, default_augmenters
        from loamworks.sources.loaders import read_jsonl

        augment(read_jsonl(spark, args.input), default_augmenters(_llm(args.llm) if args.llm else None), args.factor).drop("pos").write.mode("overwrite").json(args.output)
    elif args.command == "checkpoints":
        from loamworks.operators.jobs import Jobs

        jobs = Jobs(spark, args.dir)
        if args.action == "list":
            for r in jobs.list().collect():
                print(f"{r['job_id']} done {r['done']} failed {r['failed']} {r['updated_at']}")
        elif args.action == "delete":
            jobs.delete(args.job_id)
        else:
            print(f"{len(jobs.cleanup(max_age_days=args.max_age))} deleted")
    elif args.command == "upload":
        from loamworks.sources.hub import DatasetCard, FolderTransport, upload_jsonl

        splits = args.splits or (["train"] if len(args.inputs) == 1 else [f"part{i}" for i in range(len(args.inputs))])
        for path, split in zip(args.inputs, splits, strict=True):
            print(upload_jsonl(FolderTransport(args.hub), path, args.repo, split, args.private, DatasetCard(args.name or args.repo, args.description)))
    else:
        from loamworks.sources.hub import FolderTransport, download

        download(spark, FolderTransport(args.hub), args.repo, args.split, args.output)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args, SparkSession.builder.appName("loamworks").getOrCreate())
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # noqa: BLE001 - the command line says what went wrong
        print(f"loamworks: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

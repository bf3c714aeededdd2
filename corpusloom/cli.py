"""Command line: ``python -m corpusloom.cli init | translate | glossary init|check|sync|review``.

``main`` returns the exit status: 1 for an error and for a check with issues, 0 else, failed files of a batch included.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.paths import dry_run_path, glob_base, with_language
from .operators.lint import issue_lines
from .operators.translate import translate
from .plans import tasks
from .sources import files, glossary
from .sources.providers import create_provider

CONFIG = "corpusloom.yaml"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom")
    top.add_argument("--version", action="version", version=files.version())
    top.add_argument("--config", default=CONFIG)
    top.add_argument("--dry-run", action="store_true")
    top.add_argument("--verbose", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("init").add_argument("--force", action="store_true")
    one = commands.add_parser("translate")
    one.add_argument("--input", required=True, help="a file, or a pattern in quotes")
    one.add_argument("--lang", required=True)
    one.add_argument("--output")
    one.add_argument("--output-dir")
    one.add_argument("--max-chunk-lines", type=int, default=300)
    words = commands.add_parser("glossary").add_subparsers(dest="task", required=True)
    made = words.add_parser("init")
    made.add_argument("--output", default="glossary.yaml")
    made.add_argument("--force", action="store_true")
    checked = words.add_parser("check")
    for name in ("--input", "--glossary", "--lang"):
        checked.add_argument(name, required=True)
    words.add_parser("sync").add_argument("--glossary", required=True)
    reviewed = words.add_parser("review")
    reviewed.add_argument("--glossary", required=True)
    reviewed.add_argument("--output")
    return top


def _translate(spark: SparkSession, args: argparse.Namespace) -> int:
    config = files.load_config(args.config, os.path.dirname(os.path.abspath(args.config)))
    options = {"model": config.model}
    if args.verbose:
        print(f"Provider {config.provider}, model {config.model}", file=sys.stderr)
    if any(c in args.input for c in "*?[]{}"):
        return _translate_batch(spark, args, config, options)
    docs = tasks.one_document(spark, args.input)
    path = lambda column: spark.range(1).select(column.alias("p")).first()["p"]
    if args.dry_run:
        print(f"Would translate {args.input} to {args.output or path(dry_run_path(F.lit(args.input), F.lit(args.lang)))} ({config.provider}, {config.model})")
        return 0
    create_provider(config.provider, config.model)  # a missing key fails before any call
    row = translate(docs.withColumnRenamed("path", "doc_id"), args.lang, config.provider, options, max_lines=args.max_chunk_lines).first()
    if row["error"]:
        raise files.AppError(row["error"])
    to = args.output or path(with_language(F.lit(args.input), F.lit(args.lang)))
    os.makedirs(os.path.dirname(to) or ".", exist_ok=True)
    with open(to, "w", encoding="utf-8", newline="") as f:
        f.write(row["content"])
    print(f"Wrote {to}: {row['total_tokens']} tokens in {row['chunks']} chunks")
    return 0


def _translate_batch(spark: SparkSession, args: argparse.Namespace, config: files.Config, options: dict) -> int:
    root = (glob_base(args.input) if os.path.isabs(args.input) else None) or "."
    pattern = args.input if root == "." else os.path.relpath(args.input, root)
    if not args.dry_run:
        create_provider(config.provider, config.model)
    rows = tasks.batch(spark, root, pattern.removeprefix("./"), args.lang, config.provider, options, args.output_dir or config.output_dir, args.dry_run, max_lines=args.max_chunk_lines)
    for r in rows.orderBy("current").toLocalIterator():
        verb = "would become" if args.dry_run else "became"
        used = f" ({r['total_tokens']} tokens, {r['chunks']} chunks)" if args.verbose and r["chunks"] else ""
        print(f"[{r['current']}/{r['total']}] {r['path']} " + (f"failed: {r['error']}" if r["error"] else f"{verb} {r['output_path']}{used}"), file=sys.stderr if r["error"] else sys.stdout)
    n = rows.agg(F.count("*").alias("total"), F.count("error").alias("failed")).first()
    print(f"Total {n['total']}, succeeded {n['total'] - n['failed']}, failed {n['failed']}")
    return 0


def _glossary(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.task == "init":
        glossary.init_glossary(args.output, args.force)
        print(f"Wrote {args.output}")
    elif args.task == "check":
        issues = tasks.check(spark, args.input, args.glossary, args.lang).persist()
        n = issues.count()
        print(f"{args.input}: {n or 'no'} terminology issues")
        for r in issue_lines(issues).toLocalIterator():
            print(r["value"])
        return int(n > 0)
    elif args.task == "sync":
        done = tasks.sync(spark, args.glossary)
        for r in done.coverage.orderBy("lang_pos").toLocalIterator():
            print(f"{r['lang']}: {r['translated']} of {r['total']} terms")
        for r in done.missing.orderBy("term_pos").toLocalIterator():
            print(f"{r['canonical']} lacks {', '.join(r['missing_languages'])}")
    else:
        report = tasks.review(spark, args.glossary)
        if args.output:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(report)
            print(f"Wrote {args.output}")
        else:
            print(report, end="")
    return 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "init":
            files.init_config(args.config, args.force)
            print(f"Wrote {args.config}; put the provider's key into the environment, or into .env beside it")
            return 0
        spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
        return _translate(spark, args) if args.command == "translate" else _glossary(spark, args)
    except (files.AppError, ValueError, OSError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

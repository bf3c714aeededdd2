"""Whole tasks over files: translate a set of documents, check one, bring a glossary up to date, review it."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import common_directory, glob_base, output_path
from ..operators import coverage, lint
from ..operators.translate import summary, translate
from ..sources import glossary as G
from ..sources.files import AppError, matched_documents, read_documents, write_documents


def one_document(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of one file, which must be there."""
    folder, name = os.path.split(path)
    if not name or not os.path.exists(path):
        raise AppError(f"Input file not found: {path}", "Is the path right?")
    # the name is no pattern: what has a meaning in one is put in brackets
    literal = "".join(f"[{c}]" if c in "*?[]{}\\" else c for c in name)
    if literal != name:
        return read_documents(spark, folder or ".", "**").where(F.col("path") == name)
    return read_documents(spark, folder or ".", name)


def known_glossary(path: str) -> G.Glossary:
    found = G.load_glossary(path)
    if found is None:
        raise AppError(f"Glossary file not found: {path}", "Make one first.")
    return found


def check(spark: SparkSession, path: str, glossary: str, lang: str) -> DataFrame:
    """The issues of one document: ``doc_id`` (its path)``, lang, line, key_path, forbidden, canonical``."""
    words = known_glossary(glossary)
    words.check_language(lang)
    docs = one_document(spark, path).select("path", F.col("path").alias("doc_id"), F.lit(lang).alias("lang"), "text")
    if path.endswith(".json"):
        from ..operators.jsonflat import parse_errors

        if not parse_errors(docs).isEmpty():
            raise AppError(f"Invalid JSON: {path}")
    return lint.lint(docs, words.forbidden_frame(spark))


@dataclass
class Synced:
    coverage: DataFrame
    missing: DataFrame
    stubs: int


def sync(spark: SparkSession, path: str) -> Synced:
    """Coverage and gaps of a glossary as it was; then empty translations fill the gaps in its file."""
    was = known_glossary(path)
    terms, languages = was.terms_frame(spark), was.languages_frame(spark)
    filled, stubs = G.with_stubs(was)
    if stubs:
        G.save_glossary(filled, path)
    return Synced(coverage.coverage(terms, languages), coverage.missing(terms, languages), stubs)


def review(spark: SparkSession, path: str) -> str:
    words = known_glossary(path)
    return coverage.review(words.terms_frame(spark), words.languages_frame(spark)).first()["report"]


def numbered(rows: DataFrame, key: str = "path") -> DataFrame:
    """``rows`` with ``current`` (from 1, in the order of ``key``) and ``total``, without all rows in one task.

    Ranges of the key are numbered apart; the counts of the ranges before are added, one row a partition.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, key).withColumn("range_no", F.spark_partition_id()).persist()
    sizes = ranged.groupBy("range_no").agg(F.count("*").alias("n"))  # as many rows as partitions
    before = sizes.select("range_no", (F.sum("n").over(Window.orderBy("range_no")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    at = F.row_number().over(Window.partitionBy("range_no").orderBy(key))
    return ranged.join(F.broadcast(before), "range_no").withColumn("current", F.col("before") + at).drop("range_no", "before")


def batch(
    spark: SparkSession, root: str, pattern: str, lang: str, provider: str = "echo", options: dict | None = None,
    output_dir: str | None = None, dry_run: bool = False, on_progress: Callable[[dict], None] | None = None, **how,
) -> DataFrame:
    """Translate the files below ``root`` that match, and write each beside itself or below ``output_dir``.

    ``root`` and ``output_dir`` (from ``root`` on, if relative) are folders that all executors share.  One row a file: ``path, output_path, error, total_tokens, chunks, current, total``.  A failed file
    has an ``error`` and nothing written; a dry run calls and writes nothing and has no errors but of paths.
    ``on_progress`` gets ``total, current, succeeded, failed, skipped`` after each file, in order of paths,
    when the calls are done.  Answers are kept until the rows are (see ``translate``).
    """
    docs = matched_documents(spark, root, pattern)
    base = None
    if output_dir is not None:
        base = glob_base(pattern) or common_directory(docs).first()["base"]
    where = output_path(F.col("path"), F.lit(lang), F.lit(output_dir).cast("string"), F.lit(base).cast("string"))
    planned = docs.select("path", where.alias("o")).select("path", F.col("o.path").alias("output_path"), F.col("o.error").alias("path_error"))
    if dry_run:
        none = F.lit(None).cast("long")
        rows = numbered(planned.select("path", "output_path", F.col("path_error").alias("error"), none.alias("total_tokens"), none.alias("chunks")))
    else:
        good = docs.join(planned.where("path_error is null").select("path"), "path", "left_semi")
        done = translate(good.withColumnRenamed("path", "doc_id"), lang, provider, options, **how)
        met = planned.join(done.withColumnRenamed("doc_id", "path"), "path", "left").withColumn("error", F.coalesce("path_error", "error")).persist()
        to = F.col("output_path") if output_dir is None else F.substr("output_path", F.lit(len(output_dir.rstrip("/")) + 2))
        write_documents(met.where("error is null").select(to.alias("path"), F.col("content").alias("text")), os.path.join(root, output_dir or ""))
        rows = numbered(met.select("path", "output_path", "error", "total_tokens", "chunks"))
    if on_progress:
        good_n = bad_n = 0
        for r in rows.orderBy("current").select("current", "total", "error").toLocalIterator():
            good_n, bad_n = good_n + (r["error"] is None), bad_n + (r["error"] is not None)
            on_progress({"total": r["total"], "current": r["current"], "succeeded": good_n, "failed": bad_n, "skipped": 0})
    return rows


def totals(rows: DataFrame) -> DataFrame:
    """``total, succeeded, failed, errors`` of a batch."""
    return summary(rows.select(F.col("path").alias("doc_id"), "error"))

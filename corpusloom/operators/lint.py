"""Terminology lint of Markdown and JSON documents against a glossary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .jsonflat import string_leaves


def body_lines(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """``line_no, line`` of the text behind frontmatter and code, cleaned; numbers count from the file's first line."""
    plain = docs.select(*keep, X.unix_lines(F.col(text_col)).alias("t")).select(*keep, X.frontmatter(F.col("t")).alias("fm"), X.protect(X.body(F.col("t")))["text"].alias("b"))
    each = plain.select(*keep, X.line_count(F.col("fm")).alias("skip"), F.posexplode(F.split("b", "\n", -1)).alias("i", "line"))
    return each.select(*keep, (F.col("i") + 1 + F.col("skip")).alias("line_no"), X.clean_line(F.col("line")).alias("line"))


def _hits(texts: DataFrame, forbidden: DataFrame, column: str, most_rows: int = 100_000) -> DataFrame:
    """Texts joined to the forbidden words of their language that stand uncovered in them."""
    small = forbidden.limit(most_rows + 1).count() <= most_rows
    words = F.broadcast(forbidden) if small else forbidden
    return texts.join(words, "lang").where(F.col(column).contains(F.col("word")) & F.expr(f"`{column}` rlike pattern"))


def lint_markdown(docs: DataFrame, forbidden: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id, lang, line, forbidden, canonical``: one row for a word and line, however often it stands there.

    ``docs`` has ``doc_id`` and the language ``lang`` to check; a null text or language gives no issue.
    """
    hits = _hits(body_lines(docs, text_col), forbidden, "line")
    return hits.select("doc_id", "lang", F.col("line_no").alias("line"), F.col("word").alias("forbidden"), "canonical", "term_pos", "word_pos")


def lint_json(docs: DataFrame, forbidden: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id, lang, line, key_path, forbidden, canonical`` over the string leaves of JSON documents; ``line`` is 0."""
    leaves = string_leaves(docs, text_col, ("doc_id", "lang")).withColumn("clean", X.clean_line(F.col("value")))
    hits = _hits(leaves, forbidden, "clean")
    return hits.select("doc_id", "lang", F.lit(0).alias("line"), "key_path", F.col("word").alias("forbidden"), "canonical", "term_pos", "word_pos")


def lint(docs: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Both kinds, by the ``path``: ``.json`` documents by their leaves, others by lines."""
    is_json = F.coalesce(F.col("path").endswith(".json"), F.lit(False))
    lines = lint_markdown(docs.where(~is_json), forbidden).withColumn("key_path", F.lit(None).cast("string"))
    return lines.unionByName(lint_json(docs.where(is_json), forbidden))


def issue_counts(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """``doc_id, issues, passed`` for every document."""
    n = issues.groupBy("doc_id").agg(F.count("*").alias("issues"))
    out = docs.select("doc_id").join(n, "doc_id", "left").withColumn("issues", F.coalesce("issues", F.lit(0)))
    return out.withColumn("passed", F.col("issues") == 0)


def issue_lines(issues: DataFrame) -> DataFrame:
    """Issues rendered one a line, in the order of terms, words and lines."""
    where = F.coalesce("key_path", F.concat(F.lit("Line "), F.col("line").cast("string"))) if "key_path" in issues.columns else F.concat(F.lit("Line "), F.col("line").cast("string"))
    text = F.format_string('  %s: "%s" → use "%s"', where, "forbidden", "canonical")
    return issues.orderBy("doc_id", "term_pos", "word_pos", "line").select("doc_id", text.alias("value"))

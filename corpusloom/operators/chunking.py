"""Heading-aware chunks of long texts: folds over each document's array of lines.

A document is one row, so no exchange is needed; lines keep their order inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank

#: Lines of a chunk at most, and lines below which a chunk joins the one before.
MAX_LINES, SMALL = 300, 50


def _bound(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _facts(lines: Column) -> Column:
    """Per line ``struct<inside, fence>``: inside a fence before it, and a fence line itself."""

    def step(acc, line):
        fence = line.startswith("```")
        now = F.struct((acc["open"] != fence).alias("open"), F.concat(acc["out"], F.array(F.struct(acc["open"].alias("inside"), fence.alias("fence")))).alias("out"))
        return now

    return F.aggregate(lines, F.struct(F.lit(False).alias("open"), F.array().cast("array<struct<inside:boolean,fence:boolean>>").alias("out")), step, lambda s: s["out"])


def _safe_cuts(lines: Column, most: Column) -> Column:
    """Line numbers where a chunk starts: at ``most`` lines or the first later line outside fences and tables."""

    def of(facts):
        def step(acc, i):
            f, line = F.get(facts, i), F.get(lines, i)
            start = F.element_at(acc, -1)
            cut = (i - start >= most) & ~f["inside"] & ~f["fence"] & ~line.startswith("|")
            return F.when(cut, F.concat(acc, F.array(i))).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(0), F.size(lines) - 1), F.array(F.lit(0)), step)

    return _bound(_facts(lines), of)


def _segments(lines: Column, starts: Column) -> Column:
    """Texts of the line ranges that begin at ``starts``; blank ones are dropped."""
    cut = F.transform(starts, lambda s, i: F.array_join(F.slice(lines, s + 1, F.coalesce(F.get(starts, i + 1), F.size(lines)) - s), "\n"))
    return F.filter(cut, lambda t: ~is_blank(t))


def headings(lines: Column, level: int) -> Column:
    """Numbers of the heading lines of a level, outside fences."""
    mark = "#" * level + " "

    def of(facts):
        return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).startswith(mark) & ~F.get(facts, i)["inside"] & ~F.get(facts, i)["fence"])

    return _bound(_facts(lines), of)


def _split_safely(text: Column, most: Column) -> Column:
    return _bound(F.split(text, "\n", -1), lambda lines: _bound(_safe_cuts(lines, most), lambda cuts: _segments(lines, cuts)))


def _from_zero(starts: Column) -> Column:
    return F.when(F.get(starts, F.lit(0)) == 0, starts).otherwise(F.concat(F.array(F.lit(0)), starts))


def _n_lines(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def _split_section(text: Column, most: Column) -> Column:
    """A section that may be too long, at its third-level headings and else where it is safe."""

    def by_heads(lines):
        def with_heads(heads):
            inner = F.flatten(F.transform(_segments(lines, _from_zero(heads)), lambda t: F.when(_n_lines(t) > most, _split_safely(t, most)).otherwise(F.array(t))))
            # a section with no inner heading, or one that only starts with it, can't be cut by headings
            return F.when(F.size(F.filter(heads, lambda h: h > 0)) > 0, inner).otherwise(_split_safely(text, most))

        return _bound(headings(lines, 3), with_heads)

    return F.when(_n_lines(text) <= most, F.array(text)).otherwise(_bound(F.split(text, "\n", -1), by_heads))


def _merged(chunks: Column, most: Column, small: int) -> Column:
    """A chunk of fewer than ``small`` lines joins the one before if both fit."""

    def step(acc, c):
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (_n_lines(c) < small) & (_n_lines(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(""))) + _n_lines(c) <= most)
        joined = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n"), c)))
        return F.when(fits, joined).otherwise(F.concat(acc, F.array(c)))

    return F.aggregate(chunks, F.array().cast("array<string>"), lambda acc, c: F.when(F.size(acc) == 0, F.array(c)).otherwise(step(acc, c)))


def chunks(text: Column, max_lines: int = MAX_LINES, small: int = SMALL) -> Column:
    """Chunks of a text, in order; a null text has none."""
    most = F.lit(max_lines)

    def of(lines):
        def with_heads(heads):
            sections = F.flatten(F.transform(_segments(lines, _from_zero(heads)), lambda t: _split_section(t, most)))
            return F.when(F.size(heads) > 0, _merged(sections, most, small)).otherwise(_split_safely(text, most))

        return _bound(headings(lines, 2), with_heads)

    return F.when(_n_lines(text) <= most, F.array(text)).otherwise(_bound(F.split(text, "\n", -1), of))


def chunk_rows(docs: DataFrame, text_col: str = "text", max_lines: int = MAX_LINES, small: int = SMALL, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``chunk_no`` (from 0) and ``chunk`` of every document."""
    return docs.select(*keep, F.posexplode(chunks(F.col(text_col), max_lines, small)).alias("chunk_no", "chunk"))

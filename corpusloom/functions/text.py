"""Markdown structure and text cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that JavaScript's ``\s`` and ``trim`` take as white space.
JS_SPACE = r"\t\n\x0B\f\r    -     　﻿"
_SPACE_IN_LINE = JS_SPACE.replace(r"\n", "")

#: Frontmatter at the start of a text, and fenced blocks; a fence that is never closed takes the rest.
FRONTMATTER = r"\A(?:---\n([\s\S]*?)\n---[ \t]*(?:\n|\z)|---\n---[ \t]*(?:\n|\z))"
CLOSED = rf"^(`{{3,}}+)[^\n]*\n(?s:.*?)(?<=\n)\1`*+[{_SPACE_IN_LINE}]*+(?=\n|\z)"
FENCE = rf"(?m){CLOSED}|(?m)^`{{3,}}[\s\S]*\z"
INLINE = r"`[^`\n]+`"


def unix_lines(text: Column) -> Column:
    """CRLF to LF; a lone CR stays."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def is_blank(text: Column) -> Column:
    return text.rlike(rf"\A[{JS_SPACE}]*\z")


def frontmatter(text: Column) -> Column:
    """The frontmatter of a text with LF line ends, its closing line included; null if none."""
    found = F.regexp_extract(text, FRONTMATTER, 0)
    return F.when(found != "", found)


def body(text: Column) -> Column:
    return F.substr(text, F.length(F.coalesce(frontmatter(text), F.lit(""))) + 1)


def line_count(text: Column) -> Column:
    """Line ends in a text; 0 for null."""
    return F.coalesce(F.size(F.split(text, "\n", -1)) - 1, F.lit(0))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fence_blocks(text: Column) -> Column:
    """Matches of FENCE as ``struct<block, closed>``; only the last can be unclosed."""
    return F.transform(F.regexp_extract_all(text, F.lit(FENCE), F.lit(0)), lambda b: F.struct(b.alias("block"), b.rlike(rf"(?m)\A{CLOSED[1:]}\z").alias("closed")))


def _zipped(text: Column, pattern: str, found: Column, put) -> Column:
    """``text`` with the i-th match of ``pattern`` replaced by ``put(match, i)``."""
    parts = F.transform(F.split(text, pattern, -1), lambda p, i: F.concat(p, F.when(i >= F.size(found), F.lit("")).otherwise(put(F.get(found, i), i))))
    return F.array_join(parts, "")


def protect(text: Column) -> Column:
    """``struct<text, entries>``: fences and inline code behind placeholders.

    A fenced block leaves as many line ends as it had, so line numbers stay.
    ``entries`` is an ordered array of ``struct<placeholder, original>``.
    """

    def fences(blocks):
        def put(b, i):
            pad = F.repeat(F.lit("\n"), F.size(F.split(b["block"], "\n", -1)) - 1)
            return F.when(b["closed"], F.concat(F.lit("__CODE_BLOCK_"), i.cast("string"), F.lit("__"), pad)).otherwise(b["block"])

        out = _zipped(text, FENCE, blocks, put)
        own = F.transform(F.filter(blocks, lambda b: b["closed"]), lambda b, i: F.struct(F.concat(F.lit("__CODE_BLOCK_"), i.cast("string"), F.lit("__")).alias("placeholder"), b["block"].alias("original")))
        return F.struct(out.alias("text"), own.alias("entries"))

    def inline(first):
        def of(codes):
            out = _zipped(first["text"], INLINE, codes, lambda c, i: F.concat(F.lit("__INLINE_CODE_"), i.cast("string"), F.lit("__")))
            own = F.transform(codes, lambda c, i: F.struct(F.concat(F.lit("__INLINE_CODE_"), i.cast("string"), F.lit("__")).alias("placeholder"), c.alias("original")))
            return F.struct(out.alias("text"), F.concat(first["entries"], own).alias("entries"))

        return _bound(F.regexp_extract_all(first["text"], F.lit(INLINE), F.lit(0)), of)

    return _bound(_bound(fence_blocks(text), fences), inline)


def restore(text: Column, entries: Column, exact: bool = False) -> Column:
    """Placeholders replaced by their originals, in the order of ``entries``.

    ``exact`` also takes the line ends back that ``protect`` had left for a block,
    which makes the two inverse; without it they stay as blank lines.
    """

    def put(acc, e):
        p, o = e["placeholder"], e["original"]
        if exact:
            acc = F.replace(acc, F.concat(p, F.repeat(F.lit("\n"), F.size(F.split(o, "\n", -1)) - 1)), p)
            return F.replace(acc, p, o)
        return F.replace(F.replace(acc, F.concat(p, F.lit("\n")), o), p, o)

    return F.aggregate(entries, text, put)


def clean_line(line: Column) -> Column:
    """A line without URLs, link targets and URNs, taken out in this order."""
    stop = rf"[^{JS_SPACE}]"
    line = F.regexp_replace(line, rf"https?://{stop}+", "")
    line = F.regexp_replace(line, r"\]\([^)]+\)", "")
    return F.regexp_replace(line, rf"urn:{stop}+", "")


def quoted(text: str) -> str:
    """A Java pattern that matches ``text`` literally."""
    return "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else f"\\x{ord(c):02X}" for c in text)


def uncovered_pattern(word: str, canonical: str | None) -> str:
    """Pattern of a forbidden word that stands neither inside its canonical term nor inside an identifier."""
    covers = []
    at = canonical.find(word) if canonical and word else -1
    while at >= 0:
        covers.append(f"(?!(?<={quoted(canonical[:at])}){quoted(canonical[at:])})" if at else f"(?!{quoted(canonical)})")
        at = canonical.find(word, at + 1)
    return rf"(?<![A-Za-z0-9_]){''.join(covers)}{quoted(word)}(?![A-Za-z0-9_\-])"


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """``{{name}}`` replaced by each value, in order."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), value)
    return template

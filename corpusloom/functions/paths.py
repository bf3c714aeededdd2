"""Output paths of documents as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_glob(path: Column) -> Column:
    return path.rlike(r"[*?\[\]{}]")


def directory(path: Column) -> Column:
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(~path.contains("/"), F.lit(".")).when((found == "") & path.startswith("/"), F.lit("/")).otherwise(found)


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """From the last dot of the file name on; a leading dot starts no extension."""
    return F.regexp_extract(name(path), r"[^.].*?(\.[^.]*)$|^\.+[^.]+(\.[^.]*)$", 1)


def with_language(path: Column, lang: Column) -> Column:
    """``dir/base.lang.ext``; without a directory the name alone."""
    ext = extension(path)
    base = F.left(name(path), F.length(name(path)) - F.length(ext))
    new = F.concat(base, F.lit("."), lang, ext)
    where = directory(path)
    return F.when(where == ".", new).when(where == "/", F.concat(F.lit("/"), new)).otherwise(F.concat(where, F.lit("/"), new))


def dry_run_path(path: Column, lang: Column) -> Column:
    return F.concat(F.regexp_replace(path, r"\.md$", ""), F.lit("."), lang, F.lit(".md"))


def relative(path: Column, base: Column) -> Column:
    """``path`` from the folder ``base`` on; null where it lies elsewhere."""
    head = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"))
    return F.when(base == ".", path).when(path.startswith(head), F.substr(path, F.length(head) + 1))


def escapes(rel: Column) -> Column:
    """Whether a relative path leaves its folder."""
    return rel.isNull() | rel.startswith("/") | rel.rlike(r"(^|/)\.\.(/|$)")


def output_path(path: Column, lang: Column, output_dir: Column | None = None, base: Column | None = None, explicit: Column | None = None) -> Column:
    """``struct<path, error>``: an explicit path wins; then the folder with the path below ``base``; else the language suffix."""
    beside = with_language(path, lang)
    none = F.lit(None).cast("string")
    out, error = beside, none
    if output_dir is not None and base is not None:
        rel = relative(path, base)
        moved = output_dir.isNotNull() & base.isNotNull()
        out = F.when(moved & ~escapes(rel), F.concat(F.rtrim(output_dir, F.lit("/")), F.lit("/"), rel)).when(moved, none).otherwise(beside)
        error = F.when(moved & escapes(rel), F.concat(F.lit("Path traversal detected: "), path))
    if explicit is not None:
        out, error = F.coalesce(explicit, out), F.when(explicit.isNull(), error)
    return F.struct(out.alias("path"), error.alias("error"))


def glob_base(pattern: str) -> str | None:
    """The literal folder before a pattern's first wildcard; null if there is none."""
    head = re.split(r"[*?\[\]{}]", pattern, maxsplit=1)[0]
    return head.rsplit("/", 1)[0] or "/" if "/" in head else None


def glob_regex(pattern: str) -> str:
    """A Java pattern for a glob with ``**``, ``*``, ``?``, ``[]`` and ``{}``."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            out, i = out + "[" + pattern[i + 1 : end].replace("\\", "\\\\").replace("!", "^", 1 if pattern[i + 1] == "!" else 0) + "]", end + 1
            continue
        depth += (c == "{") - (c == "}" and depth > 0)
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")" if depth >= 0 else "\\}"}.get(c, "|" if c == "," and depth else re.escape(c))
        i += 1
    return f"^{out}$"


def common_directory(paths: DataFrame, column: str = "path") -> DataFrame:
    """``base``: the longest folder that all paths share; one row.  Least and greatest segment arrays share what all share."""
    parts = F.slice(F.split(column, "/"), 1, F.size(F.split(column, "/")) - 1)
    ends = paths.select(parts.alias("p")).agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    n = F.least(F.size("lo"), F.size("hi"))
    differ = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.get("lo", i) != F.get("hi", i)))
    joined = F.array_join(F.slice("lo", F.lit(1), F.get(differ, F.lit(0))), "/")
    return ends.select(F.when(F.col("lo").isNull(), None).when(joined == "", F.lit(".")).otherwise(joined).alias("base"))

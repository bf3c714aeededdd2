"""Quality rules with thresholds that adapt to each language and source.

Counts over whole texts give four rates.  Their distributions are kept as
mergeable quantile sketches: counts of log-linear buckets (seven leading bits of
an integer rate, so relative error under 1/64), which add up exactly in any
order.  A group's sketch is merged with those of its language and of all, each
scaled to ``PRIOR`` documents: a small group leans on them, a large one on itself,
and no size switches from one rule to another.  Fences from the merged quartiles
and the tails' mean distances from the median replace fixed cutoffs; they are joined to
the documents, which are filtered by them.  All arithmetic is on whole numbers.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .quality_counts import NAMES, counts
from .storage import stored

#: Rates in thousandths; whether a low one fails as well as a high one, and how many tenths of a tail's mean distance from the median a fence stands beyond a quartile, besides RANGES times the interquartile range.
RATES = {"word_length": (True, 40), "symbol_share": (False, 5), "line_share": (False, 40), "repeat_share": (False, 40)}
RANGES = 3
#: Documents that the sketches of a language and of all weigh in a group's, and the whole number that one document counts.
PRIOR, UNIT = 100, 1000


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in NAMES]))
def _counts(texts: pa.Array) -> pa.Array:
    rows = [counts(t.as_py()) for t in texts]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(NAMES))], NAMES)


def text_counts(text: Column) -> Column:
    """A struct of the counts in ``NAMES`` of a text; a null text counts as empty."""
    return _counts.asNondeterministic()(F.coalesce(text, F.lit("")).cast("binary"))


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def rates(c: Column) -> dict[str, Column]:
    def share(a: str, b: str) -> Column:
        return F.floor(1000 * c[a] / F.greatest(c[b], F.lit(1))).cast("long")

    return {"word_length": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"), "line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words")}


def bucket(v: Column) -> Column:
    """The least value of the sketch bucket of a non-negative integer."""
    low = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, low), low)


def sketches(rated: DataFrame) -> DataFrame:
    """``lang, source, rate, bucket, n``: one sketch for each group and rate."""
    long = rated.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(n).alias("rate"), bucket(F.col(n)).alias("bucket")) for n in RATES])).alias("r"))
    return long.groupBy("lang", "source", "r.rate", "r.bucket").agg(F.count("*").alias("n"))


def _alike(a: str, b: str, keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}"))
    return same


def merged(sketch: DataFrame) -> DataFrame:
    """``lang, source, rate, bucket, w``: each group's sketch with its language's and that of all, scaled to ``PRIOR`` documents."""
    groups = sketch.select("lang", "source").distinct()
    parts = sketch.select("lang", "source", "rate", "bucket", (F.col("n") * UNIT).alias("w"))
    for keys in (["lang"], []):
        by = Window.partitionBy(*keys, "rate")
        level = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n")).withColumn("docs", F.sum("n").over(by))
        level = level.select(*[F.col(k).alias(f"_{k}") for k in keys], "rate", "bucket", F.expr(f"({PRIOR * UNIT} * n) div docs").alias("w"))
        # a row for each group and bucket of the level: groups and buckets, not documents
        parts = parts.unionByName(groups.join(F.broadcast(level) if not keys else level, _alike("", "_", keys)).select("lang", "source", "rate", "bucket", "w"))
    return parts.groupBy("lang", "source", "rate", "bucket").agg(F.sum("w").alias("w"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """``lang, source, low, high`` (maps from rate to fence) for every group of the sketch."""
    by = Window.partitionBy("lang", "source", "rate")
    run = merged(sketch).withColumn("upto", F.sum("w").over(by.orderBy("bucket"))).withColumn("docs", F.sum("w").over(by))
    quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * k, F.col("bucket"))).over(by).alias(f"q{k}")
    run = run.select("lang", "source", "rate", "bucket", "w", "docs", *[quartile(k) for k in (1, 2, 3)])
    # the mean distance of what lies above the median, and below it; with nothing there the quartile range alone counts
    above = F.expr("coalesce(sum(w * (bucket - q2)) FILTER (WHERE bucket > q2) div sum(w) FILTER (WHERE bucket > q2), 0)")
    below = F.expr("coalesce(sum(w * (q2 - bucket)) FILTER (WHERE bucket < q2) div sum(w) FILTER (WHERE bucket < q2), 0)")
    out = run.groupBy("lang", "source", "rate", "q1", "q3").agg(above.alias("above"), below.alias("below"))
    tenths = F.create_map(*[F.lit(x) for n, (_, t) in RATES.items() for x in (n, t)])[F.col("rate")]
    beyond = lambda tail: RANGES * (F.col("q3") - F.col("q1")) + F.floor(tenths * F.col(tail) / 10).cast("long")
    out = out.select("lang", "source", "rate", (F.col("q1") - beyond("below")).alias("low"), (F.col("q3") + beyond("above")).alias("high"))
    maps = [F.map_from_entries(F.collect_list(F.struct("rate", c))).alias(c) for c in ("low", "high")]  # one entry a rate
    return out.groupBy("lang", "source").agg(*maps)


def _within(rate: dict[str, Column], low: Column, high: Column) -> Column:
    ok = F.lit(True)
    for name, v in rate.items():
        ok = ok & F.coalesce(v <= high[name], F.lit(True))
        if RATES[name][0]:
            ok = ok & F.coalesce(v >= low[name], F.lit(True))
    return ok


def _rated(docs: DataFrame, counted: Column, lang_col: str, source_col: str) -> DataFrame:
    """Groups and rates of the documents that pass the base rule; only these shape the fences."""
    plain = docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), counted.alias("c")).where(~base_failed(F.col("c")))
    return plain.select("lang", "source", *[v.alias(n) for n, v in rates(F.col("c")).items()])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts and verdict for each row: ``doc_id``, the counts, ``base_failed``, ``kept``.

    Null and empty texts have no words and so fail.  A null language or source is a
    group like any other.  Repeated rows are judged each, alike.  An empty table gives
    no rows; other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text_counts(F.col(text_col)).alias("c"))
    own = stored(own, "counts")
    fences = thresholds(sketches(_rated(own, F.col("c"), "lang", "source")))
    fences = fences.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "low", "high")
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    c, failed = F.col("c"), base_failed(F.col("c"))
    kept = ~failed & _within(rates(c), F.col("low"), F.col("high"))
    return own.join(fences, same, "left").select("doc_id", *[c[n].alias(n) for n in NAMES], failed.alias("base_failed"), kept.alias("kept"))


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns; each text is counted once.

    Rows are stored with their counts, since the fences need all of them first.
    """
    counted = [c for c in ("__c", "___c", "____c") if c not in docs.columns][0]
    counted_docs = docs.withColumn(counted, text_counts(F.col(f"`{text_col}`")))
    own = stored(counted_docs.where(~base_failed(F.col(counted))), "counted")
    fences = thresholds(sketches(_rated(own, F.col(counted), lang_col, source_col)))
    fences = fences.select(F.col("lang").alias("__l"), F.col("source").alias("__s"), F.col("low").alias("__low"), F.col("high").alias("__high"))
    same = F.col(lang_col).eqNullSafe(F.col("__l")) & F.col(source_col).eqNullSafe(F.col("__s"))
    ok = _within(rates(F.col(counted)), F.col("__low"), F.col("__high"))
    return own.join(fences, same, "left").where(ok).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines")


_WORD = "[^\\x20\\x09-\\x0D]"
_SAME = lambda a, b, keys: " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)
_TENTHS = "CASE rate " + " ".join(f"WHEN '{n}' THEN {t}" for n, (_, t) in RATES.items()) + " END"
#: The same rows in SQL.
OP7_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(text, '{_WORD}+')) AS w, generate_subscripts(regexp_extract_all(text, '{_WORD}+'), 1) AS i FROM t),
g AS (SELECT rid, i, w, CASE WHEN lead(w, 4) OVER o IS NOT NULL THEN [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] END AS g FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY rid, g) > 1 THEN 1 ELSE 0 END AS twice FROM g),
cover AS (SELECT rid, max(twice) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM twice),
reps AS (SELECT rid, count(*) AS n_words, CAST(sum(c) AS BIGINT) AS n_repeat_words FROM cover GROUP BY rid),
ls AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '{_WORD}') GROUP BY rid),
c AS (SELECT t.rid, doc_id, lang, source, coalesce(n_words, 0) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM t LEFT JOIN reps USING (rid) LEFT JOIN ls USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 1000 * word_chars // greatest(n_words, 1) AS word_length, 1000 * n_symbols // greatest(word_chars, 1) AS symbol_share,
  1000 * n_dup_lines // greatest(n_lines, 1) AS line_share, 1000 * n_repeat_words // greatest(n_words, 1) AS repeat_share FROM c),
long AS (SELECT lang, source, rate, v FROM f UNPIVOT (v FOR rate IN (word_length, symbol_share, line_share, repeat_share)) WHERE NOT base_failed),
sk AS (SELECT lang, source, rate, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS bucket, count(*) AS n FROM long GROUP BY ALL),
by_lang AS (SELECT lang, rate, bucket, {PRIOR * UNIT} * sum(n) // sum(sum(n)) OVER (PARTITION BY lang, rate) AS w FROM sk GROUP BY lang, rate, bucket),
over_all AS (SELECT rate, bucket, {PRIOR * UNIT} * sum(n) // sum(sum(n)) OVER (PARTITION BY rate) AS w FROM sk GROUP BY rate, bucket),
grp AS (SELECT DISTINCT lang, source FROM sk),
parts AS (SELECT lang, source, rate, bucket, {UNIT} * n AS w FROM sk UNION ALL SELECT grp.lang, grp.source, rate, bucket, w FROM grp JOIN by_lang ON {_SAME("grp", "by_lang", ["lang"])} UNION ALL SELECT lang, source, rate, bucket, w FROM grp, over_all),
m AS (SELECT lang, source, rate, bucket, sum(w) AS w FROM parts GROUP BY ALL),
run AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, rate ORDER BY bucket) AS upto, sum(w) OVER (PARTITION BY lang, source, rate) AS docs FROM m),
q AS (SELECT *, min(bucket) FILTER (upto * 4 >= docs) OVER p AS q1, min(bucket) FILTER (upto * 4 >= docs * 2) OVER p AS q2, min(bucket) FILTER (upto * 4 >= docs * 3) OVER p AS q3 FROM run WINDOW p AS (PARTITION BY lang, source, rate)),
tails AS (SELECT lang, source, rate, q1, q3, coalesce(sum(w * (bucket - q2)) FILTER (bucket > q2) // sum(w) FILTER (bucket > q2), 0) AS above, coalesce(sum(w * (q2 - bucket)) FILTER (bucket < q2) // sum(w) FILTER (bucket < q2), 0) AS below FROM q GROUP BY ALL),
fence AS (SELECT lang, source, rate, q1 - {RANGES} * (q3 - q1) - {_TENTHS} * below // 10 AS low, q3 + {RANGES} * (q3 - q1) + {_TENTHS} * above // 10 AS high FROM tails),
out_of AS (SELECT rid, bool_or(v > high OR u.rate = 'word_length' AND v < low) AS beyond FROM (SELECT rid, lang, source, rate, v FROM f UNPIVOT (v FOR rate IN (word_length, symbol_share, line_share, repeat_share))) u JOIN fence ON u.rate = fence.rate AND {_SAME("u", "fence", ["lang", "source"])} GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(beyond, false) AS kept, n_lines FROM f LEFT JOIN out_of USING (rid)
"""

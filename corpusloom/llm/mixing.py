"""Mixing sources to target weights by a Pfair schedule.

A source of weight w out of W in all releases its i-th block (from 0) at slot
floor(i*W/w) and must have it placed before slot ceil((i+1)*W/w).  Earliest
deadline first places one block a slot and meets every deadline, so after any
number of slots a source is less than one block away from its share.  The
schedule repeats after W slots: one period of W slots is computed once, and a
block's slot follows from its number by arithmetic.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .storage import stored

#: The least length of a period, and slots for each source: a weight is off by less than one slot, and the least by one slot at most.
SLOTS, SLOTS_A_SOURCE = 1000, 16
#: Rows of a source that one task ranks, on average.
BUCKET = 50_000
_ADDED = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_offset")


def whole_weights(shares: dict, slots: int = SLOTS) -> dict:
    """Positive shares as whole weights, at least 1 each, that sum to ``slots`` or ``SLOTS_A_SOURCE`` for each source if that is more."""
    slots, total = max(slots, SLOTS_A_SOURCE * len(shares)), sum(shares.values())
    exact = {s: v * slots / total for s, v in shares.items()}
    out = {s: max(1, int(v)) for s, v in exact.items()}
    order = sorted(shares, key=lambda s: (out[s] - exact[s], str(s)))
    at, left = 0, slots - sum(out.values())
    while left > 0:
        out[order[at % len(order)]] += 1
        at, left = at + 1, left - 1
    while left < 0:
        most = max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else -1e9, str(s)))
        out[most], left = out[most] - 1, left + 1
    return out


def schedule(weights: dict) -> list[tuple]:
    """One period as ``(slot, source, block number, release, deadline)``; ties of deadlines go by the source's name."""
    period = sum(weights.values())
    waiting = [(0, -(-period // w), str(s), s, 0) for s, w in weights.items()]
    heapq.heapify(waiting)
    ready, out = [], []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, deadline, name, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, name, i, s, release))
        deadline, name, i, s, release = heapq.heappop(ready)
        out.append((slot, s, i, release, deadline))
        w = weights[s]
        if i + 1 < w:
            heapq.heappush(waiting, ((i + 1) * period // w, -(-(i + 2) * period // w), name, s, i + 1))
    return out


def target_weights(counts: DataFrame, alpha: float = 0.5, slots: int = SLOTS) -> dict:
    """Weights in proportion to the ``alpha``-th power of each source's number of rows ``n``; sources are few, a row each comes to the driver."""
    rows = counts.collect()
    return whole_weights({r["__source"]: float(r["n"]) ** alpha for r in rows}, slots) if rows else {}


def mix(docs: DataFrame, weights: dict | None = None, block: int = 8, alpha: float = 0.5, slots: int = SLOTS, bucket: int = BUCKET, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows of ``docs`` with their place in the mixture.

    Adds ``mix_block, mix_release, mix_deadline, mix_slot, mix_offset`` in place of
    columns of these names; all others stay.  Inside a source rows follow the MD5 of
    their id, ties by the id and then by the whole row's hash; null ids go by the
    row's hash alone.  ``block`` rows make a block, the last may be short.  A source that has
    run out leaves its slots idle, so no row is dropped or repeated.  A null source is
    a source of its own; texts of any length stay whole; an empty table gives none.
    ``weights`` maps sources to positive whole weights and must name all of them.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in _ADDED]
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in columns if not isinstance(docs.schema[c].dataType, T.MapType)])
    key = F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("row "), whole.cast("string"))).cast("binary"))
    base = docs.select(*[F.col(f"`{c}`") for c in columns]).withColumn("__source", F.col(f"`{source_col}`")).withColumn("__key", key)
    sizes = stored(base.groupBy("__source").agg(F.count("*").alias("n")), "source-sizes")
    weights = weights or target_weights(sizes, alpha, slots)
    period = sum(weights.values())
    # buckets are ranges of the key, as many as a source's rows ask for
    dealt = sizes.select(F.col("__source").alias("__s"), F.ceil(F.col("n") / bucket).cast("long").alias("__buckets"))
    prefix = F.conv(F.substring("__key", 1, 8), 16, 10).cast("long")
    base = base.join(dealt, F.col("__source").eqNullSafe(F.col("__s"))).withColumn("__bucket", F.shiftright(prefix * F.col("__buckets"), 32)).drop("__s", "__buckets")
    counts = stored(base.groupBy("__source", "__bucket").agg(F.count("*").alias("__n")), "source-counts")
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy("__source").orderBy("__bucket")) - F.col("__n"))  # a row a bucket
    before = before.select(F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), "__before")
    ranked = base.join(before, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b"))).drop("__s", "__b")
    order = Window.partitionBy("__source", "__bucket").orderBy("__key", F.col(f"`{id_col}`"), whole)
    ranked = ranked.withColumn("__rank", F.row_number().over(order) - 1 + F.col("__before"))
    kind = docs.schema[source_col].dataType
    plan = spark.createDataFrame([(s, i, slot, r, d, weights[s]) for slot, s, i, r, d in schedule(weights)], T.StructType([T.StructField("__s", kind), *[T.StructField(n, T.LongType()) for n in ("__i", "__slot", "__release", "__deadline", "__w")]]))
    share = plan.select("__s", "__w").distinct()
    # a row a source, and a row a slot of the period; Spark broadcasts them if their sizes allow
    ranked = ranked.join(share, F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    ranked = ranked.withColumn("mix_block", F.floor(F.col("__rank") / block)).withColumn("__at", F.pmod("mix_block", F.col("__w")))
    placed = ranked.join(plan.drop("__w"), F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__at") == F.col("__i")))
    turns = F.floor(F.col("mix_block") / F.col("__w")) * period
    return placed.select(*[F.col(f"`{c}`") for c in columns], "mix_block", (turns + F.col("__release")).alias("mix_release"), (turns + F.col("__deadline")).alias("mix_deadline"), (turns + F.col("__slot")).alias("mix_slot"), (F.col("__rank") % block).cast("int").alias("mix_offset"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in the order of the mixture: partition after partition, and in each row after row.  All columns stay as they are."""
    own = {c: f"__own_{c}" for c in docs.columns if c in _ADDED}
    ordered = mix(docs.withColumnsRenamed(own), **options).repartitionByRange("mix_slot", "mix_offset").sortWithinPartitions("mix_slot", "mix_offset")
    return ordered.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


#: The same rows in SQL: whole weights by largest remainders, one period by earliest deadlines slot after slot, and ranks by MD5.
OP4_SQL = f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
shape AS (SELECT greatest({SLOTS}, {SLOTS_A_SOURCE} * count(*)) AS slots, sum(CAST(n AS DOUBLE) ** 0.5) AS total FROM sizes),
exact AS (SELECT source, CAST(n AS DOUBLE) ** 0.5 * slots / total AS x, slots FROM sizes, shape),
floors AS (SELECT source, x, slots, greatest(1, CAST(floor(x) AS BIGINT)) AS f FROM exact),
remain AS (SELECT source, f, slots - sum(f) OVER () AS missing, row_number() OVER (ORDER BY f - x, coalesce(source, 'None')) AS nth FROM floors),
weights AS (SELECT source, f + CASE WHEN nth <= missing THEN 1 ELSE 0 END AS w FROM remain),
listed AS (SELECT list(struct_pack(source := source, w := w) ORDER BY coalesce(source, 'None')) AS ws, CAST(sum(w) AS BIGINT) AS period FROM weights),
step AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS pick, list_transform(ws, lambda s: CAST(0 AS BIGINT)) AS done FROM listed
  UNION ALL
  SELECT slot + 1, pick, list_transform(done, lambda d, k: d + CASE WHEN k = pick THEN 1 ELSE 0 END)
  FROM (SELECT slot, done, list_min(list_transform(list_filter(range(1, len(ws) + 1), lambda k: done[k] < ws[k].w AND (done[k] * period) // ws[k].w <= slot + 1),
      lambda k: ((done[k] + 1) * period + ws[k].w - 1) // ws[k].w * 1000000 + k)) % 1000000 AS pick FROM step, listed WHERE slot + 1 < period)
),
plan AS (SELECT slot, ws[pick].source AS source, done[pick] - 1 AS i, ws[pick].w AS w, period FROM step, listed WHERE slot >= 0),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rank FROM documents),
placed AS (SELECT r.*, rank // 8 AS block, p.* EXCLUDE (source) FROM ranked r JOIN weights v ON r.source IS NOT DISTINCT FROM v.source JOIN plan p ON p.source IS NOT DISTINCT FROM r.source AND p.i = (rank // 8) % v.w)
SELECT doc_id, source, CAST(block AS BIGINT) AS mix_block,
  CAST((block // w) * period + (i * period) // w AS BIGINT) AS mix_release,
  CAST((block // w) * period + ((i + 1) * period + w - 1) // w AS BIGINT) AS mix_deadline,
  CAST((block // w) * period + slot AS BIGINT) AS mix_slot, CAST(rank % 8 AS INTEGER) AS mix_offset
FROM placed
"""


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs)

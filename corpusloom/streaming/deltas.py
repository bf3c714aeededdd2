"""Streams of answer deltas: folded to texts, as batches or as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folded(deltas: DataFrame, key: str = "request_id") -> DataFrame:
    """``content`` of each request: its deltas in order of ``seq`` up to the first that is done; empty ones add nothing."""
    own = deltas.groupBy(key).agg(F.min(F.when(F.col("done"), F.col("seq"))).alias("end"), F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("d"))
    upto = F.filter("d", lambda x: F.col("end").isNull() | (x["seq"] < F.col("end")))
    return own.select(key, F.array_join(F.transform(upto, lambda x: F.coalesce(x["content"], F.lit(""))), "").alias("content"), F.col("end").isNotNull().alias("done"))


def follow(deltas: DataFrame, checkpoint: str, on_chunk: Callable[[DataFrame, int], None]):
    """Start a streaming query that hands every new batch of non-empty deltas to ``on_chunk``."""
    return deltas.where("content <> '' or done").writeStream.foreachBatch(on_chunk).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def call_totals(calls: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls, failures and tokens for each window of the call log; works on streams and tables."""
    bad = F.count_if(~F.col("success"))
    seen = calls.withWatermark("timestamp", late) if calls.isStreaming else calls
    return seen.groupBy(F.window("timestamp", window), "provider").agg(F.count("*").alias("calls"), bad.alias("failed"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))

"""Connected components of links between long ids, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import new_path, released, removed, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for every node with a link; root is the least node reachable.

    Alternates large-star and small-star steps; each writes its edges to the
    shared folder, so lineage stays short and lost executors cost one step.
    No links give an empty table; loops and repeated links are ignored.
    """
    spark = edges.sparkSession
    path = new_path(spark, "links")
    now = stored(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct(), "links", path)
    seen = None
    while True:
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if sign["n"] == 0 or seen == tuple(sign):
            released(spark)
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(sign)
        nxt = new_path(spark, "links")
        now = stored(_small_star(_large_star(now)), "links", nxt)
        removed(spark, path)
        path = nxt


def joined_components(known: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """``components`` of the links that ``known`` comes from and of ``edges``.

    Steps are taken over the classes that ``edges`` joins only, each of which is one node, its least.
    """
    side = lambda c: known.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).join(side("a"), "a", "left").join(side("b"), "b", "left")
    more = components(between.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")), "a", "b")
    moved = known.join(more.select(F.col("node").alias("root"), F.col("root").alias("least")), "root", "left").select("node", F.coalesce("least", "root").alias("root"))
    return stored(moved.unionByName(more), "classes")

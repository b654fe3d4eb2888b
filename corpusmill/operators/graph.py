"""Walks over edge tables to their end, whatever its length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import shared_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder and read from there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def connected(keyed: DataFrame) -> DataFrame:
    """``row, group``: rows (``row``, ``keys``) that share a key, directly or through others, have one group.

    Rows of a key hang on its smallest row; then every tree is folded onto its smallest row: nodes take
    the smallest neighbour as parent, edges move from a node to its parent, until they are stars.  A
    chain of any length takes a logarithm of it in rounds.  Null keys join nothing.
    """
    pairs = keyed.select("row", F.explode("keys").alias("key")).where("key is not null")
    least = pairs.groupBy("key").agg(F.min("row").alias("top"))
    edges = checkpointed(pairs.join(least, "key").select(F.col("row").alias("a"), F.col("top").alias("b")).where("a <> b").distinct())
    count = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before, now = None, count(edges)
    while before != now:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        hung = both.join(parent, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = hung.groupBy("a").agg(F.min("b").alias("m"))
        edges = checkpointed(hung.join(lower, "a").select("b", "m").union(lower.select("a", "m")).toDF("a", "b").where("a <> b").distinct())
        before, now = now, count(edges)
    group = edges.select(F.col("a").alias("_row"), F.col("b").alias("_group"))
    return keyed.join(group, F.col("row") == F.col("_row"), "left").select("row", F.coalesce("_group", "row").alias("group"))


def reachable(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, most: int | None = None) -> DataFrame:
    """``node, depth`` of everything reachable from ``seeds`` (``node``) along ``edges`` (``src, dst``).

    A breadth-first walk by anti-joins to its end; ``rounds`` limits the depth and ``most`` stops it once
    more nodes are known, where a caller asks for that.
    """
    known = checkpointed(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    edge, depth = known, 0
    while rounds is None or depth < rounds:
        depth += 1
        step = edges.join(edge.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        edge = checkpointed(step.join(known, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not edge.take(1):
            break
        known = checkpointed(known.unionByName(edge))
        if most is not None and known.count() > most:
            break
    return known

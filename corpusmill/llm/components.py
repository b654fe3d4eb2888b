"""Connected components of an edge table by alternating large and small stars.

Every step is a DataFrame join on the smallest neighbour, so no node's neighbours are gathered in
one place, and each round is written to the shared folder to cut lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    out = both.join(least, "a").where(F.col("b") > F.col("a"))
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    out = down.join(least, "a")
    return out.select("b", "m").union(least.select("a", "m")).toDF("a", "b").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges`` (``a``, ``b``).

    Loops, repeated and two-way edges are fine; no edges give no rows.
    """
    check = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, seen = None, check(now)
    while before != seen:
        at = scratch.since(0)[-1:]
        now = scratch.save(_small(_large(now)), "stars")
        scratch.release(now.sparkSession, at)
        before, seen = seen, check(now)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

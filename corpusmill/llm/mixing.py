"""Mixing sources to target weights by pivotal dependent rounding, in built-in expressions only.

Each source gets a target (its weight's share of all words, at most ``cap`` times its own size,
the excess reshared by weight).  A document of the source is due ``target / source_size`` copies.
The whole part is certain; the fractional parts are rounded together: two documents meet, mass is
randomly moved from one to the other until one of them is empty or full, and the other goes on.
Blocks are folded in parallel; what is left of each block meets again a level higher, in a
reduction tree, until one remainder a source is drawn by itself: the words taken miss the target
by less than that one document.  No block outgrows the block size
by more than chance, whichever source is the largest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 128
SEED = 20240901


def _running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with ``rank`` (from 0) and, for each of ``sums``, the sum of a column over the rows before, by ``order``.

    Rows are dealt out in ranges, counted within each, and the totals of the ranges before are added:
    no task sees all rows, however many sources there are.
    """
    dealt = scratch.save(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "mix-ranges")
    names = {"rank": F.lit(1), **{k: F.col(v) for k, v in sums.items()}}
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_{k}") for k, c in names.items()])
    # one row a partition of the exchange
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_{k}").over(ahead), F.lit(0)).alias(f"_{k}") for k in names])
    rows = dealt.join(offsets, F.col("_part") == F.col("_p"))
    return rows.select(*df.columns, *[(F.col(f"_{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(k) for k, c in names.items()])


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row a source: ``source, source_size, target``.

    Sources in code-point order, null last, take the weights in turn.  With ``limit`` the cap of a
    source, the level at which ``min(limit, weight * level)`` adds up to all words is the largest
    of the levels found by taking the sources as capped one after the other.
    """
    by_name = F.col("source").asc_nulls_last()
    size = _running(sized.groupBy("source").agg(F.sum("size").alias("source_size")), [by_name], {})
    turn = F.pmod("rank", F.lit(len(weights))).cast("int")
    size = size.select("source", "source_size", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight"), (F.lit(cap) * F.col("source_size")).cast("double").alias("limit"))
    size = size.select("*", (F.col("limit") / F.col("weight")).alias("need"))
    size = scratch.save(_running(size, [F.col("need"), by_name], {"capped": "limit", "passed": "weight"}).drop("rank"), "mix-sources")
    whole = size.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(whole["size"] or 0) - F.col("capped")) / (F.lit(whole["weight"] or 0.0) - F.col("passed"))
    top = size.agg(F.max(level)).first()[0] or 0.0
    return size.select("source", "source_size", F.least("limit", F.col("weight") * F.lit(top)).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts, F.lit(SEED)), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


#: A document in the tree: its size, the hashes that tell it apart, and the words it may still take.
ITEM = "struct<size:bigint,key:bigint,nth:bigint,doc_id:bigint,tag:bigint,mass:double>"
DONE = "array<struct<size:bigint,nth:bigint,doc_id:bigint,tag:bigint,bit:int>>"
_WHO = ("nth", "doc_id", "tag")


def _fold(items: Column, level: int) -> Column:
    """Fold a sorted block: every item but one gets its bit; ``left`` is the one that goes on.

    Mass is counted in words, so the words that a block takes are kept exactly, not just the
    number of its documents.  Either way of moving mass is drawn with the chance that leaves each
    document's expectation as it was.
    """

    def item(x: Column, mass: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("size", "key", *_WHO)], mass.alias("mass"))

    def step(state: Column, b: Column) -> Column:
        a = state["left"]
        room_a, room_b, total = a["size"] - a["mass"], b["size"] - b["mass"], a["mass"] + b["mass"]
        to_a, to_b = F.least(room_a, b["mass"]), F.least(a["mass"], room_b)
        up = _uniform(a["key"], b["key"], a["size"], b["size"], F.lit(level)) * (to_a + to_b) < to_b
        fills = F.when(up, room_a <= b["mass"]).otherwise(room_b < a["mass"])
        a_ends = up == fills
        ended, goes = F.when(a_ends, a).otherwise(b), F.when(a_ends, b).otherwise(a)
        mass = F.when(fills, F.greatest(F.lit(0.0), total - ended["size"])).otherwise(total)
        left = F.when(a.isNull(), b).otherwise(item(goes, mass)).cast(ITEM)
        bit = F.struct(ended["size"].alias("size"), *[ended[c].alias(c) for c in _WHO], fills.cast("int").alias("bit"))
        done = F.when(a.isNull(), state["done"]).otherwise(F.array_append(state["done"], bit))
        return F.struct(left.alias("left"), done.cast(DONE).alias("done"))

    start = F.struct(F.lit(None).cast(ITEM).alias("left"), F.array().cast(DONE).alias("done"))
    return F.aggregate(items, start, step)


def _level(rows: DataFrame, level: int, block: int) -> DataFrame:
    """One level of the tree over ``source`` and the fields of an item: ``source, f(left, done)`` a block."""
    counts = rows.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")).select(F.col("source").alias("_s"), "blocks")
    rows = rows.join(counts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key", F.lit(SEED + level)), F.col("blocks")))
    item = F.struct("size", "key", *_WHO, "mass").cast(ITEM)
    return rows.groupBy("source", "block").agg(F.sort_array(F.collect_list(item), asc=False).alias("items")).select("source", _fold(F.col("items"), level).alias("f"))


def _sized(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, source, size`` of each row; ``tag`` is a hash of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("tag"), "source", F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"))


def _decided(docs: DataFrame, weights: tuple[int, ...], cap: int, block: int) -> DataFrame:
    """``doc_id, tag, nth, size, source, source_size, target, copies``: one row a row of ``docs``.

    Rows equal in id, text and source are numbered from their count, so they fall into blocks like all
    others, and a rerun numbers them alike.
    """
    with scratch.temporary(docs.sparkSession) as keep:
        sized = keep(_sized(docs), "mix-sizes")
        goal = keep(targets(sized, weights, cap), "mix-targets").select(F.col("source").alias("_s"), "source_size", "target")
        due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        goal = goal.select("*", F.floor(due + 1e-12).alias("whole"), F.greatest(F.lit(0.0), due - F.floor(due + 1e-12)).alias("part"))
        same_source = F.col("source").eqNullSafe(F.col("_s"))
        each = sized.where("size > 0").groupBy("source", "doc_id", "tag", "size").agg(F.count(F.lit(1)).alias("times"))
        each = each.select("source", "doc_id", "tag", "size", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth"))
        key = F.xxhash64(F.coalesce("doc_id", "tag"), F.when(F.col("doc_id").isNull() | (F.col("nth") > 1), F.col("nth")), F.col("tag")).alias("key")
        rows = each.join(goal, same_source).select("source", "size", key, *_WHO, (F.col("part") * F.col("size")).alias("mass"))
        found = [sized.where("size = 0").select("source", "size", F.lit(0).cast("bigint").alias("nth"), "doc_id", "tag", F.lit(0).alias("bit"))]
        level = 0
        while True:
            folded = keep(_level(rows, level, block), f"mix-level{level}")
            found.append(folded.select("source", F.explode("f.done").alias("d")).select("source", "d.size", *[f"d.{c}" for c in _WHO], "d.bit"))
            rows = folded.select("source", "f.left.*")
            level += 1
            if not rows.groupBy("source").count().where("count > 1").take(1):
                break
    last = F.when(_uniform(F.col("key"), F.col("size"), F.lit(-1)) * F.col("size") < F.col("mass"), 1).otherwise(0)
    found.append(rows.select("source", "size", *_WHO, last.alias("bit")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.join(goal, same_source).select("doc_id", "tag", "nth", "size", "source", "source_size", "target", (F.col("whole") + F.col("bit")).cast("int").alias("copies"))


def decide(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """``doc_id, size, source, source_size, target, copies, taken``: one row a row of ``docs``.

    Null or empty texts have size 0 and take 0.  Rows that share an id, null included, are rounded one
    by one.  A source without words has target 0.  The draws depend on ids, texts, sizes and sources
    alone, so reruns agree.
    """
    out = _decided(docs, weights, cap, block)
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as it is taken, its columns unchanged.

    Rows are told apart by id, text and source; rows equal in all three are interchangeable.
    """
    decided = _decided(docs, weights, cap, BLOCK).where("size > 0")
    taken = decided.groupBy(F.col("tag").alias("__mill_tag"), _who("tag").alias("__mill_who")).agg(F.sort_array(F.collect_list("copies")).alias("__mill_copies"))
    rows = docs.withColumn("__mill_t", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("__mill_w", _who("__mill_t"))
    # numbered and joined by the same two columns, so that the texts are exchanged once
    nth = F.row_number().over(Window.partitionBy("__mill_t", "__mill_w").orderBy("__mill_t"))
    rows = rows.withColumn("__mill_nth", nth)
    rows = rows.join(taken, (F.col("__mill_t") == F.col("__mill_tag")) & (F.col("__mill_w") == F.col("__mill_who")))
    rows = rows.withColumn("__mill_copies", F.get("__mill_copies", F.col("__mill_nth") - 1)).where("__mill_copies > 0")
    rows = rows.withColumn("__mill_copy", F.explode(F.sequence(F.lit(1), F.col("__mill_copies"))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def _who(tag: str) -> Column:
    """With ``tag``, what tells a row apart: a hash of id, source and text that isn't null."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source", tag)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return decide(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")

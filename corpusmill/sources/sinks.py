"""Sinks: collections, ledgers and renderings.  Spark's commit protocol makes each write whole or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_collection(df: DataFrame, path: str, level: int = 19) -> None:
    df.write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)


def rewrite_collection(df: DataFrame, path: str, level: int = 19) -> int:
    """Write a collection anew and return its number of rows; refused if a row got lost on the way."""
    seen = Observation("rewritten")
    write_collection(df.observe(seen, F.count(F.lit(1)).alias("n")), path, level)
    stored = df.sparkSession.read.parquet(path).count()
    if stored != seen.get["n"]:
        raise RuntimeError(f"{seen.get['n']} rows were read, {stored} are stored")
    return stored


def write_lines(df: DataFrame, tokens: str, path: str) -> None:
    """Token arrays as lines, two spaces between tokens, blank tokens left out."""
    df.select(line_format(F.col(tokens)).alias("value")).write.mode("overwrite").text(path)


def line_format(tokens: Column) -> Column:
    return F.array_join(F.filter(tokens, lambda t: F.trim(t) != ""), "  ")


def tagged_format(tokens: Column) -> Column:
    """``surface{tag,tag}`` of structs (surface, tags); an end of sentence is its bare surface."""
    one = lambda t: F.when(F.size(t["tags"]) > 0, F.concat(t["surface"], F.lit("{"), F.array_join(t["tags"], ","), F.lit("}"))).otherwise(t["surface"])
    return F.array_join(F.transform(tokens, one), "  ")


def parse_tagged(line: Column) -> Column:
    """``array<struct<surface, tags>>`` of a tagged line."""
    tags = lambda s: F.filter(F.split(F.regexp_extract(s, r"\{([^}]*)\}$", 1), ","), lambda t: t != "")
    return F.transform(F.filter(F.split(line, "  +"), lambda s: s != ""), lambda s: F.struct(F.regexp_replace(s, r"\{[^}]*\}$", "").alias("surface"), tags(s).alias("tags")))


def position_format(tokens: Column) -> Column:
    """First character of each token, and its length less one."""
    return F.transform(F.filter(tokens, lambda t: F.trim(t) != ""), lambda t: F.struct(F.left(t, F.lit(1)).alias("index"), (F.length(t) - 1).alias("syllable")))


def append_unseen(new: DataFrame, ledger: DataFrame, keys: list[str], path: str) -> None:
    """Append the rows whose keys the ledger doesn't hold, one of each."""
    new.join(ledger.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys).write.mode("append").parquet(path)


def without(ledger: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger without the rows of ``gone``."""
    return ledger.join(gone.select(*keys).distinct(), keys, "left_anti")


def write_json_in_order(df: DataFrame, key: str, path: str) -> None:
    df.orderBy(key).write.mode("overwrite").json(path)


def append_json(df: DataFrame, path: str) -> None:
    """Append records to a journal; a write that fails leaves none."""
    df.write.mode("append").json(path)

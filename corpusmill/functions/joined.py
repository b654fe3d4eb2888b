"""Lookups in lexicons of any size: runs of a text meet the lexicon in a join, and the text is walked with the answers.

A run is a stretch that entries may lie in: characters of the lexicon's own alphabet, or ids without a gap.  Distinct
runs are cut into the pieces that are as long as some entry, and only digests of runs travel with the pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import storage

FLUSH = 65_536
Runs = Callable[[object], list[tuple[int, object]]]


def digest(run) -> bytes:
    """Sixteen bytes that name a run: a string or a list of strings."""
    parts = [run] if isinstance(run, str) else [str(len(run)), *(f"{len(x)}:{x}" for x in run)]
    return hashlib.md5("\n".join(parts).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def batches_of(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded length."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held = []
    cols = list(zip(*held, strict=True)) or [()] * len(kinds)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def runs_of_alphabet(entries: DataFrame, column: str) -> Runs:
    """A function that finds the runs of the characters that ``column`` has; there are no more of them than code points."""
    letters = [r[0] for r in entries.select(F.explode(F.split(column, "")).alias("c")).distinct().collect() if r[0]]
    pattern = "[" + "".join(map(re.escape, sorted(letters))) + "]+" if letters else r"(?!)"

    def runs(t: str) -> list[tuple[int, str]]:
        return [(m.start(), m[0]) for m in re.finditer(pattern, t)]

    return runs


def runs_of_ids(ids: list[str | None]) -> list[tuple[int, list[str]]]:
    """Stretches without a null."""
    out: list[tuple[int, list[str]]] = []
    for k, x in enumerate(ids):
        if x is None:
            continue
        if out and out[-1][0] + len(out[-1][1]) == k:
            out[-1][1].append(x)
        else:
            out.append((k, [x]))
    return out


def asked(docs: DataFrame, value: Column, runs: Runs) -> DataFrame:
    """``tag, key, run``: the runs of each row's value under the value's hash; rows whose hashes collide share answers, which are right for both."""
    kind = "array<string>" if docs.select(value.alias("v")).schema["v"].dataType.typeName() == "array" else "string"
    rows = docs.select(F.xxhash64(value).alias("tag"), value.alias("value")).where("value IS NOT NULL")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for k in range(b.num_rows):
                    tag, once = b.column(0)[k].as_py(), {}
                    for _, run in runs(b.column(1)[k].as_py()):
                        once.setdefault(digest(run), run)
                    for key, run in once.items():
                        yield tag, key, run

        yield from batches_of(rows(), ["tag", "key", "run"], [pa.int64(), pa.binary(), pa.list_(pa.string()) if kind != "string" else pa.string()])

    return rows.mapInArrow(ask, f"tag bigint, key binary, run {kind}")


def spans(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """``key, spans``: the entries (``path, value``) that lie in each run (``key, run``); of equal paths the least value counts."""
    long = F.length if entries.schema["path"].dataType.typeName() == "string" else F.size
    unique = entries.where(F.col("path").isNotNull()).groupBy("path").agg(F.min("value").alias("value"))
    sizes = sorted(r[0] for r in unique.select(long("path").alias("n")).distinct().collect() if r[0] > 0)  # as many as entries have lengths
    kind = entries.schema["path"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((key, start, run[start : start + n]) for b in batches for key, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for start in range(len(run)) for n in sizes if start + n <= len(run))
        yield from batches_of(rows, ["key", "start", "path"], [pa.binary(), pa.int32(), pa.string() if kind == "string" else pa.list_(pa.string())])

    pieces = runs.mapInArrow(cut, f"key binary, start int, path {kind}")
    return pieces.join(unique, "path").groupBy("key").agg(F.collect_list(F.struct("start", long("path").alias("size"), "value")).alias("spans"))


def with_answers(docs: DataFrame, value: Column, runs: Runs, answers: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` with ``mill_found``: for each run of the row's value what ``answers`` says (``key, spans`` for ``key, run``)."""
    path = storage.new_path(docs.sparkSession, "runs")
    asked(docs, value, runs).write.parquet(path)  # read twice
    all_runs = docs.sparkSession.read.parquet(path)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes but much work each, so Spark isn't to merge the tasks
    said = answers(all_runs.select("key", "run").dropDuplicates(["key"]).repartition(tasks, "key"))
    of_tag = all_runs.select("tag", "key").distinct().join(said, "key").groupBy(F.col("tag").alias("mill_tag")).agg(F.collect_list(F.struct("key", "spans")).alias("mill_found"))
    return docs.withColumn("mill_tag", F.xxhash64(value)).join(of_tag, "mill_tag", "left").drop("mill_tag")


class Answers:
    """The longest entry at each place of one text, as the walks ask for it."""

    def __init__(self, sequence, runs: Runs, found: list[dict] | None):
        said = {f["key"]: f["spans"] for f in found or ()}
        self.at: dict[int, tuple[int, object]] = {}
        for offset, run in runs(sequence) if said else ():
            for s in said.get(digest(run), ()):
                k = offset + s["start"]
                if k + s["size"] > self.at.get(k, (0, None))[0]:
                    self.at[k] = k + s["size"], s["value"]

    def longest(self, sequence, start: int) -> tuple[int, object]:
        return self.at.get(start, (start + 1, None))

"""Intermediate tables in the folder that all executors share.

A table written here cuts lineage and outlives a lost executor.  The folder is the session's
``spark.checkpoint.dir``; where that is unset, a temporary one is set in local mode (tests), and on
a cluster the run is refused, as its executors wouldn't see each other's files.

A table can go once nothing reads it any more: inside :func:`temporary` go all but those kept.
What a returned DataFrame still reads goes with :func:`release`, or with the folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_of_thread = threading.local()


def _written() -> list[str]:
    """Paths of the tables that this thread wrote."""
    if not hasattr(_of_thread, "paths"):
        _of_thread.paths = []
    return _of_thread.paths


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="corpusmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written().append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables this thread wrote so far, for :func:`since`."""
    return len(_written())


def since(place: int) -> list[str]:
    """Paths of the tables that this thread wrote after a mark and that are still there."""
    return _written()[place:]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    for path in list(paths):
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        if path in _written():
            _written().remove(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete the tables saved inside at its end, but for those saved by the function it gives."""
    at, kept = mark(), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = save(df, name)
        kept.append(_written()[-1])
        return out

    try:
        yield keep
    finally:
        release(spark, [p for p in since(at) if p not in kept])


def width(spark: SparkSession) -> int:
    """How many partitions an exchange gets: the session's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

"""Bounded samples of rows to fit models on.

Rows are told apart by id and text: repeated rows count once, and rows that share an id, null included, are
chosen apart from each other.  Those of least hash are taken, so reruns agree on any layout of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ONE = 1 << 30
_SPARE = 1.5  # of the rows wanted, so that the estimate of their number may be off


def bounded(rows: DataFrame, size: int, columns: list[str], by: Column | None = None, groups: int = 1) -> DataFrame:
    """``columns`` of at most ``size`` different rows (by ``doc_id`` and ``text``) of each value of ``by``.

    Of the values of ``by`` the ``groups`` with most rows take part (on a tie the first in order).  Rows are
    never all or none: with rows there is a sample, and no more than ``size * groups`` rows leave.  One pass estimates
    how many different rows there are, the next thins them by hash before anything is exchanged.
    """
    key, group = F.xxhash64("doc_id", "text", F.lit("sample")).alias("k"), (F.lit(0) if by is None else by).alias("g")
    keyed = rows.select(key, group, F.struct(*columns).alias("row"))
    sizes = keyed.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("k").alias("d"))
    found = sizes.where(F.col("g").isNotNull()).orderBy(F.desc("n"), "g").limit(groups).collect()
    if not found:
        return keyed.where(F.lit(False)).select("row.*")
    share = [x for r in found for x in (F.lit(r["g"]), F.lit(int(min(1.0, _SPARE * size / max(1, r["d"])) * _ONE)))]
    thin = keyed.where(F.pmod("k", F.lit(_ONE)) < F.element_at(F.create_map(*share), F.col("g")))
    once = thin.groupBy("g", "k").agg(F.first("row").alias("row"))
    place = F.row_number().over(Window.partitionBy("g").orderBy("k"))
    return once.withColumn("place", place).where(F.col("place") <= size).select("row.*")

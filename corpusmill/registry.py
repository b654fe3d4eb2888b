"""Every query of the library by name, with its DuckDB statement where SQL can express it."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "operators.text_queries",
    "operators.corpus",
    "operators.ordered",
    "operators.repair_queries",
    "operators.page_queries",
    "operators.matching",
    "operators.audit",
    "operators.grammar",
    "operators.column_queries",
    "operators.source_queries",
    "operators.variant_queries",
    "operators.particles",
    "operators.engine_queries",
    "operators.clauses",
    "operators.shape_matching",
    "operators.mending",
    "operators.templates",
    "operators.two_way",
)


def _catalogs():
    return [importlib.import_module(f"corpusmill.{m}").C for m in MODULES]


def queries() -> dict:
    return {k: v for c in _catalogs() for k, v in c.queries.items()}


def oracles() -> dict[str, str]:
    return {k: v for c in _catalogs() for k, v in c.oracles.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["structural_quality_gate"](spark, sf_dir)

"""Every query at the smallest scale, against DuckDB where it has a statement."""

import pytest

from corpusmill import registry

from .oracle import compare

SF = "/root/testdata/sf0.001"
MAY_BE_EMPTY = {"lookalike_repairs", "fuzzy_memory"}
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        compare(spark, SF, QUERIES[name], ORACLES[name])
    else:
        # values are compared in test_brute, test_whole and test_functions; here, that the query gives named rows
        df = QUERIES[name](spark, SF)
        assert len(set(df.columns)) == len(df.columns)
        assert name in MAY_BE_EMPTY or df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

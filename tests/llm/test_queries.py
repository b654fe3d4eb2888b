"""The queries with a DuckDB statement, at the smallest scale."""

import pytest

from corpusmill.llm import catalog
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    compare(spark, SF, catalog.QUERIES[name], catalog.ORACLES[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))

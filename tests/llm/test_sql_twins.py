"""Queries of the subpackage that SQL can express, against it."""

import pytest

from tests.compare import duck_rows, spark_rows
from tickweave.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    got, want = spark_rows(registry.queries()[name](spark, "/root/testdata/sf0.001")), duck_rows(registry.oracle_sql()[name], "/root/testdata/sf0.001")
    assert got == want and sum(want[1].values()) > 0

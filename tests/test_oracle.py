import pytest

from tests.compare import duck_rows, spark_rows
from tickweave.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_matches_sql(spark, name):
    got = spark_rows(registry.queries()[name](spark, SF))
    want = duck_rows(registry.oracle_sql()[name], SF)
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert sum(want[1].values()) > 0 or name in {"c2_bootstrap_simple"}

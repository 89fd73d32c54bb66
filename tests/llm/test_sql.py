import pytest

from millrace.llm import registry
from oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    compare(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)

import pytest

from millrace.plans import catalogue
from oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, name):
    compare(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name], SF)


def test_entry_recovers_planted_model(spark):
    got = {r["idx"]: r["estimate"] for r in catalogue.entry(spark, SF).collect()}
    assert [round(got[i], 4) for i in range(5)] == [0.5072, 0.9283, -0.9571, 1.1756, 0.9396]


def test_wide_binding(spark):
    rows = catalogue.queries()["embeddings_binary_newton"](spark, SF).collect()
    assert abs(sum(r["estimate"] ** 2 for r in rows) ** 0.5 - 5.9139) < 1e-3

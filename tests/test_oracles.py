import pytest
from oracle import compare, tables

from ledgerloom.plans import registry

ROOT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return tables(ROOT)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got, wanted = compare(spark, con, ROOT, registry.queries()[name], registry.oracle_sql()[name])
    assert len(got) == len(wanted)
    assert got == wanted

import pytest
from check_oracles import compare, duck

from graphloom.plans.oracles import ORACLES
from graphloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
SLOW = {"cycles_members", "parsed_callables", "parsed_edges", "parsed_imports"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_equals_sql(spark, con, name):
    diff, _ = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert diff == ""

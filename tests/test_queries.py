import pytest

import __spark_entry__ as contract
import workload
from tests.oracle import compare, database

SMALL = "/root/testdata/sf0.001"


LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def databases():
    return {sf_dir: database(sf_dir) for sf_dir in (SMALL, LARGER)}


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_query_equals_sql(spark, databases, name):
    sql = workload.ORACLES.get(name)
    assert sql, "every query has SQL"
    difference = compare(spark, databases[SMALL], SMALL, workload.QUERIES[name], sql)
    if difference == "no rows":  # then the larger tables must give some
        difference = compare(spark, databases[LARGER], LARGER, workload.QUERIES[name], sql)
    assert difference is None, difference


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns[0] == "project" and rows.count() > 0

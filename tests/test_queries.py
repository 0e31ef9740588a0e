"""Every registered query against its SQL on the smallest generated tables."""

import pytest

import __spark_entry__ as entry_points
from check import compare, duck
from workload.oracles import ORACLES
from workload.queries import QUERIES as OWN

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: query for name, query in entry_points.queries().items() if name in OWN}


@pytest.fixture(scope="module")
def database():
    connection = duck(SF_DIR)
    yield connection
    connection.close()


def test_every_oracle_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, database, name):
    result = compare(spark, database, SF_DIR, name, QUERIES[name], ORACLES.get(name))
    assert result.startswith(("ok", "rows")), result


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["brand_name", "category", "brand_health_index", "health_label", "alert_flag"]
    assert df.count() > 0

"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from fixtures.cases import CASES
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = {name: q for name, q in entry.queries().items() if name in CASES}, entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["hostname", "groupname", "member_username"]
    assert df.count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert name in ORACLE
    ok, message = compare(df, con, ORACLE[name])
    assert ok, message

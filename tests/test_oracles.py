"""Every registered query against its reference SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as e
from tests.check_oracles import compare

SF = "/root/testdata/sf0.001"


def test_every_query_has_reference_sql():
    assert set(e.ORACLES) == set(e.QUERIES)


def test_entry(spark):
    assert e.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", list(e.QUERIES))
def test_query(spark, name):
    result, _ = compare(spark, name, SF, e.queries()[name], e.oracle_sql().get(name))
    assert result.startswith("ok"), result

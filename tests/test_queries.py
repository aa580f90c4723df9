"""Every query of the core against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from kilnspan.plans import catalogue
from tests.helpers import from_spark, from_sql

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    got = from_spark(catalogue.QUERIES[name](spark, FOLDER))
    if name in catalogue.SQL:
        assert got == from_sql(FOLDER, catalogue.SQL[name])


def test_entry(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"model_id", "phase", "global_batch_id", "lm_loss"}
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

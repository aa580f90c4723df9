"""Every query of the subpackage on the smallest tables, against its SQL where there is one."""

import os

import pytest

from kilnspan.llm import queries, sql
from tests.helpers import from_spark, from_sql

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = from_spark(queries.QUERIES[name](spark, FOLDER))
    if name in sql.SQL:
        assert got == from_sql(FOLDER, sql.SQL[name])

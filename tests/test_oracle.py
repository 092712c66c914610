"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from quirework.plans.compare import compare

from .conftest import SF_DIR

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    message = compare(QUERIES[name](spark, SF_DIR), con, ORACLE.get(name))
    assert message.startswith("ok"), message
    assert "EMPTY" not in message


def test_entry(spark):
    assert entry.entry(spark).count() > 0

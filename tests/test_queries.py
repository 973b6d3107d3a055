"""Every registered query against its SQL, on the smallest tables."""

import pytest
from conftest import SF

from checks.compare import differences, duck
from checks.oracle import ORACLE, WITHOUT_SQL
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) | WITHOUT_SQL
    assert not set(ORACLE) & WITHOUT_SQL


@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, con, name):
    assert differences(spark, con, SF, QUERIES[name], ORACLE[name]) == []

"""Queries beside their SQL, on the smallest tables, and the guard of the entry."""

import pytest
from conftest import SF

import __spark_entry__ as entry
from checks.compare import TABLES, differences, duck
from scoreloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, name):
    assert "pages" in TABLES and "benchmark" in TABLES
    assert differences(spark, duck(SF), SF, QUERIES[name], ORACLE[name]) == []


def test_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(ORACLE) <= set(entry.oracle_sql())

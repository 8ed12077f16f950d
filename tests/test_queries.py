"""Every registered query against its DuckDB statement, and registration rules."""

import pytest

import __spark_entry__ as entry
from checks.compare import connect, difference
from checks.oracle_sql import statements as checks_statements

STATEMENTS = checks_statements(entry.AS_OF.isoformat())
QUERIES = {name: query for name, query in entry.queries().items() if name in entry._SHOP_QUERIES}


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", QUERIES)
def test_matches_statement(spark, data, duck, name):
    assert difference(QUERIES[name](spark, data), duck, STATEMENTS[name]) is None


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(STATEMENTS)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 5


def test_all_classes_occur(spark, data):
    """The data reaches every branch of the classifications."""
    urgency = {r[0] for r in QUERIES["gold_predictive_maintenance"](spark, data).select("maintenance_urgency").distinct().collect()}
    load = {r[0] for r in QUERIES["gold_capacity_planning"](spark, data).select("load_status").distinct().collect()}
    assert urgency == {"Critical", "Warning", "Normal"}
    assert load == {"Overloaded", "High Load", "Normal", "Underutilized"}

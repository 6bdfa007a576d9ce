"""Every registered query against its SQL twin."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from deskloom.plans.oracle import ORACLE_SQL
from deskloom.plans.registry import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MAY_BE_EMPTY = {"duplicates_email"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert compare(df, con, entry.oracle_sql()[name]) is None
    if name not in MAY_BE_EMPTY:
        assert not df.isEmpty()


def test_entry(spark):
    rows = {r["status"]: r["n"] for r in entry.entry(spark).collect()}
    assert set(rows) == {"Pending", "Ongoing", "Complete"} and sum(rows.values()) == 1500


@pytest.mark.parametrize(
    "name, order",
    [
        ("tickets_by_day", lambda r: r["day"]),
        ("top_stores", lambda r: (-r["n"], r["store_name"])),
        ("company_history", lambda r: r["id"]),
        ("home_list", lambda r: (-r["sort_date"].timestamp(), -r["ticket_no"])),
    ],
)
def test_order(spark, name, order):
    rows = entry.queries()[name](spark, SF_DIR).collect()
    assert rows == sorted(rows, key=order)

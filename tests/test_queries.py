"""Queries against their SQL on the smallest scale; the checker covers all of them."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, compare

SF = "/root/testdata/sf0.001"
SMALL = ["page_markdown", "node_counts", "source_census", "entity_text", "table_cells", "timeline_items", "report_markdown",
         "capture_plan", "missing_image_count", "lost_components"]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", SMALL)
def test_equals_sql(spark, db, name):
    assert compare(spark, db, SF, name).startswith("equal")


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["page_id", "md"]

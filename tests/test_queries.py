import os

import duckdb
import pytest

import __spark_entry__ as entry
from lakekit.operators import merge, search, weblinks
from lakekit.plans import views
from lakekit.plans.conformance import TABLES
from lakekit.plans.views import table
from tools.check_oracles import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return connection


def test_entry(spark):
    assert entry.entry(spark).count() == 11
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    line = compare(spark, con, SF, name)
    assert line.startswith(("ok", "rows")) and "TYPES" not in line, line


def plan(df):
    return df._jdf.queryExecution().toString()


def test_rows_per_key_are_limited_before_the_shuffle(spark):
    for df in (
        merge.store_if_better(views.snapshots(spark, SF), "key", "score", "seq"),
        merge.version_history(views.snapshots(spark, SF), "key", ["ts", "seq"]),
        search.search_batch(views.repo_meta(spark, SF), {1: "csv"}),
        weblinks.project_links(weblinks.page_links(table(spark, SF, "pages"), "page_id"), "page_id", "https://m"),
    ):
        text = plan(df)
        assert text.index("Final") < text.index("Partial") and "WindowGroupLimit" in text


def test_filters_and_columns_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF}/part.parquet")
    text = plan(df.filter("p_size > 30").select("p_partkey"))
    assert "PushedFilters: [IsNotNull(p_size), GreaterThan(p_size,30)]" in text
    text = plan(search.best(views.repo_meta(spark, SF), 5).select("seq"))
    assert "TakeOrderedAndProject" in text and "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in text


def test_no_query_uses_a_cross_join(spark):
    for name in ("search_batch", "pii_columns", "health_score", "repo_quality", "upsert", "candidate_select", "rows_sort"):
        text = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name

"""Bloom filters before joins, and row counts out of footers."""

from pyspark.sql import functions as F

from lakekit.catalog import NO_TABLES, Catalog
from lakekit.operators import keyfilter


def test_filter_clears_most_others_and_no_key(spark):
    keys = spark.range(0, 20_000, 2, 4).selectExpr("concat('https://h.org/', id) AS url")
    may = keyfilter.key_filter(keys, "url")
    rows = spark.range(20_000).selectExpr("id", "concat('https://h.org/', id) AS url")
    passed = rows.where(may(F.col("url")))
    assert passed.where("id % 2 = 0").count() == 10_000
    assert passed.where("id % 2 = 1").count() < 300
    small = keyfilter.key_filter(keys, "url", max_bytes=1)
    assert rows.where("id % 2 = 0").where(~small(F.col("url"))).count() == 0
    assert spark.createDataFrame([(None,)], "url string").where(may(F.col("url"))).count() == 0
    assert rows.where(keyfilter.key_filter(keys.where("false"), "url")(F.col("url"))).count() == 0


def test_rows_without_blocked_keys(spark):
    blocked = spark.createDataFrame([("b",), ("d",), ("d",), (None,)], "url string")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d"), (5, "a")], "n int, url string")
    for limit in (0, 1_000):
        kept = keyfilter.without_keys(rows, blocked, "url", limit)
        assert kept.columns == ["n", "url"] or limit
        assert sorted(r.n for r in kept.collect()) == [1, 3, 5]
    plan = keyfilter.without_keys(rows, blocked, "url", 0)._jdf.queryExecution().optimizedPlan().toString()
    # Cleared rows never meet the join.
    assert plan.startswith("Union") and plan.count("LeftAnti") == 1


def test_footers_count_stored_tables(spark, tmp_path):
    catalog = Catalog(spark)
    assert catalog.schema_context() == NO_TABLES and catalog.list_tables().count() == 0
    for i in range(6):
        spark.range(i * 10).selectExpr("id", "cast(id as string) AS s", "id % 2 AS p").write.partitionBy("p").parquet(str(tmp_path / f"t {i}+"))
    for i in range(1, 6):
        catalog.ingest_parquet(f"t{i}", str(tmp_path / f"t {i}+"))
    catalog.register("some", catalog.tables["t3"].where("id < 5"))
    rows = {r.table: r.rows for r in catalog.list_tables().collect()}
    assert rows == {**{f"t{i}": i * 10 for i in range(1, 6)}, "some": 5}
    plan = catalog._stored_rows()._jdf.queryExecution().toString()
    # One scan for all tables, and no column of theirs.
    assert plan.split("== Physical Plan ==")[1].count("FileScan parquet") == 1 and "ReadSchema: struct<>" in plan
    assert catalog.schema_lines(canonical=True).where("table = 't2'").first().line == "Table 't2' (20 rows): id (integer), s (string), p (integer)"
    # A name that comes to stand for something else is counted anew.
    catalog.register("t2", spark.range(3).toDF("x"))
    assert {r.table: r.rows for r in catalog.list_tables().collect()}["t2"] == 3

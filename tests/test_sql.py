import re

import pytest
from pyspark.sql import DataFrame

from lakekit.catalog import Catalog, run_sql
from lakekit.operators import statements


def test_guards(spark):
    texts = ["SELECT 1", "drop table x", "SELECT 'update' AS u", "SELECT updated FROM t", "COPY t TO 'x'", "select 1; Delete from t"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    found = [r.refused for r in statements.sql_guard(df, "s").collect()]
    words = re.compile(r"\b(DROP|DELETE|UPDATE|INSERT|ALTER|TRUNCATE|CREATE)\b", re.IGNORECASE)
    assert found == [bool(words.search(t)) for t in texts]
    for good in ["SELECT 1", "select 'drop' x -- delete", "WITH a AS (SELECT 1) SELECT * FROM a", "FROM t SELECT a",
                 "VALUES (1)", "(SELECT 1)", "SELECT replace(a, 'x', 'y') FROM t;", 'SELECT "set" FROM t']:
        assert statements.is_read_only(good), good
    for bad in ["COPY t TO 'x'", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "SET a = 1", "SELECT 1; SELECT 2", "", "EXPLAIN SELECT 1"]:
        assert not statements.is_read_only(bad), bad


def test_extraction(spark):
    answers = ["Sure:\n```sql\nSELECT 1;\n```\nok", "```\nSELECT 2\n```", " SELECT 3;; ", "```sql\nSELECT 4"]
    df = spark.createDataFrame([(t,) for t in answers], "a string")
    assert [r.sql for r in statements.extract_sql(df, "a").collect()] == ["SELECT 1", "SELECT 2", "SELECT 3", "SELECT 4"]
    texts = ['x ```json\n{"a":1}\n``` y', '```\n[1]\n```', '{"b":2}', "no", "```json\n{}"]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    found = [(r.json, r.valid) for r in statements.extract_json(df, "a").collect()]
    assert found == [('{"a":1}', True), ("[1]", True), ('{"b":2}', True), ("no", False), (None, False)]


def test_catalog_queries(spark):
    catalog = Catalog(spark)
    assert catalog.schema_context() == "No tables registered." and catalog.list_tables().count() == 0
    catalog.register("my-table", spark.range(5))
    assert catalog.envelope('SELECT "id" FROM my_table WHERE "id" > 2') == {
        "columns": ["id"], "rows": [[3], [4]], "row_count": 2, "sql": 'SELECT "id" FROM my_table WHERE "id" > 2'
    }
    assert isinstance(catalog.query("SELECT * FROM my_table"), DataFrame)
    with pytest.raises(PermissionError):
        catalog.query("DROP TABLE my_table")
    with pytest.raises(ValueError):
        catalog.envelope("SELECT * FROM my_table", max_rows=4)
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == "false"
    assert run_sql(spark, 'SELECT "v" FROM t', {"t": spark.createDataFrame([(7,)], "v int")}).first()[0] == 7


@pytest.mark.parametrize(
    "sql",
    [
        r"SELECT '\'' ; INSERT INTO t VALUES (1) --'",
        "FROM t -- x\rINSERT INTO u SELECT *",
        "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a",
        "FROM t INSERT INTO u SELECT *",
        "SELECT r'\\' , 1 FROM t; DROP TABLE t --'",
        "SELECT 1 /* open",
        "SELECT 'open",
        "SELECT 1 /* a /* b */ ; DROP TABLE t */ ; DROP TABLE t",
        "EXPLAIN SELECT 1",
        "VALUES (1) ; VALUES (2)",
    ],
)
def test_gate_refuses(spark, sql):
    with pytest.raises(PermissionError):
        Catalog(spark).query(sql)


@pytest.mark.parametrize("sql", ["SELECT 'drop table x' AS s", r"SELECT 'it\'s; DELETE' AS s", "SELECT 1 -- insert\n", "SELECT 1 /* a /* drop */ */", "FROM VALUES (1) AS t(a) SELECT a", "WITH a AS (SELECT 1 AS x) SELECT * FROM a"])
def test_gate_lets_reading_through(spark, sql):
    assert Catalog(spark).query(sql).count() == 1

"""Inputs that Spark derives from the driver tables, each over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekit.functions.text import suffix
from lakekit.operators.governance import license_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text(column: str) -> Column:
    return F.col(column).cast("string")


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of downloaded projects: ten documents, and two event property files, per project."""
    k = F.col("doc_id") % 10
    name = (
        F.when(k == 0, "LICENSE")
        .when(k == 1, "README.md")
        .when(k.between(2, 4), F.concat(F.lit("data_"), k.cast("string"), F.lit(".csv")))
        .when(k == 5, "meta_5.json")
        .otherwise(F.concat(F.lit("note_"), k.cast("string"), F.lit(".txt")))
    )
    documents = table(spark, sf_dir, "documents").select(
        F.expr("concat('repo_', doc_id div 10)").alias("repo"), name.alias("name"), F.col("text").alias("content")
    )
    events = table(spark, sf_dir, "events").select(
        F.expr("concat('repo_', event_id div 2)").alias("repo"),
        F.concat(F.lit("event_"), text("event_id"), F.lit(".json")).alias("name"),
        F.col("props").alias("content"),
    )
    return documents.unionByName(events).select(
        "repo",
        F.concat_ws("/", "repo", "name").alias("path"),
        "name",
        suffix(F.col("name")).alias("suffix"),
        F.octet_length("content").cast("bigint").alias("size"),
        "content",
    )


def repo_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project records, one per document."""
    docs = table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 3
    none = F.expr("cast(array() as array<string>)")
    return docs.select(
        F.col("doc_id").alias("seq"),
        F.concat_ws("/", "source", text("doc_id")).alias("repo_name"),
        F.concat(F.lit("https://example.org/"), "source", F.lit("/"), text("doc_id")).alias("repo_url"),
        F.col("source").alias("mirror_name"),
        F.col("text").alias("description"),
        F.col("n_chars").alias("stars"),
        F.col("lang").alias("language"),
        F.array("lang", "source").alias("tags"),
        F.when(kind == 0, F.array(F.lit("a.csv"), F.lit("b.csv")))
        .when(kind == 1, F.array(F.lit("c.json")))
        .otherwise(none)
        .alias("data_files"),
        F.when(kind == 0, F.array(F.lit(".csv")))
        .when(kind == 1, F.array(F.lit(".json")))
        .otherwise(none)
        .alias("data_types"),
        (F.col("doc_id") % 7 == 0).alias("api_docs_found"),
        (F.col("n_chars") % 41 + F.col("doc_id") % 10).cast("double").alias("quality_score"),
        F.concat(F.lit("Language: "), "lang").alias("structure_summary"),
        license_of(F.col("text")).alias("license"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int")))
        .alias("ingested_at"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"),
        F.col("o_totalprice").alias("score"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderstatus").alias("license"),
    )


def probe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"),
        "ts",
        F.col("event_id").alias("seq"),
        (F.col("event_type") != "error").alias("ok"),
        F.col("value").alias("latency"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored API answers: the orders of a customer in pages of a bounded key range, wrapped five ways."""
    orders = table(spark, sf_dir, "orders")
    item = F.concat(F.lit('{"id": '), text("o_orderkey"), F.lit(', "status": "'), "o_orderstatus", F.lit('"}'))
    pages = (
        orders.select("o_custkey", F.floor(F.col("o_orderkey") / 4096).alias("page"), "o_orderkey", item.alias("item"))
        .groupBy("o_custkey", "page")
        .agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "item"))).alias("items"))
    )
    listed = F.concat(F.lit("["), F.array_join(F.transform("items", lambda i: i["item"]), ", "), F.lit("]"))
    kind = F.col("o_custkey") % 5

    def wrapped(key: str) -> Column:
        return F.concat(F.lit('{"' + key + '": '), listed, F.lit("}"))

    body = (
        F.when(kind == 0, listed)
        .when(kind == 1, wrapped("data"))
        .when(kind == 2, wrapped("results"))
        .when(kind == 3, wrapped("items"))
    )
    # The last shape holds one order, so its customers have one answer for each.
    single = F.explode(F.when(kind == 4, F.transform("items", lambda i: i["item"])).otherwise(F.array(body)))
    return pages.select("o_custkey", "page", single.alias("body"))


def repo_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored search answers, one item per document; every sixth item has no URL."""
    docs = table(spark, sf_dir, "documents")
    full_name = F.concat_ws("/", "source", text("doc_id"))
    url = F.when(F.col("doc_id") % 6 != 0, F.concat(F.lit("https://example.org/"), full_name))
    item = F.struct(
        full_name.alias("full_name"),
        url.alias("html_url"),
        F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("description"),
        F.col("n_chars").alias("stargazers_count"),
        F.col("lang").alias("language"),
        F.array("lang", "source").alias("topics"),
    )
    return docs.select("doc_id", F.to_json(F.struct(F.array(item).alias("items"))).alias("body"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer texts around a statement: in a sql fence, in a bare fence, or without one."""
    statement = F.concat(F.lit("SELECT "), text("conv_id"), F.lit(";"))
    kind = F.col("turn") % 3
    body = (
        F.when(kind == 0, F.concat("text", F.lit("\n```sql\n"), statement, F.lit("\n```\n"), "text"))
        .when(kind == 1, F.concat("text", F.lit("\n```\n"), statement, F.lit("\n```\n"), "text"))
        .otherwise(F.concat(F.lit("  "), statement, F.lit(" ")))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body"))


def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer texts around the properties of each event; some are cut short."""
    kind = F.col("event_id") % 5
    body = (
        F.when(kind == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone.")))
        .when(kind == 1, F.concat(F.lit("Here:\n```\n"), "props", F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here: "), "props"))
        .when(kind == 3, F.concat(F.lit("```json\n"), "props"))
        .otherwise(F.col("props"))
    )
    return table(spark, sf_dir, "events").select("event_id", body.alias("body"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement per order; a third of the kinds write, one only seems to."""
    n = text("o_orderkey")
    kind = F.col("o_orderkey") % 8
    sql = (
        F.when(kind == 0, F.concat(F.lit("SELECT * FROM orders WHERE o_orderkey = "), n))
        .when(kind == 1, F.concat(F.lit("delete from orders where o_orderkey = "), n))
        .when(kind == 2, F.concat(F.lit("SELECT 'update' AS updated, "), n))
        .when(kind == 3, F.concat(F.lit("COPY t_"), n, F.lit(" TO 'x'")))
        .when(kind == 4, F.concat(F.lit("WITH x AS (SELECT "), n, F.lit(") INSERT INTO t SELECT * FROM x")))
        .when(kind == 5, F.concat(F.lit("SELECT created, "), n, F.lit(" FROM updates")))
        .when(kind == 6, F.concat(F.lit("Drop TABLE t_"), n))
        .otherwise(F.concat(F.lit("/* alter */ SELECT "), n))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", sql.alias("sql"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column names per data set: the words of every document, and eight kinds of name over the customers."""
    words = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), text("doc_id")).alias("dataset"),
        F.explode(F.array_distinct(F.split(F.lower("text"), r"(?U)\W+"))).alias("column"),
    )
    ends = ["email_address", "Phone", "zip_code", "last_name", "tax_id", "ip_addr", "balance", "unzipped"]
    end = F.element_at(F.array(*[F.lit(e) for e in ends]), (F.col("c_custkey") % 8 + 1).cast("int"))
    names = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("customer_"), F.expr("c_custkey div 100").cast("string")).alias("dataset"),
        F.concat_ws("_", F.lower("c_mktsegment"), end).alias("column"),
    )
    return words.filter("column != ''").unionByName(names)


def data_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose links lead to data files two levels deep."""
    html = F.regexp_replace("html", r'href="(/[^"]*)"', r'href="/data$1.CSV"')
    return table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))


def ragged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a four-column CSV without header: whole, short, long, blank, and with blank cells."""
    kind = F.col("event_id") % 9
    whole = F.concat_ws(",", text("event_id"), "event_type", text("value"), F.lit("x"))
    line = (
        F.when(kind == 0, F.concat_ws(",", text("event_id"), "event_type"))
        .when(kind == 1, F.concat_ws(",", whole, F.lit("extra")))
        .when(kind == 2, F.lit(""))
        .when(kind == 3, F.concat_ws(",", text("event_id"), F.lit('"a,b"'), F.lit(""), F.lit(" ")))
        .otherwise(F.concat_ws(",", text("event_id"), "event_type", text("value"), F.lit("2024-01-01")))
    )
    return table(spark, sf_dir, "events").select(line.alias("value"))

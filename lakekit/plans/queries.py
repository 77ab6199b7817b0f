"""Every operator as a named query over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekit import lake
from lakekit.catalog import Catalog, canonical_type
from lakekit.functions.text import human_size, slug, table_name_col
from lakekit.operators import (
    browse,
    corpus,
    governance,
    health,
    merge,
    profile,
    quality,
    search,
    searchindex,
    statements,
    weblinks,
)
from lakekit.plans import conformance, views
from lakekit.plans.views import table, text
from lakekit.session import scratch_path
from lakekit.sources import api, csv, files, sinks, tables
from lakekit.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- sources ---------------------------------------------------------------


def _customer_csv(spark, sf_dir) -> str:
    path = scratch_path(spark, "customer")
    sinks.export_csv(table(spark, sf_dir, "customer"), path)
    return path


def _customer_columns(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("c_custkey").cast("bigint"),
        "c_name",
        F.col("c_nationkey").cast("bigint"),
        F.col("c_acctbal").cast("double"),
        "c_mktsegment",
    )


@query
def csv_table(spark, sf_dir):
    catalog = Catalog(spark)
    catalog.ingest_csv("customer-table", _customer_csv(spark, sf_dir))
    return _customer_columns(spark.table("customer_table"))


@query
def csv_directory(spark, sf_dir):
    root = scratch_path(spark, "tree")
    for name in ("region", "nation", "supplier", "customer"):
        sinks.export_csv(table(spark, sf_dir, name), f"{root}/{name[0]}/{name}.csv")
    catalog = Catalog(spark)
    catalog.ingest_csv_directory(root)
    return catalog.list_tables().select("table", "rows", F.size("columns").cast("bigint").alias("columns"))


@query
def csv_raw(spark, sf_dir):
    path = scratch_path(spark, "ragged")
    views.ragged_lines(spark, sf_dir).write.text(path)
    raw = csv.read_raw_csv(spark, path, columns=["id", "kind", "value", "day"])
    return raw.select("id", "kind", "value", "day", F.col(csv.CELLS).cast("bigint").alias("cells"))


@query
def csv_raw_multiline(spark, sf_dir):
    path = scratch_path(spark, "documents")
    sinks.export_csv(table(spark, sf_dir, "documents"), path)
    raw = csv.read_raw_csv(spark, path, multi_line=True)
    return raw.select("doc_id", F.sha2("text", 256).alias("text_hash"), "lang", "source", "n_chars")


def _documents_csv(spark, sf_dir) -> str:
    """Documents as CSV, whose texts hold line breaks."""
    path = scratch_path(spark, "documents")
    sinks.export_csv(table(spark, sf_dir, "documents"), path)
    return path


def _document_columns(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("doc_id").cast("bigint"), F.sha2("text", 256).alias("text_hash"), "lang", "source", F.col("n_chars").cast("bigint")
    )


@query
def csv_quoted_table(spark, sf_dir):
    """A typed table out of files with line breaks inside quotes."""
    catalog = Catalog(spark)
    rows = catalog.ingest_csv("documents-csv", _documents_csv(spark, sf_dir))
    return _document_columns(spark.table("documents_csv")).withColumn("rows", F.lit(rows).cast("bigint"))


@query
def csv_quoted_to_parquet(spark, sf_dir):
    target = scratch_path(spark, "converted")
    sinks.csv_to_parquet(spark, _documents_csv(spark, sf_dir), target)
    return _document_columns(spark.read.parquet(target))


@query
def csv_damaged(spark, sf_dir):
    """The records of a CSV file that are too short or too long, by their length."""
    path = scratch_path(spark, "ragged")
    views.ragged_lines(spark, sf_dir).write.text(path)
    schema = "id string, kind string, value string, day string"
    bad = csv.damaged_records(spark, path, T.StructType.fromDDL(schema), False, ",", header=False)
    cells = F.split("record", ",")
    return bad.groupBy(F.size(cells).cast("bigint").alias("pieces")).agg(
        F.count("*").alias("records"), F.sum(cells[0].cast("bigint")).alias("ids")
    )


@query
def csv_tree_types(spark, sf_dir):
    """Types of the columns of all CSV tables of a folder, each table of several files, found together."""
    root = scratch_path(spark, "tree")
    for name in ("nation", "supplier", "customer", "orders", "documents"):
        sinks.export_csv(table(spark, sf_dir, name).repartition(3), f"{root}/{name[0]}/{name}.csv")
    catalog = Catalog(spark)
    catalog.ingest_csv_directory(root)
    found = catalog.table_columns()
    return found.select("table", "rows", F.col("position").cast("bigint"), "column", "type")


@query
def json_batch_convert(spark, sf_dir):
    """JSON Lines files of several columns converted together; types are those of each file."""
    source, target = scratch_path(spark, "tree"), scratch_path(spark, "converted")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    sinks.export_json(orders.repartition(4), f"{source}/orders")
    sinks.export_json(table(spark, sf_dir, "supplier"), f"{source}/supplier")
    sinks.batch_convert(spark, source, target, "*.json")
    rows = []
    for folder in sinks.child_names(spark, target):
        df = spark.read.parquet(f"{target}/{folder}")
        keys = ("o_orderkey", "o_totalprice") if "o_orderkey" in df.columns else ("s_suppkey", "s_acctbal")
        rows.append(df.select(F.lit(keys[0]).alias("key"), F.col(keys[0]).cast("bigint").alias("id"), F.col(keys[1]).cast("double").alias("amount")))
    return csv.union_all(rows)


@query
def parquet_table(spark, sf_dir):
    catalog = Catalog(spark)
    rows = catalog.ingest_parquet("part", f"{sf_dir.rstrip('/')}/part.parquet")
    return spark.table("part").select("p_partkey", "p_name", "p_retailprice", F.lit(rows).cast("bigint").alias("rows"))


def _json_lines(spark, sf_dir) -> str:
    path = scratch_path(spark, "supplier")
    sinks.export_json(table(spark, sf_dir, "supplier"), path)
    return path


def _supplier_columns(df: DataFrame) -> DataFrame:
    return df.select("s_suppkey", "s_name", F.col("s_nationkey").cast("bigint"), F.col("s_acctbal").cast("double"))


@query
def json_table(spark, sf_dir):
    return _supplier_columns(tables.read_json(spark, _json_lines(spark, sf_dir), lines=True))


@query
def metadata_dir(spark, sf_dir):
    """Project records written as JSON documents, some of them broken, read back best first."""
    path = scratch_path(spark, "metadata")
    repos = views.repo_meta(spark, sf_dir)
    body = F.to_json(F.struct("repo_name", "repo_url", "mirror_name", "stars", "tags", "quality_score", "license"))
    broken = F.when(F.col("seq") % 10 == 3, F.concat(F.lit("{"), body)).otherwise(body)
    # One document per line instead of one per file: the tables hold too many for single files.
    repos.select(broken.alias("value")).write.text(path)
    records = tables.parse_metadata(spark.read.text(path), "value")
    return records.select(
        "repo_name", "repo_url", "stars", "quality_score", F.array_join("tags", ",").alias("tags"), "license", "language"
    )


@query
def file_inventory(spark, sf_dir):
    found = files.inventory(views.corpus_files(spark, sf_dir).select("repo", "path", "size"))
    return found.select("path", "name", "size", "suffix", "preview")


@query
def data_file_list(spark, sf_dir):
    return files.data_files(views.corpus_files(spark, sf_dir).select("path", "size"))


@query
def object_listing(spark, sf_dir):
    """Files and bytes of a written table, by listing alone: as many rows counted as were written."""
    path = scratch_path(spark, "listing")
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey")
    orders.write.partitionBy("o_orderstatus").parquet(path)
    folder = F.regexp_extract("path", "o_orderstatus=([^/]+)", 1)
    return (
        files.list_objects(spark, path, "*.parquet")
        .groupBy(folder.alias("status"))
        .agg((F.sum("size") > 0).alias("has_bytes"))
    )


@query
def api_payload_rows(spark, sf_dir):
    rows = api.payload_rows(views.payloads(spark, sf_dir), "body", ["o_custkey", "page"])
    return rows.select(
        "o_custkey",
        F.try_variant_get("item", "$.id", "bigint").alias("order_id"),
        F.try_variant_get("item", "$.status", "string").alias("status"),
    )


@query
def api_repo_items(spark, sf_dir):
    rows = api.payload_rows(views.repo_payloads(spark, sf_dir), "body", ["doc_id"])
    items = api.repo_items(rows, ["doc_id"])
    return items.withColumn("tags", F.array_join("tags", ","))


# --- sinks -----------------------------------------------------------------


@query
def csv_to_parquet(spark, sf_dir):
    target = scratch_path(spark, "converted")
    sinks.csv_to_parquet(spark, _customer_csv(spark, sf_dir), target)
    return _customer_columns(spark.read.parquet(target))


@query
def json_to_parquet(spark, sf_dir):
    target = scratch_path(spark, "converted")
    sinks.json_to_parquet(spark, _json_lines(spark, sf_dir), target, lines=True)
    return _supplier_columns(spark.read.parquet(target))


@query
def conversion_sizes(spark, sf_dir):
    path, target = scratch_path(spark, "lineitem"), scratch_path(spark, "converted")
    lines = table(spark, sf_dir, "lineitem")
    sinks.export_csv(lines, path)
    sinks.csv_to_parquet(spark, path, target, schema=lines.schema)
    sizes = sinks.conversion_sizes(spark, path, target)
    return sizes.select(
        (F.col("parquet_size") < F.col("original_size")).alias("smaller"),
        F.col("saving_percent").between(0, 100).alias("in_range"),
    )


@query
def batch_convert_plan(spark, sf_dir):
    """Source files are the corpus files, outputs exist for some of them, older or newer."""
    corpus_files = views.corpus_files(spark, sf_dir)
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    day = F.lit("2024-01-02").cast("date")
    sources = corpus_files.select("path", stem.alias("stem"), "suffix", day.alias("mtime"))
    written = corpus_files.select(stem.alias("stem"), F.date_add(day, (F.col("size") % 3 - 1).cast("int")).alias("mtime"))
    plan = sinks.conversion_plan(sources, written.filter("stem not like '%5'"))
    return plan.select("path", "action")


@query
def batch_convert(spark, sf_dir):
    """Two folders of CSV files with different columns, converted twice: the second run skips all."""
    source, target = scratch_path(spark, "tree"), scratch_path(spark, "converted")
    for name in ("region", "nation", "supplier"):
        sinks.export_csv(table(spark, sf_dir, name), f"{source}/{name[0]}/{name}")
    first = sinks.batch_convert(spark, source, target)
    second = sinks.batch_convert(spark, source, target)
    again = (second["converted"] == 0) and (second["skipped"] == first["converted"])
    names = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("supplier", "s_suppkey")]
    parts = []
    for folder in sinks.child_names(spark, target):
        df = spark.read.parquet(f"{target}/{folder}")
        for name, key in names:
            if key in df.columns:
                parts.append(df.agg(F.count(key).alias("rows")).select(F.lit(name).alias("table"), "rows"))
    return csv.union_all(parts).withColumn("second_run_skips", F.lit(again))


@query
def export_parquet(spark, sf_dir):
    path = scratch_path(spark, "part")
    sinks.export_parquet(table(spark, sf_dir, "part"), path)
    return spark.read.parquet(path).withColumn("p_size", F.col("p_size").cast("bigint"))


@query
def export_csv(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    path = scratch_path(spark, "part")
    sinks.export_csv(parts, path)
    back = csv.read_csv(spark, path, schema=parts.schema)
    return back.withColumn("p_size", F.col("p_size").cast("bigint"))


@query
def export_json(spark, sf_dir):
    path = scratch_path(spark, "part")
    parts = table(spark, sf_dir, "part")
    sinks.export_json(parts, path, "p_name", "RED")
    return spark.read.schema(parts.schema).json(path).select("p_partkey", "p_name", "p_retailprice")


@query
def write_append(spark, sf_dir):
    path = scratch_path(spark, "append")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    sinks.write_append(orders.filter("o_orderstatus = 'F'"), path)
    sinks.write_append(orders.filter("o_orderstatus <> 'F'"), path)
    return spark.read.parquet(path)


@query
def write_replace(spark, sf_dir):
    path = scratch_path(spark, "replace")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    sinks.write_replace(orders, path)
    sinks.write_replace(orders.filter("o_orderstatus = 'O'"), path)
    return spark.read.parquet(path)


@query
def write_merge(spark, sf_dir):
    """Customers, with the balance replaced by the price of the customer's last order."""
    path, target = scratch_path(spark, "merge"), scratch_path(spark, "merged")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("score"))
    sinks.write_replace(customers, path)
    sinks.write_merge(spark, views.snapshots(spark, sf_dir), path, target, ["key"], "seq")
    return spark.read.parquet(target)


@query
def license_report(spark, sf_dir):
    repos = views.repo_meta(spark, sf_dir).withColumn("slug", slug(F.col("repo_name")))
    return sinks.license_rows(repos.select("slug", "repo_name", "license", "repo_url"))


# --- catalog ---------------------------------------------------------------


_CATALOG = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


@query
def list_tables(spark, sf_dir):
    catalog = Catalog(spark)
    for name in _CATALOG:
        catalog.register(name, table(spark, sf_dir, name))
    found = catalog.table_columns()
    return found.select("table", "rows", F.col("position").cast("bigint").alias("position"), "column")


@query
def schema_context(spark, sf_dir):
    catalog = Catalog(spark)
    for name in _CATALOG:
        catalog.ingest_parquet(name, f"{sf_dir.rstrip('/')}/{name}.parquet")
    return catalog.schema_lines(canonical=True).select("line")


# --- browse ----------------------------------------------------------------


def _customer_text(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", text("c_nationkey").alias("c_nationkey"), text("c_acctbal").alias("c_acctbal"), "c_mktsegment"
    )


@query
def rows_filter(spark, sf_dir):
    return browse.rows_filter(_customer_text(spark, sf_dir), "c_mktsegment", "build")


@query
def rows_sort(spark, sf_dir):
    """The first page of three orders: by number, by text, and by a mixed column that keeps input order."""
    customers = _customer_text(spark, sf_dir).withColumn(
        "mixed", F.when(F.col("c_custkey") % 2 == 0, "2024-01-01").otherwise(F.col("c_nationkey"))
    )
    parts = []
    for kind, column, descending in [
        ("number", "c_nationkey", False),
        ("number_desc", "c_nationkey", True),
        ("text", "c_mktsegment", False),
        ("text_desc", "c_mktsegment", True),
        ("input", "mixed", True),
    ]:
        ordered = browse.rows_sort(customers, column, "c_custkey", descending)
        parts.append(browse.rows_page(ordered, 100).select(F.lit(kind).alias("kind"), "c_custkey"))
    return csv.union_all(parts)


@query
def rows_sort_all(spark, sf_dir):
    """The whole table in numeric order of a text column, with the row's place in that order."""
    customers = _customer_text(spark, sf_dir)
    ordered = browse.number_sorted(customers, "c_acctbal", "c_custkey", "place")
    return ordered.select("c_custkey", "place")


@query
def rows_page(spark, sf_dir):
    ordered = browse.rows_sort(_customer_text(spark, sf_dir), "c_acctbal", "c_custkey", descending=True)
    return browse.rows_page(ordered, limit=50, offset=75).select("c_custkey", "c_acctbal")


@query
def rows_totals(spark, sf_dir):
    return browse.rows_totals(_customer_text(spark, sf_dir), "c_name", "00001")


@query
def preview(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return browse.preview(lines, "o_orderkey")


@query
def content_preview(spark, sf_dir):
    return browse.content_preview(views.corpus_files(spark, sf_dir))


@query
def chart_series(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "n/a").otherwise(text("o_totalprice")).alias("price")
    )
    return browse.chart_series(orders, "o_orderstatus", "price", "o_orderkey")


# --- profile ---------------------------------------------------------------


@query
def column_stats(spark, sf_dir):
    return _stats(profile.column_stats(table(spark, sf_dir, "lineitem")))


def _stats(df: DataFrame) -> DataFrame:
    return df.withColumn("position", F.col("position").cast("bigint"))


@query
def column_stats_text(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return _stats(profile.column_stats(lines.select(*[text(c).alias(c) for c in lines.columns])))


@query
def column_stats_long(spark, sf_dir):
    """The same statistics by the form for very wide tables, on orders."""
    orders = table(spark, sf_dir, "orders")
    return _stats(profile.column_stats_from(profile.long_measures(orders, orders.columns)))


def _ragged(spark, sf_dir) -> DataFrame:
    path = scratch_path(spark, "ragged")
    views.ragged_lines(spark, sf_dir).write.text(path)
    return csv.read_raw_csv(spark, path, columns=["id", "kind", "value", "day"])


@query
def column_stats_ragged(spark, sf_dir):
    return _stats(profile.column_stats(_ragged(spark, sf_dir)))


@query
def csv_profile(spark, sf_dir):
    return _stats(profile.csv_profile(_ragged(spark, sf_dir)))


def _dated(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("gaps"),
        F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("holes"),
        "o_orderstatus",
    )


@query
def date_columns(spark, sf_dir):
    return _stats(profile.date_columns(_dated(spark, sf_dir), "o_orderkey"))


@query
def date_columns_whole(spark, sf_dir):
    """The same by all cells of every column."""
    return _stats(profile.date_columns(_dated(spark, sf_dir), "o_orderkey", rows=None))


def _guessable(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text("o_custkey").alias("whole"),
        text("o_totalprice").alias("fraction"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.concat(text("o_custkey"), F.lit("-"), text("o_orderkey")).alias("dashed"),
        F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(text("o_custkey")).alias("gaps"),
        F.lit("").alias("nothing"),
        "o_orderstatus",
    )


@query
def infer_types(spark, sf_dir):
    return _stats(profile.infer_types(_guessable(spark, sf_dir), "o_orderkey"))


@query
def infer_types_whole(spark, sf_dir):
    """The same by all rows."""
    return _stats(profile.infer_types(_guessable(spark, sf_dir), "o_orderkey", rows=None))


def _guessed_tables(spark, sf_dir) -> dict:
    return {"customer": (_customer_text(spark, sf_dir), "c_custkey"), "orders": (_guessable(spark, sf_dir), "o_orderkey")}


@query
def infer_types_batch(spark, sf_dir):
    return _stats(profile.infer_types_batch(_guessed_tables(spark, sf_dir)))


@query
def infer_types_batch_whole(spark, sf_dir):
    """The same by all rows."""
    return _stats(profile.infer_types_batch(_guessed_tables(spark, sf_dir), rows=None))


@query
def schema_json(spark, sf_dir):
    return profile.schema_json(profile.infer_types(_guessable(spark, sf_dir), "o_orderkey"), "orders-1")


@query
def schema_json_whole(spark, sf_dir):
    """The same by all rows."""
    return profile.schema_json(profile.infer_types(_guessable(spark, sf_dir), "o_orderkey", rows=None), "orders-1")


@query
def chart_suggestion(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    by_status = orders.groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("avg_price"))
    by_day = orders.groupBy("o_orderdate").agg(F.avg("o_totalprice").alias("avg_price"), F.count("*").alias("n"))
    return csv.union_all(
        [
            profile.chart_suggestion(by_status, "Average price by status"),
            profile.chart_suggestion(by_day, "Price trend by day"),
            profile.chart_suggestion(by_day, "Price by day"),
            profile.chart_suggestion(orders.select("o_orderstatus", "o_orderpriority"), "All orders"),
        ]
    )


# --- corpus and governance -------------------------------------------------


@query
def json_valid(spark, sf_dir):
    body = F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    events = table(spark, sf_dir, "events").select("event_id", corpus.json_valid(body).alias("valid"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), corpus.json_valid(F.col("text")).alias("valid"))
    return events.withColumn("origin", F.lit("event")).unionByName(docs.withColumn("origin", F.lit("document")))


@query
def xml_report(spark, sf_dir):
    """Pages, and each page title wrapped as a small XML document."""
    pages = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    wrapped = F.concat(F.lit("<page><id>"), text("page_id"), F.lit("</id><title>"), title, F.lit("</title></page>"))
    both = pages.select("page_id", F.lit("html").alias("kind"), "html").unionByName(
        pages.select("page_id", F.lit("title").alias("kind"), wrapped.alias("html"))
    )
    return corpus.xml_report(both, "html", ["page_id", "kind"])


@query
def xml_report_titles(spark, sf_dir):
    """XML documents made of the page titles without markup: all well-formed, two levels deep."""
    title = F.regexp_replace(F.regexp_extract("html", "<title>(.*?)</title>", 1), "[^a-zA-Z ]", "")
    parts = [F.lit("<page><id>"), text("page_id"), F.lit("</id><title>"), title, F.lit("</title>")]
    end = F.when(F.col("page_id") % 4 == 0, "").otherwise("</page>")
    body = table(spark, sf_dir, "pages").select("page_id", F.concat(*parts, end).alias("body"))
    report = corpus.xml_report(body, "body", ["page_id"])
    return report.select("page_id", "valid", "root_tag", F.col("unique_elements").cast("bigint").alias("unique_elements"))


@query
def pii_columns(spark, sf_dir):
    return governance.pii_columns(views.headers(spark, sf_dir))


@query
def pii_by_file(spark, sf_dir):
    return governance.pii_by_file(views.headers(spark, sf_dir), ["dataset"])


@query
def pii_by_csv_file(spark, sf_dir):
    """Files of the corpus whose CSV header suggests personal data, or not."""
    found = governance.csv_headers(views.corpus_files(spark, sf_dir))
    return governance.pii_by_file(found, ["repo", "path"])


@query
def license_detect(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", governance.license_of(F.col("text")).alias("license"))


@query
def license_detect_whole_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", governance.license_of(F.col("text"), head_chars=None).alias("license")
    )


@query
def license_by_repo(spark, sf_dir):
    return governance.license_by_repo(views.corpus_files(spark, sf_dir))


@query
def license_summary(spark, sf_dir):
    return governance.license_summary(views.repo_meta(spark, sf_dir))


@query
def license_summary_joined(spark, sf_dir):
    repos = views.repo_meta(spark, sf_dir)
    licenses = repos.filter("license is not null").select("repo_url", "license")
    return governance.license_summary(repos, licenses)


@query
def license_counts(spark, sf_dir):
    return governance.license_counts(views.repo_meta(spark, sf_dir))


@query
def api_docs(spark, sf_dir):
    """Corpus in which some files are API descriptions and some README files name an endpoint."""
    corpus_files = views.corpus_files(spark, sf_dir)
    swagger = corpus_files.filter("name = 'meta_5.json' and size % 3 = 0").select(
        "repo", F.concat("repo", F.lit("/docs/swagger.json")).alias("path"), "content"
    )
    readme = F.when(
        (F.col("name") == "README.md") & (F.col("size") % 2 == 0),
        F.concat("content", F.lit("\nGET https://example.org/API/x")),
    ).otherwise(F.col("content"))
    return governance.api_docs(corpus_files.select("repo", "path", readme.alias("content")).unionByName(swagger))


# --- quality ---------------------------------------------------------------


def _quality(spark, sf_dir) -> DataFrame:
    return quality.repo_quality(views.corpus_files(spark, sf_dir))


@query
def repo_quality(spark, sf_dir):
    return _quality(spark, sf_dir).withColumn("data_types", F.array_join("data_types", ","))


@query
def structure_summary(spark, sf_dir):
    facts = (
        table(spark, sf_dir, "documents")
        .groupBy(F.expr("concat('repo_', doc_id div 10)").alias("repo"))
        .agg(F.min("lang").alias("language"), F.max("n_chars").alias("stars"))
    )
    return quality.structure_summary(views.corpus_files(spark, sf_dir), _quality(spark, sf_dir), facts)


@query
def quality_gate(spark, sf_dir):
    return quality.quality_gate(_quality(spark, sf_dir)).select("repo", "quality_score")


def _candidates(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as search results per customer page, one market segment blacklisted, suppliers as seeds."""

    def url(column):
        return F.concat(F.lit("https://example.org/"), text(column))

    results = table(spark, sf_dir, "orders").select(
        url("o_custkey").alias("repo_url"), F.col("o_totalprice").cast("bigint").alias("stars"), F.col("o_orderkey").alias("seq")
    )
    blacklist = (
        table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").select(url("c_custkey").alias("repo_url"))
    )
    seeds = table(spark, sf_dir, "supplier").select(
        url("s_suppkey").alias("repo_url"), F.col("s_acctbal").cast("bigint").alias("stars"), F.col("s_suppkey").alias("seq")
    )
    return results, blacklist, seeds


@query
def candidate_select(spark, sf_dir):
    return quality.candidate_select(*_candidates(spark, sf_dir), min_stars=200_000)


@query
def candidate_select_filtered(spark, sf_dir):
    """The same with a Bloom filter before the blacklist, as for a huge one."""
    return quality.candidate_select(*_candidates(spark, sf_dir), min_stars=200_000, filter_from=0)


@query
def score_bands(spark, sf_dir):
    return quality.score_bands(_quality(spark, sf_dir))


@query
def lake_projects(spark, sf_dir):
    """Projects built from the corpus against a store that already holds some, with other scores."""
    corpus_files = views.corpus_files(spark, sf_dir)
    built = lake.lake_projects(corpus_files, minimum=0.0)
    stored = built.filter("total_files > 8").withColumn("quality_score", (F.col("total_files") % 3) * 10.0)
    found = lake.lake_projects(corpus_files, stored)
    return found.select("repo", "quality_score", "license", "total_files")


@query
def lake_file_records(spark, sf_dir):
    corpus_files = views.corpus_files(spark, sf_dir)
    return lake.lake_file_records(corpus_files, lake.lake_projects(corpus_files))


# --- merge -----------------------------------------------------------------


@query
def cas_dedup(spark, sf_dir):
    return merge.cas_dedup(views.corpus_files(spark, sf_dir))


@query
def cas_dedup_hash(spark, sf_dir):
    return merge.cas_dedup(views.corpus_files(spark, sf_dir), by_name=False)


@query
def flat_layout(spark, sf_dir):
    return merge.flat_layout(views.corpus_files(spark, sf_dir).select("repo", "path", "name", "suffix"))


@query
def store_if_better(spark, sf_dir):
    kept = merge.store_if_better(views.snapshots(spark, sf_dir), "key", "score", "seq")
    return kept.select("key", "score", "seq")


@query
def version_history(spark, sf_dir):
    kept = merge.version_history(views.snapshots(spark, sf_dir), "key", ["ts", "seq"])
    return kept.select("key", "score", "seq")


@query
def upsert(spark, sf_dir):
    """Customers as known records, orders as the batch; half of the customers are unknown at first."""
    name = F.concat(F.lit("customer "), text("c_custkey"))
    known = (
        table(spark, sf_dir, "customer")
        .filter("c_acctbal > 4500")
        .select(
            F.col("c_custkey").alias("repo_url"),
            name.alias("repo_name"),
            F.col("c_acctbal").alias("quality_score"),
            F.lit("U").alias("license"),
            F.lit("2000-01-01").alias("updated_at"),
        )
    )
    batch = views.snapshots(spark, sf_dir).select(
        F.col("key").alias("repo_url"),
        F.concat(F.lit("order "), text("seq")).alias("repo_name"),
        F.col("score").alias("quality_score"),
        "license",
        F.date_format("ts", "yyyy-MM-dd").alias("updated_at"),
        "seq",
    )
    return merge.upsert(known, batch).drop("uuid")


@query
def insert_ignore(spark, sf_dir):
    """Event files against document files already recorded: new (hash, name) pairs, first path each."""
    hashed = merge.with_hash(views.corpus_files(spark, sf_dir)).select("sha256", "name", "path", "suffix")
    known = hashed.filter("suffix = '.csv'")
    return merge.insert_ignore(known, hashed, ["sha256", "name"], "path").select("sha256", "name", "path")


@query
def hash_exists(spark, sf_dir):
    docs = merge.with_hash(table(spark, sf_dir, "documents"), "text")
    stored = docs.filter("source = 'src0'")
    return merge.hash_exists(docs.select("doc_id", "sha256"), stored)


@query
def metadata_import(spark, sf_dir):
    """Old records, each twice and some without optional fields, against those of one language."""
    repos = views.repo_meta(spark, sf_dir)
    missing = F.col("seq") % 4 == 0
    old = repos.select(
        *[F.col(f.name) for f in tables.REPO_META.fields if f.name in ("repo_name", "repo_url", "mirror_name", "tags", "data_types")],
        F.when(~missing, F.col("stars")).alias("stars"),
        F.when(~missing, F.col("language")).alias("language"),
        F.when(~missing, F.col("quality_score")).alias("quality_score"),
        "license",
        F.when(~missing, F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("ingested_at"),
        F.explode(F.array(F.concat(F.lit("a"), text("seq")), F.concat(F.lit("b"), text("seq")))).alias("slug"),
    )
    for field in tables.REPO_META.fields:
        if field.name not in old.columns:
            old = old.withColumn(field.name, F.lit(None).cast(field.dataType))
    known = repos.filter("language = 'de'").select("repo_url")
    added = merge.metadata_import(old, known)
    return added.select(
        "slug", "repo_name", "repo_url", "stars", "language", "quality_score", "license", "tags",
        F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"),
    )


# --- search ----------------------------------------------------------------


@query
def inverted_index(spark, sf_dir):
    blocks = search.index_blocks(search.postings(views.repo_meta(spark, sf_dir)))
    return blocks.withColumn("keys", F.array_join(F.transform("keys", lambda k: k.cast("string")), ","))


@query
def index_lookup(spark, sf_dir):
    """A lookup in the stored index."""
    path = scratch_path(spark, "index")
    search.write_index(search.postings(views.repo_meta(spark, sf_dir)), path)
    return search.lookup(spark.read.parquet(path), ["the", "src1", "csv", ".csv", "leaux"])


_INDEXES: dict[tuple, searchindex.TermIndex | searchindex.TextIndex] = {}


def _index(spark, sf_dir, kind):
    """The stored index of a table, written once in a session."""
    at = (spark.sparkContext.applicationId, sf_dir, kind)
    if at not in _INDEXES:
        _INDEXES[at] = kind.build(views.repo_meta(spark, sf_dir), scratch_path(spark, "search-index"))
    return _INDEXES[at]


@query
def term_index(spark, sf_dir):
    """What the stored index of terms holds: by kind of place, its terms, and the records that have them."""
    postings = _index(spark, sf_dir, searchindex.TermIndex).postings
    entries = postings.select("term", F.explode("entries").alias("e"))
    place = F.when(F.col("e").bitwiseAND(searchindex.NAMED) != 0, "name").when(F.col("e").bitwiseAND(searchindex.DESCRIBED) != 0, "description")
    return entries.where(place.isNotNull()).groupBy(place.alias("place")).agg(F.count_distinct("term").alias("terms"), F.count("*").alias("entries"))


@query
def index_search_topk(spark, sf_dir):
    found = _index(spark, sf_dir, searchindex.TermIndex).search("the reaux csv API src1")
    return found.withColumn("score", F.round("score", 6))


@query
def search_topk(spark, sf_dir):
    found = search.search(views.repo_meta(spark, sf_dir), "the reaux csv API src1")
    return found.withColumn("score", F.round("score", 6))


BATCH_QUERIES = {
    1: "the station of json feedback",
    2: "src2 de und schen",
    3: "REST endpoint le reaux",
    4: "tabular state",
    5: "xyzzy",
}


@query
def index_search_batch(spark, sf_dir):
    found = _index(spark, sf_dir, searchindex.TermIndex).search_batch(BATCH_QUERIES)
    return found.withColumn("score", F.round("score", 6))


@query
def search_batch(spark, sf_dir):
    found = search.search_batch(views.repo_meta(spark, sf_dir), BATCH_QUERIES)
    return found.withColumn("score", F.round("score", 6))


@query
def index_search_substring(spark, sf_dir):
    found = _index(spark, sf_dir, searchindex.TextIndex).search_substring("Thanedble")
    return found.select("seq", "repo_name", "quality_score")


@query
def index_search_sidebar(spark, sf_dir):
    return _index(spark, sf_dir, searchindex.TextIndex).search_sidebar("de src1").select("seq", "repo_name")


@query
def search_substring(spark, sf_dir):
    return search.search_substring(views.repo_meta(spark, sf_dir), "Thanedble").select("seq", "repo_name", "quality_score")


@query
def search_sidebar(spark, sf_dir):
    return search.search_sidebar(views.repo_meta(spark, sf_dir), "de src1").select("seq", "repo_name")


@query
def lake_stats(spark, sf_dir):
    return search.lake_stats(views.repo_meta(spark, sf_dir)).withColumn("data_types", F.array_join("data_types", ","))


@query
def recent(spark, sf_dir):
    found = search.recent(views.repo_meta(spark, sf_dir))
    return found.select("seq", "repo_name", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("ingested_at"))


@query
def best(spark, sf_dir):
    return search.best(views.repo_meta(spark, sf_dir), 25).select("seq", "repo_name", "quality_score")


@query
def list_all_repos(spark, sf_dir):
    return search.best(views.repo_meta(spark, sf_dir), None).select("seq", "repo_name", "quality_score")


# --- web pages -------------------------------------------------------------


@query
def page_links(spark, sf_dir):
    links = weblinks.page_links(table(spark, sf_dir, "pages"), "page_id")
    return links.withColumn("position", F.col("position").cast("bigint"))


@query
def data_links(spark, sf_dir):
    links = weblinks.data_links(weblinks.page_links(views.data_pages(spark, sf_dir), "page_id"))
    return links.withColumn("position", F.col("position").cast("bigint"))


@query
def project_links(spark, sf_dir):
    links = weblinks.page_links(views.data_pages(spark, sf_dir), "page_id")
    pages = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", 'href="/([^"]*)"', 1)
    seen = pages.select(F.concat(F.lit("https://mirror.example.org/data/"), title, F.lit(".CSV")).alias("repo_url"))
    wide = links.withColumn("href", F.replace("href", F.lit("/data"), F.lit("/data/")))
    found = weblinks.project_links(wide, "page_id", "https://mirror.example.org/", seen, max_per_page=3)
    return found.withColumn("position", F.col("position").cast("bigint"))


# --- health ----------------------------------------------------------------


def _health(spark, sf_dir) -> DataFrame:
    return health.health_score(views.probe_events(spark, sf_dir), "entity", ["ts", "seq"], "ok", "latency")


@query
def health_score(spark, sf_dir):
    return _health(spark, sf_dir)


@query
def health_stats(spark, sf_dir):
    return health.health_stats(_health(spark, sf_dir), "entity")


@query
def weighted_sample(spark, sf_dir):
    return health.weighted_sample(_health(spark, sf_dir), "entity", 5, "7").select("entity", "score")


# --- incremental forms -----------------------------------------------------


def _arrive(spark, rows: DataFrame, label: str, make: Callable[[str], incremental.IncrementalTable]) -> DataFrame:
    """Result of a table that ``rows`` reach in three stretches of ``seq``, one run of the stream for each."""
    source, target = scratch_path(spark, label), scratch_path(spark, label)
    store = make(target)
    third = F.floor(F.col("seq") * 3 / (rows.agg(F.max("seq")).scalar() + 1))
    for part in range(3):
        rows.filter(third == part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        store.start(stream, target + "-checkpoint").awaitTermination()
    return store.result()


@query
def stream_convert(spark, sf_dir):
    """New CSV files converted by two runs, the second of which sees only what came after the first."""
    source, target, checkpoint = (scratch_path(spark, "convert") for _ in range(3))
    parts = table(spark, sf_dir, "part")
    sinks.export_csv(parts.filter("p_size <= 25"), source, mode="append")
    incremental.convert_new_files(spark, source, target, checkpoint, parts.schema).awaitTermination()
    sinks.export_csv(parts.filter("p_size > 25"), source, mode="append")
    incremental.convert_new_files(spark, source, target, checkpoint, parts.schema).awaitTermination()
    return spark.read.parquet(target).withColumn("p_size", F.col("p_size").cast("bigint"))


@query
def stream_keep_better(spark, sf_dir):
    def make(path):
        return incremental.BestPerKey(spark, path, "key", "score", "seq", compact_every=2)

    return _arrive(spark, views.snapshots(spark, sf_dir), "better", make).select("key", "score", "seq")


@query
def stream_upsert(spark, sf_dir):
    rows = views.snapshots(spark, sf_dir).select(
        F.col("key").alias("repo_url"),
        F.col("seq").alias("first_seq"),
        F.col("score").alias("quality_score"),
        "license",
        F.date_format("ts", "yyyy-MM-dd").alias("updated_at"),
        "seq",
    )

    def make(path):
        return incremental.Upserts(spark, path, "repo_url", "seq", compact_every=2)

    result = _arrive(spark, rows, "upserts", make)
    return result.select("repo_url", "first_seq", "quality_score", "license", "updated_at")


@query
def stream_insert_ignore(spark, sf_dir):
    def make(path):
        return incremental.FirstPerKey(spark, path, ["key", "license"], "seq")

    return _arrive(spark, views.snapshots(spark, sf_dir), "inserts", make).select("key", "license", "score", "seq")


@query
def stream_health(spark, sf_dir):
    def make(path):
        return incremental.RunningHealth(spark, path, "entity", ["ts", "seq"], "ok", "latency", compact_every=2)

    return _arrive(spark, views.probe_events(spark, sf_dir), "health", make)


# --- statements ------------------------------------------------------------


@query
def sql_guard(spark, sf_dir):
    return statements.sql_guard(views.statements(spark, sf_dir), "sql")


@query
def extract_sql(spark, sf_dir):
    return statements.extract_sql(views.answers(spark, sf_dir), "body").select("conv_id", "turn", "sql")


@query
def extract_json(spark, sf_dir):
    return statements.extract_json(views.json_answers(spark, sf_dir), "body").select("event_id", "json", "valid")


# --- column functions ------------------------------------------------------


@query
def scalar_functions(spark, sf_dir):
    name = F.concat(F.lit(" "), F.col("source"), F.lit("/Ünï x+"), text("doc_id"), F.lit(".v1 "))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        slug(name).alias("slug"),
        table_name_col(name).alias("table_name"),
        human_size(F.col("n_chars")).alias("size"),
        human_size(F.col("n_chars") * 123457).alias("big_size"),
        F.sha2("text", 256).alias("sha256"),
    )


def _conformance(statement: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = Catalog(spark)
        for name in conformance.TABLES:
            if name in statement:
                catalog.register(name, table(spark, sf_dir, name))
        return catalog.query(statement)

    return run


for _name, (_spark_sql, _) in conformance.STATEMENTS.items():
    QUERIES[_name] = _conformance(_spark_sql)

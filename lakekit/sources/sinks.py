"""Writers: Parquet conversion, exports, write modes and the license report."""

from __future__ import annotations

import hashlib
import json
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekit.functions.text import license_or_unknown, suffix
from lakekit.operators.browse import rows_filter
from lakekit.operators.merge import merge_rows
from lakekit.operators.ordering import number_rows
from lakekit.sources.csv import csv_delimiter, damaged_records, has_quoted_breaks, parse_records, read_csv
from lakekit.sources.files import list_objects
from lakekit.sources.inspect import FileForm, inspect_files, merged_schema
from lakekit.sources.records import file_names, is_blank_record, plain_path, quoted_records
from lakekit.sources.tables import is_json_lines, read_json
from lakekit.storage import child_names, delete_path, path_exists, qualified

log = logging.getLogger(__name__)

# Row groups are sized in bytes by the Parquet writer; files are capped in rows.
MAX_ROWS_PER_FILE = 10_000_000


def export_parquet(df: DataFrame, path: str, compression: str = "zstd", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", compression).option("maxRecordsPerFile", MAX_ROWS_PER_FILE).parquet(path)


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(header=True, quote='"', escape='"').csv(path)


def export_json(df: DataFrame, path: str, column: str | None = None, value: str = "", mode: str = "overwrite") -> None:
    """One JSON object per line, nulls included, after an optional contains filter."""
    kept = rows_filter(df, column, value) if column else df
    kept.write.mode(mode).option("ignoreNullFields", False).json(path)


def csv_to_parquet(spark: SparkSession, source: str, target: str, compression: str = "zstd", damaged: str = "raise", **read) -> None:
    """Convert one CSV table. Damaged records raise before anything is written, or are left out with ``damaged="drop"``;
    :func:`damaged_records` shows them."""
    delimiter = read.pop("delimiter", None) or csv_delimiter(spark, source)
    breaks = read.pop("multi_line", None)
    breaks = has_quoted_breaks(spark, source, delimiter) if breaks is None else breaks
    table = read_csv(spark, source, multi_line=breaks, delimiter=delimiter, damaged=damaged, **read)
    if damaged == "raise":
        n = damaged_records(spark, source, table.schema, breaks, delimiter).count()
        if n:
            raise ValueError(f"{source} has {n} damaged records")
    export_parquet(table, target, compression)


def json_to_parquet(spark: SparkSession, source: str, target: str, compression: str = "zstd", damaged: str = "raise", **read) -> None:
    """Convert one JSON table. Damaged values raise before anything is written, or are left out with ``damaged="drop"``."""
    schema = read.pop("schema", None)
    if read.get("lines") is None:
        read["lines"] = is_json_lines(spark, source)
    if schema is None:
        schema = read_json(spark, source, **read).schema
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    fields = [f for f in schema if f.name != _CORRUPT]
    if not fields:
        raise ValueError(f"{source} holds no JSON objects")
    marked = read_json(spark, source, schema=T.StructType([*fields, T.StructField(_CORRUPT, T.StringType())]), **read)
    # The reader refuses queries on the corrupt column alone, so a data column is named too.
    bad = F.col(_CORRUPT).isNotNull() & (F.coalesce(F.length(F.col(_quoted(fields[0].name)).cast("string")), F.lit(0)) >= 0)
    if damaged == "raise" and (n := marked.where(bad).count()):
        raise ValueError(f"{source} has {n} damaged values")
    export_parquet(marked.where(~bad).drop(_CORRUPT), target, compression)


def conversion_sizes(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Bytes before and after a conversion and the saving in percent."""
    before = list_objects(spark, source).agg(F.sum("size").alias("original_size"))
    after = list_objects(spark, target, "*.parquet").agg(F.sum("size").alias("parquet_size")).scalar()
    return before.withColumn("parquet_size", after).withColumn(
        "saving_percent",
        F.when(
            F.col("original_size") > 0, F.bround((1 - F.col("parquet_size") / F.col("original_size")) * 100, 0)
        ).otherwise(0.0),
    )


def conversion_plan(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """What to do with each source file: convert, or skip when its output is strictly newer.

    Both sides hold ``(stem, mtime)``, sources also ``suffix``; the stem is the
    path without its suffix.
    """
    newest = outputs.groupBy("stem").agg(F.max("mtime").alias("out_mtime"))
    fresh = F.col("out_mtime") > F.col("mtime")
    known = F.col("suffix").isin(".csv", ".json")
    return (
        sources.filter(F.col("suffix") != ".parquet")
        .join(newest, "stem", "left")
        .withColumn("action", F.when(F.coalesce(fresh, F.lit(False)) | ~known, "skip").otherwise("convert"))
    )


def _below(spark: SparkSession, path: Column, root: str) -> Column:
    """The part of ``path`` below the folder ``root``."""
    return F.substr(F.regexp_replace(path, "^file:/+", "file:/"), F.lit(len(qualified(spark, root)) + 2))


def _stem(relative: Column) -> Column:
    return F.regexp_replace(relative, r"\.[^./]+$", "")


def batch_convert(
    spark: SparkSession, source: str, target: str, pattern: str = "*.csv", delete_original: bool = False
) -> dict:
    """Convert the new files below ``source`` to Parquet below ``target``.

    Delimiter, quoted line breaks and the form of JSON are found for each file, in one scan of all. Types are those of
    each file alone; files of one form, header and types are converted by one job, each into its own folder
    ``source=<path without suffix>`` below a folder per set of columns. A file with a record of the wrong length, an
    unclosed quote or a broken JSON value fails and is kept; it does not stop the others. A source is deleted only after
    its rows have been counted in the output.

    Returns the counts, the bytes saved, and ``files``: a record for each file that was tried.
    """
    files = list_objects(spark, source, pattern).select(
        "path",
        "size",
        F.col("last_modified").alias("mtime"),
        _stem(_below(spark, F.col("path"), source)).alias("stem"),
        suffix(F.col("path")).alias("suffix"),
    )
    outputs = _written(spark, target)
    plan = conversion_plan(files, outputs)
    counts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
    stats = {"converted": 0, "skipped": counts.get("skip", 0), "failed": 0, "bytes_saved": 0, "files": []}
    fresh = {r["path"]: r for r in plan.filter("action = 'convert'").collect()}
    if not fresh:
        return stats
    before = {(r["stem"], r["folder"]) for r in outputs.select("stem", "folder").distinct().collect()} if counts else set()
    groups: dict[tuple, list] = {}
    failed: dict[str, str] = {}
    for path, form in inspect_files(spark, list(fresh)).items():
        if form.error:
            failed[path] = form.error
        else:
            schema = merged_schema([form.schema]) if form.kind == ".csv" else form.schema
            groups.setdefault((form.kind, form.delimiter, form.whole, schema.json()), []).append(path)
    rows: dict[str, int] = {}
    folders: dict[str, str] = {}
    for (kind, delimiter, whole, schema), paths in groups.items():
        try:
            form = FileForm(kind, delimiter, whole, T.StructType.fromJson(json.loads(schema)))
            _convert(spark, form, paths, source, target, rows, folders, failed)
        except Exception as error:  # noqa: BLE001 - one bad group must not stop the others
            log.warning("cannot convert %d files: %s", len(paths), error)
            failed |= {p: str(error).split("\n")[0] for p in paths if p not in rows}
    written = _written(spark, target).groupBy("stem", "folder").agg(F.sum("size").alias("size")).collect() if rows else []
    sizes = {(r["stem"], r["folder"]): r["size"] for r in written}
    for path, row in sorted(fresh.items()):
        done = path in rows
        size = sizes.get((row["stem"], folders.get(path)), 0)
        record = {"file": row["stem"] + row["suffix"], "status": "converted" if done else "failed", "original_size": row["size"]}
        if done:
            record |= {"parquet_size": size, "rows": rows[path], "ratio": round(size / row["size"], 4) if row["size"] else 0.0}
            stats["converted"] += 1
            stats["bytes_saved"] += row["size"] - size
            for folder in {f for stem, f in before if stem == row["stem"]} - {folders[path]}:
                # The file had other columns or types the last time.
                delete_path(spark, f"{target.rstrip('/')}/{folder}/source={_escaped(row['stem'])}")
            if delete_original:
                delete_path(spark, path)
        else:
            record["error"] = failed.get(path, "not converted")
            stats["failed"] += 1
        stats["files"].append(record)
    return stats


_CORRUPT = "_corrupt_record"


def _load(spark: SparkSession, form: FileForm, paths: list[str]) -> DataFrame:
    """The records with ``_path``; ``_corrupt_record`` holds those that do not fit the schema."""
    schema = T.StructType([*form.schema.fields, T.StructField(_CORRUPT, T.StringType())])
    if form.kind == ".csv" and form.whole:
        records, _ = quoted_records(spark, paths, form.delimiter)
        names = file_names(spark, paths).withColumnRenamed("path", "_path")
        kept = records.where(~F.col("header") & ~is_blank_record(F.col("record"))).join(names, "file")
        return kept.select(parse_records(F.col("record"), schema, form.delimiter).alias("r"), "_path").select("r.*", "_path")
    reader = spark.read.options(mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT).schema(schema)
    if form.kind == ".csv":
        reader = reader.options(header=True, quote='"', escape='"', sep=form.delimiter, enforceSchema=True, columnPruning=False)
    loaded = reader.csv(paths) if form.kind == ".csv" else reader.option("multiLine", form.whole).json(paths)
    return loaded.withColumn("_path", plain_path(F.col("_metadata.file_path")))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _convert(
    spark: SparkSession, form: FileForm, paths: list[str], source: str, target: str,
    rows: dict[str, int], folders: dict[str, str], failed: dict[str, str],
) -> None:
    """Write files of one form and schema, and count the rows of each in the output against those read."""
    records = _load(spark, form, paths)
    first = form.schema.names[0]
    broken = F.col(_CORRUPT).isNotNull() & (F.coalesce(F.length(F.col(_quoted(first)).cast("string")), F.lit(0)) >= 0)
    read = {r["_path"]: r for r in records.groupBy("_path").agg(F.count("*").alias("n"), F.count_if(broken).alias("bad")).collect()}
    for path, r in read.items():
        if r["bad"]:
            failed[path] = f"{r['bad']} damaged records"
    good = [p for p in paths if p not in failed]
    if not good:
        return
    schema = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in form.schema)
    name = f"{form.kind[1:]}-{_digest([schema])}"
    folder = f"{target.rstrip('/')}/{name}"
    table = (records if len(good) == len(paths) else _load(spark, form, good)).drop(_CORRUPT)
    (
        table.withColumn("source", _stem(_below(spark, F.col("_path"), source)))
        .drop("_path")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("source")
        .parquet(folder)
    )
    root = len(qualified(spark, source)) + 1
    stems = {p[root:].rsplit(".", 1)[0]: p for p in good}
    kept = spark.read.schema("source string").parquet(folder).groupBy("source").agg(F.count("*").alias("n")).collect()
    found = {r["source"]: r["n"] for r in kept}
    for stem, path in stems.items():
        expected = read[path]["n"] if path in read else 0
        if found.get(stem, 0) == expected:
            rows[path], folders[path] = expected, name
        else:
            failed[path] = f"{found.get(stem, 0)} of {expected} rows were written"


def _digest(columns: list[str]) -> str:
    return hashlib.sha256("\x1f".join(columns).encode()).hexdigest()[:12]


def _escaped(stem: str) -> str:
    return "".join(c if c not in '"#%\'*/:=?\\{[]^\x7f' and ord(c) > 31 else f"%{ord(c):02X}" for c in stem)


def _written(spark: SparkSession, target: str) -> DataFrame:
    """Stem, time, size and folder of the Parquet files already below ``target``."""
    if not path_exists(spark, target) or not child_names(spark, target):
        return spark.createDataFrame([], "stem string, mtime timestamp, size bigint, folder string")
    folder = F.regexp_extract("path", r"/source=([^/]+)/", 1)
    return list_objects(spark, target, "*.parquet").select(
        plain_path(folder).alias("stem"),
        F.col("last_modified").alias("mtime"),
        "size",
        F.regexp_extract("path", r"/([^/]+)/source=[^/]+/", 1).alias("folder"),
    )


def write_append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_merge(spark: SparkSession, batch: DataFrame, path: str, target: str, keys: list[str], order: str) -> None:
    """Merge ``batch`` into the table at ``path`` and write the result to ``target``.

    A table is never overwritten while it is read, so the result goes to a new
    path, which the caller then takes as the table.
    """
    table = spark.read.parquet(path)
    merge_rows(table, batch, keys, order).write.mode("overwrite").parquet(target)


def license_rows(repos: DataFrame, slug: str = "slug") -> DataFrame:
    """Numbered rows of the license report, in file-name order."""
    rows = repos.select(
        F.col(slug).alias("slug"),
        "repo_name",
        license_or_unknown(F.col("license")).alias("license"),
        F.coalesce("repo_url", F.lit("")).alias("repo_url"),
    )
    return number_rows(rows, [F.col("slug")], "number")


def license_report(repos: DataFrame, path: str, slug: str = "slug") -> None:
    """Write the license report as Markdown text, in order across its part files."""
    rows = license_rows(repos, slug)
    line = F.concat(
        F.lit("| "),
        F.col("number").cast("string"),
        F.concat(F.lit(" | ["), "repo_name", F.lit("]("), "repo_url", F.lit(") | ")),
        F.concat("license", F.lit(" | "), "repo_url", F.lit(" |")),
    )
    spark = repos.sparkSession
    head = [
        "# Dataset Licenses",
        "",
        "| # | Dataset | License | Source |",
        "|---|---------|---------|--------|",
    ]
    top = spark.createDataFrame([(i - len(head), text) for i, text in enumerate(head)], "number bigint, value string")
    licensed = F.count_if(F.col("license") != "Unknown")
    footer = rows.agg(
        (F.count("*") + 1).alias("number"),
        F.concat(
            F.lit("\n**"), licensed.cast("string"), F.lit("/"), F.count("*").cast("string"),
            F.lit("** datasets have a detected license."),
        ).alias("value"),
    )
    lines = top.unionByName(rows.select("number", line.alias("value"))).unionByName(footer)
    lines.orderBy("number").select("value").write.mode("overwrite").text(path)

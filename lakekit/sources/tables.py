"""Parquet and JSON tables, and folders of one-document JSON files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPO_META = T.StructType(
    [
        T.StructField("repo_name", T.StringType()),
        T.StructField("repo_url", T.StringType()),
        T.StructField("mirror_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("stars", T.LongType()),
        T.StructField("language", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("data_files", T.ArrayType(T.StringType())),
        T.StructField("data_types", T.ArrayType(T.StringType())),
        T.StructField("api_docs_found", T.BooleanType()),
        T.StructField("quality_score", T.DoubleType()),
        T.StructField("structure_summary", T.StringType()),
        T.StructField("license", T.StringType()),
        T.StructField("license_file_path", T.StringType()),
        T.StructField("local_path", T.StringType()),
        T.StructField("metadata_path", T.StringType()),
        T.StructField("ingested_at", T.StringType()),
        T.StructField("updated_at", T.StringType()),
    ]
)
REPO_META_REQUIRED = ["repo_name", "repo_url", "mirror_name"]


def repo_meta_defaults() -> dict:
    """Default of every optional field of a project record."""
    no_strings = F.expr("cast(array() as array<string>)")
    text = ["description", "language", "structure_summary", "local_path", "metadata_path", "ingested_at", "updated_at"]
    return {
        **{name: F.lit("") for name in text},
        **{name: no_strings for name in ("tags", "data_files", "data_types")},
        "stars": F.lit(0).cast("bigint"),
        "api_docs_found": F.lit(False),
        "quality_score": F.lit(0.0),
    }


def with_defaults(df: DataFrame) -> DataFrame:
    """Project records with missing optional fields filled."""
    return df.withColumns({name: F.coalesce(F.col(name), value) for name, value in repo_meta_defaults().items()})


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(path) if isinstance(path, str) else spark.read.parquet(*path)


def json_lines(first: str | None, second: str | None) -> bool:
    """Whether text that begins with these two lines is JSON Lines: its first line is a whole object, and another one
    or nothing follows."""

    def whole(line: str) -> bool:
        try:
            return isinstance(json.loads(line), dict)
        except ValueError:
            return False

    return first is not None and whole(first) and (second is None or second.lstrip().startswith("{"))


def is_json_lines(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether a JSON path holds one object per line, judged by its first lines with text."""
    head = [r[0] for r in spark.read.text(path).where("trim(value) != ''").take(2)] + [None, None]
    return json_lines(head[0], head[1])


def read_json(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, lines: bool | None = None
) -> DataFrame:
    """JSON table: an array of objects or one object per file, or one object per line with ``lines``.

    JSON Lines files split across tasks; array files are one task each. Without ``lines`` the form is found by content.
    """
    reader = spark.read.option("multiLine", not (is_json_lines(spark, path) if lines is None else lines))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def parse_metadata(documents: DataFrame, body: str) -> DataFrame:
    """Project records from a column of JSON documents; other columns are kept.

    Texts that hold no JSON object or lack a required field are skipped.
    """
    schema = T.StructType(REPO_META.fields + [T.StructField("_corrupt_record", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    records = documents.withColumn("_record", F.from_json(body, schema, options)).drop(body).select("*", "_record.*")
    whole = F.col("_corrupt_record").isNull()
    for name in REPO_META_REQUIRED:
        whole = whole & F.col(name).isNotNull()
    return with_defaults(records.filter(whole).drop("_record", "_corrupt_record"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Project records from a folder of one-document JSON files, best first; ``slug`` is the file stem."""
    documents = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(
        "value", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("slug")
    )
    return parse_metadata(documents, "value").orderBy(F.col("quality_score").desc(), F.col("slug"))

"""File inventory of a folder tree or an object-store prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekit.functions.fixed import DATA_SUFFIXES, PREVIEW_SUFFIXES
from lakekit.functions.text import human_size, suffix


def list_objects(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, size, size_human, last_modified`` of every file below ``path``.

    The file content is never read. ``path`` may be any file system Spark
    knows, such as ``s3a://bucket/prefix``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        "path",
        F.col("length").alias("size"),
        human_size(F.col("length")).alias("size_human"),
        F.col("modificationTime").alias("last_modified"),
    )


def inventory(files: DataFrame) -> DataFrame:
    """Name, suffix, size text and preview flag of ``files(path, size, ...)``.

    Files below a ``.git`` folder are left out.
    """
    name = F.element_at(F.split("path", "/"), -1)
    return (
        files.filter(~F.concat(F.lit("/"), F.col("path")).contains("/.git/"))
        .withColumn("name", name)
        .withColumn("suffix", suffix(F.col("name")))
        .withColumn("size_human", human_size(F.col("size"), ("B", "KB", "MB", "GB", "TB")))
        .withColumn("preview", F.col("suffix").isin(PREVIEW_SUFFIXES))
    )


def data_files(files: DataFrame) -> DataFrame:
    """Files whose name ends in a data suffix, each path once."""
    ends = F.lit(False)
    for ending in DATA_SUFFIXES:
        ends = ends | F.col("path").endswith(ending)
    return files.filter(ends).dropDuplicates(["path"])

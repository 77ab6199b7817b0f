"""Path helpers and the batch log behind incremental tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _hadoop(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as listings name it, without a slash at its end."""
    fs, p = _hadoop(spark, path)
    return fs.makeQualified(p).toString().rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(p))


class BatchLog:
    """A table kept as one Parquet folder per batch plus a compacted base.

    Each batch is written under its own id, so replaying a batch rewrites the
    same folder. Readers see complete folders only (those with ``_SUCCESS``)
    and merge them with an associative rule, which keeps the cost of a batch
    in proportion to the batch and not to the table.
    """

    ID = "log_id"

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _ids(self, kind: str) -> list[int]:
        found = []
        for name in child_names(self.spark, self.path):
            match = re.fullmatch(rf"{kind}-(\d+)", name)
            if match and path_exists(self.spark, f"{self.path}/{name}/_SUCCESS"):
                found.append(int(match.group(1)))
        return sorted(found)

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}-{number:012d}"

    def base_id(self) -> int | None:
        ids = self._ids("base")
        return ids[-1] if ids else None

    def batch_ids(self) -> list[int]:
        base = self.base_id()
        return [i for i in self._ids("batch") if base is None or i > base]

    def write(self, batch_id: int, df: DataFrame) -> None:
        base = self.base_id()
        if base is not None and batch_id <= base:
            return  # a replay of a batch that the base already holds
        df.write.mode("overwrite").parquet(self._folder("batch", batch_id))

    def read(self) -> DataFrame | None:
        """All rows with the id of their folder in ``log_id``; None when empty."""
        base, batches = self.base_id(), self.batch_ids()
        folders = [self._folder("base", base)] if base is not None else []
        folders += [self._folder("batch", i) for i in batches]
        if not folders:
            return None
        folder_name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        number = F.element_at(F.split(folder_name, "-"), -1).cast("bigint")
        return self.spark.read.parquet(*folders).withColumn(self.ID, number)

    def compact(self, merged: DataFrame) -> None:
        """Write ``merged`` (the merge of ``read()``) as the new base, then drop what it replaces."""
        batches = self.batch_ids()
        if not batches:
            return
        old_base = self.base_id()
        merged.write.mode("overwrite").parquet(self._folder("base", batches[-1]))
        for number in batches:
            delete_path(self.spark, self._folder("batch", number))
        if old_base is not None:
            delete_path(self.spark, self._folder("base", old_base))

"""Row order at scale: first rows per key, and numbered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakekit.session import scratch_path

# From this many rows per key on, Spark no longer limits them before the shuffle.
GROUP_LIMIT = 1000
SLICES = 256


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every key in ``order``.

    Spark limits each key to ``n`` rows in every task before the shuffle, so a
    key that holds most of the rows costs no more than any other. It does so
    for small ``n`` only; beyond that, each key is first limited in slices.
    """
    if n >= GROUP_LIMIT:
        sliced = df.withColumn("_slice", F.spark_partition_id() % SLICES)
        df = _ranked(sliced, [*keys, "_slice"], order, n).drop("_slice")
    return _ranked(df, keys, order, n)


def _ranked(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_rank")


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows from 1 in a total ``order`` without a single-task window.

    Rows are range-partitioned and written once in order; the second read adds
    to each row the number of rows in the partitions before its own. The range
    bounds come from a sample, so both steps must see one written result.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "numbered")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id()
    ranged.withColumns(
        {"_part": F.spark_partition_id(), "_local": local.bitwiseAND(F.lit(2**33 - 1))}
    ).write.parquet(path)
    written = spark.read.parquet(path)
    # One row per partition, so this window and the broadcast are bounded by the partition count.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        written.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    return (
        written.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_local") + 1)
        .drop("_part", "_local", "_start")
    )

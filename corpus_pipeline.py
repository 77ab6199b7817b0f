"""A training-data pipeline over ``documents``: quality, near copies, repeated strings, contamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet before the next one reads it.
All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekit.llm import decontaminate, jaccard, packing, quality, substrings
from lakekit.session import scratch_path


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return quality.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near copies, the document of least id stays."""
    return jaccard.keep_one(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a document of smaller id holds are cut out; documents with nothing left go."""
    left = substrings.remove_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in left.columns else left


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces, sequences and places of all tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeated_strings),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Packing depends on a tokenizer, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        folder, result = scratch_path(spark, "stage"), stage(spark, docs, sf_dir)
        result.write.parquet(folder)
        docs = spark.read.schema(result.schema).parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)

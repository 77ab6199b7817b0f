"""Connected components of an edge table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekit.session import scratch_path


#: Tasks that the nodes of one label are spread over.
SALTS = 16


def salted(left: DataFrame, right: DataFrame, key: str, spread: Column, salts: int) -> DataFrame:
    """``left`` joined with the one row that ``right`` has for its ``key``; rows of one key meet it in several tasks."""
    dealt = left.withColumn("_salt", F.pmod(spread, F.lit(salts)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame, scratch: str | None = None) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a and b); the label is the least node of its component.

    Each round takes the least label among a node's neighbours, then that label's own label, so long chains shrink
    by half. Rounds end in a table in the shared folder, below ``scratch`` if given; the last is one that changes nothing.
    """
    spark, kind = edges.sparkSession, edges.schema["a"].dataType.simpleString()

    def place(label: str) -> str:
        return f"{scratch}/{label}-{uuid.uuid4().hex}" if scratch else scratch_path(spark, label)

    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    folder = place("edges")
    both.write.parquet(folder)
    both = spark.read.schema(f"a {kind}, b {kind}").parquet(folder)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label"))
    while True:
        near = both.join(labels, both["a"] == labels["node"]).groupBy("b").agg(F.min("label").alias("near"))
        best = labels.join(near, labels["node"] == near["b"]).select("node", "label", F.least("label", "near").alias("next"))
        # Only labels that are used, each once; the nodes of a large component share one.
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("further")).join(best.select("next").distinct(), "next")
        moved = salted(best, jump, "next", F.xxhash64("node"), SALTS).select(
            "node", F.least("next", "further").alias("label"), (F.least("next", "further") != F.col("label")).alias("changed")
        )
        folder = place("labels")
        moved.write.parquet(folder)
        moved = spark.read.schema(f"node {kind}, label {kind}, changed boolean").parquet(folder)
        labels = moved.select("node", "label")
        if not moved.where("changed").limit(1).count():
            return labels

"""The whole lake build as one set of DataFrames: check, score, gate, and store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekit.operators.governance import csv_headers, pii_by_file
from lakekit.operators.merge import cas_path, store_if_better, with_hash
from lakekit.operators.quality import is_data_file, quality_gate, repo_quality

MINIMUM_SCORE = 5.0


def lake_projects(files: DataFrame, stored: DataFrame | None = None, minimum: float = MINIMUM_SCORE) -> DataFrame:
    """Scored projects that pass the gate.

    With ``stored``, earlier records of the same columns, a project keeps its
    stored record unless the new score is higher.
    """
    passed = quality_gate(repo_quality(files), minimum)
    if stored is None:
        return passed
    both = stored.withColumn("_arrival", F.lit(0)).unionByName(passed.withColumn("_arrival", F.lit(1)))
    return store_if_better(both, "repo", "quality_score", "_arrival").drop("_arrival")


def lake_file_records(files: DataFrame, projects: DataFrame) -> DataFrame:
    """One record per stored object of the passing projects, with its personal-data findings.

    Only hashes, paths and flags are shuffled; the content stays where it is read.
    """
    hashed = with_hash(files.filter(is_data_file(F.col("path"))))
    flagged = pii_by_file(csv_headers(files), ["repo", "path"]).drop("findings")
    kept = hashed.join(projects.select("repo"), "repo", "left_semi").join(flagged, ["repo", "path"], "left")
    return (
        kept.groupBy("sha256", "name")
        .agg(
            F.min_by("repo", "path").alias("repo"),
            F.min("path").alias("path"),
            F.min("size").alias("size"),
            F.min("suffix").alias("suffix"),
            F.coalesce(F.min_by("pii_flagged", "path"), F.lit(False)).alias("pii_flagged"),
            F.coalesce(F.min_by("pii_fields", "path"), F.lit("")).alias("pii_fields"),
        )
        .withColumn("storage_path", cas_path(F.col("sha256"), F.col("name")))
    )

"""Rows out of stored API responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WRAPPERS = ["data", "results", "items"]


def payload_rows(payloads: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """One row per item of each JSON ``body``, as ``keep`` columns, ``pos`` and variant ``item``.

    A list gives its elements; an object gives the list under the first
    present of the keys ``data``, ``results`` and ``items``, even when that
    list is empty or null; any other object is one item itself.
    """
    parsed = payloads.select(*keep, F.try_parse_json(F.col(body)).alias("_v"))

    # A path into a list finds no key, so a list that is the whole answer holds itself.
    wrapped = [F.try_variant_get(F.col("_v"), f"$.{key}", "variant") for key in _WRAPPERS]
    holder = F.coalesce(*wrapped, F.col("_v"))
    items = parsed.filter(F.col("_v").isNotNull()).withColumn("_holder", holder)
    # A list is read as an array of variants; anything else is no array and becomes an array of one.
    listed = F.try_variant_get(F.col("_holder"), "$", "array<variant>")
    single = F.array(F.col("_holder"))
    return items.filter(~F.is_variant_null("_holder")).select(
        *keep, F.posexplode(F.coalesce(listed, single)).alias("pos", "item")
    )


def repo_items(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Project records from search items; items without a URL give no row."""

    def text(key: str) -> Column:
        return F.try_variant_get(F.col("item"), f"$.{key}", "string")

    return rows.select(
        *keep,
        F.coalesce(text("full_name"), F.lit("")).alias("repo_name"),
        text("html_url").alias("repo_url"),
        F.lit("github_api").alias("mirror_name"),
        F.coalesce(text("description"), F.lit("")).alias("description"),
        F.coalesce(F.try_variant_get("item", "$.stargazers_count", "bigint"), F.lit(0)).alias("stars"),
        F.coalesce(text("language"), F.lit("")).alias("language"),
        F.coalesce(
            F.try_variant_get("item", "$.topics", "array<string>"), F.expr("cast(array() as array<string>)")
        ).alias("tags"),
    ).filter(F.col("repo_url") != "")

"""Content addressing, keep-if-better, version history and keyed merges.

Every rule reduces a key to a bounded number of rows before the shuffle, and
joins only tables with one row per key, so no key can overload a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekit.functions.fixed import FLAT_FOLDERS, FLAT_OTHER
from lakekit.functions.text import slug
from lakekit.operators.ordering import first_per_key
from lakekit.sources.tables import with_defaults


def with_hash(files: DataFrame, content: str = "content") -> DataFrame:
    """Files with the SHA-256 of their bytes; the content itself is dropped before any shuffle."""
    return files.withColumn("sha256", F.sha2(F.col(content), 256)).drop(content)


def cas_path(sha256: Column, name: Column) -> Column:
    return F.concat(F.lit("raw/"), F.left(sha256, F.lit(2)), F.lit("/"), sha256, F.lit("_"), name)


def cas_dedup(files: DataFrame, by_name: bool = True) -> DataFrame:
    """One row per stored object of the content-addressed layout, with the copies it replaces.

    Objects are kept once per hash and file name, or once per hash alone; the
    smallest path stands for them.
    """
    keys = ["sha256", "name"] if by_name else ["sha256"]
    kept = (
        with_hash(files)
        .groupBy(*keys)
        .agg(
            F.min("path").alias("first_path"),
            *([] if by_name else [F.min_by("name", "path").alias("name")]),
            F.min("size").alias("size"),
            F.count("*").alias("copies"),
        )
    )
    return kept.withColumn("storage_path", cas_path(F.col("sha256"), F.col("name")))


def flat_layout(files: DataFrame, order: str = "path") -> DataFrame:
    """Target path of every data file by suffix and project; on a collision the last file wins."""
    folder = F.lit(FLAT_OTHER)
    for ending, name in FLAT_FOLDERS.items():
        folder = F.when(F.col("suffix") == ending, F.lit(name)).otherwise(folder)
    target = F.concat(
        F.lit("data/structured/"), folder, F.lit("/"), slug(F.col("repo")), F.lit("_"), F.col("name")
    )
    return (
        files.withColumn("target_path", target)
        .groupBy("target_path")
        .agg(F.max_by("path", order).alias("source_path"), F.count("*").alias("files"))
    )


def store_if_better(records: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """What a store holds after all records arrived in ``order``: a later record needs a higher score."""
    return first_per_key(records, [key], [F.col(score).desc_nulls_last(), F.col(order)])


def version_history(records: DataFrame, key: str, order: list[str], keep: int = 10) -> DataFrame:
    """The last ``keep`` versions of every key."""
    return first_per_key(records, [key], [F.col(c).desc_nulls_last() for c in order], keep)


UPDATED_COLUMNS = ["quality_score", "license", "updated_at"]


def fold_upserts(batch: DataFrame, key: str, order: str, updated: list[str]) -> DataFrame:
    """A batch reduced to one row per key: first insert, last values of the updated columns.

    Keeps ``order`` as the first position, and adds ``_last`` as the last one.
    """
    fixed = [c for c in batch.columns if c not in (key, *updated)]
    return (
        batch.groupBy(key)
        .agg(
            F.min_by(F.struct(*fixed), order).alias("_first"),
            F.max_by(F.struct(*updated), order).alias("_new"),
            F.max(order).alias("_last"),
        )
        .select(key, "_first.*", "_new.*", "_last")
    )


def upsert(
    table: DataFrame, batch: DataFrame, key: str = "repo_url", order: str = "seq", updated: list[str] | None = None
) -> DataFrame:
    """Insert new keys; for known keys only score, license and update time change.

    The id of a row derives from its key, so a replayed batch gives the same rows.
    """
    updated = updated or UPDATED_COLUMNS
    new = fold_upserts(batch, key, order, updated).drop("_last", order)
    columns = [c for c in table.columns if c not in (key, "uuid")]
    t, b = table.alias("t"), new.alias("b")
    known = F.col(f"t.{key}").isNotNull()
    present = F.col(f"b.{key}").isNotNull()

    def merged(name: str) -> Column:
        if name in updated:
            return F.when(present, F.col(f"b.{name}")).otherwise(F.col(f"t.{name}"))
        if name not in batch.columns:
            return F.col(f"t.{name}")
        return F.when(known, F.col(f"t.{name}")).otherwise(F.col(f"b.{name}"))

    rows = t.join(b, F.col(f"t.{key}") == F.col(f"b.{key}"), "full_outer").select(
        F.coalesce(f"t.{key}", f"b.{key}").alias(key),
        *([F.col("t.uuid").alias("_uuid")] if "uuid" in table.columns else [F.lit(None).cast("string").alias("_uuid")]),
        *[merged(c).alias(c) for c in columns],
    )
    return rows.withColumn("uuid", F.coalesce("_uuid", row_id(F.col(key)))).drop("_uuid")


def row_id(key: Column) -> Column:
    """A stable id of 36 characters from a key."""
    digest = F.sha2(key.cast("string"), 256)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.substring(digest, 13, 4),
        F.substring(digest, 17, 4),
        F.substring(digest, 21, 12),
    )


def insert_ignore(table: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of ``batch`` to append: the first of each key that ``table`` does not hold."""
    first = first_per_key(batch, keys, [F.col(order)])
    return first.join(table.select(*keys).distinct(), keys, "left_anti")


def hash_exists(hashes: DataFrame, table: DataFrame) -> DataFrame:
    """Each hash with whether ``table`` holds it."""
    held = table.select("sha256").distinct().withColumn("_held", F.lit(True))
    return hashes.join(held, "sha256", "left").withColumn("stored", F.coalesce("_held", F.lit(False))).drop("_held")


def metadata_import(records: DataFrame, known: DataFrame, order: str = "slug") -> DataFrame:
    """Old project records to add: unknown URLs only, the first record of each, typed and with defaults.

    Records without a URL share the empty URL, of which one row is kept.
    """
    filled = with_defaults(records).withColumns(
        {
            "repo_url": F.coalesce("repo_url", F.lit("")),
            "repo_name": F.coalesce("repo_name", order),
            "mirror_name": F.coalesce("mirror_name", F.lit("")),
        }
    )
    fresh = insert_ignore(known, filled, ["repo_url"], order)
    return fresh.withColumns(
        {
            "tags": F.to_json("tags"),
            "data_types": F.to_json("data_types"),
            "ingested_at": F.try_to_timestamp(F.nullif("ingested_at", F.lit(""))),
            "updated_at": F.try_to_timestamp(F.nullif("updated_at", F.lit(""))),
        }
    )


def merge_rows(table: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keyed merge: rows of ``batch`` replace those with the same key, the last one of each key winning."""
    last = first_per_key(batch, keys, [F.col(order).desc_nulls_last()])
    untouched = table.join(last.select(*keys), keys, "left_anti")
    return untouched.unionByName(last.select(*table.columns))

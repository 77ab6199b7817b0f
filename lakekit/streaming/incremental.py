"""Streams that keep a table up to date batch by batch.

Every micro-batch is reduced to one row per key and written to a batch log
under its own id. The rules are associative, so merging the log gives the
result of the batch operator over all rows, and replaying a batch changes
nothing. ``compact_every`` bounds the number of folders a reader merges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakekit.operators.health import compose_chunks, finish, health_chunks
from lakekit.operators.merge import UPDATED_COLUMNS, fold_upserts, row_id, store_if_better
from lakekit.operators.ordering import first_per_key
from lakekit.storage import BatchLog

ID = BatchLog.ID


class IncrementalTable:
    """A batch log with a rule to reduce a batch and a rule to merge the log."""

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 50):
        self.log = BatchLog(spark, path)
        self.compact_every = compact_every

    def reduce(self, batch: DataFrame) -> DataFrame:
        raise NotImplementedError

    def merge(self, rows: DataFrame) -> DataFrame:
        """Rows of the log, one per key, in the form ``reduce`` writes them."""
        raise NotImplementedError

    def result(self) -> DataFrame | None:
        rows = self.log.read()
        return None if rows is None else self.merge(rows)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        self.log.write(batch_id, self.reduce(batch))
        if len(self.log.batch_ids()) >= self.compact_every:
            self.log.compact(self.merge(self.log.read()))

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(self.apply)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


class BestPerKey(IncrementalTable):
    """Keep-if-better: the stored row of a key gives way to a higher score only."""

    def __init__(self, spark: SparkSession, path: str, key: str, score: str, order: str, **options):
        super().__init__(spark, path, **options)
        self.key, self.score, self.order = key, score, order

    def reduce(self, batch: DataFrame) -> DataFrame:
        return store_if_better(batch, self.key, self.score, self.order)

    def merge(self, rows: DataFrame) -> DataFrame:
        order = [F.col(self.score).desc_nulls_last(), F.col(ID), F.col(self.order)]
        return first_per_key(rows, [self.key], order).drop(ID)


class Upserts(IncrementalTable):
    """Upsert: a key keeps its first row, with the last values of the updated columns."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, updated: list[str] | None = None, **options):
        super().__init__(spark, path, **options)
        self.key, self.order, self.updated = key, order, updated or UPDATED_COLUMNS

    def reduce(self, batch: DataFrame) -> DataFrame:
        return fold_upserts(batch, self.key, self.order, self.updated)

    def merge(self, rows: DataFrame) -> DataFrame:
        fixed = [c for c in rows.columns if c not in (self.key, ID, "_last", *self.updated)]
        first = F.struct(ID, self.order)
        last = F.struct(ID, "_last")
        return (
            rows.groupBy(self.key)
            .agg(
                F.min_by(F.struct(*fixed), first).alias("_first"),
                F.max_by(F.struct(*self.updated, "_last"), last).alias("_new"),
            )
            .select(self.key, "_first.*", "_new.*")
        )

    def result(self) -> DataFrame | None:
        rows = super().result()
        return None if rows is None else rows.drop("_last").withColumn("uuid", row_id(F.col(self.key)))


class FirstPerKey(IncrementalTable):
    """Insert-or-ignore: the first row of a key stays."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, **options):
        super().__init__(spark, path, **options)
        self.keys, self.order = keys, order

    def reduce(self, batch: DataFrame) -> DataFrame:
        return first_per_key(batch, self.keys, [F.col(self.order)])

    def merge(self, rows: DataFrame) -> DataFrame:
        return first_per_key(rows, self.keys, [F.col(ID), F.col(self.order)]).drop(ID)


class RunningHealth(IncrementalTable):
    """Running health score. Events are sorted within a micro-batch; a later batch applies after it."""

    def __init__(
        self, spark: SparkSession, path: str, entity: str, order: list[str], ok: str, latency: str | None = None, **options
    ):
        super().__init__(spark, path, **options)
        self.entity, self.order, self.ok, self.latency = entity, order, ok, latency

    def reduce(self, batch: DataFrame) -> DataFrame:
        return compose_chunks(health_chunks(batch, self.entity, self.order, self.ok, self.latency))

    def merge(self, rows: DataFrame) -> DataFrame:
        return compose_chunks(rows, [ID])

    def result(self) -> DataFrame | None:
        rows = super().result()
        return None if rows is None else finish(rows, self.entity)


def convert_new_files(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    schema,
    file_format: str = "csv",
    delete_original: bool = False,
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Convert the files that arrived below ``source`` since the last run, each exactly once.

    With ``delete_original`` Spark removes a source file once a later run
    has committed the batch that read it.
    """
    reader = spark.readStream.format(file_format).schema(schema).option("recursiveFileLookup", True)
    if file_format == "csv":
        reader = reader.options(header=True, quote='"', escape='"')
    if delete_original:
        reader = reader.option("cleanSource", "delete")
    rows = reader.load(source)
    if transform:
        rows = transform(rows)
    return (
        rows.writeStream.format("parquet")
        .option("path", target)
        .option("compression", "zstd")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

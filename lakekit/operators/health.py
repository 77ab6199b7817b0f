"""Running health score of entities from their event log.

A success adds to the score up to a ceiling, a failure takes from it down to a
floor, so the order of events matters. Both steps have the form
``x -> min(high, max(low, x + shift))``, and steps of that form compose into
one of the same form. A long log is therefore cut anywhere, each piece
reduced to one ``(shift, low, high)``, and the pieces composed in order: no
task ever holds all events of an entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekit.functions.fixed import HEALTH_ALIVE, HEALTH_GAIN, HEALTH_LOSS, HEALTH_MAX, HEALTH_MIN, HEALTH_START

_STEP = ["shift", "low", "high"]


def _compose_runs(entity_run: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Compose neighbouring steps of each run pairwise until one per run is left."""
    run = entity_run
    while True:
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        if len(starts) == len(run):
            return step
        offset = np.arange(len(run)) - np.repeat(starts, np.diff(np.r_[starts, len(run)]))
        first = np.flatnonzero(offset % 2 == 0)
        second = first + 1
        paired = second < len(run)
        paired[paired] = run[second[paired]] == run[first[paired]]
        merged = step[first]
        later = step[second[paired]]
        earlier = merged[paired]
        merged[paired] = np.column_stack(
            [
                earlier[:, 0] + later[:, 0],
                np.minimum(later[:, 2], np.maximum(later[:, 1], earlier[:, 1] + later[:, 0])),
                np.minimum(later[:, 2], np.maximum(later[:, 1], earlier[:, 2] + later[:, 0])),
            ]
        )
        run, step = run[first], merged


def _steps(events: pd.DataFrame) -> pd.DataFrame:
    """Each event as a chunk of one."""
    ok = events["last_ok"].to_numpy(dtype=bool)
    return events.assign(
        shift=np.where(ok, HEALTH_GAIN, -HEALTH_LOSS),
        low=np.where(ok, -np.inf, HEALTH_MIN),
        high=np.where(ok, HEALTH_MAX, np.inf),
        successes=ok.astype(np.int64),
        failures=(~ok).astype(np.int64),
    )


def _reduce(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per run of equal entities in sorted ``rows``."""
    entity = rows["entity"].to_numpy()
    changed = np.r_[True, entity[1:] != entity[:-1]]
    starts = np.flatnonzero(changed)
    ends = np.r_[starts[1:], len(rows)] - 1
    out = rows.iloc[starts].reset_index(drop=True)
    steps = _compose_runs(np.cumsum(changed), rows[_STEP].to_numpy(dtype=float))
    out[_STEP] = steps
    for name in ("successes", "failures"):
        out[name] = np.add.reduceat(rows[name].to_numpy(), starts)
    out["last_ok"] = rows["last_ok"].to_numpy()[ends]
    latency = rows["latency"].to_numpy(dtype=float)
    known = np.where(np.isnan(latency), -1, np.arange(len(rows)))
    at = np.maximum.reduceat(known, starts)
    out["latency"] = np.where(at >= 0, latency[at], np.nan)
    return out


def _reduce_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pending = None
    for events in batches:
        batch = _steps(events)
        if pending is not None:
            batch = pd.concat([pending, batch], ignore_index=True)
        if batch.empty:
            continue
        reduced = _reduce(batch)
        pending = reduced.iloc[-1:]
        yield reduced.iloc[:-1]
    if pending is not None:
        yield pending


def health_chunks(
    events: DataFrame, entity: str, order: list[str], ok: str, latency: str | None = None
) -> DataFrame:
    """Event log reduced to a few rows per entity, each standing for a stretch of its events.

    Events are range-partitioned by entity and order, which cuts a busy entity
    over many tasks.
    """
    positive = F.col(latency).cast("double") if latency else F.lit(None).cast("double")
    success = F.coalesce(F.col(ok), F.lit(False))
    names = [f"o{i}" for i in range(len(order))]
    narrow = events.select(
        F.col(entity).alias("entity"),
        *[F.col(c).alias(n) for c, n in zip(order, names)],
        success.alias("last_ok"),
        F.when(success & (positive > 0), positive).alias("latency"),
    )
    keys = ["entity", *names]
    ranged = narrow.repartitionByRange(*keys).sortWithinPartitions(*keys)
    added = [T.StructField(n, T.DoubleType()) for n in _STEP]
    added += [T.StructField(n, T.LongType()) for n in ("successes", "failures")]
    reduced = ranged.mapInPandas(_reduce_sorted, schema=T.StructType(narrow.schema.fields + added))
    return reduced.withColumn("latency", F.nanvl("latency", F.lit(None).cast("double")))


def _clamped(step: Column, value: Column) -> Column:
    return F.least(step["high"], F.greatest(step["low"], value + step["shift"]))


def compose_chunks(chunks: DataFrame, before: list[str] | None = None) -> DataFrame:
    """Chunks of each entity composed into one; ``before`` names columns that order ahead of the event order.

    An entity has at most one chunk per partition, whatever its number of events.
    """
    names = sorted((c for c in chunks.columns if c[0] == "o" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    position = F.struct(*(before or []), *names)
    pieces = F.array_sort(F.collect_list(F.struct(position.alias("at"), *_STEP)))
    start = F.struct(F.lit(0.0).alias("shift"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    composed = F.aggregate(
        "pieces",
        start,
        lambda acc, s: F.struct(
            (acc["shift"] + s["shift"]).alias("shift"),
            _clamped(s, acc["low"]).alias("low"),
            _clamped(s, acc["high"]).alias("high"),
        ),
    )
    return (
        chunks.groupBy("entity")
        .agg(
            pieces.alias("pieces"),
            F.min(position).alias("at"),
            F.sum("successes").alias("successes"),
            F.sum("failures").alias("failures"),
            F.max_by("last_ok", position).alias("last_ok"),
            F.max_by("latency", F.when(F.col("latency").isNotNull(), position)).alias("latency"),
        )
        .select(
            "entity",
            *[F.col(f"at.{n}").alias(n) for n in names],
            composed.alias("step"),
            "successes",
            "failures",
            "last_ok",
            "latency",
        )
        .select("entity", *names, "step.*", "successes", "failures", "last_ok", "latency")
    )


def finish(composed: DataFrame, entity: str = "entity") -> DataFrame:
    """Score and state from one composed row per entity.

    An entity is dead when its last event is a failure that left it below the
    limit; any success revives it.
    """
    score = F.least("high", F.greatest("low", F.lit(HEALTH_START) + F.col("shift")))
    return composed.select(
        F.col("entity").alias(entity),
        score.alias("score"),
        "successes",
        "failures",
        (F.col("last_ok") | (score >= HEALTH_ALIVE)).alias("alive"),
        F.col("latency").alias("latency_ms"),
    )


def health_score(events: DataFrame, entity: str, order: list[str], ok: str, latency: str | None = None) -> DataFrame:
    """Score, counts, state and last positive latency of every entity after all its events."""
    return finish(compose_chunks(health_chunks(events, entity, order, ok, latency)), entity)


def health_stats(scores: DataFrame, entity: str) -> DataFrame:
    """Totals over all entities, mean score of those alive, and the best of them."""
    alive = F.col("alive")
    return scores.agg(
        F.count("*").alias("total"),
        F.count_if(alive).alias("alive"),
        F.count_if(~alive).alias("dead"),
        F.coalesce(F.bround(F.avg(F.when(alive, F.col("score"))), 1), F.lit(0.0)).alias("avg_score"),
        F.min_by(entity, F.when(alive, F.struct(-F.col("score"), F.col(entity)))).alias("top_entity"),
    )


def weighted_sample(scores: DataFrame, entity: str, n: int = 1, seed: str = "0") -> DataFrame:
    """``n`` alive entities drawn without replacement in proportion to their score.

    Repeatable for one seed. Entities with score 0 are drawn only once no other
    is left, and then uniformly.
    """
    weight = F.when(F.col("score") > 0, F.col("score")).otherwise(1.0)
    digest = F.md5(F.concat(F.col(entity).cast("string"), F.lit(seed)))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return (
        scores.filter("alive")
        .withColumn("_key", -F.log(uniform) / weight)
        .orderBy(F.col("score") <= 0, "_key", entity)
        .limit(n)
        .drop("_key")
    )

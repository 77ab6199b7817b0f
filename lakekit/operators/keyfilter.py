"""Bloom filters of a table's keys: rows that surely have no partner in a huge table are told apart before a join.

The bits are set in the tasks and merged word by word; the driver sees them packed, at most ``MAX_BYTES`` of them, however
many keys there are. Beyond that the filter lets more rows pass, which the join that follows decides exactly.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 12
PROBES = 4
MAX_BYTES = 64 << 20
#: From this many keys on a join asks a filter first; fewer are joined as they are.
FILTER_FROM = 1_000_000
_WORDS = 4096


def key_filter(keys: DataFrame, column: str, max_bytes: int = MAX_BYTES) -> Callable[[Column], Column]:
    """A test of a key: false if it is surely none of ``keys``. Null is no key."""
    spark = keys.sparkSession
    known = keys.select(F.col(column).alias("key")).where("key IS NOT NULL")
    n = known.count()
    words = max(_WORDS, min(n * BITS_PER_KEY // 64 + 1, max_bytes // 8) // _WORDS * _WORDS)

    def cells(key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(p), key), F.lit(words * 64)) for p in range(PROBES)]

    cell = known.select(F.explode(F.array(*cells(F.col("key")))).alias("cell"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("cell") % 64).cast("int"))
    merged = cell.groupBy(F.floor(F.col("cell") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    packed = merged.groupBy(F.floor(F.col("word") / _WORDS).alias("share")).agg(F.collect_list(F.struct("word", "bits")).alias("words"))
    bits = np.zeros(words, dtype=np.int64)
    for row in packed.toLocalIterator():
        for word, value in row["words"]:
            bits[word] = value
    shared = spark.sparkContext.broadcast(bits.view(np.uint64))

    @F.arrow_udf("boolean")
    def may_hold(*probes: pa.Array) -> pa.Array:
        found = np.ones(len(probes[0]), dtype=bool)
        for probe in probes:
            at = probe.to_numpy()
            found &= (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pa.array(found)

    return lambda key: may_hold(*cells(key)) & key.isNotNull()


def without_keys(rows: DataFrame, blocked: DataFrame, column: str, filter_from: int = FILTER_FROM) -> DataFrame:
    """The rows whose key is none of ``blocked``. Of a large table of keys a filter is asked first, and only the rows that
    it does not clear are shuffled to the keys."""
    keys = blocked.select(column).distinct()
    if keys.count() < filter_from:
        return rows.join(keys, column, "left_anti")
    may = key_filter(keys, column)(F.col(column))
    marked = rows.withColumn("_may", may)
    cleared = marked.where("NOT _may OR _may IS NULL").drop("_may")
    return cleared.unionByName(marked.where("_may").drop("_may").join(keys, column, "left_anti"))

"""Operator 13, an audit of how filters interact, with a counting-Bloom prepass for duplicates.

Five filters judge every text; the audit says for each order of the filters, and each step, what goes, what would have
gone before or after, what only this filter catches, which good and toxic documents go, and each filter's Shapley share.

Four filters look at one text. The fifth asks whether a smaller id has the same text. Its prepass counts texts in a
sketch: every task counts the cells of its texts' hashes, counters stop at two, and the tasks' sketches are merged share
by share. A text with a cell that was met once is surely unique and is cleared. Only the others are shuffled, whole, once
for a task, for the least id of every text. Flags then join with these ids and with the labels, and everything
else follows from additive counts by part and set of failed filters: 32 numbers a part, whatever the number of orders.

The sketch has ``CELLS_PER_TEXT`` cells a text up to ``SKETCH_BYTES`` of bits, which bounds what is broadcast (64 million texts);
beyond that it clears fewer texts, more are shuffled, and results stay the same.

Cases: a null text is empty; documents without an id fail the duplicate filter neither themselves nor make others fail;
rows of equal id and text are no duplicates of each other; repeated rows count one by one; several labels of an id count
as good (toxic) if one of them is; documents without labels are neither; an empty table has no parts and gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import permutations
from math import factorial
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekit.llm.blocks import split_by
from lakekit.llm.columns import named

LETTERS = "ABCDE"
#: Cells of a share of the sketch as a power of two, cells for each text, and bytes that the merged sketch may take.
SHARE_BITS = 18
CELLS_PER_TEXT = 8
SKETCH_BYTES = 64 << 20
#: Counters that a task gathers before it hands them on.
_GATHER = 1 << 21
_TWICE = np.uint32(1 << 31)


def failures(text: Column) -> list[Column]:
    """The conditions A to D, each true for texts that fail."""
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]


@dataclass
class Sketch:
    """Bits of the cells that were met at least twice: ``shares`` of ``2 ** width`` cells, ``probes`` cells for a text."""

    shares: int
    width: int
    probes: int
    bits: np.ndarray | None = None

    def cells(self, h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
        """The cells of texts with these hashes, all in one share."""
        share = (h1.astype(np.uint64) % np.uint64(self.shares)).astype(np.int64) << self.width
        own = h2.astype(np.uint64)
        return [share | ((own >> np.uint64(p * self.width)).astype(np.int64) & ((1 << self.width) - 1)) for p in range(self.probes)]


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def sketch(texts: DataFrame, text: str = "text") -> Sketch:
    """The merged sketch of all texts.

    The counters are built in the tasks and merged by share; the driver sees the merged bits alone.
    """
    n, width, gather = texts.count(), SHARE_BITS, _GATHER
    shares = min((n * CELLS_PER_TEXT >> width) + 1, max(1, SKETCH_BYTES * 8 >> width))
    made = Sketch(shares, width, max(1, min(3, round(0.69 * (shares << width) / max(n, 1)))))

    def partial(cells: list[np.ndarray]) -> pa.RecordBatch:
        cell, met = np.unique(np.concatenate([np.zeros(0, np.int64), *cells]), return_counts=True)
        out = []
        for share, at in split_by(cell >> width):
            own = (cell[at] & ((1 << width) - 1)).astype(np.uint32)
            out.append((share, np.where(met[at] > 1, own | _TWICE, own).astype("<u4").tobytes()))
        share, counters = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(share, pa.int64()), pa.array(counters, pa.binary())], ["share", "counters"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: list[np.ndarray] = []
        for batch in batches:
            cells += made.cells(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            if sum(map(len, cells)) >= gather:
                yield partial(cells)
                cells = []
        yield partial(cells)

    def merge(partials: pa.Table) -> pa.Table:
        met = np.zeros(1 << width, dtype=np.uint8)
        for counters in partials.column("counters").to_pylist():
            own = np.frombuffer(counters, "<u4")
            at = own & ~_TWICE
            met[at] = np.minimum(met[at] + np.where(own & _TWICE, 2, 1), 2)
        return pa.table([partials.column("share")[:1], pa.array([np.packbits(met > 1).tobytes()])], ["share", "bits"])

    partials = texts.select(*_hashes(named(text))).mapInArrow(count, "share long, counters binary")
    bits = np.zeros((shares, 1 << (width - 3)), dtype=np.uint8)
    for row in partials.groupBy("share").applyInArrow(merge, "share long, bits binary").toLocalIterator():
        bits[row["share"]] = np.frombuffer(row["bits"], np.uint8)
    return replace(made, bits=bits.reshape(-1))


def possible_repeats(spark: SparkSession, made: Sketch) -> Callable[[Column, Column], Column]:
    """A function of a text's two hashes: false for texts that are surely unique."""
    shared = spark.sparkContext.broadcast(made)

    @F.arrow_udf("boolean")
    def possible(h1: pa.Array, h2: pa.Array) -> pa.Array:
        found = np.ones(len(h1), dtype=bool)
        for cell in shared.value.cells(h1.to_numpy(), h2.to_numpy()):
            found &= (shared.value.bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
        return pa.array(found)

    return possible


def failed_filters(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per document: ``id``, ``part`` and ``failed``, a bit for each filter that the document fails."""
    spark = documents.sparkSession
    rows = documents.select(
        named(doc_id).alias("id"),
        F.coalesce(named(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(named(text), F.lit("")).alias("text"),
    )
    possible = possible_repeats(spark, sketch(rows))
    marked = rows.withColumn("possible", possible(*_hashes(F.col("text"))))
    # Equal texts are one row for a task before they are shuffled.
    least = marked.where("possible").groupBy("text").agg(F.min("id").alias("id")).where("id IS NOT NULL")
    firsts = least.select("id", F.sha2("text", 256).alias("digest"), F.lit(True).alias("first"))
    bits = reduce(add, [F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures(F.col("text")))])
    flags = marked.select("id", "part", "possible", bits.alias("failed"), F.when(F.col("possible"), F.sha2("text", 256)).alias("digest"))
    again = F.col("possible") & F.col("id").isNotNull() & F.col("first").isNull()
    joined = flags.join(firsts, ["id", "digest"], "left")
    return joined.select("id", "part", (F.col("failed") + F.when(again, 1 << (len(LETTERS) - 1)).otherwise(0)).alias("failed"))


def counts(flagged: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """How many documents, good and toxic ones each part has for each set of failed filters."""
    marks = labels.groupBy(named(doc_id).alias("id")).agg(
        F.max((named(quality) == 1).cast("long")).alias("good"), F.max((named(toxic) == 1).cast("long")).alias("toxic")
    )
    known = flagged.join(marks, "id", "left")
    return known.groupBy("part", "failed").agg(
        F.count("*").alias("n"),
        F.sum(F.coalesce("good", F.lit(0).cast("long"))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0).cast("long"))).alias("toxic"),
    )


def interactions(known: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The audit of all orders of ``letters`` from the counts by set of failed filters."""
    size = len(letters)
    steps = [
        ("".join(order), step + 1, letters.index(letter), sum(1 << letters.index(x) for x in order[:step]))
        for order in permutations(letters)
        for step, letter in enumerate(order)
    ]
    orders = known.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, before int")
    # What a step does depends on its filter and on which filters ran before, not on their order.
    state = F.explode(F.sequence(F.lit(0), F.lit((size << size) - 1)))
    states = known.withColumn("state", state).select(
        "*", F.shiftright("state", size).alias("filter"), F.col("state").bitwiseAND((1 << size) - 1).alias("before")
    )
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    states = states.withColumn("bit", bit).where(F.col("before").bitwiseAND(F.col("bit")) == 0)
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("failed").bitwiseAND(F.col("before")) != 0

    def total(value: Column | str, *conditions: Column) -> Column:
        return F.sum(F.when(reduce(lambda a, b: a & b, conditions), value).otherwise(F.lit(0).cast("long")))

    # Of the orders, one in as many as a document has failing filters puts this one first among them.
    share = F.col("n") * (factorial(size) / F.greatest(F.bit_count("failed"), F.lit(1))).cast("long")
    judged = states.groupBy("part", "filter", "before").agg(
        total(F.col("n"), ~fails, ~earlier).alias("kept"),
        total(F.col("n"), fails, ~earlier).alias("removed"),
        total(F.col("n"), fails, earlier).alias("redundant"),
        total(F.col("n"), F.col("failed") == F.col("bit")).alias("unique_fails"),
        total(F.col("good"), fails, ~earlier).alias("good_lost"),
        total(F.col("toxic"), fails, ~earlier).alias("toxic_lost"),
        total(share, fails).alias("shapley"),
    )
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return judged.join(F.broadcast(orders), ["filter", "before"]).select("part", "filter_order", "step", *columns)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The audit of all documents by language."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return interactions(counts(failed_filters(documents), labels))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), f AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS failed
  FROM d
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), c AS (
  SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, failed
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
    JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter,
    (1 << (ascii(substr(filter_order, step, 1)) - 65)) AS own,
    coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i::INT, 1)) - 65))), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), judged AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN failed & (before | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN failed & before = 0 AND failed & own <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN failed & before <> 0 AND failed & own <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN failed & before = 0 AND failed & own <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN failed & before = 0 AND failed & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM steps, c GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM judged
"""

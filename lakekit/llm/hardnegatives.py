"""Operator 12, hard-negative mining over an inverted multi-index.

Vectors become integers and are halved. A codebook for each half, fitted on a bounded sample, gives every vector two
codes; a pair of codes is a cell. Every task builds shards of the index from its own rows: vectors in the order of cells,
and for both halves the radius of each code, the largest distance of a member from its centre.

An anchor's inner product with a member of a cell is at most the sum of two half bounds: the product with the code's
centre plus the length of the anchor's half times the code's radius. Both halves' bounds are sorted, and a heap walks the
cells of a shard by falling sum (the multi-sequence algorithm). First it looks for the positives, the best rows of the
anchor's label; a shard is done when the next sum is below the last positive found. Then every positive opens a window of
scores in which the best rows of other labels are its negatives; a window is certified when it is full and the next
sum is below its last entry, or the next sum is below the window, and a shard is done when all windows are. Results
are exact, and ties go to the smaller id.

Every row is indexed; nothing but the codebooks rests on the sample. Anchors are searched in parts of ``ANCHORS``, which
bounds what is broadcast; each part is one scan of the index, without a shuffle of vectors, and the few best rows
of each shard meet in a window by anchor. A label or a vector that a third of the rows share makes no group.

Cases: rows with a null id, label or vector, or any null or non-finite component, take no part; components are clamped
so that products fit into 64 bits; a shorter vector counts as filled up with zeros; of anchors with one id the least by
label and vector counts, and a row is never its own anchor's positive or negative, nor is another row of that id;
repeated rows are separate rows; fewer positives or negatives than asked are all there are; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakekit.llm.columns import named
from lakekit.session import scratch_path

SCALE = 256.0
#: Vectors that the codebooks are fitted on, codes of a half, and rounds of fitting.
SAMPLE = 4096
CODES = 16
ROUNDS = 8
#: Rows of a shard, anchors of a part, and rows whose products are taken at once.
SHARD_ROWS = 1 << 16
ANCHORS = 1 << 15
STEP_ROWS = 2048

_INDEX = "shard long, n long, width int, kind string, vectors binary, ids binary, labels binary, cells binary, radii binary"


def integers(vectors: pa.Array, width: int, scale: float) -> np.ndarray:
    """``floor(scale * x)`` of every component, shorter vectors filled up with zeros."""
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(vectors).cast(pa.float64()).to_numpy(zero_copy_only=False)
    limit = float(isqrt((2**63 - 1) // max(width, 1)))
    out = np.zeros((len(size), width), dtype=np.int64)
    out[np.arange(width) < size[:, None]] = np.clip(np.floor(flat * scale), -limit, limit).astype(np.int64)
    return out


def products(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products; floating point is used where it is exact."""
    if rows.dtype == np.float64:
        return (rows @ anchor.astype(np.float64)).astype(np.int64)
    return rows @ anchor


def fit(sample: np.ndarray, codes: int) -> np.ndarray:
    """Centres of one half by Lloyd's rounds from evenly spaced vectors of the sample."""
    distinct = np.unique(sample, axis=0).astype(np.float64)
    if not len(distinct):
        return np.zeros((1, sample.shape[1]))
    centres = distinct[np.linspace(0, len(distinct) - 1, min(codes, len(distinct))).astype(int)]
    for _ in range(ROUNDS):
        own = _nearest(sample, centres)
        for code in range(len(centres)):
            members = sample[own == code]
            if len(members):
                centres[code] = members.mean(axis=0)
    return centres


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2.0 * (vectors @ centres.T), axis=1)


def _shards(
    batches: Iterator[pa.RecordBatch], books: list[np.ndarray], width: int, scale: float, shard_rows: int
) -> Iterator[pa.RecordBatch]:
    """The index of a task's rows, a row for each shard."""
    part, number, held, rows = TaskContext.get().partitionId(), 0, [], 0
    half = books[0].shape[1]

    def shard() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        vectors = integers(table.column("vector").combine_chunks(), width, scale)
        parts, codes, radii = [vectors[:, :half], vectors[:, half:]], [], []
        for own, centres in zip(parts, books, strict=True):
            code = _nearest(own, centres)
            radius = np.full(len(centres), -1.0)
            np.maximum.at(radius, code, np.sqrt(((own - centres[code]) ** 2).sum(axis=1)))
            codes.append(code)
            radii.append(radius)
        cell = codes[0] * len(books[1]) + codes[1]
        order = np.argsort(cell, kind="stable")
        begin = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1))
        kind = next(k for k in ("<i2", "<i4", "<i8") if not vectors.size or np.abs(vectors).max() <= np.iinfo(k).max)
        ids, labels = (table.column(c).to_numpy()[order].astype("<i8").tobytes() for c in ("id", "label"))
        data = vectors[order].astype(kind).tobytes()
        values = [(part << 32) | number, len(order), width, kind, data, ids, labels, begin.astype("<i8").tobytes()]
        values.append(np.concatenate(radii).tobytes())
        names = [f.split()[0] for f in _INDEX.split(", ")]
        return pa.RecordBatch.from_pylist([dict(zip(names, values, strict=True))], _index_schema())

    for batch in batches:
        at = 0
        while at < len(batch):
            take = min(len(batch) - at, shard_rows - rows)
            held.append(batch.slice(at, take))
            at, rows = at + take, rows + take
            if rows == shard_rows:
                yield shard()
                held, rows, number = [], 0, number + 1
    if rows:
        yield shard()


def _index_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _INDEX.split(", ")])


@dataclass
class Shard:
    """A shard of the index as a task searches it."""

    vectors: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    begin: np.ndarray
    books: list[np.ndarray]
    radii: list[np.ndarray]
    step: int = STEP_ROWS

    @classmethod
    def of(cls, row: dict, books: list[np.ndarray], largest: int, step: int) -> Shard:
        """``largest`` is the largest size of an anchor's component."""
        vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(row["n"], row["width"])
        exact = float(np.abs(vectors.astype(np.int64)).max(initial=0)) * largest * row["width"] < 2**53
        radii = np.frombuffer(row["radii"], np.float64)
        return cls(
            vectors.astype(np.float64 if exact else np.int64),
            np.frombuffer(row["ids"], "<i8"),
            np.frombuffer(row["labels"], "<i8"),
            np.frombuffer(row["cells"], "<i8"),
            books,
            [radii[: len(books[0])], radii[len(books[0]) :]],
            step,
        )

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """Rows by cells of falling bound, some at a time, each time with a bound for all rows still to come."""
        half = self.books[0].shape[1]
        bounds, codes = [], []
        for own, centres, radii in zip((anchor[:half], anchor[half:]), self.books, self.radii, strict=True):
            own = own.astype(np.float64)
            length = np.sqrt((own**2).sum())
            bound = centres @ own + length * np.maximum(radii, 0)
            # Rounding must not lower a bound.
            bound += 1e-9 * (1 + length * (np.sqrt((centres**2).sum(axis=1)) + np.maximum(radii, 0)))
            live = np.flatnonzero(radii >= 0)
            order = live[np.argsort(-bound[live], kind="stable")]
            bounds.append(bound[order].tolist())
            codes.append(order.tolist())
        (b1, b2), (c1, c2), width = bounds, codes, len(self.books[1])
        if not b1 or not b2:
            return
        heap, met, gathered, size = [(-b1[0] - b2[0], 0, 0)], {(0, 0)}, [], 0
        while heap:
            _, i, j = heapq.heappop(heap)
            cell = c1[i] * width + c2[j]
            begin, end = int(self.begin[cell]), int(self.begin[cell + 1])
            if end > begin:
                gathered.append(np.arange(begin, end))
                size += end - begin
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(b1) and y < len(b2) and (x, y) not in met:
                    met.add((x, y))
                    heapq.heappush(heap, (-b1[x] - b2[y], x, y))
            if size >= self.step or (size and not heap):
                yield np.concatenate(gathered), -heap[0][0] if heap else -np.inf
                gathered, size = [], 0


def best(score: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` by falling score and rising id."""
    if len(score) > 4 * n:
        floor = np.partition(score, len(score) - n)[len(score) - n]
        some = score >= floor
        score, ids = score[some], ids[some]
    order = np.lexsort((ids, -score))[:n]
    return score[order], ids[order]


def positives(shard: Shard, anchor: int, label: int, vector: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the shard's ``n`` best rows of the anchor's label."""
    score, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for rows, bound in shard.walk(vector):
        rows = rows[(shard.labels[rows] == label) & (shard.ids[rows] != anchor)]
        if len(rows):
            found = products(shard.vectors[rows], vector)
            score, ids = best(np.concatenate([score, found]), np.concatenate([ids, shard.ids[rows]]), n)
        if len(score) == n and bound < score[-1]:
            break
    return score, ids


def negatives(
    shard: Shard, anchor: int, label: int, vector: np.ndarray, floors: list[int], tops: list[int], n: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Scores and ids of the shard's ``n`` best rows of other labels in each window ``floor <= score <= top``."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    windows, open_ = [none] * len(floors), {w for w in range(len(floors)) if floors[w] <= tops[w]}
    if not open_:
        return windows
    for rows, bound in shard.walk(vector):
        rows = rows[(shard.labels[rows] != label) & (shard.ids[rows] != anchor)]
        if len(rows):
            score, ids = products(shard.vectors[rows], vector), shard.ids[rows]
            some = (score >= min(floors[w] for w in open_)) & (score <= max(tops[w] for w in open_))
            score, ids = score[some], ids[some]
            for w in open_ if len(score) else ():
                inside = (score >= floors[w]) & (score <= tops[w])
                if inside.any():
                    have, known = windows[w]
                    windows[w] = best(np.concatenate([have, score[inside]]), np.concatenate([known, ids[inside]]), n)
        open_ = {w for w in open_ if not (bound < floors[w] or (len(windows[w][0]) == n and bound < windows[w][0][-1]))}
        if not open_:
            break
    return windows


def _search(index: DataFrame, books: list[np.ndarray], largest: int, look: Callable[[Shard], Iterator[tuple]], schema: str) -> DataFrame:
    """``look`` in every shard; its tuples are rows of ``schema``, all of whose columns are longs."""
    names, step = [f.split()[0] for f in schema.split(", ")], STEP_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                found = list(look(Shard.of(batch.slice(at, 1).to_pylist()[0], books, largest, step)))
                columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return index.mapInArrow(run, schema)


def mine(
    vectors: DataFrame,
    anchors: Column,
    low: int = 50,
    high: int = 95,
    n_positives: int = 5,
    n_negatives: int = 3,
    scale: float = SCALE,
    vec_id: str = "vec_id",
    label: str = "label",
    embedding: str = "embedding",
) -> DataFrame:
    """One row per anchor, positive and negative: their ids and scores, and the negative's rank among those returned.

    A negative's score lies between ``low`` and ``high`` hundredths of the positive's. ``anchors`` says which rows are
    anchors; ids and labels are whole numbers.
    """
    spark = vectors.sparkSession
    finite = F.forall(named(embedding), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(named(vec_id).isNotNull() & named(label).isNotNull() & named(embedding).isNotNull() & finite).select(
        named(vec_id).cast("long").alias("id"),
        named(label).cast("long").alias("label"),
        named(embedding).alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )
    width = max(2, rows.agg(F.max(F.size("vector"))).first()[0] or 0)
    half = width // 2
    some = rows.select("id", "label", "vector").orderBy(F.xxhash64("id"), "id", "label", "vector")
    sample = integers(some.select("vector").limit(max(256, min(SAMPLE, (32 << 20) // (8 * max(width, 1))))).toArrow().column(0).combine_chunks(), width, scale)
    books = [fit(sample[:, :half], CODES), fit(sample[:, half:], CODES)]
    folder, shard_rows = scratch_path(spark, "multi-index"), SHARD_ROWS
    built = rows.select("id", "label", "vector").mapInArrow(lambda it: _shards(it, books, width, scale, shard_rows), _INDEX)
    built.write.parquet(folder)
    index = spark.read.schema(_INDEX).parquet(folder)

    asked = rows.where("anchor").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("own"))
    asked = asked.select("id", "own.label", "own.vector")
    n_parts = asked.count() // ANCHORS + 1
    results = scratch_path(spark, "hard-negatives")
    for part in range(n_parts):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(n_parts)) == part).orderBy("id").toArrow()
        mined = _mine_part(spark, index, books, own, width, scale, low, high, n_positives, n_negatives)
        mined.write.mode("append").parquet(results)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).parquet(results)


def _mine_part(
    spark: SparkSession, index: DataFrame, books: list[np.ndarray], own: pa.Table, width: int, scale: float, low: int, high: int, n_positives: int, n_negatives: int
) -> DataFrame:
    """The search of one part of the anchors over the whole index."""
    ids, labels = (own.column(c).to_numpy() for c in ("id", "label"))
    vectors = integers(own.column("vector").combine_chunks(), width, scale)
    queries, largest = spark.sparkContext.broadcast(vectors), int(np.abs(vectors).max(initial=0))

    def look_for_positives(shard: Shard) -> Iterator[tuple]:
        for a in range(len(ids)):
            score, found = positives(shard, ids[a], labels[a], queries.value[a], n_positives)
            yield np.full(len(found), a), score, found

    met = _search(index, books, largest, look_for_positives, "a long, score long, id long")
    order = Window.partitionBy("a").orderBy(F.col("score").desc(), "id")
    first = met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_positives).orderBy("a", "place").toArrow()
    # At most ``n_positives`` rows for each anchor of the part.
    a, score, positive = (first.column(c).to_numpy() for c in ("a", "score", "id"))
    begin = np.searchsorted(a, np.arange(len(ids) + 1))
    # The window's ends as whole scores: low * p <= 100 * s <= high * p.
    floors = [-(-low * int(p) // 100) for p in score]
    tops = [high * int(p) // 100 for p in score]
    shared = spark.sparkContext.broadcast((begin, floors, tops))

    def look_for_negatives(shard: Shard) -> Iterator[tuple]:
        begin, floors, tops = shared.value
        for a in range(len(ids)):
            at = slice(begin[a], begin[a + 1])
            windows = negatives(shard, ids[a], labels[a], queries.value[a], floors[at], tops[at], n_negatives)
            for place, (found, negative) in enumerate(windows):
                yield np.full(len(found), begin[a] + place), found, negative

    met = _search(index, books, largest, look_for_negatives, "place long, negative_score long, negative_id long")
    order = Window.partitionBy("place").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy()
            columns = [ids[a[at]], positive[at], batch.column("rank"), batch.column("negative_id"), score[at], batch.column("negative_score")]
            names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    return ranked.select("place", "negative_score", "negative_id", "rank").mapInArrow(
        name, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """The hard negatives of every fiftieth vector, every seventh label being wrong by one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", wrong), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""

"""Operator 1, benchmark decontamination.

Normalised word windows of the benchmark items form a hash set that every task holds; the word windows of the
training texts are looked up in it by hash, hits are verified word by word, and the hit spans, or the documents that
hold them, are removed.

The set is broadcast only while the benchmark's texts are within ``broadcast_bytes``. Beyond that, window hashes are
joined by a shuffle and each document is verified against the windows the join found for it; results are the same.

Cases: a null text has no words and no hits; an item without words has no window; an item without an id marks words
but is not counted or listed; items with equal ids count once; rows of equal id are judged one by one; either table
may be empty; other columns are ignored, or handed through by :func:`remove`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekit.llm.columns import named
from lakekit.llm.memory import each
from lakekit.llm.textblocks import ALNUM, Piece, as_text, covered, per_doc_sum, pieces

WINDOW = 10
BROADCAST_BYTES = 32 << 20
_BITS = 20
_HIT = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
_ARROW_HIT = [
    ("n_words", pa.int64()),
    ("n_hit", pa.int64()),
    ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
]


def _windows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(item, size, hash, words) of every window of the items."""
    for batch in batches:
        ids, text = batch.column(0).to_pylist(), as_text(batch.column(1))
        for lo, hi in pieces(text):
            piece = Piece(text.slice(lo, hi - lo), lower=True).split(ALNUM)
            words, rows = piece.word_hashes(), []
            sizes = {min(n, int(c)) for c in piece.counts if c}
            for size in sizes:
                for h, at in zip(*piece.gram_hashes(words, size), strict=True):
                    doc = piece.doc[at]
                    if min(n, piece.counts[doc]) == size:
                        rows.append((ids[lo + doc], size, int(h.view(np.int64)), _words(piece, at, size)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item", "size", "hash", "words"]
            )


def _words(piece: Piece, at: int, size: int) -> str:
    buf = piece.buf
    return b" ".join(buf[piece.start[i] : piece.end[i]].tobytes() for i in range(at, at + size)).decode("utf-8", "replace")


def benchmark_windows(benchmark: DataFrame, n: int, item_id: str, text: str) -> DataFrame:
    """Distinct windows with the ids of their items: size, hash, words, items."""
    rows = benchmark.select(named(item_id).cast("string").alias("item"), named(text).alias("text"))
    found = rows.mapInArrow(lambda it: _windows(it, n), "item string, size int, hash long, words string")
    return found.groupBy("size", "hash", "words").agg(F.collect_set("item").alias("items"))


class _Set:
    """Windows by size: a bit map and sorted hashes to find candidates, and their words to verify them."""

    def __init__(self, rows: list[tuple[int, int, str, list[str]]]):
        self.items = {(size, words): items for size, _, words, items in rows}
        self.by_size = {}
        for size in {r[0] for r in rows}:
            hashes = np.unique(np.array([r[1] for r in rows if r[0] == size], dtype=np.int64).view(np.uint64))
            bits = np.zeros(1 << _BITS, dtype=bool)
            bits[hashes & np.uint64((1 << _BITS) - 1)] = True
            self.by_size[size] = bits, hashes

    def scan(self, piece: Piece) -> tuple[np.ndarray, list[set[str]]]:
        """Which words are hit, and the items found in each document."""
        hit_from, hit_to = [], []
        found: list[set[str]] = [set() for _ in range(piece.n_docs)]
        words = piece.word_hashes()
        for size, (bits, hashes) in self.by_size.items():
            grams, at = piece.gram_hashes(words, size)
            maybe = np.flatnonzero(bits[grams & np.uint64((1 << _BITS) - 1)])
            place = np.minimum(np.searchsorted(hashes, grams[maybe]), len(hashes) - 1)
            for i in at[maybe[hashes[place] == grams[maybe]]]:
                items = self.items.get((size, _words(piece, i, size)))
                if items is not None:
                    hit_from.append(i)
                    hit_to.append(i + size)
                    found[piece.doc[i]].update(items)
        return covered(np.array(hit_from, np.int64), np.array(hit_to, np.int64), len(piece.start)), found


def _spans(piece: Piece, hit: np.ndarray) -> list[list[dict[str, int]]]:
    """Per document, byte ranges of the runs of hit words."""
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    # A run ends at a document's end even when the next document begins with one.
    cut = piece.first[(piece.first > 0) & (piece.first < len(hit))]
    cut = cut[hit[cut] & hit[cut - 1]]
    first = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut]))
    last = np.sort(np.concatenate([np.flatnonzero(edge == -1), cut])) - 1
    out: list[list[dict[str, int]]] = [[] for _ in range(piece.n_docs)]
    for a, b in zip(first, last, strict=True):
        doc = piece.doc[a]
        base = piece.doc_start[doc]
        out[doc].append({"start": int(piece.start[a] - base), "end": int(piece.end[b] - base)})
    return out


def _judge(text: pa.Array, windows: _Set) -> list[pa.Array]:
    parts: list[list] = [[], [], [], []]
    for lo, hi in pieces(text):
        piece = Piece(text.slice(lo, hi - lo), lower=True).split(ALNUM)
        hit, found = windows.scan(piece)
        parts[0].extend(piece.counts.tolist())
        parts[1].extend(per_doc_sum(hit, piece.first, piece.first + piece.counts).tolist())
        parts[2].extend(sorted(s) for s in found)
        parts[3].extend(_spans(piece, hit))
    return [pa.array(p, k) for p, (_, k) in zip(parts, _ARROW_HIT, strict=True)]


def find(
    documents: DataFrame,
    benchmark: DataFrame,
    n: int = WINDOW,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``documents`` as struct ``row``, with n_words, n_hit, the ids of the items found (sorted) and byte spans of hits."""
    windows = benchmark_windows(benchmark, n, item_id, item_text)
    rows = documents.select(F.struct(*(named(c) for c in documents.columns)).alias("row"), named(text).alias("text"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), *T.StructType.fromDDL(_HIT)])
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(named(item_text))), F.lit(0))).first()[0]
    if size * n <= broadcast_bytes:
        held = documents.sparkSession.sparkContext.broadcast(
            [(r["size"], r["hash"], r["words"], r["items"]) for r in windows.collect()]
        )

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = _Set(held.value)

            def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
                columns = _judge(as_text(batch.column("text")), windows)
                return pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", *(k for k, _ in _ARROW_HIT)])

            yield from each(judge, batches)

        return rows.mapInArrow(scan, schema)
    return _find_by_join(rows, windows, schema)


def _find_by_join(rows: DataFrame, windows: DataFrame, schema: T.StructType) -> DataFrame:
    """The same by a shuffle: documents meet the windows of which they hold the hash, then verify these only."""
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # at most n of them

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, text = batch.column("key").to_pylist(), as_text(batch.column("text"))
            for lo, hi in pieces(text):
                piece = Piece(text.slice(lo, hi - lo), lower=True).split(ALNUM)
                words = piece.word_hashes()
                for size in sizes:
                    grams, at = piece.gram_hashes(words, size)
                    pairs = np.unique(np.stack([piece.doc[at].astype(np.uint64), grams]), axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([keys[lo + int(d)] for d in pairs[0]], pa.string()),
                            pa.array(np.full(pairs.shape[1], size, np.int32)),
                            pa.array(pairs[1].view(np.int64)),
                        ],
                        ["key", "size", "hash"],
                    )

    keyed = rows.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256))
    held = keyed.select("key", "text").mapInArrow(hashes, "key string, size int, hash long").distinct()
    found = held.join(windows, ["size", "hash"]).groupBy("key").agg(
        F.collect_list(F.struct("size", "hash", "words", "items")).alias("windows")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = as_text(batch.column("text"))
            parts = []
            for i, own in enumerate(batch.column("windows").to_pylist()):
                own_set = _Set([(w["size"], w["hash"], w["words"], w["items"]) for w in own or []])
                parts.append(_judge(text.slice(i, 1), own_set))
            columns = [pa.concat_arrays(list(c)) for c in zip(*parts, strict=True)] if parts else []
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", *(k for k, _ in _ARROW_HIT)])

    return keyed.join(found, "key", "left").select("row", "text", "windows").mapInArrow(verify, schema)


def remove(documents: DataFrame, benchmark: DataFrame, action: str = "documents", text: str = "text", **options) -> DataFrame:
    """``documents`` without contamination: ``action`` is "documents" or "spans" (hit words are cut out of the text).

    Columns stay as they are, but for ``text`` under "spans"; a text without hits is unchanged.
    """
    found = find(documents, benchmark, text=text, **options)
    if action == "documents":
        return found.where("n_hit = 0").select("row.*")
    if action != "spans":
        raise ValueError(f"unknown action {action!r}")

    @F.pandas_udf("string")
    def cut(texts, spans):
        return pd.Series([_cut(t, s) for t, s in zip(texts, spans, strict=True)])

    kept = found.withColumn("cut", F.when(F.col("n_hit") > 0, cut(F.col("row").getField(text), F.col("spans"))))
    new = F.when(F.col("n_hit") > 0, F.col("cut")).otherwise(F.col("row").getField(text))
    return kept.select(*(new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in documents.columns))


def _cut(text: str | None, spans) -> str | None:
    if text is None or spans is None or not len(spans):
        return text
    raw, out, at = text.encode(), [], 0
    for span in spans:
        out.append(raw[at : span["start"]])
        at = span["end"]
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Hits of the benchmark's ten-word windows in every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return find(documents, benchmark).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT *, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT d.*, s.n, unnest(generate_series(1, len(w) - s.n + 1)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) s WHERE len(w) >= s.n)
), hits AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)
), marked AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (r) LEFT JOIN named USING (r)
"""

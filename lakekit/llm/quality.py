"""Operator 2, quality rules on repetition found by a suffix array.

Every text is a string of words. Its suffixes are sorted by doubling the compared length; the common prefixes of
neighbours are the longest-common-prefix intervals, whose words are the maximal repeated substrings. Their spans are
united, and a text fails when they cover too much of it or when the longest of them is too long.

The array is built for a piece of many documents at once, one numpy sort a round, and only over suffixes that still
tie, so the work follows the text and its repeats.

Cases: null and empty texts have no words and fail the rule on few words; rows of equal id are judged one by one; an
empty table gives no rows; other columns are ignored, or handed through by :func:`keep`.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekit.llm.columns import fields, named
from lakekit.llm.memory import tidy
from lakekit.llm.textblocks import VISIBLE, Piece, as_text, covered, mix, per_doc_sum, pieces

MIN_WORDS = 10
#: A repeat counts from this many words on.
REPEAT_WORDS = 5
#: Repeats may cover so many percent of the words.
MAX_COVERED = 20
#: The longest repeat may have so many words.
MAX_LONGEST = 100
#: Bytes of text sorted at once; sorting takes about fifty times as much memory.
_SORT_BYTES = 1 << 20
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat"]


def _ranks(order: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For keys in sorted order: where each run of equal keys begins, and which keys are in a run of several."""
    new = np.empty(len(keys), dtype=bool)
    new[:1] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(keys)))
    return np.repeat(first, length), np.repeat(length > 1, length)


def repeat_lengths(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word place, the length of the longest repeat in its document that begins there.

    ``words`` are word hashes and ``doc`` the document of each, in ascending order.
    """
    n = len(words)
    best = np.zeros(n, dtype=np.int64)
    if n < 2:
        return best
    key = mix(words, doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    begin, tied = _ranks(order, key[order])
    rank = np.empty(n + 1, dtype=np.int32)
    rank[order] = begin
    rank[n] = -1
    levels, size = [rank.copy()], 1
    open_ = order[tied]
    while len(open_):
        # Ties are of one document, so at most one of them ends with it; the shorter text sorts first.
        after = np.minimum(open_ + size, n)
        follow = np.where(doc[np.minimum(after, n - 1)] == doc[open_], rank[after], -1).astype(np.int64)
        pair = (rank[open_].astype(np.int64) << 32) | (follow + 1)
        by = np.argsort(pair, kind="stable")
        open_, pair = open_[by], pair[by]
        sub, tied = _ranks(by, pair)
        group, _ = _ranks(by, pair >> 32)
        rank[open_] = (pair >> 32) + (sub - group)
        levels.append(rank.copy())
        open_ = open_[tied]
        size *= 2
    # Common prefixes of neighbours, from the longest compared length down.
    array = np.empty(n, dtype=np.int64)
    array[rank[:n]] = np.arange(n)
    a, b = array[:-1], array[1:]
    pair = np.flatnonzero(levels[0][a] == levels[0][b])
    left, right = a[pair].copy(), b[pair].copy()
    x, y = left.copy(), right.copy()
    for level in range(len(levels) - 1, -1, -1):
        step = np.where(levels[level][x] == levels[level][y], 1 << level, 0)
        x += step
        y += step
    common = x - left
    np.maximum.at(best, left, common)
    np.maximum.at(best, right, common)
    return best


def _measure(text: pa.Array, least: int) -> np.ndarray:
    """The counts of _FIELDS for every text, one row each."""
    parts = []
    for lo, hi in pieces(text, _SORT_BYTES):
        piece = Piece(text.slice(lo, hi - lo)).split(VISIBLE)
        to = piece.first + piece.counts
        longest = repeat_lengths(piece.word_hashes(), piece.doc)
        at = np.flatnonzero(longest >= least)
        hit = covered(at, at + longest[at], len(longest))
        lead = VISIBLE[piece.buf] & ((piece.buf & 0xC0) != 0x80)
        top = np.zeros(piece.n_docs, dtype=np.int64)
        np.maximum.at(top, piece.doc, longest)
        parts.append(
            np.stack(
                [
                    piece.counts,
                    per_doc_sum(lead, piece.doc_start, piece.doc_end),
                    per_doc_sum(_SYMBOL[piece.buf], piece.doc_start, piece.doc_end),
                    np.array([_dup_lines(piece.bytes_of(i)) for i in range(piece.n_docs)], dtype=np.int64),
                    per_doc_sum(hit, piece.first, to),
                    top,
                ]
            )
        )
    return np.concatenate(parts, axis=1) if parts else np.zeros((len(_FIELDS), 0), dtype=np.int64)


def _dup_lines(text: bytes) -> int:
    lines = Counter(text.split(b"\n"))
    return sum(n - 1 for line, n in lines.items() if n > 1 and line.split())


def measure(documents: DataFrame, text: str = "text", repeat_words: int = REPEAT_WORDS) -> DataFrame:
    """``documents`` as struct ``row`` with its counts of words, symbols, lines and repeats.

    Only the text goes to Python, once, and only counts come back.
    """

    @F.arrow_udf(fields(**dict.fromkeys(_FIELDS, "long")))
    def count(texts: pa.Array) -> pa.Array:
        values = tidy(_measure, as_text(texts), repeat_words)
        return pa.StructArray.from_arrays([pa.array(v) for v in values], _FIELDS)

    # So that no optimizer rule counts once for a filter and once more for the counts.
    counts = count.asNondeterministic()(named(text))
    rows = documents.select(F.struct(*(named(c) for c in documents.columns)).alias("row"), counts.alias("counts"))
    return rows.select("row", *(F.col("counts").getField(c).alias(c) for c in _FIELDS))


def verdict(
    min_words: int = MIN_WORDS, max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST
) -> tuple[F.Column, F.Column]:
    """The base rules' failure and the whole verdict, over the columns of :func:`measure`."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_covered * F.col("n_words"))
    return failed, ~failed & (F.col("longest_repeat") <= max_longest)


def keep(documents: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The documents that pass, with their own columns."""
    return measure(documents, text).where(verdict(**limits)[1]).select("row.*")


def op2_repetition(spark, sf_dir: str) -> DataFrame:
    """Repetition and base counts of every document, and whether it stays."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    failed, kept = verdict()
    return measure(documents).select(
        F.col("row.doc_id").alias("doc_id"), *_FIELDS[:5], failed.alias("base_failed"), kept.alias("kept")
    )


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), lines AS (
  SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line
), dup AS (SELECT r, sum(n - 1) AS n_dup_lines FROM lines GROUP BY r
), grams AS (
  SELECT r, i, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) > 4)
), twice AS (SELECT r, i FROM grams JOIN (SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1) USING (r, g)
), hit AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(generate_series(i, i + 4)) AS p FROM twice) GROUP BY r
), starts AS (
  SELECT r, w, i FROM twice JOIN d USING (r) WHERE len(w) >= i + 100
), long AS (
  SELECT DISTINCT r FROM (SELECT r FROM starts GROUP BY r, array_to_string(w[i : i + 100], ' ') HAVING count(*) > 1)
), counts AS (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols
  FROM d
), measured AS (
  SELECT counts.*, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    long.r IS NOT NULL AS too_long
  FROM counts LEFT JOIN dup USING (r) LEFT JOIN hit USING (r) LEFT JOIN long USING (r)
), judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT too_long AS kept
FROM judged
"""

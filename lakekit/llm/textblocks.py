"""Words of many documents at once, as flat numpy arrays.

An Arrow batch of texts is cut into pieces of a few megabytes; each piece becomes one byte buffer in which blanks
part the documents, so that a word never spans two of them. A text longer than a piece is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20
_PAD = 16
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)

#: Letters, digits and everything above ASCII, as in [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Everything but ASCII white space, as in [^\x20\x09-\x0D].
VISIBLE = np.ones(256, dtype=bool)
VISIBLE[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray, x: np.ndarray | np.uint64) -> np.ndarray:
    """Fold ``x`` into 64-bit hashes ``h``; order matters and every bit of both counts."""
    h = (h ^ x) * _M1
    h ^= h >> _S
    h *= _M2
    h ^= h >> _S
    return h


def as_text(column: pa.Array) -> pa.Array:
    """The column with 64-bit offsets and nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def pieces(text: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or of one row."""
    ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
        yield at, to
        at = to


def hash_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every range, eight bytes a step; ``buf`` ends with eight spare bytes."""
    view = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    size = end - start
    h = size.astype(np.uint64) * _M2
    live, at, k = None, start, 0
    while True:
        left = (size if live is None else size[live]) - k
        chunk = view[at + k] & _MASKS[np.minimum(left, 8)]
        if live is None:
            h = mix(h, chunk)
        else:
            h[live] = mix(h[live], chunk)
        k += 8
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        live = more if live is None else live[more]
        at = start[live]


class Piece:
    """One piece: ``buf`` holds a blank, the documents parted by blanks, and padding."""

    def __init__(self, text: pa.Array, lower: bool = False):
        sizes = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(text)], pa.int32()), text), pa.scalar(" ", pa.large_string()))
        data = joined.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
        n = int(sizes.sum()) + max(0, len(text) - 1)
        self.buf = np.full(n + 1 + _PAD, 0x20, dtype=np.uint8)
        self.buf[1 : n + 1] = LOWER[raw[:n]] if lower else raw[:n]
        self.n_docs = len(text)
        self.doc_start = 1 + np.cumsum(sizes + 1) - (sizes + 1)
        self.doc_end = self.doc_start + sizes

    def bytes_of(self, doc: int) -> bytes:
        return self.buf[self.doc_start[doc] : self.doc_end[doc]].tobytes()

    def split(self, table: np.ndarray) -> Piece:
        """Find the words: runs of bytes that ``table`` marks."""
        inside = table[self.buf].view(np.int8)
        inside[0] = 0
        inside[-_PAD:] = 0
        # The blanks between documents must part words whatever the table says.
        inside[self.doc_end] = 0
        edges = np.flatnonzero(np.diff(inside)) + 1
        self.start, self.end = edges[::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.doc_start)
        self.counts = np.diff(np.append(self.first, len(self.start)))
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)
        return self

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        return hash_ranges(self.buf, self.start, self.end)

    def gram_hashes(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words within a document, and the index of each run's first word."""
        m = len(words) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        g = mix(words[at], np.uint64(n))
        for j in range(1, n):
            g = mix(g * _M2, words[at + j])
        return g, at


def covered(first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in a range ``first <= place < last``."""
    step = np.zeros(size + 1, dtype=np.int64)
    np.add.at(step, first, 1)
    np.subtract.at(step, last, 1)
    return np.cumsum(step[:size]) > 0


def per_doc_sum(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of ``values[start:end]`` for many ranges."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[end] - total[start]

"""Suffix arrays by two-stage sorting, and the common prefixes of neighbours, with numpy.

The array is over a set of byte strings. A suffix ends with its string, and an end sorts before every byte.
"""

from __future__ import annotations

import numpy as np

_PAD = 16
_KEEP = np.array([0] + [((1 << (8 * k)) - 1) << (64 - 8 * k) for k in range(1, 9)], dtype=np.uint64)


class Strings:
    """Byte strings laid out one after the other, each followed by one byte that stands for its end."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        """``data`` holds the strings without gaps; none is empty."""
        n = int(sizes.sum())
        self.start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        place = np.arange(n) + np.repeat(np.arange(len(sizes)), sizes)
        self.buf = np.zeros(n + len(sizes) + _PAD, dtype=np.uint8)
        self.buf[place] = data
        #: Bytes from a place to its string's end; 0 at the end itself.
        self.left = (self.start + sizes)[self.owner] - np.arange(len(self.owner))

    def word(self, at: np.ndarray, skip: int) -> np.ndarray:
        """Eight bytes from ``at + skip`` as a number that sorts like them, with zeros after the string's end."""
        view = np.ndarray((len(self.buf) - 7,), dtype=">u8", buffer=self.buf, strides=(1,))
        left = np.clip(self.left[at] - skip, 0, 8)
        return view[np.minimum(at + skip, len(view) - 1)].astype(np.uint64) & _KEEP[left]


def _direct(strings: Strings, at: np.ndarray) -> np.ndarray:
    """Sort the suffixes at ``at`` by comparing them, eight bytes a round and only those that still tie."""
    key = strings.word(at, 0)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    open_ = np.arange(len(at))
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(at) else np.zeros(0, np.int64)
    skip, deepest = 8, int(strings.left.max(initial=0))
    while True:
        same = np.zeros(len(open_) + 1, dtype=bool)
        same[1:-1] = group[1:] == group[:-1]
        tied = same[1:] | same[:-1]
        open_, group = open_[tied], group[tied]
        if not len(open_):
            return at
        if skip >= deepest:
            # Equal but for zero bytes before an end: the shorter is smaller, equal ones keep their places' order.
            at[open_] = at[open_][np.lexsort((at[open_], strings.left[at[open_]], group))]
            return at
        key = strings.word(at[open_], skip)
        order = np.lexsort((key, group))
        at[open_], key = at[open_][order], key[order]
        group = np.cumsum(np.concatenate([[0], (group[1:] != group[:-1]) | (key[1:] != key[:-1])]))
        skip += 8


def suffix_array(strings: Strings) -> np.ndarray:
    """All suffixes in order, without the empty ones.

    Suffixes smaller than their successor are sorted directly. Every other suffix is larger than its successor, so a
    scan over the array from its front meets the successor first and puts the suffix behind those its bucket already
    has; scans go bucket by bucket, and within a bucket along runs of its byte.
    """
    n = len(strings.left)
    if not n:
        return np.zeros(0, dtype=np.int64)
    symbol = np.where(strings.left > 0, strings.buf[:n].astype(np.uint16) + 1, 0).astype(np.uint16)
    # The next place whose symbol differs from its follower decides for the whole run before it.
    turn = np.where(np.append(symbol[1:] != symbol[:-1], True), np.arange(n), n)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    follower = np.append(symbol, 0)
    smaller = symbol[turn] < follower[turn + 1]
    smaller[strings.left == 0] = True
    direct = _direct(strings, np.flatnonzero(smaller & (strings.left > 0)))
    bounds = np.searchsorted(symbol[direct], np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(258)]

    def induce(entries: np.ndarray, own: int) -> None:
        before = entries[entries > 0] - 1
        before = before[~smaller[before] & (symbol[before] > own)]
        if len(before):
            kinds = symbol[before]
            order = np.argsort(kinds, kind="stable")
            before, kinds = before[order], kinds[order]
            first = np.flatnonzero(np.diff(kinds, prepend=0))
            for kind, part in zip(kinds[first], np.split(before, first[1:]), strict=True):
                waiting[kind].append(part)

    induce(np.flatnonzero(strings.left == 0), 0)
    out = []
    for own in range(1, 257):
        lists = waiting[own]
        newest = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
        lists = [newest]
        while len(newest):
            before = newest[newest > 0] - 1
            newest = before[~smaller[before] & (symbol[before] == own)]
            lists.append(newest)
        bucket = np.concatenate([*lists, direct[bounds[own] : bounds[own + 1]]])
        waiting[own] = []
        if len(bucket):
            out.append(bucket)
            induce(bucket, own)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def common_prefixes(strings: Strings, array: np.ndarray, most: int) -> np.ndarray:
    """For each suffix but the first, the bytes it shares with the one before, counted up to ``most``."""
    a, b = array[:-1], array[1:]
    out = np.minimum(np.minimum(strings.left[a], strings.left[b]), most)
    live = np.arange(len(a))
    for skip in range(0, most, 8):
        differ = strings.word(a[live], skip) ^ strings.word(b[live], skip)
        end = np.flatnonzero(differ)
        equal = np.zeros(len(end), dtype=np.int64)
        for k in range(1, 8):
            equal += (differ[end] & _KEEP[k]) == 0
        out[live[end]] = np.minimum(out[live[end]], skip + equal)
        live = live[differ == 0]
        live = live[out[live] > skip + 8]
        if not len(live):
            break
    return out

"""Distinct texts grouped into blocks of bounded size, for work that asks all other blocks about its keys.

A task packs the texts of a batch that go to one block into one compressed row, each text once, with a number for each
(such as its least id or how often it occurs). A block's rows are unpacked in the order of the texts' MD5, so whoever
unpacks a block sees the same texts in the same order, whatever order rows arrive in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakekit.llm.memory import each

PACKED = "block long, h binary, value binary, size binary, data binary"


def _zstd() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def split_by(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, the places that hold it in ascending order) for each value of ``bucket``."""
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])) if len(order) else []
    if len(order):
        yield from zip(bucket[order][first].tolist(), np.split(order, first[1:]), strict=True)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``start .. start + size`` of many ranges, one after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def as_table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def pack(rows: DataFrame, combine: np.ufunc) -> DataFrame:
    """``rows`` has h (MD5 as hex), text, value (long) and block (long); ``combine`` joins the values of equal texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _zstd()

        def blocks(batch: pa.RecordBatch) -> pa.Table:
            h, block = np.array(batch.column("h").to_pylist(), dtype="S32"), batch.column("block").to_numpy()
            value, text = batch.column("value").to_numpy(), batch.column("text").to_pylist()
            out = []
            for own, at in split_by(block):
                keys, first, place = np.unique(h[at], return_index=True, return_inverse=True)
                values = value[at[first]].copy()
                others = np.setdiff1d(np.arange(len(at)), first)
                combine.at(values, place[others], value[at[others]])
                parts = [text[i].encode() for i in at[first]]
                data = b"".join(parts)
                size = np.array([len(data), *map(len, parts)], dtype="<u4")
                out.append((own, keys.tobytes(), values.astype("<i8").tobytes(), size.tobytes(), codec.compress(data, asbytes=True)))
            kinds = [pa.int64(), *[pa.binary()] * 4]
            return as_table(out, ["block", "h", "value", "size", "data"], kinds)

        for table in each(blocks, batches):
            yield from table.to_batches()

    return rows.select("h", "text", "value", "block").mapInArrow(run, PACKED)


def unpack(table: pa.Table, combine: np.ufunc) -> tuple[list[str], np.ndarray, pa.Array]:
    """The MD5s, values and texts of a block."""
    codec = _zstd()
    h, value, text = [np.zeros(0, "S32")], [np.zeros(0, np.int64)], []
    for row in table.select(["h", "value", "size", "data"]).to_pylist():
        size = np.frombuffer(row["size"], "<u4").astype(np.int64)
        data = codec.decompress(row["data"], decompressed_size=int(size[0])) if size[0] else pa.py_buffer(b"")
        ends = pa.array(np.concatenate([[0], np.cumsum(size[1:])]))
        text.append(pa.LargeStringArray.from_buffers(len(size) - 1, ends.buffers()[1], data))
        h.append(np.frombuffer(row["h"], "S32"))
        value.append(np.frombuffer(row["value"], "<i8"))
    keys, values = np.concatenate(h), np.concatenate(value)
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(order) else order
    values = combine.reduceat(values[order], first) if len(order) else values
    texts = pa.concat_arrays(text) if text else pa.array([], pa.large_string())
    return [k.decode() for k in keys[order][first]], values, texts.take(pa.array(order[first], pa.int64()))

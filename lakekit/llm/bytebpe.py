"""Operator 11, byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut into pre-tokens ("words"). A block of some megabytes of texts keeps its distinct words once and, for every
document, the positions at which they stand. The words of all blocks meet in buckets by their hash; there each distinct
word is encoded once. The ids travel back to the blocks that asked and are put in place by position. Decoding joins ids
with the table of the tokens' bytes.

A word goes once for a block, however often the block holds it, so no word, however common, sends more than one entry a
block. A bucket takes the words of at most ``GROUP`` blocks (16 GB of text); beyond that a word is encoded once for each
such group, which bounds what a task holds. The number of buckets follows the bytes read. The vocabulary is a file on
every machine and is neither shuffled nor broadcast. Lost shuffle files are written again from the texts; a block has the
same name then, as long as the input gives a task the same rows.

Cases: a null or empty text has no ids and decodes to no bytes; a text longer than a block is a block of its own; rows are
encoded one by one, also when they are repeated or their id is null or not unique; an empty table gives no rows; other
columns are ignored. Decoding a null list gives null, and an id that is not in the table raises an error.
"""

from __future__ import annotations

import base64
import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lakekit.llm.blocks import ranges, split_by
from lakekit.llm.columns import fields, named
from lakekit.llm.textblocks import as_text, hash_ranges

#: Bytes and documents of a block, blocks that one bucket may serve, and blocks for each bucket.
BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 1 << 16
GROUP = 4096
BLOCKS_PER_BUCKET = 4
#: Texts with more characters are cut into words one at a time.
_LONG = 4 << 20
#: Rows that are decoded at once.
_DECODE_ROWS = 512
_TABLES: dict[str, pa.Array] = {}
_ENCODINGS: dict[tuple[str, str], object] = {}


def ranks_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def words_pattern() -> str:
    """The expression whose matches the public vocabularies encode one by one."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary's token bytes and ids: a line for each, the bytes in base 64."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def _encoding(path: str, pattern: str):
    if (path, pattern) not in _ENCODINGS:
        import tiktoken

        _ENCODINGS[path, pattern] = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _ENCODINGS[path, pattern]


def token_table(path: str) -> pa.Array:
    """The bytes of every token in the order of ids, null for an id without one."""
    if path not in _TABLES:
        tokens = {i: t for t, i in read_ranks(path).items()}
        _TABLES[path] = pa.array([tokens.get(i) for i in range(max(tokens, default=-1) + 1)], pa.large_binary())
    return _TABLES[path]


def _joined(table: pa.Array, at: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Entries of ``table`` in the order of ``at``, joined up to each of ``ends``."""
    taken = table.take(pa.array(at))
    starts = np.frombuffer(taken.buffers()[1], np.int64)[: len(at) + 1] if len(at) else np.zeros(1, np.int64)
    bounds = starts[np.concatenate([[0], ends])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds), taken.buffers()[2]])


def _small(data: bytes) -> bytes:
    """Compressed, with the size in front."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def _whole(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd").decompress(data[8:], decompressed_size=size, asbytes=True) if size else b""


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, which compress better than the numbers."""
    return _small(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_whole(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _split(
    batches: Iterator[pa.RecordBatch], pattern: str, kind: pa.DataType, block_bytes: int, block_rows: int, long: int
) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: their ids, their numbers of words, the distinct words, and which word stands at each position."""
    part, number, cut = TaskContext.get().partitionId(), 0, regex.compile(pattern)
    words, positions, docs, taken = defaultdict(), [], [], 0
    words.default_factory = words.__len__

    def block() -> pa.RecordBatch:
        at = np.concatenate([np.zeros(0, np.uint32), *positions])
        # The commonest words get the least numbers.
        order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), dtype=np.uint32)
        rank[order] = np.arange(len(words))
        known = [w.encode() for w in words]
        known = [known[i] for i in order.tolist()]
        ids = pa.concat_arrays(docs)
        columns = [
            pa.array([(part << 32) | number], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            pa.array([_planes(np.array([len(p) for p in positions]))]),
            pa.array([_planes(rank[at])]),
            pa.array([_planes(np.array([len(w) for w in known]))]),
            pa.array([_small(b"".join(known))]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "docs", "counts", "positions", "sizes", "words"])

    for batch in batches:
        ids, text = batch.column(0).cast(kind), as_text(batch.column(1))
        size, begin = pc.binary_length(text).to_pylist(), 0
        for row, own in enumerate(text):
            value = own.as_py()
            if positions and (taken + size[row] > block_bytes or len(positions) >= block_rows):
                docs.append(ids.slice(begin, row - begin))
                yield block()
                words.clear()
                positions, docs, taken, number, begin = [], [], 0, number + 1, row
            if len(value) > long:
                positions.append(np.fromiter((words[m.group()] for m in cut.finditer(value)), np.uint32))
            else:
                found = cut.findall(value)
                positions.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
            taken += size[row]
        docs.append(ids.slice(begin))
    if positions:
        yield block()


def _buckets(sizes: np.ndarray, words: bytes, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, the words that belong there) by a hash of each word's bytes."""
    end = np.cumsum(sizes, dtype=np.int64)
    padded = np.concatenate([np.frombuffer(words, np.uint8), np.zeros(8, np.uint8)])
    hashes = hash_ranges(padded, end - sizes, end) if len(sizes) else np.zeros(0, np.uint64)
    return split_by((hashes % np.uint64(n_buckets)).astype(np.int64))


def _texts(sizes: np.ndarray, words: bytes) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [words[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def encode(
    documents: DataFrame,
    ranks: str | None = None,
    pattern: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    packed: bool = False,
) -> DataFrame:
    """One row per document: its id and ``ids``, its tokens without special ones.

    ``ranks`` is the path, on every machine, of a vocabulary of byte strings with ranks that holds all single bytes.
    ``packed`` ids are little-endian unsigned 32-bit integers in one binary value instead of an array.
    """
    spark, path, cut = documents.sparkSession, ranks or ranks_path(), pattern or words_pattern()
    rows = documents.select(named(doc_id).alias("id"), named(text).alias("text"))
    id_type = rows.schema["id"].dataType
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_blocks = total // BLOCK_BYTES + 1
    n_groups, n_buckets = n_blocks // GROUP + 1, min(n_blocks, GROUP) // BLOCKS_PER_BUCKET + 1
    n_tasks = max(spark.sparkContext.defaultParallelism, min(n_blocks, 100_000))
    kind = to_arrow_type(id_type)
    block = fields(block="long", docs=T.ArrayType(id_type), counts="binary", positions="binary", sizes="binary", words="binary")
    # Both readers of the blocks take all columns, so the texts are cut and shuffled once.
    sizes = (BLOCK_BYTES, BLOCK_ROWS, _LONG)
    blocks = rows.mapInArrow(lambda it: _split(it, cut, kind, *sizes), block).repartition(n_tasks, "block")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["block", "sizes", "words"]).to_pylist():
                sizes, words = _numbers(row["sizes"]), _whole(row["words"])
                data, start, out = np.frombuffer(words, np.uint8), np.cumsum(sizes, dtype=np.int64) - sizes, []
                for bucket, own in _buckets(sizes, words, n_buckets):
                    own_size = sizes[own].astype(np.int64)
                    out.append((bucket, _planes(own_size), _small(data[ranges(start[own], own_size)].tobytes())))
                if out:
                    bucket, size, text = zip(*out, strict=True)
                    block = pa.array([row["block"]] * len(out), pa.int64())
                    yield pa.RecordBatch.from_arrays([block, pa.array(bucket, pa.int64()), pa.array(size), pa.array(text)], ["block", "bucket", "sizes", "words"])

    def answer(asked: pa.Table) -> pa.Table:
        encoding, known, out = _encoding(path, cut), {}, []
        for row in asked.to_pylist():
            words = _texts(_numbers(row["sizes"]), _whole(row["words"]))
            for word in words:
                if word not in known:
                    known[word] = np.array(encoding.encode_ordinary(word.decode()), dtype="<u4").tobytes()
            ids = list(map(known.__getitem__, words))
            tokens = _planes(np.frombuffer(b"".join(ids), "<u4"))
            out.append((row["block"], row["bucket"], _planes(np.array([len(i) // 4 for i in ids])), tokens))
        block, bucket, counts, ids = zip(*out, strict=True)
        return pa.table([pa.array(block, pa.int64()), pa.array(bucket, pa.int64()), pa.array(counts), pa.array(ids)], ["block", "bucket", "n", "ids"])

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0] for c in left.column_names}
        sizes, words = _numbers(row["sizes"].as_py()), _whole(row["words"].as_py())
        answers = {r["bucket"]: r for r in right.to_pylist()}
        number, found, n = [np.zeros(0, np.int64)], [], [np.zeros(1, np.int64)]
        for bucket, own in _buckets(sizes, words, n_buckets):
            number.append(own)
            n.append(_numbers(answers[bucket]["n"]).astype(np.int64) * 4)
            found.append(_numbers(answers[bucket]["ids"]).astype("<u4").tobytes())
        # Each word's ids as bytes, in the order of buckets; ``entry`` says where a word is.
        ends, order = np.cumsum(np.concatenate(n)), np.concatenate(number)
        table = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(order), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(found))])
        entry = np.empty(len(order), dtype=np.int32)
        entry[order] = np.arange(len(order), dtype=np.int32)
        at, counts = _numbers(row["positions"].as_py()), _numbers(row["counts"].as_py())
        ids = _joined(table, entry[at], np.cumsum(counts, dtype=np.int64))
        return pa.table([row["docs"].values, ids.cast(pa.binary()) if packed else _lists(ids)], ["id", "ids"])

    asked = blocks.mapInArrow(ask, fields(block="long", bucket="long", sizes="binary", words="binary"))
    group = F.pmod(F.xxhash64("block"), F.lit(n_groups))
    answers = asked.groupBy("bucket", group.alias("share")).applyInArrow(answer, fields(block="long", bucket="long", n="binary", ids="binary"))
    placed = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(place, fields(id=id_type, ids="binary" if packed else "array<int>"))
    return placed.withColumnRenamed("id", doc_id)


def _lists(packed: pa.Array) -> pa.Array:
    """Packed ids as lists."""
    ends = np.frombuffer(packed.buffers()[1], np.int64)[: len(packed) + 1] // 4
    data = packed.buffers()[2]
    flat = pa.Int32Array.from_buffers(pa.int32(), int(ends[-1]), [None, data if data is not None else pa.py_buffer(b"")])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def decode(encoded: DataFrame, ranks: str | None = None, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row: the id, ``ids``, and the ``bytes`` of the tokens, by a join of the ids with the table of tokens.

    ``ids`` are arrays or packed, as :func:`encode` gives them.
    """
    path = ranks or ranks_path()
    rows = encoded.select(named(doc_id).alias("id"), named(ids).alias("ids"))
    binary = isinstance(rows.schema["ids"].dataType, T.BinaryType)
    if not binary:
        rows = rows.withColumn("ids", F.col("ids").cast("array<int>"))

    def look_up(lists: pa.Array) -> pa.Array:
        table = token_table(path)
        if binary:
            flat = np.frombuffer(b"".join(lists.fill_null(b"").to_pylist()), "<u4")
            n = pc.fill_null(pc.binary_length(lists), 0).to_numpy() // 4
        else:
            flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        if len(flat) and (flat.min() < 0 or flat.max() >= len(table) or (table.null_count and table.take(pa.array(flat)).null_count)):
            raise ValueError("an id is not in the vocabulary")
        found = _joined(table, flat, np.cumsum(n, dtype=np.int64))
        return pc.if_else(pc.is_null(lists), pa.scalar(None, pa.binary()), found.cast(pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _DECODE_ROWS):
                some = batch.slice(at, _DECODE_ROWS)
                yield pa.RecordBatch.from_arrays([*some.columns, look_up(some.column(1))], ["id", "ids", "bytes"])

    schema = T.StructType([*rows.schema.fields, T.StructField("bytes", T.BinaryType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", doc_id)


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """The number and digest of every document's ids, and the digest of what they decode to."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    decoded = decode(encode(documents, packed=True))
    return decoded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )

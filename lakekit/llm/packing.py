"""Operator 4, packing by shortest-pack-first over the length histogram.

Documents become token ids and one end id; each is cut into pieces of the sequence length and a rest. The histogram of
piece lengths, at most one count for each length, comes to the driver, which places lengths longest first, each time
into the emptiest packs, and only updates how often each packing pattern occurs. A piece then finds its sequence by its
rank among the pieces of its length: a task counts ranks within its own share, a window over one row per task and
length adds the counts of the tasks before it, so that a length which holds most pieces is still spread over all tasks.

Cases: a null or empty text is one piece that holds the end id; repeated rows are packed one by one; an empty table
gives no rows; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakekit.llm.columns import named
from lakekit.llm.memory import each
from lakekit.llm.textblocks import as_text, pieces
from lakekit.session import scratch_path

CAPACITY = 2048
END_ID = 1
#: Words a worker remembers; then it keeps those of the texts at hand.
_REMEMBER = 600_000
#: Neither white space, letters nor numbers: behind letters they are a unit of their own.
_TAIL = b"!\"#$%&'()*+,-./:;=?@[\\]^_`{|}~"
_ENCODERS: dict[str, Encoder] = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """A tokenizer that drops white space, over words it has seen before.

    White space ends every token, and capitals A-Z are folded, so texts are encoded word by word and a word's ids are
    kept as bytes. ``folds`` holds if the tokenizer lower-cases; special strings keep their case and their own path.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(size, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        added = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values()).encode()
        self.tail = bytes(c for c in _TAIL if c not in added)
        self.known: dict[bytes, bytes] = {}

    def _one(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.array(ids, dtype=self.kind).tobytes()

    def learn(self, words: list[bytes]) -> None:
        """Know all ``words``, which are distinct, and forget others if these are too many together."""
        known = self.known
        missing = [w for w in words if w not in known]
        if len(known) + len(missing) > _REMEMBER:
            known = self.known = {w: known[w] for w in words if w in known}
        heads = [w.rstrip(self.tail) for w in missing]
        letters = [h for h in dict.fromkeys(heads) if h.isalpha() or h.decode().isalpha()]
        own = {h: known[h] for h in letters if h in known}
        plain = [h for h in letters if h not in own]
        # Runs of letters are one unit each to the tokenizer, so many are encoded as one text and parted at word ends.
        for at in range(0, len(plain), 512):
            some = plain[at : at + 512]
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, dtype=self.kind)
            ends = (np.flatnonzero(self.last[ids]) + 1) * ids.itemsize
            if len(ends) == len(some) and ends[-1] == ids.nbytes:
                ends = ends.tolist()
                own.update(zip(some, map(ids.tobytes().__getitem__, map(slice, [0, *ends], ends))))
            else:
                own.update((head, self._one(head.decode())) for head in some)
        for word, head in zip(missing, heads):
            if head not in own:
                known[word] = self._one(word.decode())
            elif len(head) == len(word):
                known[word] = own[head]
            else:
                tail = word[len(head) :]
                if tail not in known:
                    known[tail] = self._one(tail.decode())
                known[word] = own[head] + known[tail]

    def ids_of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text; a word that these texts share is looked up once."""
        # Words part at ASCII white space only; other white space stays inside a word, where the tokenizer drops it.
        lists = pc.ascii_split_whitespace(texts)
        words, lower = lists.values, pc.ascii_lower(lists.values)
        special = pc.match_substring(words, "<|")
        distinct = (pc.if_else(special, words, lower) if pc.any(special).as_py() else lower).dictionary_encode()
        _, ends, data = distinct.dictionary.buffers()
        ends = np.frombuffer(ends, np.int64)[: len(distinct.dictionary) + 1].tolist()
        own = list(map((data.to_pybytes() if data else b"").__getitem__, map(slice, ends, ends[1:])))
        self.learn(own)
        ids = pa.array(map(self.known.__getitem__, own), pa.large_binary()).take(distinct.indices)
        _, ends, data = ids.buffers()
        bounds = np.frombuffer(ends, np.int64)[lists.offsets.to_numpy()] // np.dtype(self.kind).itemsize
        ids, bounds = np.frombuffer(data or b"", dtype=self.kind), bounds.tolist()
        for start, end in zip(bounds, bounds[1:]):
            yield ids[start:end]

    def ids(self, text: str) -> np.ndarray:
        return next(self.ids_of(pa.array([text], pa.large_string())))


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(count, piece lengths) of the packs: each length, longest first, goes to the packs with most room."""
    packs: list[list[tuple[int, list[int]]]] = [[] for _ in range(capacity + 1)]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        room = max((r for r in range(capacity + 1) if packs[r]), default=0)
        while left > 0:
            while room >= length and not packs[room]:
                room -= 1
            if room < length:
                # No pack has room for it: open packs, as full of this length as they get.
                each = min(capacity // length, left)
                packs[capacity - each * length].append((left // each, [length] * each))
                left %= each
                continue
            count, lengths = packs[room].pop()
            used = min(count, left)
            if count > used:
                packs[room].append((count - used, lengths))
            packs[room - length].append((used, [*lengths, length]))
            left -= used
    return [p for room in packs for p in room]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    words, seen, part = encoder(path), np.zeros(capacity + 1, dtype=np.int64), TaskContext.get().partitionId()

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, start, length, crc, total, rank, all_ids = [], [], [], [], [], [], []
        texts = as_text(batch.column(1))
        found = (ids for at, to in pieces(texts) for ids in words.ids_of(texts.slice(at, to - at)))
        for i, own_ids in enumerate(found):
            ids = np.append(own_ids, end_id).astype("<u4")
            for at in range(0, len(ids), capacity):
                own = ids[at : at + capacity]
                row.append(i)
                start.append(at)
                length.append(len(own))
                crc.append(zlib.crc32(own.tobytes()))
                total.append(len(ids))
                rank.append(seen[len(own)])
                seen[len(own)] += 1
                if with_ids:
                    all_ids.append(own.astype(np.int32))
        columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
        columns += [pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64())]
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]
        if with_ids:
            columns.append(pa.array(all_ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    yield from each(cut, batches)


def pack(
    documents: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: the document's id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked.

    ``tokenizer`` is the path, on every machine, of a ``tokenizers`` file that lower-cases, drops white space and marks
    the ends of words, as ``word_bpe_49k.json`` does.
    """
    spark, path = documents.sparkSession, tokenizer or vocabulary_path()
    rows = documents.select(named(doc_id).alias("id"), named(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long"
    schema += ", ids array<int>" * with_ids
    folder = scratch_path(spark, "pieces")
    # Ranks depend on the order in which a task met its rows, so they are fixed by writing them once.
    rows.mapInArrow(lambda it: _pieces(it, path, capacity, end_id, with_ids), schema).write.parquet(folder)
    pieces = spark.read.schema(schema).parquet(folder)
    shares = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = shares.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(patterns(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, sequences, offsets = slots
        for batch in batches:
            rank = batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            at = np.searchsorted(keys, (batch.column("length").to_numpy() << 48) | rank, side="right") - 1
            sequence = pa.array(sequences[at] + rank - ranks[at])
            kept = [batch.column(c) for c in fields]
            yield pa.RecordBatch.from_arrays([*kept, sequence, pa.array(offsets[at])], [*fields, "sequence_id", "offset"])

    fields = ["id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] * with_ids)]
    out = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long{', ids array<int>' * with_ids}, sequence_id long, offset long"
    return pieces.join(bases, ["length", "part"]).mapInArrow(place, out).withColumnRenamed("id", doc_id)


def _slots(packs: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each place in a pattern, in order of (length, first rank): that key, the rank, the first sequence, the offset."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for count, lengths in packs:
        offset = 0
        for length in lengths:
            rank = taken.get(length, 0)
            rows.append(((length << 48) | rank, rank, sequence, offset))
            taken[length] = rank + count
            offset += length
        sequence += count
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return tuple(table.T.copy())


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """The piece, sequence and place of all tokens of all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

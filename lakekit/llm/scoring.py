"""Operator 6, language-model scores by deleted interpolation.

The model mixes the maximum-likelihood estimates of a word after its predecessor, of the word alone, and a uniform
one. The mixture's weights depend on how often the predecessor was seen, in powers of two, and are learned by
expectation-maximisation on a tenth of the training texts whose counts are deleted from the estimates meanwhile.

Distinct texts form blocks. A block counts its words and word pairs and asks for their counts everywhere, by hash, in
one shuffle of packed arrays; answers are written to the shared folder. The deleted texts form blocks of their own, so
learning the weights reads these only: rounded probabilities and how often each combination occurs go to the driver, a
table whose size depends on the rounding alone. A last pass scores every block.

Cases: null and empty texts are one end mark; rows of a null id belong to fold 0 and are not learned from; equal rows
count as often as they occur and get equal scores; without training texts every probability is uniform; an empty table
gives no rows; other columns are ignored. Words and pairs are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekit.llm.blocks import as_table, pack, split_by, unpack
from lakekit.llm.columns import named
from lakekit.llm.linear import fold
from lakekit.llm.textblocks import VISIBLE, Piece, mix, pieces
from lakekit.session import scratch_path

BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 8 << 20
FOLDS, HELD, DELETED = 10, 0, 1
#: Probabilities are rounded to powers of two to this fraction while the weights are learned.
_FINE = 4
_ROUNDS = 60
_START, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


class _Block:
    """The texts of a block as words with an end mark each, and as distinct words and pairs."""

    def __init__(self, table: pa.Table):
        self.h, self.value, text = unpack(table, np.add)
        words, counts = [], []
        for lo, hi in pieces(text):
            piece = Piece(text.slice(lo, hi - lo), lower=True).split(VISIBLE)
            words.append(np.insert(piece.word_hashes(), piece.first + piece.counts, _END))
            counts.append(piece.counts + 1)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        token = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.end = np.cumsum(self.counts)
        self.begin = self.end - self.counts
        before = np.concatenate([[_START], token[:-1]])
        before[self.begin] = _START
        self.doc = np.repeat(np.arange(len(self.h)), self.counts)
        self.words, self.word = np.unique(token, return_inverse=True)
        self.pairs, self.pair = np.unique(mix(mix(before, _START), token), return_inverse=True)
        #: The place of each token's predecessor among the words; the start stands for the end mark, seen as often.
        end_place = np.searchsorted(self.words, _END)
        self.before = np.concatenate([[end_place], self.word[:-1]]) if len(token) else self.word
        self.before[self.begin] = end_place

    def asks(self, deleted: bool, bits: int) -> Iterator[tuple]:
        """(kind, bucket, keys, counts, deleted counts) to send; keys keep their order."""
        for kind, keys, place in ((1, self.words, self.word), (2, self.pairs, self.pair)):
            counts = np.bincount(place, weights=self.value[self.doc], minlength=len(keys)).astype("<u8")
            for bucket, own in split_by((keys >> np.uint64(64 - bits)).astype(np.int64)):
                yield kind, bucket, _squeeze(keys[own]), counts[own].tobytes(), deleted

    def counts_of(self, answers: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the block's words and pairs everywhere."""
        found: dict[int, list[tuple[int, bytes]]] = {1: [], 2: []}
        for row in answers.select(["kind", "bucket", column]).to_pylist():
            found[row["kind"]].append((row["bucket"], row[column]))
        return tuple(np.frombuffer(b"".join(c for _, c in sorted(found[k])), "<u8").astype(np.float64) for k in (1, 2))


def _squeeze(keys: np.ndarray) -> bytes:
    """Ascending numbers as differences, by byte planes, of which the upper ones are mostly zero."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """Sum the counts of a bucket's keys over all blocks, and tell each block those of its own."""
    parts = {c: table.column(c).to_pylist() for c in ("block", "keys", "counts", "deleted")}
    keys = [_expand(k) for k in parts["keys"]]
    counts = np.concatenate([np.frombuffer(c, "<u8") for c in parts["counts"]]).astype(np.float64)
    gone = counts * np.repeat(parts["deleted"], [len(k) for k in keys])
    unique, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=counts, minlength=len(unique)).astype("<u8")
    cut = np.bincount(place, weights=gone, minlength=len(unique)).astype("<u8")
    kind, bucket = key[0].as_py(), key[1].as_py()
    rows, at = [], 0
    for block, deleted, own in zip(parts["block"], parts["deleted"], keys, strict=True):
        mine = place[at : at + len(own)]
        rows.append((block, kind, bucket, total[mine].tobytes(), (total - cut)[mine].tobytes() if deleted else None, None, None, None))
        at += len(own)
    if kind == 1:
        rows.append((None, kind, bucket, None, None, int((total > 0).sum()), int(total.sum()), int(cut.sum())))
    return as_table(rows, _ANSWER, [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 3])


_ANSWER = ["block", "kind", "bucket", "counts", "rest", "distinct", "tokens", "deleted_tokens"]


def level(counts: np.ndarray) -> np.ndarray:
    """The frequency class of contexts: 0 for unseen ones, then one for each power of two."""
    return np.where(counts > 0, np.floor(np.log2(np.maximum(counts, 1))) + 1, 0).astype(np.int64)


def expectation_maximisation(table: np.ndarray, uniform: float, rounds: int = _ROUNDS) -> np.ndarray:
    """Weights of pair, word and uniform estimate for every level, from (level, pair, word, weight) rows.

    A level without events takes those of all levels together; an unseen context gives the pair's share to the others.
    """

    def learn(rows: np.ndarray) -> np.ndarray:
        p = np.stack([rows[:, 1], rows[:, 2], np.full(len(rows), uniform)])
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = w[:, None] * p
            w = (share / share.sum(axis=0) * rows[:, 3]).sum(axis=1)
            w = (w + 1e-6 * w.sum()) / (w + 1e-6 * w.sum()).sum()
        return w

    every = learn(table) if len(table) else np.array([0.4, 0.4, 0.2])
    weights = np.tile(every, (65, 1))
    for own in np.unique(table[:, 0]) if len(table) else []:
        weights[int(own)] = learn(table[table[:, 0] == own])
    weights[0, 1:] += weights[0, 0] / 2
    weights[0, 0] = 0
    return weights


def _divide(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    return np.where(np.asarray(b) > 0, a / np.maximum(b, 1), 0.0)


def score(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` as struct ``row`` with held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = documents.sparkSession
    part = fold(named(doc_id), FOLDS)
    rows = documents.select(
        F.struct(*(named(c) for c in documents.columns)).alias("row"),
        F.coalesce(named(text), F.lit("")).alias("text"),
        (part == HELD).alias("held_out"),
        (part == DELETED).alias("deleted"),
    ).withColumn("h", F.md5("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, bits = total // BLOCK_BYTES + 1, max(1, int(total // BUCKET_BYTES).bit_length())
    # Blocks of deleted texts have negative numbers.
    at = F.xxhash64("h")
    block = F.when(F.col("deleted"), -1 - F.pmod(at, F.lit(n_blocks // FOLDS + 1))).otherwise(F.pmod(at, F.lit(n_blocks)))
    packed = pack(rows.select("h", "text", (~F.col("held_out")).cast("long").alias("value"), block.alias("block")), np.add)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        own = key[0].as_py()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
        out = [(own, *row) for row in _Block(table).asks(own < 0, bits)]
        return as_table(out, ["block", "kind", "bucket", "keys", "counts", "deleted"], kinds)

    asked = packed.groupBy("block").applyInArrow(
        ask, "block long, kind int, bucket long, keys binary, counts binary, deleted boolean"
    )
    schema = "block long, kind int, bucket long, counts binary, rest binary, distinct long, tokens long, deleted_tokens long"
    folder = scratch_path(spark, "counts")
    asked.groupBy("kind", "bucket").applyInArrow(_answer, schema).write.option("compression", "zstd").parquet(folder)
    answers = spark.read.schema(schema).parquet(folder)
    sums = answers.where("block IS NULL").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("distinct", "tokens", "deleted_tokens"))).first()
    n_distinct, n_tokens, n_deleted = (int(x) for x in sums)
    uniform = 1 / (n_distinct + 1)

    def events(key: tuple, texts: pa.Table, own: pa.Table) -> pa.Table:
        block = _Block(texts)
        words, pairs = block.counts_of(own, "rest")
        context = words[block.before]
        pair, word = _divide(pairs[block.pair], context), _divide(words[block.word], n_tokens - n_deleted)
        bins = [np.where(p > 0, np.round(_FINE * np.log2(np.where(p > 0, p, 1))), 1).astype(np.int64) for p in (pair, word)]
        rows, times = np.unique(np.stack([level(context), *bins, block.value[block.doc]]), axis=1, return_counts=True)
        return pa.table([*map(pa.array, rows[:3]), pa.array((rows[3] * times).astype(np.float64))], ["level", "pair", "word", "weight"])

    seen = (
        packed.where("block < 0").groupBy("block").cogroup(answers.where("block < 0").groupBy("block"))
        .applyInArrow(events, "level long, pair long, word long, weight double")
        .groupBy("level", "pair", "word").agg(F.sum("weight").alias("weight"))
    ).toArrow()
    table = np.column_stack([seen.column(c).to_numpy() for c in ("level", "pair", "word", "weight")]).astype(np.float64)
    for c in (1, 2):
        table[:, c] = np.where(table[:, c] > 0, 0.0, 2.0 ** (np.minimum(table[:, c], 0) / _FINE))
    # The order of summation should not depend on the order of rows.
    weights = expectation_maximisation(table[np.lexsort(table.T)], uniform)

    def judge(key: tuple, texts: pa.Table, own: pa.Table) -> pa.Table:
        block = _Block(texts)
        words, pairs = block.counts_of(own, "counts")
        count, context = words[block.word], words[block.before]
        mixed = weights[level(context)]
        chance = mixed[:, 0] * _divide(pairs[block.pair], context) + mixed[:, 1] * _divide(count, n_tokens) + mixed[:, 2] * uniform
        base = np.log10((count + 0.1) / (n_tokens + 0.1 * (n_distinct + 1)))
        sums = [np.add.reduceat(x, block.begin) if len(x) else x for x in ((count > 0).astype(np.int64), base, np.log10(chance))]
        deleted = pa.array(np.full(len(block.h), key[0].as_py() < 0))
        return pa.table([pa.array(block.h, pa.string()), deleted, pa.array(block.counts), *map(pa.array, sums)], _SCORES)

    scored = packed.groupBy("block").cogroup(answers.where("block IS NOT NULL").groupBy("block")).applyInArrow(
        judge, "h string, deleted boolean, n_tokens long, n_known long, base_score double, score double"
    )
    found = rows.select("row", "held_out", "deleted", "h").join(scored, ["h", "deleted"])
    return found.select("row", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


_SCORES = ["h", "deleted", "n_tokens", "n_known", "base_score", "score"]


def op6_language_model(spark, sf_dir: str) -> DataFrame:
    """The model's and the base's log probability of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    columns = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return score(documents).select(F.col("row.doc_id").alias("doc_id"), *columns)

"""Operator 7, removal of repeated byte strings by suffix arrays.

A byte goes if a string of ``length`` bytes over it also starts in a document of smaller id. Of equal texts only the
first can hold a new string, so texts are made distinct first. Distinct texts are grouped into blocks of a few
megabytes, which talk to each other through two shuffles of packed arrays:

1. Every window of ``length`` bytes picks the least hash of its short grams, its anchor. Equal windows pick equal
   anchors, so a block asks which of its anchors occur in another text, by hash.
2. Around each shared anchor, the bytes under the windows that picked it are sent to the anchor's bucket, once for
   each block and content. There their suffixes are sorted in two stages; neighbours that share ``length`` bytes are
   one string, and the smallest id that holds it goes back to the blocks.

Then each block cuts its texts. Blocks have a bounded size, identical content travels once for a block, and what a
frequent passage sends follows the number of blocks and its variants, not its copies. A bucket holds all surroundings of
its anchors, so one gram with very many different surroundings is one large sort.

Cases: ids are whole numbers; a null text is an empty one; a null id is larger than all others and equal ids are not smaller than each other;
texts shorter than ``length`` stay; repeated rows are judged alike; an empty table gives no rows. Texts and contexts
are told apart by MD5 and by 64-bit hashes, strings by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekit.llm.blocks import as_table, pack, ranges, split_by, unpack
from lakekit.llm.columns import named
from lakekit.llm.memory import tidy
from lakekit.llm.suffixes import Strings, common_prefixes, suffix_array
from lakekit.llm.textblocks import Piece, covered, hash_ranges, mix, pieces

LENGTH = 50
#: Bytes of text in a block, bytes of text to a bucket of anchors and of contexts, bytes sorted at once.
BLOCK_BYTES = 6 << 20
ANCHOR_BUCKET_BYTES = 24 << 20
CONTEXT_BUCKET_BYTES = 2 << 20
SORT_BYTES = 1 << 20
_GRAM = 16
_STRIDE = 1 << 19
_NO_ID = (1 << 63) - 1
_PLACE = np.uint64(20)


class _Block:
    """The distinct texts of a block, in the order of their MD5, and the anchors of their windows."""

    def __init__(self, table: pa.Table, length: int):
        self.length = length
        self.h, self.ids, self.text = unpack(table, np.minimum)

    def runs(self) -> Iterator[tuple[Piece, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(piece, its first text, texts, first and last window, anchor hash) of windows in a row with one anchor."""
        length, span = self.length, self.length - _GRAM + 1
        for lo, hi in pieces(self.text, 1 << 21):
            piece = Piece(self.text.slice(lo, hi - lo))
            buf = piece.buf
            view = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
            for at in range(0, len(buf) - length, _STRIDE):
                to = min(at + _STRIDE, len(buf) - length)
                grams = mix(mix(view[at : to + span - 1].copy(), np.uint64(_GRAM)), view[at + 8 : to + span + 7])
                # Order by hash, then by place: the leftmost least gram of a window.
                key = (grams >> _PLACE << _PLACE) | np.arange(len(grams), dtype=np.uint64)
                width = 1
                while width * 2 <= span:
                    key = np.minimum(key[:-width], key[width:])
                    width *= 2
                if width < span:
                    key = np.minimum(key[: to - at], key[span - width : span - width + to - at])
                anchor = (key & np.uint64((1 << 20) - 1)).astype(np.int64)
                window = np.arange(at, to)
                doc = np.searchsorted(piece.doc_start, window, side="right") - 1
                ok = np.flatnonzero((doc >= 0) & (window + length <= piece.doc_end[doc]))
                if not len(ok):
                    continue
                anchor, doc, window = anchor[ok], doc[ok], window[ok]
                new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(ok)) - 1
                yield piece, lo, doc[begin], window[begin], window[end], grams[anchor[begin]]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor hashes in order, and which of them occur in several texts of this block."""
        found = [np.unique(np.stack([g, (doc + lo).astype(np.uint64)]), axis=1) for _, lo, doc, _, _, g in self.runs()]
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.uint64)
        order = np.lexsort((pairs[1], pairs[0]))
        hashes, doc = pairs[:, order]
        keys, first = np.unique(hashes, return_index=True)
        last = np.append(first[1:], len(hashes)) - 1
        return keys, doc[first] != doc[last] if len(keys) else np.zeros(0, dtype=bool)


def _binary(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


def _shared(table: pa.Table) -> pa.Table:
    """Answer, for each block, which of the anchors it asked about occur in several texts."""
    keys = [np.frombuffer(k, "<u8") for k in table.column("keys").to_pylist()]
    many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)) for m, k in zip(table.column("many").to_pylist(), keys, strict=True)]
    flat = np.concatenate(keys)
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    hit = (count > 1) | (np.bincount(place, weights=np.concatenate(many)) > 0)
    bits, at, rows = hit[place], 0, []
    for block, own in zip(table.column("block").to_pylist(), keys, strict=True):
        shared = own[bits[at : at + len(own)]]
        if len(shared):
            rows.append((block, _binary(shared, "<u8")))
        at += len(own)
    return as_table(rows, ["block", "keys"], [pa.int64(), pa.binary()])


def _contexts(block: _Block, answers: pa.Table, buckets: int) -> list[tuple]:
    """The bytes under the windows of shared anchors, each content once, by bucket."""
    shared = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(k, "<u8") for k in answers.column("keys").to_pylist())]))
    parts: list[list[np.ndarray]] = [[] for _ in range(6)]
    if len(shared):
        for piece, lo, doc, first, last, grams in block.runs():
            place = np.minimum(np.searchsorted(shared, grams), len(shared) - 1)
            own = np.flatnonzero(shared[place] == grams)
            if not len(own):
                continue
            begin, end = first[own], last[own] + block.length
            key = mix(hash_ranges(piece.buf, begin, end), grams[own])
            ids = block.ids[doc[own] + lo]
            order = np.argsort(key, kind="stable")
            key, at = np.unique(key[order], return_index=True)
            sizes = (end - begin)[order[at]]
            spot = ranges(begin[order[at]], sizes)
            for store, value in zip(
                parts,
                (key, grams[own][order[at]], np.minimum.reduceat(ids[order], at), np.maximum.reduceat(ids[order], at), sizes, piece.buf[spot]),
                strict=True,
            ):
                store.append(value)
    if not parts[0]:
        return []
    key, gram, least, most, sizes, data = (np.concatenate(p) for p in parts)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    rows = []
    for bucket, own in split_by((gram % np.uint64(buckets)).astype(np.int64)):
        packed = [_binary(key[own], "<u8"), _binary(gram[own], "<u8"), _binary(least[own], "<i8"), _binary(most[own], "<i8")]
        rows.append((bucket, *packed, _binary(sizes[own], "<u2"), data[ranges(start[own], sizes[own])].tobytes()))
    return rows


def _least_ids(data: np.ndarray, sizes: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(context, first and last window, id) where runs of a context's windows have one least id."""
    strings = Strings(data, sizes)
    array = suffix_array(strings)
    array = array[strings.left[array] >= length]
    same = common_prefixes(strings, array, length) >= length
    begin = np.flatnonzero(np.concatenate([[True], ~same]))
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(array))))
    found = np.empty(len(strings.left), dtype=np.int64)
    found[array] = np.minimum.reduceat(least[strings.owner[array]], begin)[group]
    window = np.flatnonzero(strings.left >= length)
    owner, smallest = strings.owner[window], found[window]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (smallest[1:] != smallest[:-1])]))
    last = np.append(first[1:], len(window)) - 1
    base = strings.start[owner[first]]
    return owner[first], window[first] - base, window[last] - base, smallest[first]


def _compare(table: pa.Table, length: int) -> pa.Table:
    """Answer, for each block and context, which windows some text of smaller id holds."""
    parts = {c: table.column(c).to_pylist() for c in table.column_names}
    key = np.concatenate([np.frombuffer(k, "<u8") for k in parts["keys"]])
    gram = np.concatenate([np.frombuffer(k, "<u8") for k in parts["grams"]])
    least = np.concatenate([np.frombuffer(k, "<i8") for k in parts["least"]])
    most = np.concatenate([np.frombuffer(k, "<i8") for k in parts["most"]])
    sizes = np.concatenate([np.frombuffer(k, "<u2") for k in parts["sizes"]]).astype(np.int64)
    data = np.frombuffer(b"".join(parts["data"]), np.uint8)
    block = np.repeat(parts["block"], [len(k) // 8 for k in parts["keys"]])
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # Equal contexts of several blocks are one; contexts of one anchor stay together when a bucket is sorted in turns.
    order = np.lexsort((key, gram))
    new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (gram[order][1:] != gram[order][:-1])])
    first = np.flatnonzero(new)
    context = np.empty(len(key), dtype=np.int64)
    context[order] = np.cumsum(new) - 1
    unique = order[first]
    smallest = np.minimum.reduceat(least[order], first)
    volume = np.cumsum(sizes[unique])
    found, at = [], 0
    while at < len(unique):
        to = max(at + 1, int(np.searchsorted(volume, (volume[at - 1] if at else 0) + SORT_BYTES, side="right")))
        while to < len(unique) and gram[unique[to]] == gram[unique[to - 1]]:
            to += 1
        own = unique[at:to]
        who, a, b, ids = _least_ids(data[ranges(start[own], sizes[own])], sizes[own], smallest[at:to], length)
        found.append((who + at, a, b, ids))
        at = to
    who, a, b, ids = (np.concatenate(f) for f in zip(*found, strict=True))
    begin = np.searchsorted(who, context)
    count = np.searchsorted(who, context, side="right") - begin
    asked = np.repeat(np.arange(len(key)), count)
    run = ranges(begin, count)
    hit = ids[run] < most[asked]
    asked, run = asked[hit], run[hit]
    rows = []
    for own_block, own in split_by(block[asked]):
        who, at = asked[own], run[own]
        packed = [_binary(a[at], "<u2"), _binary(b[at], "<u2"), _binary(ids[at], "<i8")]
        rows.append((own_block, _binary(key[who], "<u8"), _binary(gram[who], "<u8"), *packed))
    return as_table(rows, ["block", "keys", "grams", "first", "last", "ids"], [pa.int64(), *[pa.binary()] * 5])


def _cut(block: _Block, answers: pa.Table, with_text: bool) -> pa.Table:
    """What is left of each text of the block."""
    parts = {c: b"".join(answers.column(c).to_pylist()) for c in ("keys", "grams", "first", "last", "ids")}
    key = np.frombuffer(parts["keys"], "<u8")
    order = np.argsort(key, kind="stable")
    key = key[order]
    first, last = (np.frombuffer(parts[c], "<u2").astype(np.int64)[order] for c in ("first", "last"))
    ids = np.frombuffer(parts["ids"], "<i8")[order]
    grams = np.unique(np.frombuffer(parts["grams"], "<u8"))
    gone: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(block.h))]
    if len(grams):
        for piece, lo, doc, begin, end, own in block.runs():
            place = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            at = np.flatnonzero(grams[place] == own)
            if not len(at):
                continue
            asked = mix(hash_ranges(piece.buf, begin[at], end[at] + block.length), own[at])
            lowest = np.searchsorted(key, asked)
            count = np.searchsorted(key, asked, side="right") - lowest
            who = np.repeat(at, count)
            run = ranges(lowest, count)
            hit = ids[run] < block.ids[doc[who] + lo]
            who, run = who[hit], run[hit]
            base = begin[who] - piece.doc_start[doc[who]]
            for text, places in split_by(doc[who] + lo):
                gone[text].append((base[places] + first[run[places]], base[places] + last[run[places]] + block.length))
    rows = []
    for h, own_id, text, cuts in zip(block.h, block.ids.tolist(), block.text.to_pylist(), gone, strict=True):
        raw = text.encode()
        removed = spans = 0
        if cuts:
            mask = covered(*(np.concatenate(c) for c in zip(*cuts, strict=True)), len(raw))
            removed = int(mask.sum())
            spans = int((np.diff(mask.view(np.int8), prepend=0) == 1).sum())
            raw = np.frombuffer(raw, np.uint8)[~mask].tobytes()
        row = (h, own_id, removed, spans, hashlib.sha256(raw).hexdigest())
        # A cut may part the bytes of a character; what is left of it goes.
        rows.append((*row, raw.decode("utf-8", "ignore")) if with_text else row)
    names, kinds = ["h", "first_id", "n_removed", "n_spans", "kept_sha256"], [pa.string(), *[pa.int64()] * 3, pa.string()]
    return as_table(rows, [*names, "kept"] if with_text else names, [*kinds, pa.string()] if with_text else kinds)


def _judge(documents: DataFrame, doc_id: str, text: str, length: int, with_text: bool) -> DataFrame:
    """One row per distinct text: h, first_id, n_removed, n_spans, kept_sha256, and what is kept of it if asked."""
    if not 2 * _GRAM <= length <= 4096:
        raise ValueError(f"strings of {length} bytes are not supported")
    rows = documents.select(
        F.coalesce(named(doc_id).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(named(text), F.lit("")).alias("text")
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, n_anchors, n_contexts = (total // size + 1 for size in (BLOCK_BYTES, ANCHOR_BUCKET_BYTES, CONTEXT_BUCKET_BYTES))
    texts = rows.withColumn("h", F.md5("text")).withColumn("block", F.pmod(F.xxhash64("h"), F.lit(n_blocks)))
    blocks = pack(texts.withColumnRenamed("id", "value"), np.minimum)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        keys, many = tidy(lambda: _Block(table, length).anchors())
        out = [
            (bucket, key[0].as_py(), _binary(keys[own], "<u8"), np.packbits(many[own]).tobytes())
            for bucket, own in split_by((keys % np.uint64(n_anchors)).astype(np.int64))
        ]
        return as_table(out, ["bucket", "block", "keys", "many"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    def send(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = tidy(lambda: _contexts(_Block(texts, length), answers, n_contexts)) if texts.num_rows and answers.num_rows else []
        names = ["bucket", "block", "keys", "grams", "least", "most", "sizes", "data"]
        out = [(row[0], key[0].as_py(), *row[1:]) for row in out]
        return as_table(out, names, [pa.int64(), pa.int64(), *[pa.binary()] * 6])

    def cut(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        return tidy(lambda: _cut(_Block(texts, length), answers, with_text))

    asked = blocks.groupBy("block").applyInArrow(ask, "bucket long, block long, keys binary, many binary")
    shared = asked.groupBy("bucket").applyInArrow(lambda table: tidy(_shared, table), "block long, keys binary")
    sent = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        send, "bucket long, block long, keys binary, grams binary, least binary, most binary, sizes binary, data binary"
    )
    answers = sent.groupBy("bucket").applyInArrow(
        lambda table: tidy(_compare, table, length), "block long, keys binary, grams binary, first binary, last binary, ids binary"
    )
    schema = "h string, first_id long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(cut, schema)


def repeated(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """``documents`` as struct ``row`` with n_bytes, n_removed, n_spans, kept_sha256, and the text kept if asked.

    With ``with_text`` the struct leaves out the text.
    """
    columns = [c for c in documents.columns if not (with_text and c == text)]
    rows = documents.select(
        F.struct(*(named(c) for c in columns)).alias("row"),
        F.coalesce(named(doc_id).cast("long"), F.lit(_NO_ID)).alias("id"),
        F.md5(F.coalesce(named(text), F.lit(""))).alias("h"),
        F.octet_length(F.coalesce(named(text), F.lit(""))).cast("long").alias("n_bytes"),
        named(text).isNull().alias("was_null"),
    )
    found = rows.join(_judge(documents, doc_id, text, length, with_text), "h")
    # A later copy of a text has nothing new in it.
    copy = (F.col("id") > F.col("first_id")) & (F.col("n_bytes") >= length)
    out = [
        "row",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    ]
    if with_text:
        out.append(F.when(copy, F.lit("")).when(~F.col("was_null"), F.col("kept")).alias("kept"))
    return found.select(*out)


def remove_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``documents`` with the repeated strings cut out of ``text``; rows of which nothing is left go."""
    found = repeated(documents, doc_id, text, length, with_text=True).where("n_removed = 0 OR n_removed < n_bytes")
    return found.select(*(F.col("kept").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in documents.columns))


def op7_substrings(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 50 bytes that an earlier one holds."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated(documents).select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")

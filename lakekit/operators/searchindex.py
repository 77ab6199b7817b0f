"""Stored search indexes: ranked search from postings alone, and substring search by trigrams with verification.

**Terms.** A record's block is its level of quality and its range of keys, so blocks differ in what their best record can
score. Postings hold, for each term and block, which records have it and where: as an index token, inside the name, or
inside the description. A query token's letters lie inside a run of word characters, so the terms that contain it, found
by trigrams of the vocabulary, say which names and descriptions contain it; texts are never read. A search bounds every
block by the best that its postings and its records' quality allow, scores the blocks of the highest bounds first, and then
only those whose bound reaches the score of the last record kept.

**Texts.** Postings of the byte trigrams of whole records give the records that may contain a string; these alone are read
and looked into. A string of fewer than three bytes is looked for in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakekit.functions.text import words
from lakekit.operators.ordering import first_per_key
from lakekit.operators.search import intended_types, long_words, name_parts, query_tokens, record_text, sidebar_text, wants_api
from lakekit.session import scratch_path

BLOCK = 4096
LEVELS = 16
PARTS = 32
#: Blocks that are scored before the threshold is known.
FIRST_BLOCKS = 8
#: Up to so many candidates are looked up by their keys, more by a join.
LOOKED_UP = 5000
LISTED, NAMED, DESCRIBED = 1, 2, 4
_POINTS = {LISTED: 1.0, NAMED: 1.5, DESCRIBED: 0.5}


def _part(value: Column | str) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(PARTS)).cast("int")


#: Terms of records that are sorted into lists at once.
_TERMS = 1 << 19


def _term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, block, entries, flags) of stretches of records, so that a shuffle carries lists instead of single entries.

    A term may have several lists for a block, one from each stretch that holds records of it.
    """

    def lists(terms: list[pa.Array], blocks: list[np.ndarray], entries: list[np.ndarray]) -> pa.RecordBatch:
        coded = pa.concat_arrays(terms).dictionary_encode()
        kinds, rank = np.unique(np.concatenate(blocks), return_inverse=True)
        # An entry is below 2^15.
        code = np.sort(coded.indices.to_numpy().astype(np.int64) << 40 | rank << 15 | np.concatenate(entries))
        cut = np.flatnonzero(np.concatenate([[True], code[1:] >> 15 != code[:-1] >> 15])) if len(code) else np.zeros(0, np.int64)
        entry, first = (code & 0x7FFF).astype(np.int32), code[cut]
        flags = np.bitwise_or.reduceat(entry & 7, cut) if len(code) else np.zeros(0, np.int32)
        columns = [
            coded.dictionary.take(pa.array(first >> 40)),
            pa.array(kinds[first >> 15 & 0x1FFFFFF]),
            pa.ListArray.from_arrays(pa.array(np.append(cut, len(code)), pa.int32()), pa.array(entry)),
            pa.array(flags, pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["term", "block", "entries", "flags"])

    held, taken = ([], [], []), 0
    for batch in batches:
        sizes = [pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy() for c in ("runs", "others", "names")]
        ends = np.cumsum(sum(sizes, np.zeros(batch.num_rows, np.int64)))
        block, offset = batch.column("block").to_numpy(), batch.column("offset").to_numpy()
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(int(np.searchsorted(ends, before + _TERMS, "right")), at + 1)
            for name, size in zip(("runs", "others", "names"), sizes, strict=True):
                terms, row = batch.column(name).slice(at, to - at).flatten(), np.repeat(np.arange(at, to), size[at:to])
                if name == "runs":
                    # Every run of a description with more than two characters is an index token too.
                    flag = np.where(pc.utf8_length(terms).to_numpy() > 2, LISTED | DESCRIBED, DESCRIBED)
                else:
                    flag = LISTED if name == "others" else NAMED
                for column, value in zip(held, (terms, block[row], offset[row] * 8 + flag), strict=True):
                    column.append(value)
            taken += int(ends[to - 1] - before)
            if taken >= _TERMS:
                yield lists(*held)
                held, taken = ([], [], []), 0
            at = to
    if taken:
        yield lists(*held)


def _term_postings(repos: DataFrame, block: Column, key: str) -> DataFrame:
    """Lists of a record's index tokens and the runs of word characters in name and description."""

    def distinct(terms: Column) -> Column:
        return F.filter(F.array_distinct(terms), lambda t: t != "")

    none = F.array().cast("array<string>")
    three = repos.select(
        block.alias("block"),
        F.pmod(F.col(key), F.lit(BLOCK)).cast("long").alias("offset"),
        distinct(words(F.coalesce("description", F.lit("")))).alias("runs"),
        distinct(F.concat(F.coalesce(name_parts(), none), long_words(F.col("structure_summary")))).alias("others"),
        distinct(words(F.coalesce("repo_name", F.lit("")))).alias("names"),
    )
    return three.mapInArrow(_term_lists, "term string, block long, entries array<int>, flags int")


def _base(types: list[str], api: bool) -> Column:
    """Points of a record that do not depend on its words."""
    points = F.lit(0.0)
    if types:
        points = points + F.when(F.arrays_overlap("data_types", F.array(*map(F.lit, types))), 2.0).otherwise(0.0)
    return points + F.when(F.col("api_docs_found"), 2.0).otherwise(0.0) if api else points


def _flag_points(flags: Column) -> Column:
    return sum((F.when(flags.bitwiseAND(f) != 0, p).otherwise(0.0) for f, p in _POINTS.items()), F.lit(0.0))


class TermIndex:
    """Ranked search over the index stored at ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "seq"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.docs = spark.read.parquet(f"{self.path}/docs")
        self.blocks = spark.read.parquet(f"{self.path}/blocks")
        # An empty table has no folders to take the columns from.
        self.postings = spark.read.schema("term string, block long, entries array<int>, flags int, part int").parquet(f"{self.path}/postings")
        self.grams = spark.read.schema("term string, gram string, part int").parquet(f"{self.path}/grams")

    @classmethod
    def build(cls, repos: DataFrame, path: str, key: str = "seq") -> TermIndex:
        """Write the index of project records whose ``key`` is a whole number."""
        spark, path = repos.sparkSession, path.rstrip("/")
        quality = F.coalesce("quality_score", F.lit(0.0)) * 0.02
        shares = [i / LEVELS for i in range(1, LEVELS)]
        cuts = sorted(set(repos.agg(F.percentile_approx(quality, shares, 1000)).first()[0] or []))
        level = sum((F.when(quality > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("long")
        block = F.shiftleft(level, 44) + F.floor(F.col(key) / BLOCK)
        docs = repos.select(
            block.alias("block"), key, "repo_name", quality.alias("quality"), "data_types", F.coalesce("api_docs_found", F.lit(False)).alias("api_docs_found")
        )
        docs.write.mode("overwrite").parquet(f"{path}/docs")
        kept = spark.read.parquet(f"{path}/docs").groupBy("block").agg(
            F.max("quality").alias("quality"),
            F.array_distinct(F.flatten(F.collect_set(F.coalesce("data_types", F.array().cast("array<string>"))))).alias("data_types"),
            F.bool_or("api_docs_found").alias("api_docs_found"),
        )
        kept.write.mode("overwrite").parquet(f"{path}/blocks")
        # A list holds one block at most, which bounds it; a folder takes as many tasks as its lists need.
        lists = _term_postings(repos, block, key).withColumn("part", _part("term"))
        postings = lists.hint("rebalance", "part").sortWithinPartitions("part", "term", "block")
        postings.write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
        # The trigrams of the terms that lie in names or descriptions.
        terms = spark.read.schema("term string, flags int, part int").parquet(f"{path}/postings").where(F.col("flags").bitwiseAND(NAMED | DESCRIBED) != 0).select("term").distinct()
        grams = terms.where(F.length("term") > 2).select("term", F.explode(_trigrams(F.col("term"))).alias("gram")).withColumn("part", _part("gram"))
        short = terms.where(F.length("term") == 2).select("term", F.col("term").alias("gram")).withColumn("part", _part("gram"))
        every = grams.unionByName(short).hint("rebalance", "part").sortWithinPartitions("part", "gram", "term")
        every.write.mode("overwrite").partitionBy("part").parquet(f"{path}/grams")
        return cls(spark, path, key)

    def _parts(self, values: list[str]) -> list[int]:
        """The folders in which values lie."""
        rows = self.spark.createDataFrame([(v,) for v in values], "v string").select(_part("v").alias("p")).distinct().collect()
        return [r["p"] for r in rows]

    def matches(self, tokens: list[str]) -> DataFrame:
        """(token, term, exact) for the tokens themselves and every term that contains one."""
        exact = self.spark.createDataFrame([(t, t, True) for t in tokens], "token string, term string, exact boolean")
        pieces = [(t, g) for t in tokens if len(t) > 2 for g in {t[i : i + 3] for i in range(len(t) - 2)}]
        frames = [exact]
        if pieces:
            asked = self.spark.createDataFrame([(t, g, len({p for p in pieces if p[0] == t})) for t, g in pieces], "token string, gram string, n int")
            grams = sorted({g for _, g in pieces})
            listed = self.grams.where(F.col("part").isin(self._parts(grams)) & F.col("gram").isin(grams))
            some = listed.join(F.broadcast(asked), "gram").groupBy("token", "term", "n").count().where("count = n")
            frames.append(some.where("contains(term, token) AND term != token").select("token", "term", F.lit(False).alias("exact")))
        short = [t for t in tokens if len(t) <= 2]
        if short:
            # Letters too few for a trigram are looked for in the vocabulary.
            terms = self.postings.where(F.col("flags").bitwiseAND(NAMED | DESCRIBED) != 0).select("term").distinct()
            found = terms.select("term", F.explode(F.filter(F.array(*map(F.lit, short)), lambda t: F.col("term").contains(t))).alias("token"))
            frames.append(found.where("term != token").select("token", "term", F.lit(False).alias("exact")))
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    def _listed(self, tokens: list[str]) -> DataFrame:
        """(token, block, entries, exact, flags) of all postings that count for a token; only an exact term counts as listed.

        Terms and postings found are written first: searches use them several times, and Spark then knows their size.
        """
        matches = self._kept(self.matches(tokens).withColumn("part", _part("term")))
        parts = [r["part"] for r in matches.select("part").distinct().collect()]
        keep = F.when(F.col("exact"), 7).otherwise(NAMED | DESCRIBED)
        joined = self.postings.where(F.col("part").isin(parts)).join(matches, ["part", "term"])
        rows = joined.select("token", "block", "entries", "exact", F.col("flags").bitwiseAND(keep).alias("flags"))
        return self._kept(rows.where("flags != 0"))

    def _kept(self, rows: DataFrame) -> DataFrame:
        folder = scratch_path(self.spark, "found")
        rows.write.parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def _points(self, listed: DataFrame) -> DataFrame:
        """(token, key, points)."""
        entry = listed.select("token", "block", "exact", F.explode("entries").alias("e"))
        own = F.col("e").bitwiseAND(F.when(F.col("exact"), 7).otherwise(NAMED | DESCRIBED))
        key = F.shiftright(F.shiftleft("block", 20), 20) * BLOCK + F.shiftright("e", 3)
        flags = entry.select("token", key.alias(self.key), own.alias("flags")).groupBy("token", self.key).agg(F.bit_or("flags").alias("flags"))
        return flags.select("token", self.key, _flag_points(F.col("flags")).alias("points"))

    def bounds(self, tokens: list[str], types: list[str], api: bool) -> tuple[DataFrame, DataFrame]:
        """The postings of a query, and every block with the best score that any of its records can have."""
        listed = self._listed(tokens) if tokens else None
        own = _base(types, api)
        blocks = self.blocks.select("block", "quality", own.alias("base"))
        if listed is None:
            return None, blocks.select("block", (F.col("base") + F.col("quality")).alias("bound"))
        flags = listed.groupBy("token", "block").agg(F.bit_or("flags").alias("flags"))
        best = flags.groupBy("block").agg(F.sum(_flag_points(F.col("flags"))).alias("points"))
        bound = F.coalesce("points", F.lit(0.0)) + F.col("base") + F.col("quality")
        return listed, blocks.join(best, "block", "left").select("block", bound.alias("bound"))

    def _scored(self, blocks: DataFrame, listed: DataFrame | None, types: list[str], api: bool) -> DataFrame:
        """The records of some blocks with their scores."""
        docs = self.docs.join(blocks.select("block"), "block", "left_semi")
        base = _base(types, api)
        if listed is None:
            return docs.select(self.key, "repo_name", (base + F.col("quality")).alias("score"))
        points = self._points(listed.join(blocks.select("block"), "block", "left_semi")).groupBy(self.key).agg(F.sum("points").alias("points"))
        score = F.coalesce("points", F.lit(0.0)) + base + F.col("quality")
        return docs.join(points, self.key, "left").select(self.key, "repo_name", score.alias("score"))

    def search(self, query: str, top_k: int = 10) -> DataFrame:
        """The best ``top_k`` records, ties in the order of keys; equal to :func:`lakekit.operators.search.search`."""
        types, api = intended_types(query), wants_api(query)
        listed, bounds = self.bounds(query_tokens(query), types, api)
        order = [F.col("score").desc(), F.col(self.key)]
        first = [r["block"] for r in bounds.orderBy(F.col("bound").desc(), "block").limit(FIRST_BLOCKS).collect()]
        chosen = self.spark.createDataFrame([(b,) for b in first], "block long")
        some = self._scored(chosen, listed, types, api).where("score > 0").orderBy(*order).limit(top_k).collect()
        last = some[-1]["score"] if len(some) == top_k else 0.0
        # A block of the same bound may hold a record of the same score and a smaller key.
        rest = bounds.where((F.col("bound") >= last) & ~F.col("block").isin(first) & (F.col("bound") > 0))
        schema = self.docs.select(self.key, "repo_name").schema.add("score", "double")
        others = self._scored(rest, listed, types, api).where("score > 0")
        return self.spark.createDataFrame(some, schema).unionByName(others).orderBy(*order).limit(top_k)

    def search_batch(self, queries: dict[int, str], top_k: int = 10) -> DataFrame:
        """Ranked search for many queries at once, from the postings of all their tokens."""
        spark, key = self.spark, self.key
        asked = spark.createDataFrame([(i, t) for i, q in queries.items() for t in query_tokens(q)], "query_id long, token string")
        kinds = {q: (tuple(intended_types(q)), wants_api(q)) for q in queries.values()}
        numbers = {k: n for n, k in enumerate(sorted(set(kinds.values())))}
        plans = spark.createDataFrame([(i, numbers[kinds[q]]) for i, q in queries.items()], "query_id long, kind int")
        tokens = sorted({t for q in queries.values() for t in query_tokens(q)})
        per_kind = F.array(*(F.struct(F.lit(n).alias("kind"), _base(list(k[0]), k[1]).alias("base")) for k, n in numbers.items()))
        docs = self.docs.select(key, "repo_name", "quality", F.inline(per_kind))
        points = self._points(self._listed(tokens)) if tokens else spark.createDataFrame([], f"token string, `{key}` long, points double")
        hits = points.join(asked, "token").groupBy("query_id", key).agg(F.sum("points").alias("points")).join(plans, "query_id")
        scored = hits.join(docs, ["kind", key]).select("query_id", key, "repo_name", (F.col("points") + F.col("base") + F.col("quality")).alias("score"))
        # Records without any token rank by what a query asks for besides words, of which there are few kinds.
        plain = first_per_key(docs.withColumn("score", F.col("base") + F.col("quality")), ["kind"], [F.col("score").desc(), F.col(key)], top_k)
        plain = plain.join(plans, "kind").select("query_id", key, "repo_name", "score")
        every = scored.unionByName(plain).groupBy("query_id", key, "repo_name").agg(F.max("score").alias("score"))
        return first_per_key(every.where("score > 0"), ["query_id"], [F.col("score").desc(), F.col(key)], top_k)


def _trigrams(text: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substr(text, i, F.lit(3))))


#: Bytes of text whose trigrams are sorted at once, whatever the size of an Arrow batch or of a text.
_TEXT_BYTES = 1 << 20
#: Pairs of a trigram and a record that are gathered before they are listed.
_PAIRS = 2 << 20


def _pairs(data: np.ndarray, ends: np.ndarray, first: int) -> np.ndarray:
    """Distinct ``trigram << 32 | row`` of texts that lie one behind the other; their rows count from ``first``."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(first, first + len(ends) - 1), np.diff(ends))
    code = data[:-2].astype(np.int64) << 48 | data[1:-1].astype(np.int64) << 40 | data[2:].astype(np.int64) << 32 | row[:-2]
    return np.unique(code[row[:-2] == row[2:]])


def _byte_trigrams(batches: Iterator[pa.RecordBatch], key: str, width: int) -> Iterator[pa.RecordBatch]:
    """(gram, block, offsets) of texts: which records of a block of keys hold three bytes in a row."""

    def lists(held: list[np.ndarray], owners: list[np.ndarray]) -> pa.RecordBatch:
        keys, rank = np.unique(np.concatenate(owners), return_inverse=True)
        code = np.concatenate(held)
        code = np.unique(code >> 32 << 32 | rank[code & 0xFFFFFFFF])
        gram, row = code >> 32, code & 0xFFFFFFFF
        block, offset = keys[row] // width, (keys[row] % width).astype("<u2")
        cut = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])])) if len(code) else np.zeros(0, np.int64)
        bounds = pa.array(np.append(cut, len(code)) * 2, pa.int32())
        offsets = pa.BinaryArray.from_buffers(pa.binary(), len(cut), [None, bounds.buffers()[1], pa.py_buffer(offset.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(gram[cut].astype(np.int32)), pa.array(block[cut]), offsets], ["gram", "block", "offsets"])

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, ends, keys) of few texts each; a longer text comes in pieces that share two bytes."""
        keys, text = batch.column(key).to_numpy(), batch.column("text").cast(pa.large_binary())
        if not len(text):
            return
        ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(keys):
            to = int(np.searchsorted(ends, ends[at] + _TEXT_BYTES, "right")) - 1
            if to > at:
                yield data[ends[at] : ends[to]], ends[at : to + 1], keys[at:to]
            else:
                to = at + 1
                for begin in range(ends[at], ends[to], _TEXT_BYTES):
                    piece = data[begin : min(begin + _TEXT_BYTES + 2, ends[to])]
                    yield piece, np.array([0, len(piece)]), keys[at:to]
            at = to

    held, owners, taken, rows = [], [], 0, 0
    for batch in batches:
        for data, ends, keys in pieces(batch):
            held.append(_pairs(data, ends, rows))
            owners.append(keys)
            taken, rows = taken + len(held[-1]), rows + len(keys)
            if taken >= _PAIRS:
                yield lists(held, owners)
                held, owners, taken, rows = [], [], 0, 0
    if held:
        yield lists(held, owners)


def _intersect(key: str, width: int):
    def run(listed: pa.Table) -> pa.Table:
        """The records of a block that hold every trigram asked for."""
        wanted, found = listed.column("n")[0].as_py(), {}
        for gram, offsets in zip(listed.column("gram").to_pylist(), listed.column("offsets").to_pylist(), strict=True):
            found.setdefault(gram, []).append(np.frombuffer(offsets, "<u2"))
        if len(found) < wanted:
            return pa.table({key: pa.array([], pa.int64())})
        lists = sorted((np.unique(np.concatenate(v)) for v in found.values()), key=len)
        common = lists[0]
        for other in lists[1:]:
            common = np.intersect1d(common, other, assume_unique=True)
        return pa.table({key: pa.array(listed.column("block")[0].as_py() * width + common.astype(np.int64))})

    return run


class TextIndex:
    """Substring search over the records stored, and indexed by byte trigrams, at ``path``."""

    #: Keys of a block; an offset in a block takes two bytes.
    WIDTH = 4096

    def __init__(self, spark: SparkSession, path: str, key: str = "seq"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.records = spark.read.parquet(f"{self.path}/records")
        self.grams = spark.read.schema("gram int, block long, offsets binary, part int").parquet(f"{self.path}/grams")

    @classmethod
    def build(cls, repos: DataFrame, path: str, key: str = "seq") -> TextIndex:
        """Store the records by key in small row groups, and the trigrams of all that a search looks into."""
        spark, path = repos.sparkSession, path.rstrip("/")
        repos.sortWithinPartitions(key).write.mode("overwrite").option("parquet.block.size", 1 << 20).parquet(f"{path}/records")
        kept = spark.read.parquet(f"{path}/records")
        text = F.concat_ws("\0", record_text(kept), F.lower(sidebar_text()))
        width = cls.WIDTH
        listed = kept.select(F.col(key).cast("long").alias("key"), text.alias("text")).mapInArrow(
            lambda it: _byte_trigrams(it, "key", width), "gram int, block long, offsets binary"
        )
        # As many tasks as the lists need; one folder may take several.
        parts = listed.withColumn("part", F.col("gram") % PARTS).hint("rebalance", "part").sortWithinPartitions("part", "gram", "block")
        parts.write.mode("overwrite").partitionBy("part").parquet(f"{path}/grams")
        return cls(spark, path, key)

    def candidates(self, wanted: str) -> DataFrame | None:
        """Keys of the records that hold all trigrams of ``wanted``; None when it is too short to have any."""
        data = wanted.encode()
        grams = sorted({int.from_bytes(data[i : i + 3], "big") for i in range(len(data) - 2)})
        if not grams:
            return None
        listed = self.grams.where(F.col("part").isin(sorted({g % PARTS for g in grams})) & F.col("gram").isin(grams))
        asked = listed.select("gram", "block", "offsets", F.lit(len(grams)).alias("n"))
        return asked.groupBy("block").applyInArrow(_intersect(self.key, self.WIDTH), f"`{self.key}` long")

    def _read(self, wanted: str) -> DataFrame:
        """The records to look into: only the candidates where there are any trigrams."""
        keys = self.candidates(wanted)
        if keys is None:
            return self.records
        few = [r[0] for r in keys.limit(LOOKED_UP + 1).collect()]
        if len(few) <= LOOKED_UP:
            # A list of keys reaches the statistics of the row groups.
            return self.records.where(F.col(self.key).isin(few))
        return self.records.join(keys, self.key, "left_semi")

    def search_substring(self, query: str) -> DataFrame:
        """Records whose JSON text contains the query, best quality first; a blank query finds nothing."""
        wanted = query.lower().strip()
        if not wanted:
            return self.records.limit(0)
        found = self._read(wanted)
        return found.where(record_text(found).contains(wanted)).orderBy(F.col("quality_score").desc_nulls_last(), "repo_name")

    def search_sidebar(self, query: str) -> DataFrame:
        """Records with the query in name, description, tags or data types; a blank query keeps all."""
        wanted = query.lower().strip()
        if not wanted:
            return self.records
        return self._read(wanted).where(F.lower(sidebar_text()).contains(wanted))

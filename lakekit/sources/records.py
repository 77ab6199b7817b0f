"""CSV records out of file splits that may begin anywhere, also inside quotes.

A line break inside quotes is no end of a record, and whether a split begins inside quotes depends on all the text before
it. So files are read in three steps, each over all splits at once:

1. Every split is walked for both answers: inside or outside at its start. What is left is a row per split: how it
   ends in either case, and which of its first and last lines belong to records that it shares with its neighbours.
2. A prefix scan over these rows, file by file, gives the state at the start of every split. A split that ends alike in
   both cases settles it; others keep the state or flip it, so windows over sums of flips do it.
3. Every split is cut into records from its true state. The few lines at borders are put together by a group for each
   record that spans splits.

A quote opens only at the start of a cell and is doubled inside quotes; any other quote stands for itself. Lines end with
``\\n``, or ``\\r\\n``; a record keeps the breaks inside its quotes as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakekit.session import scratch_path

#: Up to so many splits, a row of some 50 bytes each, their states are broadcast; beyond that they are joined by a shuffle.
BROADCAST_SPLITS = 500_000
#: Bytes of text that Python takes out of an Arrow batch at once.
PIECE = 1 << 20

_SUMMARY = (
    "file long, start long, first_id long, n long, full long, end_out boolean, tail_out long, end_in boolean, head_in long, tail_in long"
)
_BLANK = r"\A[\x00-\x20]*\z"
_RECORD = "file long, start long, at long, header boolean, record string"


_QUOTED = r'[^"]*+(?:""[^"]*+)*+'


def opens_quotes(delimiter: str, end: str = r"\Z") -> str:
    """An expression for a line that begins outside quotes and leaves them open; ``end`` stands for the end of the text."""
    d = re.escape(delimiter)
    return rf'(?:(?:"{_QUOTED}"[^{d}]*+|[^"{d}][^{d}]*+)?+{d})*+"{_QUOTED}{end}'


def quote_steps(delimiter: str) -> tuple[re.Pattern, re.Pattern]:
    """Expressions that match a line after which quotes are open, for lines that begin outside and inside quotes."""
    d, opens = re.escape(delimiter), opens_quotes(delimiter)
    return re.compile(opens), re.compile(rf'{_QUOTED}(?:\Z|"[^{d}]*+{d}{opens})')


def breaks_inside_quotes(line: Column, delimiter: str) -> Column:
    """Whether a line that begins outside quotes leaves them open, as only records with line breaks do."""
    return line.contains('"') & line.rlike(r"\A" + opens_quotes(delimiter, r"\z"))


def lines_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with the hash of their file's path, the start of their split and an id that rises within a split."""
    start, mark = F.col("_metadata.file_block_start"), "\ufeff"
    text = F.make_valid_utf8("value")
    return (
        spark.read.option("lineSep", "\n")
        .text(paths)
        .select(
            F.when((start == 0) & text.startswith(mark), F.substr(text, F.lit(2))).otherwise(text).alias("value"),
            F.xxhash64("_metadata.file_path").alias("file"),
            start.alias("start"),
            F.monotonically_increasing_id().alias("id"),
        )
    )


def file_names(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file``, the hash that stands for a path, and ``path`` as a listing names it."""
    names = spark.read.text(paths).inputFiles()
    named = spark.createDataFrame([(re.sub("^file:/+", "file:/", n),) for n in names], "uri string")
    return named.select(F.xxhash64("uri").alias("file"), plain_path(F.col("uri")).alias("path"))


def plain_path(path: Column) -> Column:
    """A path from file metadata as a listing names it; a plus sign stands for itself there."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")


def _steps(values: pa.Array, steps: tuple[re.Pattern, re.Pattern]) -> Iterator[tuple[int, tuple[bool, bool]]]:
    """(line, whether quotes are open after it when it begins outside, inside) for lines with quotes; others change nothing."""
    at = np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))
    for i, line in zip(at.tolist(), values.take(pa.array(at)).to_pylist(), strict=True):
        yield i, (steps[0].match(line) is not None, steps[1].match(line) is not None)


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Stretches of rows with few bytes of text, whatever Spark puts into a batch; a longer text is a stretch of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")), at + 1)
            yield batch.slice(at, to - at)
            at = to


def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """(file, start, first row, row after the last) of each stretch of rows of one split."""
    file, start = batch.column("file").to_numpy(), batch.column("start").to_numpy()
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    ends = [*cuts.tolist(), len(file)]
    for a, b in zip([0, *cuts.tolist()], ends, strict=True):
        if b > a:
            yield int(file[a]), int(start[a]), a, b


class _Walk:
    """A split walked for both states at its start."""

    def __init__(self, file: int, start: int, first_id: int):
        self.key, self.first_id, self.n, self.full = (file, start), first_id, 0, None
        self.inside, self.tail, self.head = [False, True], [None, None], None

    def step(self, at: int, leaves: tuple[bool, bool]) -> None:
        for case in (0, 1):
            before, after = self.inside[case], leaves[self.inside[case]]
            if after and not before:
                self.tail[case] = at
            elif before and not after:
                if case and self.head is None:
                    self.head = at + 1
                self.tail[case] = None
            self.inside[case] = after

    def row(self) -> tuple:
        tails = [self.n if t is None else t for t in self.tail]
        head, full = (self.n if x is None else x for x in (self.head, self.full))
        return (*self.key, self.first_id, self.n, full, self.inside[0], tails[0], self.inside[1], head, tails[1])


def _summary(batches: Iterator[pa.RecordBatch], delimiter: str) -> Iterator[pa.RecordBatch]:
    """A row for each split; rows of a split come one after the other."""
    steps, walk, names = quote_steps(delimiter), None, [f.split()[0] for f in _SUMMARY.split(", ")]

    def rows(done: list[_Walk]) -> pa.RecordBatch:
        kinds = [pa.bool_() if "boolean" in f else pa.int64() for f in _SUMMARY.split(", ")]
        columns = zip(*(w.row() for w in done), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in pieces(batches, "value"):
        done, ids = [], batch.column("id")
        for file, start, a, b in runs(batch):
            if walk is None or walk.key != (file, start):
                done += [walk] if walk else []
                walk = _Walk(file, start, ids[a].as_py())
            values = batch.column("value").slice(a, b - a)
            if walk.full is None:
                text = np.flatnonzero(pc.match_substring_regex(values, r"[^\x00-\x20]").to_numpy(zero_copy_only=False))
                walk.full = walk.n + int(text[0]) if len(text) else None
            for i, leaves in _steps(values, steps):
                walk.step(walk.n + i, leaves)
            walk.n += b - a
        if done:
            yield rows(done)
    if walk:
        yield rows([walk])


def split_states(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """The prefix scan: for each split whether it begins and ends inside quotes, its shared first and last lines, and where
    the record that reaches into it began."""
    summary = lines.select("value", "file", "start", "id").mapInArrow(lambda it: _summary(it, delimiter), _SUMMARY)
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    settles = F.col("end_out") == F.col("end_in")
    flips = (F.col("end_out") & ~F.col("end_in")).cast("int")
    counted = summary.withColumn("flips", F.sum(flips).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.coalesce(F.lag("flips").over(order), F.lit(0)) - F.coalesce(
        F.last(F.when(settles, F.col("flips")), ignorenulls=True).over(before), F.lit(0)
    )
    settled = F.coalesce(F.last(F.when(settles, F.col("end_out")), ignorenulls=True).over(before), F.lit(False))
    known = counted.withColumn("inside", settled != (since % 2 == 1)).select(
        "file",
        "start",
        "first_id",
        "n",
        "inside",
        F.when(F.col("inside"), F.col("end_in")).otherwise(F.col("end_out")).alias("open"),
        F.when(F.col("inside"), F.col("head_in")).otherwise(F.lit(0)).alias("head"),
        F.when(F.col("inside"), F.col("tail_in")).otherwise(F.col("tail_out")).alias("tail"),
        F.when(F.col("full") < F.col("n"), F.struct("start", "full")).alias("text"),
    )
    opener = F.when(F.col("tail") < F.col("n"), F.struct("start", "tail"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return known.select(
        *known.columns[:-1],
        F.last(opener, ignorenulls=True).over(before).alias("opener"),
        F.first("text", ignorenulls=True).over(whole).alias("header"),
        F.last("open").over(whole).alias("unclosed"),
    )


def _cut(batches: Iterator[pa.RecordBatch], delimiter: str) -> Iterator[pa.RecordBatch]:
    """The records that lie within one split: those between its shared first and last lines."""
    steps, key, at, inside, held, held_at = quote_steps(delimiter), None, 0, False, [], 0
    for batch in pieces(batches, "value"):
        out = []
        for file, start, a, b in runs(batch):
            head, tail = batch.column("head")[a].as_py(), batch.column("tail")[a].as_py()
            if head is None:
                raise ValueError("the files were split otherwise than before; read them again")
            if key != (file, start):
                key, at, inside, held = (file, start), 0, False, []
            low, high, skipped, at = max(at, head), min(at + b - a, tail), at, at + b - a
            if high <= low:
                continue
            values = batch.column("value").slice(a + low - skipped, high - low)
            # Whether quotes are open before each line, and after the last.
            inner, done = np.empty(len(values) + 1, dtype=bool), 0
            for i, leaves in _steps(values, steps):
                inner[done : i + 1] = inside
                inside, done = leaves[inside], i + 1
            inner[done:] = inside
            if held:
                # The record that the batch before left open.
                ends = np.flatnonzero(~inner[1:])
                n = int(ends[0]) + 1 if len(ends) else len(values)
                held += values[:n].to_pylist()
                if not len(ends):
                    continue
                out.append((file, start, np.array([held_at]), pa.array(["\n".join(held)])))
                values, inner, low, held = values[n:], inner[n:], low + n, []
            begins = np.flatnonzero(~inner[:-1])
            if inside and len(begins):
                last = int(begins[-1])
                held, held_at = values[last:].to_pylist(), low + last
                values, begins = values[:last], begins[:-1]
            if len(begins) == len(values):
                records = values
            else:
                ends = pa.array(np.append(begins, len(values)), pa.int32())
                records = pc.binary_join(pa.ListArray.from_arrays(ends, values), "\n")
            out.append((file, start, low + begins, records))
        if out:
            sizes = [len(o[2]) for o in out]
            columns = [pa.array(np.repeat([o[c] for o in out], sizes), pa.int64()) for c in (0, 1)]
            columns += [pa.array(np.concatenate([o[2] for o in out]), pa.int64()), pa.concat_arrays([o[3].cast(pa.string()) for o in out])]
            yield pa.RecordBatch.from_arrays(columns, ["file", "start", "at", "record"])


def quoted_records(spark: SparkSession, paths: str | list[str], delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """The records of CSV files whose quotes may hold line breaks, and a row for each file.

    Records have ``file``, the hash of their file's path, ``place``, which rises within a file, ``header``, true for the first
    record with text, and ``record``. Files have ``file`` and ``unclosed``, true when a quote is never closed.
    """
    lines = lines_of(spark, paths)
    folder = scratch_path(spark, "splits")
    split_states(lines, delimiter).write.parquet(folder)
    states = spark.read.parquet(folder)
    few = states.count() <= BROADCAST_SPLITS
    joined = lines.join(F.broadcast(states) if few else states.hint("merge"), ["file", "start"], "left")
    if not few:
        joined = joined.sortWithinPartitions("file", "start", "id")

    # Lines of records that span splits: few, whatever the size of the files.
    number = F.col("id") - F.col("first_id")
    shared = joined.withColumn("at", number).where("at < head OR at >= tail")
    begun = F.when(F.col("at") >= F.col("tail"), F.struct("start", "tail")).otherwise(F.col("opener"))
    pieces = shared.groupBy("file", begun.alias("begun")).agg(
        F.array_sort(F.collect_list(F.struct("start", "at", "value"))).alias("lines"), F.first("header").alias("header")
    )
    spanning = scratch_path(spark, "spanning")
    pieces.select(
        "file",
        "begun.start",
        F.col("begun.tail").alias("at"),
        F.coalesce(F.expr("begun.start = header.start AND begun.tail = header.full"), F.lit(False)).alias("header"),
        F.array_join(F.col("lines.value"), "\n").alias("record"),
    ).write.parquet(spanning)

    cut = joined.select("value", "file", "start", "head", "tail").mapInArrow(
        lambda it: _cut(it, delimiter), "file long, start long, at long, record string"
    )
    headers = states.where("header.start = start").select("file", "start", F.col("header.full").alias("at"), F.lit(True).alias("header"))
    names = F.broadcast(headers) if few else headers
    inner = cut.join(names, ["file", "start", "at"], "left").withColumn("header", F.coalesce("header", F.lit(False)))
    every = inner.select("file", "start", "at", "header", "record").unionByName(spark.read.schema(_RECORD).parquet(spanning))
    # A line has at least its break, so a later split's places are larger.
    plain = F.when(F.col("record").endswith("\r"), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    records = every.select("file", (F.col("start") + F.col("at")).alias("place"), "header", plain.alias("record"))
    return records, states.groupBy("file").agg(F.bool_or("unclosed").alias("unclosed"))


def is_blank_record(record: Column) -> Column:
    return record.rlike(_BLANK)

"""Forms, columns and types of many CSV and JSON files at once, by a few jobs whatever the number of files.

One scan finds each file's delimiter, header, quoted line breaks and form of JSON. One aggregate over the cells of all CSV
files, keyed by file and position, finds the narrowest type of every column and counts the records of a wrong length. One
aggregate over all JSON values merges their schemas file by file.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekit.sources.csv import DELIMITERS, column_names, csv_tables, likely_delimiter, read_csv, split_record
from lakekit.sources.records import BROADCAST_SPLITS, breaks_inside_quotes, file_names, is_blank_record, lines_of, pieces, quoted_records, runs
from lakekit.sources.tables import json_lines

log = logging.getLogger(__name__)

#: Documents of more characters are too large for one value and are inferred one by one.
LARGE_DOCUMENT = 32 << 20
_CELLS_AT_ONCE = 200_000
#: Types from the narrowest on, and what two of them become together.
_WIDER = {("int", "bigint"): "bigint", ("int", "double"): "double", ("bigint", "double"): "double", ("date", "timestamp"): "timestamp"}


@dataclass(frozen=True)
class FileForm:
    """How to read a file. ``whole``: quotes of a CSV hold line breaks, or a JSON file is not one object a line."""

    kind: str
    delimiter: str = ""
    whole: bool = False
    schema: T.StructType | None = None
    error: str | None = None

    def with_kinds(self, kinds: dict[int, str]) -> FileForm:
        """With the types of the columns; one without any cell has none yet."""
        fields = [T.StructField(f.name, _kind(kinds.get(i, "void"))) for i, f in enumerate(self.schema)]
        return replace(self, schema=T.StructType(fields))


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first two lines with text of every split."""
    found: dict[tuple[int, int], list[str]] = {}
    for batch in batches:
        for file, start, a, b in runs(batch):
            have = found.setdefault((file, start), [])
            if len(have) < 2:
                values = batch.column("value").slice(a, b - a)
                full = np.flatnonzero(pc.match_substring_regex(values, r"[^\x00-\x20]").to_numpy(zero_copy_only=False))
                have += [values[int(i)].as_py().removesuffix("\r") for i in full[: 2 - len(have)]]
    rows = [(*k, *v, None)[:4] for k, v in found.items() if v]
    columns = zip(*rows, strict=True) if rows else ([],) * 4
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "start", "one", "two"])


def file_facts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Per text file: first two lines with text, and whether quotes hold line breaks, for each likely delimiter."""
    lines = lines_of(spark, paths)
    heads = lines.select("file", "start", "value").mapInArrow(_heads, "file long, start long, one string, two string")
    order = Window.partitionBy("file").orderBy("start")
    heads = heads.select("file", F.col("one").alias("head"), F.coalesce("two", F.lead("one").over(order)).alias("second"), F.row_number().over(order).alias("n"))
    line = F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    breaks = [F.bool_or(breaks_inside_quotes(line, d)).alias(f"breaks{i}") for i, d in enumerate(DELIMITERS)]
    broken = lines.where(F.col("value").contains('"')).groupBy("file").agg(*breaks)
    flags = F.array(*[F.coalesce(f"breaks{i}", F.lit(False)) for i in range(len(DELIMITERS))])
    facts = file_names(spark, paths).join(heads.where("n = 1"), "file", "left").join(broken, "file", "left")
    return facts.select("path", "head", "second", flags.alias("breaks"))


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, lead, position, cell) of records; position -1 stands for a record of a wrong length.

    ``lead`` is the split's start for its first record with text, one of which is the file's header.
    """

    def flat(file: list, lead: list, width: list, cells: list) -> pa.RecordBatch:
        n = np.array([max(w, 1) for w in width], dtype=np.int64)
        position = np.concatenate([np.zeros(0, np.int64), *(np.arange(w) if w else np.array([-1]) for w in width)])
        columns = [
            pa.array(np.repeat(np.array(file, np.int64), n)),
            pa.array(lead, pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n))),
            pa.array(position.astype(np.int32)),
            pa.array(cells, pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["file", "lead", "position", "cell"])

    key, led = None, False
    for batch in pieces(batches, "record"):
        files, starts, records, delimiters, widths = (batch.column(c).to_pylist() for c in ("file", "start", "record", "delimiter", "width"))
        blank = pc.match_substring_regex(batch.column("record"), r"\A[\x00-\x20]*\z").to_pylist()
        out: tuple[list, ...] = ([], [], [], [])
        for i, record in enumerate(records):
            if (files[i], starts[i]) != key:
                key, led = (files[i], starts[i]), starts[i] < 0
            if blank[i]:
                continue
            cells = split_record(record.removesuffix("\r"), delimiters[i])
            right = len(cells) == widths[i]
            for column, value in zip(out, (files[i], None if led else starts[i], len(cells) if right else 0), strict=False):
                column.append(value)
            out[3].extend(cells if right else [None])
            led = True
            if len(out[3]) >= _CELLS_AT_ONCE:
                yield flat(*out)
                out = ([], [], [], [])
        if out[0]:
            yield flat(*out)


def _fits(cell: Column) -> dict[str, Column]:
    """Whether a cell is of each type, the narrowest first."""
    number = cell.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    whole = cell.rlike(r"^[+-]?\d+$")
    return {
        "int": whole & cell.try_cast("int").isNotNull(),
        "bigint": whole & cell.try_cast("bigint").isNotNull(),
        "double": number,
        "date": cell.rlike(r"^\d{4}-\d{2}-\d{2}$") & cell.try_cast("date").isNotNull(),
        "timestamp": cell.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}") & cell.try_cast("timestamp").isNotNull(),
        "boolean": F.lower(cell).isin("true", "false"),
    }


def _csv_kinds(spark: SparkSession, forms: dict[str, FileForm]) -> dict[str, FileForm]:
    """CSV files with the types of their columns, or the error that some of their records are damaged."""
    paths, out = list(forms), dict(forms)
    known = spark.createDataFrame([(p, f.delimiter, len(f.schema)) for p, f in forms.items()], "path string, delimiter string, width int")
    named = file_names(spark, paths)
    forms_by_file = named.join(known, "path").drop("path")
    if len(paths) <= BROADCAST_SPLITS:
        forms_by_file = F.broadcast(forms_by_file)
    frames, unclosed = [], []
    plain = [p for p in paths if not forms[p].whole]
    if plain:
        frames.append(lines_of(spark, plain).select("file", "start", F.col("value").alias("record")))
    for delimiter in DELIMITERS:
        own = [p for p in paths if forms[p].whole and forms[p].delimiter == delimiter]
        if own:
            records, files = quoted_records(spark, own, delimiter)
            frames.append(records.where("NOT header").select("file", F.lit(-1).cast("long").alias("start"), "record"))
            unclosed.append(files.where("unclosed").select("file"))
    every = frames[0]
    for frame in frames[1:]:
        every = every.unionByName(frame)
    cells = every.join(forms_by_file, "file").select("file", "start", "record", "delimiter", "width").mapInArrow(
        _cell_rows, "file long, lead long, position int, cell string"
    )
    fits = _fits(F.col("cell"))
    facts = cells.groupBy("file", "position", "lead").agg(
        F.count("*").alias("n"), F.count("cell").alias("full"), *(F.bool_and(v).alias(k) for k, v in fits.items())
    )
    header = F.min("lead").over(Window.partitionBy("file"))
    facts = facts.withColumn("header", header).where("lead IS NULL OR lead != header").groupBy("file", "position")
    merged = facts.agg(F.sum("n").alias("n"), F.sum("full").alias("full"), *(F.bool_and(k).alias(k) for k in fits))
    kind = F.coalesce(F.when(F.col("full") == 0, F.lit("void")), *(F.when(F.col(k), F.lit(k)) for k in fits), F.lit("string"))
    kinds: dict[str, dict[int, str]] = {}
    for r in merged.join(named, "file").select("path", "position", "n", kind.alias("kind")).collect():
        if r["position"] < 0:
            out[r["path"]] = replace(forms[r["path"]], error=f"{r['n']} damaged records")
        else:
            kinds.setdefault(r["path"], {})[r["position"]] = r["kind"]
    for files in unclosed:
        for r in files.join(named, "file").select("path").collect():
            out[r["path"]] = replace(forms[r["path"]], error="a quote is never closed")
    return {p: f if f.error else f.with_kinds(kinds.get(p, {})) for p, f in out.items()}


def variant_type(text: str) -> T.DataType:
    """The type of JSON values whose merged schema is ``text``; what has no one type is read as text."""
    parts = re.split(r"(`(?:[^`]|``)*`)", text)
    for i in range(0, len(parts), 2):
        part = re.sub(r"\bOBJECT<", "struct<", parts[i])
        part = re.sub(r"\b(VOID|VARIANT)\b(?!:)", "string", part)
        parts[i] = re.sub(r"DECIMAL\((\d+),(\d+)\)", lambda m: "double" if m[2] != "0" else m[0], part)
    return T._parse_datatype_string("".join(parts).replace("ARRAY<", "array<"))


def _json_kinds(spark: SparkSession, forms: dict[str, FileForm]) -> dict[str, FileForm]:
    """JSON files with their columns, or the error that they are damaged."""
    out = dict(forms)
    # In an array of its own, a value with anything after it is seen to be none.
    alone = F.try_parse_json(F.concat(F.lit("["), F.col("value"), F.lit("]")))
    value = F.when(F.try_variant_get(alone, "$[1]", "variant").isNull(), F.try_variant_get(alone, "$[0]", "variant"))
    for whole in (False, True):
        paths = [p for p in forms if forms[p].whole == whole]
        if not paths:
            continue
        if whole:
            texts = spark.read.text(paths, wholetext=True).select(
                F.xxhash64("_metadata.file_path").alias("file"), F.regexp_replace("value", r"^\x{FEFF}", "").alias("value")
            )
        else:
            texts = lines_of(spark, paths).select("file", "value").where(~is_blank_record(F.col("value")))
        large = F.length("value") > LARGE_DOCUMENT
        start = ("{", "[") if whole else ("{",)
        marked = texts.select("file", large.alias("large"), F.left(F.ltrim("value"), F.lit(1)).isin(*start).alias("starts"), F.when(~large, value).alias("v"))
        bad = ~F.col("large") & (F.col("v").isNull() | ~F.col("starts"))
        merged = marked.groupBy("file").agg(
            F.schema_of_variant_agg("v").alias("kind"), F.count_if(bad).alias("bad"), F.bool_or("large").alias("large")
        )
        for r in merged.join(file_names(spark, paths), "file").collect():
            path, form = r["path"], forms[r["path"]]
            kind = r["kind"] or ""
            inner = kind[6:-1] if kind.startswith("ARRAY<") else kind
            if r["bad"]:
                out[path] = replace(form, error="damaged JSON")
            elif r["large"]:
                found = spark.read.option("multiLine", whole).json(path).schema
                damaged = "_corrupt_record" in found.names or not found.names
                out[path] = replace(form, error="damaged JSON") if damaged else replace(form, schema=found)
            elif not inner.startswith("OBJECT<") or inner == "OBJECT<>":
                out[path] = replace(form, error="no JSON objects")
            else:
                out[path] = replace(form, schema=variant_type(inner))
    return out


def inspect_files(spark: SparkSession, paths: list[str], types: bool = True) -> dict[str, FileForm]:
    """How to read each file, with its columns and their types; CSV columns are text when no ``types`` are asked for."""
    if not paths:
        return {}
    csv: dict[str, FileForm] = {}
    json: dict[str, FileForm] = {}
    out: dict[str, FileForm] = {p: FileForm(".json" if p.lower().endswith(".json") else ".csv", error="empty") for p in paths}
    facts = file_facts(spark, paths).withColumn("delimiter", likely_delimiter(F.col("head")))
    for r in facts.collect():
        path = r["path"]
        if path not in out:
            raise ValueError(f"{path} is none of the files asked for")
        if r["head"] is None:
            out[path] = replace(out[path], error="no readable records")
        elif path.lower().endswith(".json"):
            json[path] = FileForm(".json", "", not json_lines(r["head"], r["second"]))
        else:
            whole = bool(r["breaks"][DELIMITERS.index(r["delimiter"])])
            names = column_names(split_record(r["head"], r["delimiter"]))
            csv[path] = FileForm(".csv", r["delimiter"], whole, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    out |= _with_whole_headers(spark, csv)
    checked = {p: out[p] for p in csv}
    if checked:
        found = _csv_kinds(spark, checked)
        out |= found if types else {p: replace(checked[p], error=f.error) for p, f in found.items()}
    return out | _json_kinds(spark, json)


def _with_whole_headers(spark: SparkSession, forms: dict[str, FileForm]) -> dict[str, FileForm]:
    """Names out of whole header records, where a header itself may hold a line break."""
    out = dict(forms)
    for delimiter in DELIMITERS:
        own = [p for p in forms if forms[p].whole and forms[p].delimiter == delimiter]
        if own:
            records, _ = quoted_records(spark, own, delimiter)
            for r in records.where("header").join(file_names(spark, own), "file").select("path", "record").collect():
                names = column_names(split_record(r["record"], delimiter))
                out[r["path"]] = replace(forms[r["path"]], schema=T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return out


def _kind(name: str) -> T.DataType:
    return T.NullType() if name == "void" else T._parse_datatype_string(name)


def merged_schema(schemas: list[T.StructType]) -> T.StructType | None:
    """One schema for files of one table: columns of equal names, each of a type that holds all; None if names differ.

    A column without any cell is text.
    """
    first = schemas[0]
    if any(s.names != first.names for s in schemas):
        return None
    fields = []
    for at, field in enumerate(first):
        kinds = sorted({s[at].dataType.simpleString() for s in schemas} - {"void"}) or ["string"]
        kind = kinds[0]
        for other in kinds[1:]:
            kind = _WIDER.get((kind, other)) or _WIDER.get((other, kind)) or "string"
        fields.append(T.StructField(field.name, _kind(kind)))
    return T.StructType(fields)


def read_csv_directory(
    spark: SparkSession, directory: str, recursive: bool = True, as_text: bool = False, pattern: str = "*.csv"
) -> dict[str, DataFrame]:
    """One table per CSV file, or folder of part files, below ``directory``; one that is damaged is logged and left out.

    Forms and types of all tables are found together. Only a table whose quotes hold line breaks needs jobs of its own.
    """
    tables = csv_tables(spark, directory, recursive, pattern)
    if not tables:
        return {}
    paths = list(tables.values())
    owner = {path: name for name, path in tables.items()}
    files: dict[str, list[str]] = {}
    for row in file_names(spark, paths).toLocalIterator():
        own = row["path"] if row["path"] in owner else row["path"].rsplit("/", 1)[0]
        while own not in owner and "/" in own:
            own = own.rsplit("/", 1)[0]
        files.setdefault(owner[own], []).append(row["path"])
    forms = inspect_files(spark, [p for own in files.values() for p in own], types=not as_text)
    loaded = {}
    for name, path in tables.items():
        own = [forms[p] for p in files.get(name, [])]
        own = [f for f in own if f.error != "no readable records"] or own
        errors = [f.error for f in own if f.error] or ([] if own else ["no files"])
        schema = None if errors else merged_schema([f.schema for f in own])
        if schema is None or len({f.delimiter for f in own}) > 1:
            log.warning("left out %s: %s", path, errors[0] if errors else "its files have different columns")
            continue
        loaded[name] = read_csv(spark, path, schema, multi_line=any(f.whole for f in own), delimiter=own[0].delimiter)
    return loaded

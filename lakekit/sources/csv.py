"""CSV readers: typed tables, raw cells, and directories of files."""

from __future__ import annotations

import csv as csv_module
import fnmatch
import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekit.functions.text import table_name
from lakekit.sources.records import BROADCAST_SPLITS, breaks_inside_quotes, file_names, is_blank_record, quoted_records
from lakekit.storage import qualified

#: Bits of a row's number that are left for its place in its file.
FILE_BITS = 44
CORRUPT = "_corrupt_record"
CELLS = "_cells"  # cells found in the record, before padding or cutting
ROW = "_row"  # increases with file and line order within one read

_DIALECT = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
#: Delimiters that are looked for, the likeliest first.
DELIMITERS = [",", ";", "\t", "|"]


def likely_delimiter(header: Column) -> Column:
    """The delimiter that parts a header line into most names; a comma when none does."""
    bare = F.regexp_replace(header, '"[^"]*"', "")
    found = [F.struct(F.length(bare) - F.length(F.replace(bare, F.lit(d))), F.lit(-i), F.lit(d)) for i, d in enumerate(DELIMITERS)]
    return F.greatest(*found)["col3"]


def csv_delimiter(spark: SparkSession, path: str | list[str]) -> str:
    """The delimiter of a path's first line with text."""
    line = spark.read.text(path).where("trim(value) != ''").limit(1)
    found = line.select(likely_delimiter(F.col("value"))).first()
    return found[0] if found else ","


def csv_header(spark: SparkSession, path: str, delimiter: str = ",") -> list[str]:
    """Column names of a CSV path; reads the first lines only."""
    return spark.read.options(**_DIALECT, sep=delimiter).csv(path).columns


def has_quoted_breaks(spark: SparkSession, path: str | list[str], delimiter: str = ",") -> bool:
    """Whether quotes hold a line break anywhere; the scan ends at the first one."""
    lines = spark.read.text(path)
    return not lines.where(breaks_inside_quotes(F.col("value"), delimiter)).limit(1).isEmpty()


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    infer: bool = True,
    multi_line: bool | None = None,
    delimiter: str | None = None,
    damaged: str = "raise",
) -> DataFrame:
    """A typed CSV table.

    Types are inferred in one extra pass unless ``schema`` is given; ``infer=False`` keeps every cell as text.
    Files whose quotes hold line breaks are read in many tasks too, by :func:`quoted_records`. Whether there are any
    is found by a scan unless ``multi_line`` says so. Without ``delimiter`` it is taken from the first line.

    Records of a wrong length, or with a cell that does not fit its type, raise an error when they are read;
    ``damaged="drop"`` leaves them out and ``"keep"`` pads or cuts them.
    """
    if damaged not in _MODES:
        raise ValueError(f"damaged is one of {', '.join(_MODES)}")
    delimiter = delimiter or csv_delimiter(spark, path)
    if multi_line is None:
        multi_line = has_quoted_breaks(spark, path, delimiter)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if multi_line:
        return _read_quoted(spark, path, schema, infer, delimiter, damaged)
    # A pruned read would miss records of a wrong length.
    reader = spark.read.options(**_DIALECT, sep=delimiter, mode=_MODES[damaged], columnPruning=damaged == "keep")
    if schema is None:
        schema = spark.read.options(**_DIALECT, sep=delimiter).option("inferSchema", infer).csv(path).schema
    return reader.schema(schema).csv(path)


_MODES = {"raise": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}


def column_names(cells: list[str | None]) -> list[str]:
    """Names from a header's cells: an empty one is named by its place, and one that occurs again gets its place added."""
    folded = [(c or "").lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if folded.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def split_record(record: str, delimiter: str) -> list[str | None]:
    """The cells of one record; empty ones are null."""
    csv_module.field_size_limit(sys.maxsize)
    cells = next(csv_module.reader([record], delimiter=delimiter), []) if '"' in record else record.split(delimiter)
    return [c or None for c in cells]


def parse_records(record: Column, schema: T.StructType, delimiter: str = ",") -> Column:
    """A record's cells by ``schema``, which may name a column for damaged records."""
    options = {**_DIALECT, "sep": delimiter, "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    kinds = ", ".join(f"{_quoted_name(f.name)} {f.dataType.simpleString()}" for f in schema)
    return F.from_csv(record, kinds, {k: str(v) for k, v in options.items() if k != "header"})


def _read_quoted(
    spark: SparkSession, path: str | list[str], schema: T.StructType | None, infer: bool, delimiter: str, damaged: str
) -> DataFrame:
    records, files = quoted_records(spark, path, delimiter)
    if damaged != "keep" and files.where("unclosed").count():
        raise ValueError(f"a quote is never closed in {path}")
    infer = infer and schema is None
    if schema is None:
        header = records.where("header").orderBy("file").select("record").first()
        names = column_names(split_record(header[0], delimiter)) if header else []
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    passed = F.col("header") | is_blank_record(F.col("record"))
    if infer and len(schema):
        data = records.where(~passed)
        texts = getattr(data.select("record")._jdf, "as")(spark._jvm.Encoders.STRING())
        reader = spark.read.options(**{**_DIALECT, "header": False}, sep=delimiter, inferSchema=True)
        found = spark.createDataFrame([], schema) if data.isEmpty() else DataFrame(reader._jreader.csv(texts), spark)
        kinds = [f.dataType for f in found.schema][: len(schema)]
        kinds += [T.StringType()] * (len(schema) - len(kinds))
        schema = T.StructType([T.StructField(f.name, k) for f, k in zip(schema, kinds, strict=True)])
    kept = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)] + [T.StructField(CORRUPT, T.StringType())])
    parsed = records.select(passed.alias("passed"), parse_records(F.col("record"), kept, delimiter).alias("r")).select("passed", "r.*")
    bad = F.col(CORRUPT).isNotNull()
    good = ~F.col("passed")
    if damaged == "drop":
        good = good & ~bad
    elif damaged == "raise":
        # One condition: as two, Spark could ask the second of a header.
        said = F.concat(F.lit("damaged record: "), F.left(F.col(CORRUPT), F.lit(200)))
        good = F.when(F.col("passed"), False).when(bad, F.raise_error(said).cast("boolean")).otherwise(True)
    return parsed.where(good).select(*(F.col(f"c{i}").alias(f.name) for i, f in enumerate(schema)))


def damaged_records(
    spark: SparkSession, path: str | list[str], schema: T.StructType, multi_line: bool, delimiter: str, header: bool = True
) -> DataFrame:
    """The records, as text, that do not fit ``schema``."""
    kept = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)] + [T.StructField(CORRUPT, T.StringType())])
    if multi_line:
        records, _ = quoted_records(spark, path, delimiter)
        records = records.where(~(F.col("header") & F.lit(header)) & ~is_blank_record(F.col("record")))
        parsed = records.select(parse_records(F.col("record"), kept, delimiter).alias("r")).select("r.*")
    else:
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "columnPruning": False, "enforceSchema": True}
        parsed = spark.read.options(**{**_DIALECT, "header": header}, sep=delimiter, **options).schema(kept).csv(path)
    # The reader refuses queries on the corrupt column alone, so a data column is named too.
    bad = F.col(CORRUPT).isNotNull() & (F.coalesce(F.length(F.col("c0").cast("string")), F.lit(0)) >= 0)
    return parsed.where(bad).select(F.col(CORRUPT).alias("record"))


def read_raw_csv(spark: SparkSession, path: str, multi_line: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Every record as text cells, short, long and blank records included.

    The names come from the header line, or from ``columns`` for files without one.

    Short records are padded with null, long ones cut to the header; ``_cells``
    holds the number of cells found and ``_row`` the read order. Blank lines,
    which the CSV reader drops, come back as records without cells and follow
    the others in ``_row`` order. With ``multi_line`` quotes may hold line breaks.
    """
    headless = columns is not None
    if multi_line:
        return _raw_quoted(spark, path, columns)
    columns = columns or csv_header(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns + [CORRUPT]])
    records = (
        spark.read.options(
            **{**_DIALECT, "header": not headless},
            mode="PERMISSIVE",
            columnNameOfCorruptRecord=CORRUPT,
            columnPruning=False,  # a pruned read would miss records of a wrong length
        )
        .schema(schema)
        .csv(path)
    )
    # The reader refuses queries on the corrupt column alone, so the count names a data column too.
    zero = F.least(F.coalesce(F.length(_quoted(columns[0])), F.lit(0)), F.lit(0))
    records = records.select(
        *[_quoted(c) for c in columns], (_cell_count(len(columns)) + zero).alias(CELLS), F.monotonically_increasing_id().alias(ROW)
    )
    return records.unionByName(_blank_records(spark, path, columns))


def _cell_count(n: int) -> Column:
    """The number of cells of a record, from the text that the reader keeps of records of another length."""
    unquoted = F.regexp_replace(F.col(CORRUPT), '"[^"]*"', "")
    commas = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(",")))
    return F.when(F.col(CORRUPT).isNull(), F.lit(n)).otherwise(commas + 1)


def _raw_quoted(spark: SparkSession, path: str, columns: list[str] | None) -> DataFrame:
    """The raw records of files whose quotes may hold line breaks, in one pass over the records."""
    records, _ = quoted_records(spark, path)
    if columns is None:
        header = records.where("header").orderBy("file").select("record").first()
        columns = column_names(split_record(header[0], ",")) if header else []
        records = records.where(~F.col("header"))
    kept = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(columns))] + [T.StructField(CORRUPT, T.StringType())])
    # Files follow one another in the order of their names.
    order = file_names(spark, path).orderBy("path").select("file").collect()
    numbers = spark.createDataFrame([(r["file"], i << FILE_BITS) for i, r in enumerate(order)], "file long, base long")
    numbers = F.broadcast(numbers) if len(order) <= BROADCAST_SPLITS else numbers
    placed = records.join(numbers, "file").withColumn(ROW, F.col("base") + F.col("place"))
    blank = is_blank_record(F.col("record"))
    parsed = placed.withColumn("r", parse_records(F.col("record"), kept)).select("r.*", ROW, "record", blank.alias("blank"))
    first = F.when(F.col("record") != "", F.col("record"))

    def cell(i: int) -> Column:
        alone = first if i == 0 else F.lit(None).cast("string")
        return F.when(F.col("blank"), alone).otherwise(F.col(f"c{i}")).alias(columns[i])

    cells = F.when(~F.col("blank"), _cell_count(len(columns))).when(F.col("record") != "", 1).otherwise(0)
    row = F.when(F.col("blank"), F.lit(2**62) + F.col(ROW)).otherwise(F.col(ROW))
    return parsed.select(*(cell(i) for i in range(len(columns))), cells.alias(CELLS), row.alias(ROW))


def _quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def _quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _blank_records(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    lines = spark.read.text(path)
    blank = lines.filter(is_blank_record(F.col("value")))
    first = F.when(F.col("value") != "", F.col("value"))
    cells = F.when(F.col("value") != "", 1).otherwise(0)
    return blank.select(
        *[(first if i == 0 else F.lit(None).cast("string")).alias(c) for i, c in enumerate(columns)],
        cells.alias(CELLS),
        (F.lit(2**62) + F.monotonically_increasing_id()).alias(ROW),
    )


def csv_tables(spark: SparkSession, directory: str, recursive: bool = True, pattern: str = "*.csv") -> dict[str, str]:
    """Table name to path for every ``*.csv`` file, or folder of part files, below ``directory``.

    ``pattern`` is a glob over the names of those files or folders.

    Two paths with one stem would overwrite each other's table and raise.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select("path")
    inner = r"/(.+?\.csv)(/|$)" if recursive else r"/([^/]+\.csv)(/|$)"
    root = qualified(spark, directory)
    table = F.regexp_extract(F.substr("path", F.lit(len(root) + 1)), "^" + inner, 1)
    found = (
        files.select(F.concat(F.lit(root + "/"), table).alias("path"), table.alias("relative"))
        .filter(F.element_at(F.split("relative", "/"), -1).rlike(fnmatch.translate(pattern)) & (F.col("relative") != ""))
        .distinct()
        .orderBy("path")
    )
    tables: dict[str, str] = {}
    for row in found.toLocalIterator():
        name = table_name(row["relative"].split("/")[-1].rsplit(".", 1)[0])
        if name in tables:
            raise ValueError(f"{row['path']} and {tables[name]} would both be table {name!r}")
        tables[name] = row["path"]
    return tables


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

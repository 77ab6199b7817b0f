"""Registered tables: inventory, schema summary, and read-only SQL over them."""

from __future__ import annotations

import re
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekit.functions.text import table_name
from lakekit.operators.statements import is_read_only
from lakekit.sources import sinks
from lakekit.sources.csv import read_csv
from lakekit.sources.inspect import read_csv_directory
from lakekit.sources.tables import read_json, read_parquet

NO_TABLES = "No tables registered."
ENVELOPE_ROWS = 10_000


class Catalog:
    """Tables by name. Registering a name again replaces the table."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.stored: set[str] = set()

    def register(self, name: str, df: DataFrame, stored: bool = False) -> str:
        """Name a table; ``stored`` says that it is all rows of Parquet files, which can be counted by their footers."""
        name = table_name(name)
        df.createOrReplaceTempView(name)
        self.tables[name] = df
        (self.stored.add if stored else self.stored.discard)(name)
        return name

    def ingest_csv(self, name: str, path: str, **read) -> int:
        return self.spark.table(self.register(name, read_csv(self.spark, path, **read))).count()

    def ingest_parquet(self, name: str, path: str) -> int:
        return self.spark.table(self.register(name, read_parquet(self.spark, path), stored=True)).count()

    def ingest_json(self, name: str, path: str, **read) -> int:
        return self.spark.table(self.register(name, read_json(self.spark, path, **read))).count()

    def ingest_csv_directory(
        self, directory: str, recursive: bool = True, as_text: bool = False, pattern: str = "*.csv"
    ) -> int:
        """Register every CSV below ``directory`` under its stem; returns the number of tables."""
        tables = read_csv_directory(self.spark, directory, recursive, as_text, pattern)
        for name, df in tables.items():
            self.register(name, df)
        return len(tables)

    def export_parquet(self, name: str, path: str) -> None:
        sinks.export_parquet(self.tables[name], path)

    def export_csv(self, name: str, path: str) -> None:
        sinks.export_csv(self.tables[name], path)

    def list_tables(self) -> DataFrame:
        """Every table with its row count and columns ``(name, type)``; one job counts all.

        Tables out of Parquet files are counted by one scan of all their footers, whatever their number.
        """
        kinds = "array<struct<name:string,type:string>>"
        if not self.tables:
            return self.spark.createDataFrame([], f"table string, rows bigint, columns {kinds}")
        schemas = [(name, [(f.name, f.dataType.simpleString()) for f in df.schema]) for name, df in self.tables.items()]
        columns = self.spark.createDataFrame(schemas, f"table string, columns {kinds}")
        parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in self.tables.items() if name not in self.stored]
        if self.stored:
            parts.append(self._stored_rows())
        counts = parts[0]
        for part in parts[1:]:
            counts = counts.unionByName(part)
        return columns.join(counts, "table", "left").select("table", F.coalesce("rows", F.lit(0)).alias("rows"), "columns")

    def _stored_rows(self) -> DataFrame:
        """(table, rows) of the tables out of Parquet files, with no column read."""
        files = [(re.sub("^file:/+", "file:/", uri), name) for name in sorted(self.stored) for uri in self.tables[name].inputFiles()]
        owners = self.spark.createDataFrame(files, "file string, table string")
        if not files:
            return owners.select("table", F.lit(0).cast("bigint").alias("rows"))
        # A column that no file has: the reader takes the number of rows from the footers.
        rows = self.spark.read.schema("`\u0001` int").parquet(*sorted({unquote(uri) for uri, _ in files}))
        counted = rows.groupBy(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("file")).agg(F.count("*").alias("n"))
        return owners.join(counted, "file").groupBy("table").agg(F.sum("n").alias("rows"))

    def table_columns(self) -> DataFrame:
        """One row per table and column."""
        return self.list_tables().select("table", "rows", F.posexplode("columns").alias("position", "c")).select(
            "table", "rows", "position", F.col("c.name").alias("column"), F.col("c.type").alias("type")
        )

    def table_schema(self, name: str) -> list[dict] | None:
        """Columns of one table, or None when it is unknown."""
        df = self.tables.get(name)
        if df is None:
            return None
        return [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields]

    def schema_lines(self, canonical: bool = False) -> DataFrame:
        """One line per table: name, rows, columns and their types, as Spark names them or by canonical names."""
        types = {f.dataType.simpleString(): canonical_type(f.dataType) for df in self.tables.values() for f in df.schema}
        names = F.create_map(*(F.lit(x) for pair in sorted(types.items()) for x in pair)) if canonical and types else None
        kind = (lambda c: names[c["type"]]) if names is not None else (lambda c: c["type"])
        parts = F.transform("columns", lambda c: F.concat(c["name"], F.lit(" ("), kind(c), F.lit(")")))
        return self.list_tables().select(
            "table", F.format_string("Table '%s' (%d rows): %s", "table", "rows", F.array_join(parts, ", ")).alias("line")
        )

    def schema_context(self) -> str:
        """The lines as one text; bounded by the number of registered tables."""
        lines = [r["line"] for r in self.schema_lines().orderBy("table").toLocalIterator()]
        return "\n".join(lines) if lines else NO_TABLES

    def query(self, sql: str) -> DataFrame:
        """A lazy result of one read-only statement over the registered tables."""
        if not is_read_only(sql) or not plans_only_reading(self.spark, sql):
            raise PermissionError("only a reading statement is allowed here")
        return run_sql(self.spark, sql)

    def envelope(self, sql: str, max_rows: int = ENVELOPE_ROWS) -> dict:
        """Columns and rows of a result for display; raises when it is longer than ``max_rows``."""
        result = self.query(sql)
        rows = [list(r) for r in result.take(max_rows + 1)]
        if len(rows) > max_rows:
            raise ValueError(f"more than {max_rows} rows; use query() or add a LIMIT")
        return {"columns": result.columns, "rows": rows, "row_count": len(rows), "sql": sql}


@contextmanager
def quoted_identifiers(spark: SparkSession):
    """Read ``"name"`` as an identifier, not as a string, while a statement is parsed."""
    key = "spark.sql.ansi.doubleQuotedIdentifiers"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def plans_only_reading(spark: SparkSession, sql: str) -> bool:
    """Whether Spark's own parser finds no command and no insert anywhere in the statement."""

    def acts(node) -> bool:
        kind = node.getClass()
        while kind is not None:
            names = [kind.getName(), *(i.getName() for i in kind.getInterfaces())]
            if any(n.endswith((".Command", ".ParsedStatement", ".UnaryParsedStatement", "Command")) for n in names):
                return True
            kind = kind.getSuperclass()
        inner = [node.children(), node.innerChildren()]
        return any(acts(part.apply(i)) for part in inner for i in range(part.size()) if hasattr(part.apply(i), "children"))

    with quoted_identifiers(spark):
        return not acts(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql))


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    with quoted_identifiers(spark):
        return spark.sql(sql)


def canonical_type(kind: T.DataType) -> str:
    """Type names that do not depend on the engine."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "number"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "array" if isinstance(kind, T.ArrayType) else "string"

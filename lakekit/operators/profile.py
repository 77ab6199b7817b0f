"""Column statistics, CSV profiles, type guesses and chart suggestions.

All profiles are single aggregates: each task reduces its rows to one record
per column, so the shuffle does not grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakekit.functions.fixed import TREND_WORD_ANY_CASE, TREND_WORDS
from lakekit.functions.text import is_blank, is_number_like, strip, to_number
from lakekit.operators.ordering import first_per_key
from lakekit.sources.csv import CELLS, ROW

# Columns measured by one aggregate; its generated code grows with them.
WIDE_COLUMNS = 64
DATE_SAMPLE = 20
TYPE_SAMPLE = 10


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (CELLS, ROW)]


def _number_and_blank(df: DataFrame, name: str) -> tuple[Column, Column]:
    """Number in a cell and whether the cell is blank; typed columns skip the text."""
    kind, cell = df.schema[name].dataType, quoted(name)
    if isinstance(kind, T.StringType):
        return to_number(cell), is_blank(cell)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = cell.cast("double")
        infinite = F.abs(value) == float("inf")
        return F.when(~F.isnan(value) & ~infinite, value), cell.isNull()
    if isinstance(kind, T.NumericType):
        return cell.cast("double"), cell.isNull()
    return F.lit(None).cast("double"), cell.isNull()


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: share of blank cells, and count, mean, min and max when mostly numeric.

    A column is numeric when more than half of its non-blank cells are
    numbers. Cells missing from short records count as blank.
    """
    columns = columns or data_columns(df)
    parts = [columns[i : i + WIDE_COLUMNS] for i in range(0, len(columns), WIDE_COLUMNS)]
    measured = wide_measures(df, parts[0])
    for i, part in enumerate(parts[1:], 1):
        # Each pass over a columnar table reads its own columns only.
        more = wide_measures(df, part).withColumn("position", F.col("position") + i * WIDE_COLUMNS)
        measured = measured.unionByName(more)
    return column_stats_from(measured)


def column_stats_from(measured: DataFrame) -> DataFrame:
    """Statistics from one record of measures per column."""
    numeric = (F.col("n") > 0) & (F.col("n") > (F.col("total") - F.col("blank")) * 0.5)
    return measured.select(
        "position",
        "column",
        F.col("total").alias("total_rows"),
        F.bround(F.col("blank") / F.greatest(F.col("total"), F.lit(1)), 3).alias("null_ratio"),
        numeric.alias("numeric"),
        F.when(numeric, F.col("n")).alias("count"),
        F.when(numeric, F.bround(F.col("s") / F.col("n"), 3)).alias("mean"),
        F.when(numeric, F.bround("lo", 3)).alias("min"),
        F.when(numeric, F.bround("hi", 3)).alias("max"),
    )


def wide_measures(df: DataFrame, columns: list[str]) -> DataFrame:
    """All measures of all columns in one aggregate row, unfolded to one record per column."""
    cells = {}
    for i, name in enumerate(columns):
        cells[f"n{i}"], cells[f"b{i}"] = _number_and_blank(df, name)
    parts = df.select(*[value.alias(key) for key, value in cells.items()])
    # Written as SQL text, since building hundreds of Column objects takes longer than many a scan.
    measures = ["count(1) AS total"]
    records = []
    for i in range(len(columns)):
        measures.append(f"count_if(b{i}) AS blank{i}")
        measures += [f"{f}(n{i}) AS {f}{i}" for f in ("count", "sum", "min", "max")]
        records.append(f"struct({i} AS position, total, blank{i} AS blank, count{i} AS n, sum{i} AS s, min{i} AS lo, max{i} AS hi)")
    names = F.array(*[F.lit(name) for name in columns])
    measured = parts.selectExpr(*measures).selectExpr(f"inline(array({', '.join(records)}))")
    return measured.withColumn("column", F.element_at(names, F.col("position") + 1))


def long_measures(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same measures by grouping one record per cell: one pass and a short plan for any number of
    columns, at several times the cost per cell. For wide inputs that are dear to read twice."""
    cells = []
    for i, name in enumerate(columns):
        number, blank = _number_and_blank(df, name)
        cells.append(F.struct(F.lit(i).alias("position"), F.lit(name).alias("column"), number.alias("v"), blank.alias("b")))
    return (
        df.select(F.inline(F.array(*cells)))
        .groupBy("position", "column")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if("b").alias("blank"),
            F.count("v").alias("n"),
            F.sum("v").alias("s"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
        )
    )


def csv_profile(raw: DataFrame) -> DataFrame:
    """Per column of a raw CSV: rows, rows of a wrong length, and share of blank cells.

    Unlike in ``column_stats``, cells missing from short records count as
    neither blank nor present, while the share is still over all rows.
    """
    columns = data_columns(raw)
    wrong = F.count_if(F.col(CELLS) != len(columns))
    blanks = [
        F.count_if((F.col(CELLS) > i) & is_blank(quoted(name))).alias(f"blank{i}") for i, name in enumerate(columns)
    ]
    totals = raw.agg(F.count(F.lit(1)).alias("total_rows"), wrong.alias("inconsistent_rows"), *blanks)
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column"),
            F.col("total_rows"),
            F.col("inconsistent_rows"),
            F.bround(F.col(f"blank{i}") / F.greatest("total_rows", F.lit(1)), 3).alias("null_ratio"),
        )
        for i, name in enumerate(columns)
    ]
    return totals.select(F.inline(F.array(*rows)))


def long_cells(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """One record per present cell: ``keep``, ``position``, ``column`` and text ``cell``."""
    cells = []
    for i, name in enumerate(columns):
        text = quoted(name).cast("string")
        present = F.col(CELLS) > i if CELLS in df.columns else F.lit(True)
        cells.append(
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("column"), text.alias("cell"), present.alias("present"))
        )
    return df.select(*keep, F.inline(F.array(*cells)))


def date_columns(df: DataFrame, order: str = ROW, columns: list[str] | None = None, rows: int | None = DATE_SAMPLE) -> DataFrame:
    """Columns where at least 70% of the first ``rows`` cells, and at least 3 cells, read ``dddd-dd-dd``.

    With ``rows=None`` all cells count.
    """
    columns = columns or data_columns(df)
    if rows is None:
        sample = long_cells(df, columns, []).filter("present")
    else:
        head = df.orderBy(order).limit(rows)
        if CELLS in df.columns:
            # The head holds every sample unless one of its records is short; only then look at the rest:
            # the first cells of a column are among as many first records of each length.
            short = head.agg(F.count_if(F.col(CELLS) < len(columns))).scalar()
            length = F.least(F.col(CELLS), F.lit(len(columns)))
            rest = first_per_key(df.filter(short > 0).withColumn("_length", length), ["_length"], [F.col(order)], rows)
            head = head.filter(short == 0).unionByName(rest.drop("_length"))
        cells = long_cells(head, columns, [order]).filter("present")
        sample = first_per_key(cells, ["position", "column"], [F.col(order)], rows)
    is_date = F.coalesce(strip(F.col("cell")), F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}$")
    return (
        sample.groupBy("position", "column")
        .agg(F.count("*").alias("n"), F.count_if(is_date).alias("dates"))
        .filter((F.col("n") >= 3) & (F.col("dates") / F.col("n") >= 0.7))
        .select("position", "column")
    )


def infer_types(df: DataFrame, order: str, columns: list[str] | None = None, rows: int | None = TYPE_SAMPLE) -> DataFrame:
    """Type guess per column from the first rows, or with ``rows=None`` from all: int, float, date or string, and nullable."""
    columns = columns or [c for c in data_columns(df)]
    sample = df if rows is None else df.orderBy(order).limit(rows)
    return _guess_types(long_cells(sample, columns, [F.col(order).alias("_order")]), [])


def infer_types_batch(tables: dict[str, tuple[DataFrame, str]], rows: int | None = TYPE_SAMPLE) -> DataFrame:
    """Type guesses for many tables of ``name: (table, order column)``, as one job; ``rows=None`` reads all rows.

    A table that cannot be analysed gives one row with its error.
    """
    guesses, samples, errors = [], [], []
    for name, (df, order) in tables.items():
        try:
            if rows is None:
                # Each table is reduced by its own aggregate, so rows of any number need no common order.
                own = infer_types(df, order, rows=None)
                guesses.append(own.select(F.lit(name).alias("table"), *own.columns))
                continue
            # Order columns of any type meet in one column as the numbers of the few sampled rows.
            place = F.row_number().over(Window.orderBy(order)).alias("_order")
            head = df.orderBy(order).limit(rows).select("*", place)
            samples.append(long_cells(head, data_columns(df), [F.lit(name).alias("table"), F.col("_order")]))
        except Exception as error:  # noqa: BLE001 - one bad table must not stop the others
            errors.append((name, str(error).split("\n")[0]))
    guessed = None
    for cells in samples:
        guessed = cells if guessed is None else guessed.unionByName(cells)
    if guessed is not None:
        guesses.append(_guess_types(guessed, ["table"]))
    result = None
    for own in guesses:
        own = own.withColumn("error", F.lit(None).cast("string"))
        result = own if result is None else result.unionByName(own)
    if errors:
        spark = next(iter(tables.values()))[0].sparkSession
        bad = spark.createDataFrame(errors, "table string, error string")
        result = bad if result is None else result.unionByName(bad, allowMissingColumns=True)
    return result


def _guess_types(cells: DataFrame, keys: list[str]) -> DataFrame:
    text = F.col("cell")
    missing = ~F.col("present")
    blank = missing | is_blank(text)
    value = F.when(~blank, text)
    all_digits = F.coalesce(F.bool_and(F.when(~blank, is_number_like(text))), F.lit(False))
    first = F.min_by(value, F.when(~blank, F.col("_order")))
    return (
        cells.groupBy(*keys, "position", "column")
        .agg(
            all_digits.alias("digits"),
            F.coalesce(F.bool_or(value.contains(".")), F.lit(False)).alias("dot"),
            F.coalesce(F.bool_or(value.contains("-")), F.lit(False)).alias("dash"),
            first.alias("first"),
            F.bool_or(blank).alias("nullable"),
        )
        .select(
            *keys,
            "position",
            "column",
            F.when(~F.col("digits"), "string")
            .when(F.col("dot"), "float")
            .when(F.col("dash"), F.when(F.length("first") == 10, "date").otherwise("string"))
            .otherwise("int")
            .alias("type_guess"),
            "nullable",
        )
    )


def schema_json(types: DataFrame, dataset: str, source: str | None = None) -> DataFrame:
    """The type guesses of one table as a JSON document of fields in column order, and where they come from if given."""
    field = F.struct(
        F.col("column").alias("fieldPath"),
        F.col("column").alias("description"),
        F.col("type_guess").alias("nativeDataType"),
        F.col("nullable"),
        F.array(F.lit("unknown")).alias("tags"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("position", field.alias("field"))))
    fields = F.transform(ordered, lambda f: f["field"])
    return types.agg(
        F.to_json(
            F.struct(
                F.lit(dataset).alias("dataset"),
                F.struct(fields.alias("fields")).alias("schema"),
                *([F.lit(source).alias("source")] if source is not None else []),
            )
        ).alias("document")
    )


def chart_suggestion(df: DataFrame, question: str, columns: list[str] | None = None) -> DataFrame:
    """Chart kind for a result: bar for label and number, line or bar for several numbers, else a table."""
    columns = columns or df.columns
    numeric = []
    for i, name in enumerate(columns):
        kind = df.schema[name].dataType
        if isinstance(kind, T.StringType):
            fits = F.coalesce(is_number_like(quoted(name)), F.lit(False))
        elif isinstance(kind, (T.IntegralType, T.FractionalType, T.BooleanType)) and not isinstance(kind, T.DecimalType):
            fits = quoted(name).isNotNull()
        else:
            fits = F.lit(False)
        numeric.append(F.coalesce(F.bool_and(fits), F.lit(False)).cast("int"))
    count = sum(numeric[1:], numeric[0])
    trend = any(w in question for w in TREND_WORDS) or TREND_WORD_ANY_CASE in question.lower()
    if len(columns) == 2:
        chart = F.when(F.col("numeric_columns") == 1, "bar").otherwise("table")
    elif len(columns) >= 3:
        chart = F.when(F.col("numeric_columns") >= 2, "line" if trend else "bar").otherwise("table")
    else:
        chart = F.lit("table")
    drawn = F.col("chart_type") != "table"
    return (
        df.agg(count.alias("numeric_columns"))
        .withColumn("chart_type", chart)
        .select(
            "chart_type",
            F.col("numeric_columns").cast("bigint"),
            F.when(drawn, F.lit(columns[0])).alias("x_axis"),
            F.when(drawn, F.lit(",".join(columns[1:]))).alias("y_axes"),
            F.lit(question).alias("title"),
        )
    )

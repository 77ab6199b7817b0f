"""Filter, sort, page and preview of tables with text cells.

``order`` is the column that fixes the input order: a key, or ``_row`` of the
raw CSV reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekit.functions.fixed import PREVIEW_SUFFIXES
from lakekit.functions.text import human_size, is_number_like, to_number
from lakekit.operators.corpus import pretty_json
from lakekit.operators.ordering import number_rows
from lakekit.sources.csv import CELLS

PAGE_DEFAULT = 100
PAGE_MAX = 1000
PREVIEW_ROWS = 500
PREVIEW_CHARS = 50_000
CHART_ROWS = 200


def cell_text(df: DataFrame, column: str) -> Column:
    """The cell as text: empty when blank, null when the record is too short for it."""
    cell = F.col(column).cast("string")
    if CELLS not in df.columns:
        return cell
    position = df.columns.index(column)
    return F.when(F.col(CELLS) > position, F.coalesce(cell, F.lit("")))


def rows_filter(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose ``column`` contains ``value`` in any case; an unknown column filters nothing."""
    if column not in df.columns:
        return df
    return df.filter(F.lower(cell_text(df, column)).contains(value.lower()))


def rows_sort(df: DataFrame, column: str, order: str, descending: bool = False) -> DataFrame:
    """Sort by number when every cell is one, by text when none looks like one, else keep input order.

    Ties keep the input order in both directions. The kind of order is a
    scalar subquery, so the whole sort stays one lazy plan.
    """
    if column not in df.columns:
        return df.orderBy(order)
    cell = F.coalesce(cell_text(df, column), F.lit(""))
    digits = is_number_like(cell)
    number = to_number(cell)
    kind = df.agg(
        F.when(F.bool_and(digits & number.isNotNull()), "number")
        .when(F.bool_and(~digits), "text")
        .otherwise("input")
        .alias("kind")
    ).scalar()
    as_number = F.when(kind == "number", number)
    as_text = F.when(kind == "text", cell)
    keys = [as_number, as_text]
    return df.orderBy(*[k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys], F.col(order))


def number_sorted(df: DataFrame, column: str, order: str, name: str, descending: bool = False) -> DataFrame:
    """All rows with their place, from 1, in the numeric order of ``column``; cells without a number come last.

    Serves pages far into a large table: filter on the place instead of skipping rows.
    """
    number = to_number(F.coalesce(cell_text(df, column), F.lit("")))
    first = number.desc_nulls_last() if descending else number.asc_nulls_last()
    return number_rows(df, [first, F.col(order)], name)


def rows_page(df: DataFrame, limit: int = PAGE_DEFAULT, offset: int = 0, maximum: int = PAGE_MAX) -> DataFrame:
    """One page of an already ordered table; a page longer than ``maximum`` is refused."""
    if limit > maximum:
        raise ValueError(f"a page of {limit} rows is longer than {maximum}")
    return df.offset(max(offset, 0)).limit(limit)


def rows_totals(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows in all and rows after the filter, in one pass."""
    kept = F.lit(True)
    if column in df.columns:
        kept = F.lower(cell_text(df, column)).contains(value.lower())
    return df.agg(F.count("*").alias("total"), F.count_if(kept).alias("filtered_total"))


def preview(df: DataFrame, order: str, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows in input order; ``truncated`` says whether the limit was reached."""
    head = df.orderBy(order).limit(rows)
    shown = head.agg(F.count("*").alias("n")).scalar()
    return head.withColumns({"total_rows": shown, "truncated": shown >= rows})


def content_preview(files: DataFrame, chars: int = PREVIEW_CHARS, indent_json: bool = False) -> DataFrame:
    """Kind and first characters of each file; other kinds show their size.

    With ``indent_json`` valid JSON is indented first, which takes it through Python.
    """
    if indent_json:
        pretty = pretty_json(F.when(F.col("suffix") == ".json", F.col("content")))
        files = files.withColumn("content", F.coalesce(pretty, "content"))
    text = F.col("suffix").isin([s for s in PREVIEW_SUFFIXES if s != ".csv"])
    kind = F.when(F.col("suffix") == ".csv", "csv").when(F.col("suffix") == ".json", "json").when(text, "text")
    shown = F.when(text, F.left(F.col("content"), F.lit(chars)))
    return files.select(
        "path",
        F.coalesce(kind, F.lit("binary")).alias("kind"),
        shown.alias("content"),
        F.when(kind.isNull(), human_size(F.col("size"), ("B", "KB", "MB", "GB", "TB"))).alias("size_human"),
    )


def chart_series(df: DataFrame, x: str, y: str, order: str, rows: int = CHART_ROWS) -> DataFrame:
    """Label and number of the first rows; a row whose ``y`` starts with no number is dropped as a pair."""
    leading = F.regexp_extract(F.col(y).cast("string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return (
        df.orderBy(order)
        .limit(rows)
        .select(
            F.col(order),
            F.coalesce(F.col(x).cast("string"), F.lit("")).alias("label"),
            leading.try_cast("double").alias("value"),
        )
        .filter(F.col("value").isNotNull())
    )

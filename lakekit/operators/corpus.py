"""Syntax checks on file content.

XML is judged by Spark's reader. Spark has no strict parser for JSON and Python, so the content of those files, and of
no others, goes to Python in Arrow batches.
"""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _json_ok(text: str | None) -> bool | None:
    if text is None:
        return None
    try:
        json.loads(text)
        return True
    except (ValueError, RecursionError):
        return False


def _python_ok(text: str | None) -> bool | None:
    if text is None:
        return None
    try:
        ast.parse(text)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


@F.pandas_udf(T.BooleanType())
def _json_parses(text: pd.Series) -> pd.Series:
    return text.map(_json_ok).astype(object)


def json_valid(text: Column) -> Column:
    """Whether a text is one JSON value; null for null.

    Text that does not begin and end like one is turned down here, which keeps
    prose out of Python.
    """
    blanks = F.lit(" \t\r\n")
    first = F.substring(F.ltrim(text, blanks), 1, 1)
    last = F.substring(F.rtrim(text, blanks), -1, 1)
    possible = first.isin(list('{["-0123456789tfnNI')) & last.isin(list('}]"0123456789leNy'))
    parsed = _json_parses(F.when(possible, text))
    return F.when(text.isNotNull(), possible & F.coalesce(parsed, F.lit(False)))


@F.pandas_udf(T.BooleanType())
def python_valid(text: pd.Series) -> pd.Series:
    return text.map(_python_ok).astype(object)


_XML_START = r"\A\s*(<\?xml[^>]*\?>)?\s*(<!DOCTYPE[^>\[]*+(\[[^\]]*+\][^>]*+)?>)?"
_XML_SILENT = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>"


def xml_facts(content: Column) -> Column:
    """Whether a text is one well-formed XML document, its root tag, its number of distinct tags, and what is wrong.

    Spark's own reader judges the document, and once more inside an outer element, where a second root or text
    beside the root shows. Tags are names as written, prefix included.
    """
    corrupt = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_c"}
    # The reader would cut long bodies' texts into a string, so only the wrong record's column is asked for.
    alone = F.from_xml(content, F.lit("_c string"), corrupt)
    body = F.regexp_replace(content, _XML_START, "")
    inside = F.from_xml(F.concat(F.lit("<w>"), body, F.lit("</w>")), F.lit("xs_any array<string>, _VALUE string, _c string"), corrupt)
    single = (F.size(inside["xs_any"]) == 1) & (F.trim(F.coalesce(inside["_VALUE"], F.lit(""))) == "")
    valid = F.coalesce(alone.isNotNull() & alone["_c"].isNull() & inside["_c"].isNull() & single, F.lit(False))
    tags = F.regexp_extract_all(F.regexp_replace(body, _XML_SILENT, ""), F.lit(r"<([^\s/>!?]++)"), 1)
    return F.when(
        content.isNotNull(),
        F.struct(
            valid.alias("valid"),
            F.when(valid, tags[0]).alias("root_tag"),
            F.when(valid, F.size(F.array_distinct(tags))).otherwise(0).alias("unique_elements"),
            F.when(~valid, F.lit("not one well-formed document")).alias("error"),
        ),
    )


def csv_valid(content: Column) -> Column:
    """A CSV is valid when its first line, after a byte order mark, holds a header."""
    return content.rlike(r"\A\x{FEFF}?[^\r\n]")


def file_checks(files: DataFrame) -> DataFrame:
    """``files`` with one validity flag per format, null where the format does not apply."""
    suffix, content = F.col("suffix"), F.col("content")
    is_text = F.element_at(F.split("path", "/"), -1)
    return files.withColumns(
        {
            "csv_ok": F.when(suffix == ".csv", csv_valid(content)),
            "json_ok": json_valid(F.when(is_text.endswith(".json"), content)),
            "py_ok": python_valid(F.when(is_text.endswith(".py"), content)),
            "xml_ok": xml_facts(F.when(suffix == ".xml", content))["valid"],
        }
    )


def xml_report(files: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """Well-formedness, root tag, number of distinct tags and error of every document."""
    return files.select(*keep, xml_facts(F.col(content)).alias("_x")).select(*keep, "_x.*")


@F.pandas_udf(T.StringType())
def pretty_json(text: pd.Series) -> pd.Series:
    """JSON indented for reading; text that is no JSON stays as it is."""

    def pretty(value):
        try:
            return None if value is None else json.dumps(json.loads(value), indent=2, ensure_ascii=False)
        except (ValueError, RecursionError):
            return value

    return text.map(pretty)

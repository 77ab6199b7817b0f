"""Columns and types by name, whatever characters a name holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def named(name: str) -> Column:
    """The column of exactly this name; dots, blanks and dashes are part of it."""
    return F.col("`" + name.replace("`", "``") + "`")


def fields(**kinds: T.DataType | str) -> T.StructType:
    """A schema of these columns; a type is an object or its name."""
    return T.StructType([T.StructField(n, T._parse_datatype_string(k) if isinstance(k, str) else k) for n, k in kinds.items()])

"""Statement checks and extraction of SQL or JSON from answer texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakekit.functions.fixed import STRICT_WORDS, WRITE_WORDS
from lakekit.functions.text import strip
from lakekit.operators.corpus import json_valid

_READING_START = r"^\s*\(*\s*(SELECT|WITH|FROM|VALUES)\b"


def has_write_word(sql: Column) -> Column:
    """Whether a statement names a writing word anywhere, string literals included."""
    return sql.rlike(r"(?i)\b(" + "|".join(WRITE_WORDS) + r")\b")


def without_literals(sql: str) -> str | None:
    """The statement with a blank for each literal, quoted name and comment; None if one of them never ends.

    Borders are those of Spark's lexer: backslashes escape inside quotes but not after ``r``, a line comment ends at a
    carriage return or a line feed, and bracket comments nest. A hint is no comment, so its words count.
    """
    out, at = [], 0
    while at < len(sql):
        two, one = sql[at : at + 2], sql[at]
        if two == "--":
            at = next((i for i in range(at, len(sql)) if sql[i] in "\r\n"), len(sql))
        elif two == "/*" and sql[at + 2 : at + 3] != "+":
            depth, at = 1, at + 2
            while depth:
                if at >= len(sql):
                    return None
                step = {"/*": 1, "*/": -1}.get(sql[at : at + 2], 0)
                depth, at = depth + step, at + (2 if step else 1)
        elif one in "'\"`":
            raw = one != "`" and re.search(r"(?i)(^|[^a-z0-9_])r\Z", sql[:at])
            at += 1
            while sql[at : at + 1] != one:
                if at >= len(sql):
                    return None
                at += 2 if sql[at] == "\\" and one != "`" and not raw else 1
            at += 1
        else:
            out.append(one)
            at += 1
            continue
        out.append(" ")
    return "".join(out)


def is_read_only(sql: str) -> bool:
    """The stricter gate for our own entry: one reading statement, no writing word outside literals.

    A statement whose literals or comments are not closed is refused.
    """
    bare = without_literals(sql)
    if bare is None or ";" in bare.strip().rstrip(";"):
        return False
    if not re.match(_READING_START, bare, re.IGNORECASE):
        return False
    return not re.search(r"\b(" + "|".join(STRICT_WORDS) + r")\b(?!\s*\()", bare, re.IGNORECASE)


def sql_guard(statements: DataFrame, column: str) -> DataFrame:
    return statements.withColumn("refused", has_write_word(F.col(column)))


def _fenced(answer: Column, language: str) -> Column:
    """Text of the first fence of a language, else of the first fence, else all of it."""
    marked = F.split(answer, "```" + language, 2)
    plain = F.split(answer, "```", 3)
    return (
        F.when(answer.contains("```" + language), F.split(F.try_element_at(marked, F.lit(2)), "```", 2)[0])
        .when(answer.contains("```"), F.try_element_at(plain, F.lit(2)))
        .otherwise(answer)
    )


def extract_sql(answers: DataFrame, column: str) -> DataFrame:
    """The statement in each answer, without fence, outer blanks and trailing semicolons."""
    return answers.withColumn("sql", F.regexp_replace(strip(_fenced(F.col(column), "sql")), r";+\z", ""))


def extract_json(answers: DataFrame, column: str) -> DataFrame:
    """The JSON in each answer, and whether it parses; an open fence holds none."""
    fence = F.col(column).contains("```")
    closed = F.length(F.col(column)) - F.length(F.replace(F.col(column), F.lit("```"))) >= 6
    body = F.when(~fence, F.col(column)).when(closed, strip(_fenced(F.col(column), "json")))
    return answers.withColumn("json", body).withColumn("valid", F.coalesce(json_valid(F.col("json")), F.lit(False)))

"""Text, number and size expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A decimal number with optional sign, fraction and exponent; ASCII digits only. Never steps back.
NUMBER_REGEX = r"^\s*+[+-]?+(?:\d++\.?+\d*+|\.\d++)(?:[eE][+-]?+\d++)?+\s*+$"


def strip(cell: Column) -> Column:
    """Remove leading and trailing white space, Unicode spaces included."""
    return F.regexp_replace(cell, r"(?U)^\s+|\s+$", "")


def slug(name: Column) -> Column:
    """File-system name of a project: lower case, ``/`` and odd characters to ``_``."""
    return F.regexp_replace(F.replace(F.lower(strip(name)), F.lit("/"), F.lit("_")), r"(?U)[^\w\-.]", "_")


def table_name(name: str) -> str:
    """Table name with every non-word character turned into ``_``."""
    return re.sub(r"[^\w]", "_", name)


def table_name_col(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[^\w]", "_")


def human_size(size: Column, units: tuple[str, ...] = ("B", "KB", "MB", "GB", "TB", "PB")) -> Column:
    """Bytes as text in steps of 1024 with one decimal; the last unit takes the rest."""
    value = size.cast("double")
    result = None
    for power in range(len(units) - 1, -1, -1):
        text = F.format_string(f"%.1f {units[power]}", F.bround(value / float(1024**power), 1))
        if result is None:
            result = text
        else:
            result = F.when(F.abs(value) < float(1024 ** (power + 1)), text).otherwise(result)
    return result


def is_blank(cell: Column) -> Column:
    """Null, empty or white space only; a cell that begins with a visible character needs no further look."""
    # No white space has a code from 33 to 132.
    return cell.isNull() | ~(F.ascii(cell).between(33, 132) | cell.rlike(r"(?U)\S"))


def to_number(cell: Column) -> Column:
    """The cell as a double, or null when it is no plain decimal number.

    A cast alone would also take ``1d``, ``NaN`` and hexadecimal text, and it
    is slow to turn text down.
    """
    return F.when(cell.rlike(NUMBER_REGEX), cell.try_cast("double"))


def is_number_like(cell: Column) -> Column:
    """Digits only, after dots and dashes are removed."""
    return F.translate(cell, ".-", "").rlike(r"^[0-9]+\z")


def words(text: Column) -> Column:
    """Lower-case runs of word characters, in order; empty pieces included.

    Numerals such as a raised two are word characters, and so are those that Java does not know yet.
    """
    return F.split(F.lower(text), r"(?U)[^\w\p{No}\p{Cn}]+")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` names it.

    Spark copies a shared expression into every branch of a condition; as the
    variable of a function over a one-element array it is a value instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_case(text: Column) -> Column:
    """Lower case for comparing in any case; three letters that lower case alone would miss become plain."""
    for letter, plain in (("\u017f", "s"), ("\u0131", "i"), ("\u0130", "i")):
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.lower(text)


def _literal_pieces(regex: str) -> list[str]:
    """The plain text between the special parts of a simple regular expression."""
    pieces = re.split(r"\[[^\]]*\][*+?]?|\\[sdw][*+?]?|\.[*+]|\w\?", regex)
    return [re.sub(r"\\(.)", r"\1", piece).lower() for piece in pieces if piece]


def mentions(folded: Column, regexes: list[str]) -> Column:
    """Whether a text in folded case matches one of some expressions written for any case.

    The longest plain piece of an expression is looked up first, so the
    expression itself runs on few texts, and not at all when it is all plain.
    """
    found = F.lit(False)
    for regex in regexes:
        pieces = _literal_pieces(regex)
        hit = folded.contains(max(pieces, key=len))
        if pieces != [regex.lower()]:
            hit = hit & folded.rlike("(?dU)" + _lower_letters(regex))
        found = found | hit
    return found


def _lower_letters(regex: str) -> str:
    """Lower case for the letters of an expression, but not for those that a backslash makes special."""
    return re.sub(r"(\\.)|(.)", lambda m: m.group(1) or m.group(2).lower(), regex)


def suffix(name: Column) -> Column:
    """Lower-case suffix from the last dot of a file name, or empty.

    A leading dot alone, as in ``.git``, starts no suffix.
    """
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*(\.[^./]+)$", 1))


def license_or_unknown(license_name: Column) -> Column:
    return F.coalesce(F.nullif(license_name, F.lit("")), F.lit("Unknown"))

"""Text functions as Column expressions, with the semantics of Python's ``str`` and ``re``.

Java's ``\\s`` lacks what Python takes for white space too (NBSP and others without the flag U, and
U+001C to U+001F in any case), and a failed ``regexp_extract`` gives an empty string. Patterns
are written as for Python and translated by :func:`pattern`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WHITE = r"\s\x1c-\x1f"


def pattern(python: str, ignore_case: bool = False) -> str:
    """A Python pattern for Java: Unicode classes, Unicode case folding if asked for, Python's white space."""
    out, at, inside = [], 0, False
    while at < len(python):
        two = python[at : at + 2]
        if two == r"\s":
            out.append(_WHITE if inside else f"[{_WHITE}]")
            at += 2
        elif two[0] == "\\":
            out.append(two)
            at += 2
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            at += 1
    return ("(?iU)" if ignore_case else "(?U)") + "".join(out)


def named(column: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(df: DataFrame, wanted: str) -> str:
    """A column name like ``wanted`` that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def first_group(text: Column, python: str, ignore_case: bool = True, group: int = 1) -> Column:
    """The group of the first match, null without a match. The group must not match an empty string."""
    return F.nullif(F.regexp_extract(text, pattern(python, ignore_case), group), F.lit(""))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, pattern(r"\A\s+|\s+\z"), "")


def squish(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; null stays null."""
    return F.btrim(F.regexp_replace(text, pattern(r"\s+"), " "))


def to_long(text: Column) -> Column:
    """A whole number, null if it isn't one or doesn't fit."""
    return text.try_cast("bigint")


def to_double(text: Column) -> Column:
    return text.try_cast("double")


def truncated(text: Column) -> Column:
    """A decimal number cut to its whole part."""
    return to_double(text).cast("bigint")


def contains_any(text: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found

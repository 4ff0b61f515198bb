"""Dates in several notations, and calendar truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Notations that are tried in this order.
NOTATIONS = ("yyyyMMdd", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd")
#: strftime directives and their Java counterparts.
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%%": "%"}


def parse_date(c: Column, kind: T.DataType) -> Column:
    """A date from a date, a timestamp, a string in one of the notations, or a whole number of eight digits; else null."""
    if isinstance(kind, T.DateType):
        return c
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    text = c.cast("string")
    tried = [F.try_to_date(F.when(F.length(text) == len(n), text), n) for n in NOTATIONS]
    if isinstance(kind, T.StringType):
        tried.append(text.try_cast("date"))
    return F.coalesce(*tried)


def to_day(c: Column, kind: T.DataType) -> Column:
    return parse_date(c, kind)


def to_week(c: Column, kind: T.DataType) -> Column:
    """The Monday of the week."""
    return F.date_trunc("week", parse_date(c, kind)).cast("date")


def to_month(c: Column, kind: T.DataType) -> Column:
    return F.trunc(parse_date(c, kind), "month")


GRAINS = {"day": to_day, "week": to_week, "month": to_month}


def java_pattern(pattern: str) -> str:
    """The Java date pattern of a strftime pattern."""
    out, i = "", 0
    while i < len(pattern):
        if pattern[i] == "%":
            if pattern[i : i + 2] not in DIRECTIVES:
                raise ValueError(f"unknown directive {pattern[i : i + 2]!r}")
            out += DIRECTIVES[pattern[i : i + 2]]
            i += 2
            continue
        j = pattern.find("%", i) if "%" in pattern[i:] else len(pattern)
        quoted = pattern[i:j].replace("'", "''")
        out += f"'{quoted}'" if any(x.isalpha() or x == "'" for x in pattern[i:j]) else quoted
        i = j
    return out


def format_date(c: Column, kind: T.DataType, pattern: str) -> Column:
    return F.date_format(parse_date(c, kind), java_pattern(pattern))


def with_grain(df: DataFrame, column: str, grain: str, name: str) -> DataFrame:
    """``df`` with the day, week or month of a column as ``name``."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {sorted(GRAINS)}")
    return df.withColumn(name, GRAINS[grain](F.col(column), df.schema[column].dataType))

"""Scalar column helpers (all built-in expressions, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.constants import WEEKEND


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(name: str) -> Column:
    """Column by exact name; names of the wide file contain '.', '(' and spaces."""
    return F.col(f"`{name}`")


def weekday_name(date: str | Column) -> Column:
    """Full English weekday name, e.g. 'Monday'."""
    return F.date_format(col_of(date), "EEEE")


def weekday_number(date: str | Column) -> Column:
    """Monday=1 .. Sunday=7 (ISO)."""
    return (F.dayofweek(col_of(date)) + 5) % 7 + 1


def is_weekend(dow_name: str | Column) -> Column:
    return col_of(dow_name).isin(WEEKEND).cast("int")


def flag(cond: Column) -> Column:
    """Boolean condition as int 0/1 (null condition -> 0)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def date_lit(d) -> Column:
    return F.lit(str(d)).cast("date")


def number(df: DataFrame, name: str) -> Column:
    """A column of a read file as a number: whole numbers stay bigint, everything else becomes double with its
    fraction. Text such as '3.0' is read, blank text is null, other text fails."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        text = F.trim(quoted(name))
        return F.when(text != "", text).cast("double")
    return quoted(name).cast("bigint" if isinstance(kind, T.IntegralType) else "double")

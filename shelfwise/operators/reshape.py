"""Reshape operators 5-8: wide <-> long, quantity/revenue pairing, weekday decoding.

All are projections or one generator over each row (no shuffle) except
``pivot_items`` (one shuffle on the index column).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.constants import (
    DATE_COL, QTY_PREFIX, REV_PREFIX, UNKNOWN_WEEKDAY, WEEKDAY_ONEHOT_ORDER, WEEKDAY_PREFIX)
from shelfwise.functions.exprs import number, quoted, weekday_name


def measure_columns(df: DataFrame, prefix: str) -> list[str]:
    """The measure set of a wide table is whatever carries the prefix."""
    return [c for c in df.columns if c.startswith(prefix)]


# ----------------------------------------------------------- 5. unpivot_measures
def unpivot_measures(wide: DataFrame, prefix: str = QTY_PREFIX, value: str = "qty",
                     ids: Sequence[str] = (DATE_COL,), item_col: str = "item") -> DataFrame:
    """Columns selected by prefix, wide -> long ``(ids..., item, value)``; nulls kept."""
    cols = measure_columns(wide, prefix)
    if not cols:
        raise ValueError(f"no column starts with {prefix!r}")
    long = wide.unpivot([quoted(i) for i in ids], [quoted(c) for c in cols], "_measure", value)
    item = F.expr(f"substring(_measure, {len(prefix) + 1})")
    return long.select(*[quoted(i) for i in ids], item.alias(item_col), F.col(value))


# ---------------------------------------------------------------- 6. pivot_items
def pivot_items(long: DataFrame, value: str, items: Sequence[str], index: str = "date",
                item_col: str = "item", prefix: str = "") -> DataFrame:
    """Long -> matrix index x item; the item list is given (no distinct pre-pass), and an item
    outside it fails the job instead of vanishing. Several rows of one index and item add up."""
    bad = F.raise_error(F.concat(F.lit("item outside the given list: "), F.coalesce(F.col(item_col), F.lit("null"))))
    known = F.when(F.col(item_col).isin(list(items)), F.col(item_col)).otherwise(bad.cast("string"))
    p = long.withColumn(item_col, known).groupBy(index).pivot(item_col, list(items)).agg(F.sum(value).cast(long.schema[value].dataType))
    if prefix:
        p = p.select(index, *[quoted(i).alias(prefix + i) for i in items])
    return p


# ----------------------------------------------------------- 7. pair_qty_revenue
def pair_qty_revenue(wide: DataFrame, ids: Sequence[str] = (DATE_COL,),
                     qty_prefix: str = QTY_PREFIX, rev_prefix: str = REV_PREFIX,
                     item_col: str = "item") -> DataFrame:
    """Pair each quantity column with the revenue column named by the prefix swap.

    Pairing is resolved on the column names, so the long result is produced by one
    generator over each wide row: no join and no shuffle. Quantity columns without a
    revenue twin are left out (inner pairing). Quantities are bigint if all their columns hold whole numbers by type, else
    double; text is read as numbers, blank as null."""
    cols = set(wide.columns)
    pairs = [(c[len(qty_prefix):], c, rev_prefix + c[len(qty_prefix):])
             for c in measure_columns(wide, qty_prefix) if rev_prefix + c[len(qty_prefix):] in cols]
    if not pairs:
        raise ValueError("no quantity column has a revenue twin")
    whole = all(isinstance(wide.schema[q].dataType, T.IntegralType) for _, q, _ in pairs)
    rows = F.array(*[F.struct(F.lit(i).alias(item_col),
                              number(wide, q).cast("bigint" if whole else "double").alias("qty"),
                              number(wide, r).cast("double").alias("revenue")) for i, q, r in pairs])
    return wide.select(*[quoted(i) for i in ids], F.inline(rows))


# ------------------------------------------------------------- 8. decode_weekday
def decode_weekday(df: DataFrame, out: str = "dow", date_col: str = DATE_COL) -> DataFrame:
    """One-hot weekday columns -> name: the first column (in the file's order) equal
    to 1 wins, else 'Unknown'. Without any one-hot column the name comes from the date."""
    present = [d for d in WEEKDAY_ONEHOT_ORDER if WEEKDAY_PREFIX + d in df.columns]
    if not present:
        return df.withColumn(out, weekday_name(quoted(date_col)))
    expr = F.coalesce(*[F.when(number(df, WEEKDAY_PREFIX + d) == 1, F.lit(d)) for d in present],
                      F.lit(UNKNOWN_WEEKDAY))
    return df.withColumn(out, expr)

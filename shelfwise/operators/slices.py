"""Distributed prefix operations: a key's rows in order, cut into slices over many tasks.

A window over a key sorts all rows of that key in one task. Here the rows are range-partitioned by (key, order), so that a
key with a third of all rows spreads over a third of the tasks, and what a slice needs of the slices before it (a count,
a sum, the last row) comes from one summary row for each key and slice that meet. The sliced rows are checkpointed into
the shared folder: every later step sees the same cut, also after an executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.session import cut_lineage

SLICE, AT = "_slice", "_at"
_BITS = 33  # of a row's number within its task, in monotonically_increasing_id


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df in order of (keys, order) over all tasks, plus ``_at`` (ascending in that order) and ``_slice``. Equal rows
    of (keys, order) are in one slice."""
    by = [*keys, *order]
    cut = (df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(AT, F.monotonically_increasing_id())
           .withColumn(SLICE, F.shiftright(AT, _BITS)))
    return cut_lineage(cut)


def within(keys: Sequence[str]):
    """Window over one slice of a key, in order."""
    return Window.partitionBy(*keys, SLICE).orderBy(AT)


def earlier(keys: Sequence[str]):
    """Window over the summaries of a key's earlier slices."""
    return Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def with_summary(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the columns of their (keys, slice) summary; null keys meet too."""
    on = [*keys, SLICE]
    renamed = summary.withColumnsRenamed({c: f"_s{i}" for i, c in enumerate(on)})
    same = [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(on)]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return rows.join(renamed, cond).drop(*[f"_s{i}" for i in range(len(on))])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str | None = None, rank: str = "rank",
            upto: str = "upto") -> DataFrame:
    """df plus ``rank`` (long, from 1, within the keys by order) and, with a value column, ``upto``: its sum up to and with
    the row. Rows that tie must be equal in every column, so that any order of them is the same result; a tie of rows that
    differ fails the job, as it has no defined result. The columns must be comparable (no maps)."""
    cut = sliced(df, keys, order)
    total = [F.sum(value).alias("_sum")] if value else []
    per = cut.groupBy(*keys, SLICE).agg(F.count("*").alias("_n"), *total)
    before = earlier(keys)
    per = per.select(*keys, SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
                     *([F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum0")] if value else []))
    w = within(keys)
    place, whole = F.struct(*order), F.struct(*df.columns)
    tie = (F.lag(place).over(w) == place) & (F.lag(whole).over(w) != whole)
    message = F.concat(F.lit(f"rows of one key tie on {', '.join(order)}: "), F.to_json(F.struct(*keys, *order)))
    number = F.when(F.coalesce(tie, F.lit(False)), F.raise_error(message).cast("bigint")).otherwise(
        F.row_number().over(w).cast("bigint") + F.col("_n0"))
    out = with_summary(cut, per, keys).withColumn(rank, number)
    if value:
        out = out.withColumn(upto, F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_sum0"))
    return out.select(*df.columns, rank, *([upto] if value else []))


def last_before(summary: DataFrame, keys: Sequence[str], column: str) -> Column:
    """The last non-null summary value of the key's earlier slices."""
    return F.last(column, ignorenulls=True).over(earlier(keys))

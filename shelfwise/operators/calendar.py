"""Calendar operators: 9 calendar_features, 10 calendar_dummies, 20 date_slice,
21 point_in_time, 48 densify, plus the holiday dimension builder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.exprs import date_lit, flag, is_weekend, weekday_name


def holiday_calendar(dates: DataFrame, month_days: Sequence[tuple[int, int]],
                     date_col: str = "date") -> DataFrame:
    """Holiday dates ``(date)`` for every year spanned by ``dates``, from (month, day)
    rules. The result has at most len(month_days) rows per year."""
    years = dates.select(F.year(date_col).alias("_y")).distinct()
    md = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d")) for m, d in month_days])
    return (years.select("_y", F.explode(md).alias("_md"))
            .select(F.make_date("_y", "_md.m", "_md.d").alias("date")))


def _holiday_flag(df: DataFrame, holidays, date_col: str) -> DataFrame:
    if isinstance(holidays, DataFrame):
        # A holiday calendar holds at most one row per calendar day: bounded, broadcast.
        h = holidays.select(F.col("date").alias("_hdate")).distinct().withColumn("_hol", F.lit(1))
        out = df.join(F.broadcast(h), F.col(date_col) == F.col("_hdate"), "left")
        return out.withColumn("is_holiday", F.coalesce(F.col("_hol"), F.lit(0))).drop("_hdate", "_hol")
    lits = [date_lit(d) for d in (holidays or [])]
    cond = F.col(date_col).isin(*lits) if lits else F.lit(False)
    return df.withColumn("is_holiday", flag(cond))


# -------------------------------------------------------- 9. calendar_features
def calendar_features(df: DataFrame, holidays=None, date_col: str = "date",
                      dow_col: str = "dow") -> DataFrame:
    """month, quarter, year, weekday name (kept if already decoded), is_weekend, is_holiday."""
    out = df
    if dow_col not in df.columns:
        out = out.withColumn(dow_col, weekday_name(date_col))
    out = (out.withColumn("month", F.month(date_col))
           .withColumn("quarter", F.quarter(date_col))
           .withColumn("year", F.year(date_col))
           .withColumn("is_weekend", is_weekend(dow_col)))
    return _holiday_flag(out, holidays, date_col)


def calendar(dates: DataFrame, holidays=None, date_col: str = "date") -> DataFrame:
    """The ``calendar`` dimension: one row per distinct date."""
    return calendar_features(dates.select(date_col).distinct(), holidays, date_col)


# --------------------------------------------------------- 10. calendar_dummies
def calendar_dummies(df: DataFrame, month_col: str = "month", quarter_col: str = "quarter") -> DataFrame:
    """0/1 columns Month_2..Month_12 and Quarter_2..Quarter_4 over fixed levels
    (the first level is dropped whether or not it occurs)."""
    cols = [(F.col(month_col) == m).cast("int").alias(f"Month_{m}") for m in range(2, 13)]
    cols += [(F.col(quarter_col) == q).cast("int").alias(f"Quarter_{q}") for q in range(2, 5)]
    return df.select("*", *cols)


# --------------------------------------------------------------- 20. date_slice
def date_slice(df: DataFrame, as_of, date_col: str = "date") -> DataFrame:
    """Inclusive range from Jan 2 of as_of's year to as_of (empty on Jan 1)."""
    d = date_lit(as_of)
    start = F.make_date(F.year(d), F.lit(1), F.lit(2))
    return df.where(F.col(date_col).between(start, d))


# ------------------------------------------------------------ 21. point_in_time
def point_in_time(df: DataFrame, as_of, value_cols: Sequence[str], date_col: str = "date",
                  next_prefix: str = "next_") -> DataFrame:
    """The row of ``as_of`` and the next day's values (null when that day is absent);
    empty when as_of itself is absent. One filtered scan and one global aggregate,
    no join: the IN filter is pushed to the scan."""
    d = date_lit(as_of)
    nxt = F.date_add(d, 1)
    sub = df.where(F.col(date_col).isin(d, nxt))
    is_today = F.col(date_col) == d
    aggs = [F.max(F.when(is_today, F.lit(1))).alias("_has")]
    aggs += [F.max(F.when(is_today, F.col(c))).alias(c) for c in value_cols]
    aggs += [F.max(F.when(F.col(date_col) == nxt, F.col(c))).alias(next_prefix + c) for c in value_cols]
    out = sub.agg(*aggs).where(F.col("_has") == 1)
    return out.select(d.alias(date_col), *value_cols, *[next_prefix + c for c in value_cols])


# ------------------------------------------------------------------ 48. densify
def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (a global aggregate) to every row.
    The right side is exactly one row, so broadcasting it is size-safe."""
    return df.join(F.broadcast(one_row), on=F.lit(True), how="inner")


def only_row(df: DataFrame) -> DataFrame:
    """df if it is exactly one row, by a global aggregate; none or several rows fail."""
    n = F.count(F.lit(1))
    message = F.concat(F.lit("expected exactly one row, got "), n.cast("string"))
    row = F.when(n == 1, F.first(F.struct(*df.columns))).otherwise(F.raise_error(message))
    return df.agg(row.alias("_row")).select("_row.*")


def densify(sales: DataFrame, keys: Sequence[str] = ("item",), values: Sequence[str] = ("qty",),
            attrs: Sequence[str] = (), key_table: DataFrame | None = None, span: str = "global",
            date_col: str = "date", fill: Column | int = 0, partitions: int | None = None,
            between: tuple | None = None) -> DataFrame:
    """One row per (day, key) with absent values = ``fill``; several rows of one day and key are added up.

    span='global': every key runs over the overall first..last day (the daily file's
    implicit shape); span='key': each key over its own first..last day; ``between`` gives the first and last day
    instead (dates or columns; days outside are dropped). Rows without a date take no part. A given ``key_table``
    restricts the keys (values of other keys are dropped) and adds those without any row.

    Plan: gap runs. A partial aggregate by (key, day) comes first, so event-level input of a hot key spreads over tasks
    and shrinks to a row a day before anything is ordered. Then each present day looks at the key's next one (``lead``)
    and generates the run up to it: the day itself with its values, the days of the gap with ``fill``; the key's first
    day also generates the days before it. No day grid is joined or unioned. The result is hash-partitioned by the
    key, which every per-key window and keyed fold downstream reuses without another shuffle. ``attrs`` are columns
    that depend on the key only (e.g. dish, channel) and are carried along."""
    keys, attrs = list(keys), list(attrs)
    if span not in ("global", "key"):
        raise ValueError("span must be 'global' or 'key'")
    vtypes = {v: sales.schema[v].dataType for v in values}
    fill_c = fill if isinstance(fill, Column) else F.lit(fill)
    src = sales.where(F.col(date_col).isNotNull())
    if between is not None:
        first, last = (d if isinstance(d, Column) else date_lit(d) for d in between)
        src = src.where(F.col(date_col).between(first, last))
    daily = src.groupBy(*keys, *attrs, date_col).agg(*[F.coalesce(F.sum(v), fill_c).cast(vtypes[v]).alias(v) for v in values])
    if key_table is not None:
        daily = key_table.select(*keys, *[a for a in attrs if a in key_table.columns]).distinct().join(
            daily.drop(*[a for a in attrs if a in key_table.columns]), keys, "left")
    if between is not None:
        daily = daily.withColumn("_lo", first).withColumn("_hi", last)
    elif span == "global":
        daily = attach_row(daily, src.agg(F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi")))
    else:
        daily = daily.withColumn("_lo", F.col(date_col)).withColumn("_hi", F.col(date_col))
    if partitions:
        daily = daily.repartition(partitions, *keys)
    w = Window.partitionBy(*keys).orderBy(date_col)
    day = F.col(date_col)
    starts = F.when(F.lag(day).over(w).isNull(), F.coalesce(F.least("_lo", day), "_lo")).otherwise(day)
    runs = daily.withColumn("_from", starts).withColumn("_to", F.coalesce(F.date_sub(F.lead(day).over(w), 1), "_hi"))
    run = F.when(F.col("_from") <= F.col("_to"), F.sequence("_from", "_to", F.expr("INTERVAL 1 DAY")))
    out = runs.select(*keys, *attrs, day.alias("_day"), *values, F.explode(run).alias("_each"))
    return out.select(F.col("_each").alias(date_col), *keys, *attrs,
                      *[F.when(F.col("_each") == F.col("_day"), F.col(v)).otherwise(fill_c.cast(vtypes[v])).alias(v) for v in values])

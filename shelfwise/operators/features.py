"""Feature operators 11-18, 25 and the window features 43-47.

Windows are partitioned by the series key (``item``) and ordered by ``date``; all
frames of one key share a single sort. Row frames equal day frames only on a
gap-free series, so callers run them on :func:`shelfwise.operators.calendar.densify`
output. Per-date features are aggregates by ``date``; the "previous row" of a
per-date series is the previous calendar day, found by an equi-join on the shifted
date (no unpartitioned window).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.exprs import flag


def _series_window(keys: Sequence[str], date_col: str = "date"):
    return Window.partitionBy(*keys).orderBy(date_col)


# -------------------------------------------------------- 11. total_daily_sales
def total_daily_sales(sales: DataFrame, value: str = "qty", date_col: str = "date",
                      out: str = "total_daily_sales") -> DataFrame:
    """Sum of all item quantities per day, null counted as 0 (0 for a day of nulls)."""
    return sales.groupBy(date_col).agg(F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias(out))


# ------------------------------------------------------------- 12. course_flags
def course_flags(sales: DataFrame, item_type: DataFrame, on: str = "dish",
                 date_col: str = "date", value: str = "qty") -> DataFrame:
    """has_side / has_starter per day: 1 when any item of the type has a non-null value
    that day (a recorded zero counts, as in the original)."""
    t = sales.join(item_type.select(on, "type"), on, "left")
    seen = F.col(value).isNotNull()
    return t.groupBy(date_col).agg(
        F.max(flag((F.col("type") == "Side") & seen)).alias("has_side"),
        F.max(flag((F.col("type") == "Starter") & seen)).alias("has_starter"))


# ------------------------------------------------------- 13. season_interactions
def season_interactions(df: DataFrame, value: str = "qty") -> DataFrame:
    """qty*month, qty*quarter, qty*is_holiday (needs calendar columns)."""
    v = F.col(value)
    return (df.withColumn("month_interaction", v * F.col("month"))
              .withColumn("quarter_interaction", v * F.col("quarter"))
              .withColumn("holiday_interaction", v * F.col("is_holiday")))


# ------------------------------------------------------ 14. weekend_interaction
def weekend_interaction(df: DataFrame, items, value: str = "qty", item_col: str = "item") -> DataFrame:
    """is_weekend*qty for the given item group only (list, or a frame of items)."""
    if isinstance(items, DataFrame):
        sel = df.join(items.select(item_col).distinct(), item_col, "left_semi")
    else:
        sel = df.where(F.col(item_col).isin(list(items)))
    return sel.withColumn("weekend_interaction", F.col("is_weekend") * F.col(value))


# ----------------------------------------------------- 15. weather_interactions
def weather_interactions(days: DataFrame, weather: DataFrame, date_col: str = "date") -> DataFrame:
    """temp*is_holiday and is_saturday*precipitation per day; weather is left-joined
    (days without weather give null)."""
    w = days.join(weather, date_col, "left")
    sat = flag(F.col("dow") == "Saturday")
    return (w.withColumn("temp_holiday_interaction", F.col("temp_avg") * F.col("is_holiday"))
             .withColumn("precipitation_saturday_interaction", sat * F.col("precipitation")))


# ------------------------------------------------------------ 16. side_saturday
def side_saturday(sales: DataFrame, item_type: DataFrame, on: str = "dish",
                  date_col: str = "date", value: str = "qty") -> DataFrame:
    """is_saturday * (sum of Side items' quantities that day; absent = 0)."""
    t = sales.join(item_type.select(on, "type"), on, "left")
    side = F.coalesce(F.sum(F.when(F.col("type") == "Side", F.col(value))), F.lit(0))
    sat = flag(F.date_format(date_col, "EEEE") == "Saturday")
    return (t.groupBy(date_col).agg(side.alias("_side"))
             .select(date_col, (sat * F.col("_side")).cast("bigint").alias("side_saturday_interaction")))


# --------------------------------------------------------- 17. low_demand_flag
def low_demand_flag(dense: DataFrame, items: Sequence[str], mode: str = "any_today",
                    date_col: str = "date", value: str = "qty", item_col: str = "item") -> DataFrame:
    """any_today: 1 when any watched item sold 0 that day (training form).
    all_yesterday: 1 when all watched items sold 0 on the previous day; the first day
    uses itself (serving form, which clamps the previous row to the first)."""
    w = dense.where(F.col(item_col).isin(list(items)))
    zero = flag(F.col(value) == 0)
    if mode == "any_today":
        return w.groupBy(date_col).agg(F.max(zero).alias("low_demand"))
    if mode != "all_yesterday":
        raise ValueError("mode must be 'any_today' or 'all_yesterday'")
    daily = w.groupBy(date_col).agg(F.min(zero).alias("_all0"))
    prev = daily.select(F.date_add(date_col, 1).alias(date_col), F.col("_all0").alias("_prev"))
    first = daily.agg(F.min(date_col).alias("_first"))
    out = daily.join(prev, date_col, "left")
    from shelfwise.operators.calendar import attach_row
    out = attach_row(out, first)
    return out.select(date_col, F.when(F.col(date_col) == F.col("_first"), F.col("_all0"))
                      .otherwise(F.coalesce(F.col("_prev"), F.lit(0))).alias("low_demand"))


# --------------------------------------------------------- 18. drop_incomplete
def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any null (optionally only in ``subset``)."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)


# --------------------------------------------------------- 25. assemble_features
def assemble_features(blocks: Sequence[DataFrame | Callable[[DataFrame], DataFrame]], on: Sequence[str] = ("date", "item"),
                      how: str = "inner") -> DataFrame:
    """Feature blocks side by side by key (the positional concat made explicit). The first block is a frame. A further one
    is a frame, joined by key, or a function that adds its columns to what there is so far: blocks derived from the same
    series need no join and share its partitioning."""
    out = blocks[0]
    for b in blocks[1:]:
        out = out.join(b, list(on), how) if isinstance(b, DataFrame) else b(out)
    return out


def day_features(dense: DataFrame, item_type: DataFrame | None = None, watched: Sequence[str] = (),
                 on: str = "dish", date_col: str = "date", value: str = "qty", item_col: str = "item") -> DataFrame:
    """The per-day features of 11, 12, 16 and 17 from one aggregate by day: total_daily_sales, has_side, has_starter,
    side_total (what 16 counts on Saturdays) and low_demand (any watched item at 0)."""
    t = dense.join(item_type.select(on, "type"), on, "left") if item_type is not None else dense.withColumn("type", F.lit(None).cast("string"))
    v, side = F.col(value), F.col("type") == "Side"
    zero = F.col(item_col).isin(list(watched)) & (v == 0) if watched else F.lit(False)
    return t.groupBy(date_col).agg(
        F.coalesce(F.sum(v), F.lit(0)).alias("total_daily_sales"), F.max(flag(side & v.isNotNull())).alias("has_side"),
        F.max(flag((F.col("type") == "Starter") & v.isNotNull())).alias("has_starter"),
        F.coalesce(F.sum(F.when(side, v)), F.lit(0)).alias("side_total"), F.max(flag(zero)).alias("low_demand"))


# -------------------------------------------------------------------- 43. lags
def lags(df: DataFrame, value: str = "qty", ks: Mapping[int, Sequence[str] | None] | Sequence[int] = (1,),
         keys: Sequence[str] = ("item",), date_col: str = "date", edge: str = "null",
         item_col: str = "item", prefix: str | None = None) -> DataFrame:
    """``lag_k`` of ``value`` per series. ``ks`` maps k -> item group (None = all items);
    other items get null. edge='null' leaves the first k rows null (training); 'clamp'
    uses the series' first value there (serving takes row max(0, i-k))."""
    spec = _series_window(keys, date_col)
    if not isinstance(ks, Mapping):
        ks = {k: None for k in ks}
    first = F.first(value).over(spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    pfx = prefix or f"{value}_lag"
    out = df
    for k, group in sorted(ks.items()):
        lag_c = F.lag(value, k).over(spec)
        if edge == "clamp":
            lag_c = F.when(F.row_number().over(spec) > k, lag_c).otherwise(first)
        elif edge != "null":
            raise ValueError("edge must be 'null' or 'clamp'")
        if group is not None:
            lag_c = F.when(F.col(item_col).isin(list(group)), lag_c)
        out = out.withColumn(f"{pfx}{k}", lag_c)
    return out


# -------------------------------------------------------- 44. dow_rolling_mean
def dow_rolling_mean(df: DataFrame, n: int = 6, value: str = "qty", keys: Sequence[str] = ("item",),
                     dow_col: str = "dow", date_col: str = "date", out: str = "dow_avg",
                     exclude_current: bool = False) -> DataFrame:
    """Mean of the last n same-weekday rows including the current one (min 1 row).
    exclude_current=True ends the frame at the previous same-weekday row (forecasting)."""
    spec = Window.partitionBy(*keys, dow_col).orderBy(date_col)
    frame = spec.rowsBetween(-n, -1) if exclude_current else spec.rowsBetween(-(n - 1), 0)
    return df.withColumn(out, F.avg(value).over(frame))


# -------------------------------------------------------------------- 45. trend
def trend(df: DataFrame, days: Sequence[int] = (7, 14, 21), value: str = "qty",
          keys: Sequence[str] = ("item",), date_col: str = "date",
          exclude_current: bool = False) -> DataFrame:
    """Trailing row means including the current row (min 1 row); one shared sort."""
    spec = _series_window(keys, date_col)
    out = df
    for n in days:
        frame = spec.rowsBetween(-n, -1) if exclude_current else spec.rowsBetween(-(n - 1), 0)
        out = out.withColumn(f"trend_{n}", F.avg(value).over(frame))
    return out


def dow_profile_columns(df: DataFrame, year: int, value: str = "qty", keys: Sequence[str] = ("item",),
                        dow_col: str = "dow", date_col: str = "date") -> DataFrame:
    """Training-year weekday mean and sample std attached to every row as window
    aggregates over (key, weekday): no join and, on a key-partitioned series, no
    shuffle (a lookup table would be joined on (key, weekday) and reshuffle the series)."""
    w = Window.partitionBy(*keys, dow_col)
    v = F.when(F.year(date_col) == year, F.col(value))
    return df.withColumn("dow_mean", F.avg(v).over(w)).withColumn("dow_std", F.stddev_samp(v).over(w))


def _with_profile(df: DataFrame, profile, value: str, keys: Sequence[str], dow_col: str) -> DataFrame:
    """``profile`` is a (key, weekday) statistics frame (joined) or a training year
    (window aggregates); returns df with ``_m`` and ``_s``."""
    if isinstance(profile, DataFrame):
        p = profile.select(*keys, dow_col, F.col("dow_mean").alias("_m"), F.col("dow_std").alias("_s"))
        return df.join(p, [*keys, dow_col], "left")
    out = dow_profile_columns(df, int(profile), value, keys, dow_col)
    return out.withColumnRenamed("dow_mean", "_m").withColumnRenamed("dow_std", "_s")


# ------------------------------------------------------- 46. sales_ratio_dow
def sales_ratio_dow(df: DataFrame, profile, value: str = "qty",
                    keys: Sequence[str] = ("item",), dow_col: str = "dow",
                    zero_mean: str = "raw", profile_value: str | None = None) -> DataFrame:
    """qty / training-year weekday mean. zero_mean='raw' (training): a mean of 0
    divides by 1 and no mean gives 1.0; 'one' (serving): a mean of 0 gives 1.0 and
    no mean divides by 1. ``profile``: statistics frame, or the training year."""
    j = _with_profile(df, profile, profile_value or "qty", keys, dow_col)
    v = F.col(value).cast("double")
    if zero_mean == "raw":
        r = F.coalesce(v / F.when(F.col("_m") == 0, F.lit(1.0)).otherwise(F.col("_m")), F.lit(1.0))
    elif zero_mean == "one":
        # serving: a missing weekday mean divides by 1, a mean of 0 gives 1.0
        r = F.when(F.col("_m") == 0, F.lit(1.0)).otherwise(v / F.coalesce(F.col("_m"), F.lit(1.0)))
    else:
        raise ValueError("zero_mean must be 'raw' or 'one'")
    return j.withColumn("sales_ratio_dow", r).drop("_m", "_s")


# -------------------------------------------------------- 47. dow_std_feature
def dow_std_feature(df: DataFrame, profile, keys: Sequence[str] = ("item",),
                    dow_col: str = "dow", value: str = "qty") -> DataFrame:
    """Training-year weekday sample std per row, missing -> 0. ``profile``: statistics
    frame, or the training year."""
    j = _with_profile(df, profile, value, keys, dow_col)
    return j.withColumn("dow_std", F.coalesce(F.col("_s"), F.lit(0.0))).drop("_m", "_s")

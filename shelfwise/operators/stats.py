"""Aggregation operators: 22 map_stats, 29-35 statistics and accuracy, 42 table_profile,
51 standardize.

All are hash aggregates with map-side partial aggregation. Statistic tables are keyed
by (item[, weekday]); their joins back to the series are left to AQE, which
broadcasts them only when their runtime size is under the threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.constants import DEFAULT_PRICE
from shelfwise.operators.calendar import attach_row


def _in_year(df: DataFrame, year: int | None, date_col: str) -> DataFrame:
    return df if year is None else df.where(F.year(date_col) == year)


# ------------------------------------------------------------------ 22. map_stats
def map_stats(df: DataFrame, stats: DataFrame, on: Sequence[str], cols: Sequence[str],
              default=0.0) -> DataFrame:
    """Look up per-key statistics for each row; a missing key gives ``default``."""
    s = stats.select(*on, *[F.col(c).alias(f"_st_{c}") for c in cols])
    j = df.join(s, list(on), "left")
    for c in cols:
        j = j.withColumn(c, F.coalesce(F.col(f"_st_{c}"), F.lit(default))).drop(f"_st_{c}")
    return j


# ----------------------------------------------------------------- 29. item_stats
def item_stats(df: DataFrame, year: int | None = None, value: str = "qty",
               keys: Sequence[str] = ("item",), date_col: str = "date") -> DataFrame:
    """Mean and sample std per item (over one year when given)."""
    return (_in_year(df, year, date_col).groupBy(*keys)
            .agg(F.avg(value).alias("avg_qty"), F.stddev_samp(value).alias("std_qty")))


# --------------------------------------------------------------- 30. stable_items
def stable_items(stats: DataFrame, max_avg: float = 3.0, max_std: float = 1.5) -> DataFrame:
    """Items with avg < max_avg and std < max_std (a HAVING on the statistics)."""
    return stats.where((F.col("avg_qty") < max_avg) & (F.col("std_qty") < max_std))


# ---------------------------------------------------------------- 31. dow_profile
def dow_profile(df: DataFrame, year: int | None = None, value: str = "qty",
                keys: Sequence[str] = ("item",), dow_col: str = "dow", date_col: str = "date") -> DataFrame:
    """Mean and sample std per (item, weekday), over one year when given."""
    return (_in_year(df, year, date_col).groupBy(*keys, dow_col)
            .agg(F.avg(value).alias("dow_mean"), F.stddev_samp(value).alias("dow_std")))


# ----------------------------------------------------------------- 32. unit_price
def unit_price(sales: DataFrame, dish_item: DataFrame, default: float = DEFAULT_PRICE, site: Sequence[str] = ()) -> DataFrame:
    """Per dish sum(revenue)/sum(qty) over its items whose total quantity is > 0;
    ``default`` when none. Money stays DECIMAL until the final division. ``site`` names further key columns of both
    frames: a site's own prices."""
    keys = [*site, "dish"]
    per_item = (sales.groupBy(*keys, "item")
                .agg(F.sum("revenue").alias("_rev"), F.sum("qty").alias("_q"))
                .where(F.col("_q") > 0))
    per_dish = per_item.groupBy(*keys).agg(F.sum("_rev").alias("_rev"), F.sum("_q").alias("_q"))
    dishes = dish_item.select(*keys).distinct()
    price = F.try_divide(F.col("_rev").cast("double"), F.col("_q").cast("double"))
    return (dishes.join(per_dish, keys, "left")
            .select(*keys, F.coalesce(price, F.lit(float(default))).alias("price")))


# ----------------------------------------------------------- 33. accuracy_by_item
def accuracy_by_item(pairs: DataFrame, actual: str = "actual", pred: str = "pred",
                     keys: Sequence[str] = ("item",)) -> DataFrame:
    """RMSE, MAE and R² per item. Constant actuals: R² = 1 if perfect else 0."""
    e = F.col(pred).cast("double") - F.col(actual).cast("double")
    g = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(e * e).alias("_sse"), F.avg(F.abs(e)).alias("mae"),
        (F.var_pop(F.col(actual).cast("double")) * F.count(F.lit(1))).alias("_sst"))
    r2 = (F.when(F.col("_sst") == 0, F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(F.lit(1.0) - F.col("_sse") / F.col("_sst")))
    return g.select(*keys, F.sqrt(F.col("_sse") / F.col("_n")).alias("rmse"), "mae", r2.alias("r2"))


# ------------------------------------------------------------- 34. accuracy_macro
def accuracy_macro(by_item: DataFrame) -> DataFrame:
    """Unweighted mean of the per-item metrics."""
    return by_item.agg(F.avg("rmse").alias("avg_rmse"), F.avg("mae").alias("avg_mae"),
                       F.avg("r2").alias("avg_r2"), F.count(F.lit(1)).alias("n_items"))


# --------------------------------------------------------------- 35. bias_factors
def bias_factors(pairs: DataFrame, actual: str = "actual", pred: str = "pred",
                 keys: Sequence[str] = ("item",)) -> DataFrame:
    """avg(actual)/avg(pred) per item; 1.0 when the mean prediction is <= 0."""
    g = pairs.groupBy(*keys).agg(F.avg(actual).alias("_a"), F.avg(pred).alias("_p"))
    return g.select(*keys, F.when(F.col("_p") > 0, F.col("_a") / F.col("_p"))
                    .otherwise(F.lit(1.0)).alias("bias_factor"))


# -------------------------------------------------------------- 42. table_profile
def table_profile(df: DataFrame, date_col: str = "date", dow_col: str = "dow",
                  key: str = "item", train: DataFrame | None = None, test: DataFrame | None = None,
                  feature_cols: Sequence[str] = ()) -> DataFrame:
    """One row: row count, column count, distinct weekdays, days and keys of the table, and the shapes of the training
    and test sets (rows of ``train`` and ``test`` by the feature columns that they really have).

    One aggregate: weekdays and days are sets that the calendar bounds; only the keys need a distinct aggregate."""
    named = {"n_weekdays": dow_col, "n_days": date_col}
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.size(F.collect_set(c)).cast("bigint").alias(n) for n, c in named.items() if c in df.columns]
    if key in df.columns:
        aggs.append(F.count_distinct(key).alias("n_keys"))
    out = df.agg(*aggs).withColumn("n_columns", F.lit(len(df.columns)))
    for label, part in (("train", train), ("test", test)):
        if part is not None:
            out = attach_row(out, part.agg(F.count(F.lit(1)).alias(f"{label}_rows")))
            out = out.withColumn(f"{label}_features", F.lit(sum(c in part.columns for c in feature_cols)))
    return out


# ---------------------------------------------------------------- 51. standardize
def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: mean (_mu0, ...) and population std (_sd0, ...) of each column."""
    return df.agg(*[F.avg(c).alias(f"_mu{i}") for i, c in enumerate(cols)],
                  *[F.stddev_pop(c).alias(f"_sd{i}") for i, c in enumerate(cols)])


def standardize(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None,
                suffix: str = "") -> DataFrame:
    """z-score with mean and population std fitted on ``fit`` (default ``df``); a
    constant column divides by 1. The fitted statistics are one row (a global aggregate), attached by a
    one-row broadcast. As a pipeline stage: :class:`shelfwise.operators.pipeline.Standardizer`."""
    out = attach_row(df, moments(df if fit is None else fit, cols))
    scaled = {c + suffix: (F.col(c) - F.col(f"_mu{i}")) / F.when(F.col(f"_sd{i}") == 0, F.lit(1.0)).otherwise(F.col(f"_sd{i}"))
              for i, c in enumerate(cols)}
    return out.withColumns(scaled).drop(*[f"_{m}{i}" for m in ("mu", "sd") for i in range(len(cols))])

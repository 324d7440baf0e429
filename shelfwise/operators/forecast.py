"""Forecasting: 19 split_by_year, 24 forecast_vs_actual, 52 fit_forest, 53 fit_boosted,
54 predict, 55 blend, 56 apply_bias, plus the feature matrix shared by training and
scoring.

The original fits one multi-output model over a wide day row. Spark ML regressors are
single-output, so the model here is pooled over the long (date, item) table with the
item as its training-year mean and deviation: one model scores every item and day in one
``transform``. The training matrix is checkpointed once into the shared folder and
reused by both learners.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.constants import BLEND_WEIGHTS, BOOSTING, DEFAULT_BIAS, FOREST, FOREST_ENGINE, WEEKDAYS
from shelfwise.functions.exprs import flag
from shelfwise.operators.calendar import calendar_dummies, calendar_features
from shelfwise.operators.features import (
    day_features, dow_rolling_mean, dow_std_feature, drop_incomplete, lags, sales_ratio_dow, season_interactions, trend)


# -------------------------------------------------------------- 19. split_by_year
def split_by_year(df: DataFrame, train: int, test: int, date_col: str = "date") -> DataFrame:
    """Rows of the training and test years, labelled 'train' / 'test'."""
    y = F.year(date_col)
    return (df.where(y.isin(train, test))
            .withColumn("split", F.when(y == train, F.lit("train")).otherwise(F.lit("test"))))


# --------------------------------------------------------- 24. forecast_vs_actual
def forecast_vs_actual(fc: DataFrame, act: DataFrame, keys: Sequence[str] = ("date", "item"),
                       pred: str = "pred", actual: str = "qty") -> DataFrame:
    """Forecast and actual aligned by (date, item)."""
    return (fc.select(*keys, F.col(pred).alias("pred"))
            .join(act.select(*keys, F.col(actual).alias("actual")), list(keys), "inner"))


def same_weekday_forecast(dense: DataFrame, weeks: int = 6, value: str = "qty",
                          keys: Sequence[str] = ("item",), out: str = "pred") -> DataFrame:
    """Baseline forecast: mean of the previous ``weeks`` same-weekday values (the
    current day excluded), 0 before any history."""
    d = dense if "dow" in dense.columns else dense.withColumn("dow", F.date_format("date", "EEEE"))
    f = dow_rolling_mean(d, weeks, value, keys, "dow", "date", out="_f", exclude_current=True)
    return f.withColumn(out, F.coalesce(F.col("_f"), F.lit(0.0))).drop("_f")


# ------------------------------------------------------------- feature matrix
WEATHER = ["temp_avg", "precipitation", "windspeed", "humidity"]
DAY_COLUMNS = ["total_daily_sales", "has_side", "has_starter", "low_demand"]
# scaled before the learners see them, as in the original; lags, flags and dummies are not
CONTINUOUS = ["sales_ratio_dow", "dow_avg", "trend_7", "trend_14", "trend_21", "dow_std", "month_interaction", "quarter_interaction",
              "holiday_interaction", "weekend_interaction", *WEATHER, "total_daily_sales", "temp_holiday_interaction",
              "temp_avg_lag1", "precipitation_lag1", "precipitation_saturday_interaction", "item_mean", "item_std"]
PLAIN = ["qty_lag1", "qty_lag2", "qty_lag3", "qty_lag4", "qty_lag5", "side_saturday_interaction", "has_side", "has_starter",
         "low_demand", "is_weekend", "is_holiday", *[f"dow_{d}" for d in WEEKDAYS if d != "Wednesday"],
         *[f"Month_{m}" for m in range(2, 13)], *[f"Quarter_{q}" for q in range(2, 5)]]
FEATURE_COLUMNS = CONTINUOUS + PLAIN


def norm_columns(weather: DataFrame) -> list[str]:
    """The precomputed ``_norm`` twins that a weather table brings along."""
    return [c + "_norm" for c in WEATHER if c + "_norm" in weather.columns]


def feature_matrix(dense: DataFrame, weather: DataFrame, holidays, train_year: int,
                   lag_groups: dict | None = None, as_of_lag: int = 1, item_type: DataFrame | None = None,
                   high_demand: Sequence[str] = (), watched: Sequence[str] = ()) -> DataFrame:
    """All features of the original in one chain over the dense (date, item) series, one row per day and item.

    ``as_of_lag=1`` moves every feature that would see the target day to what is known the day before (the original's
    frames include the label): ratio and interactions to the previous day, means and trends to the rows before, day
    totals and flags to the previous day, the Saturday side sales to the last same weekday. The weather of the
    target day counts as forecast. Lags of items outside their group are 0, as the original has no such
    column. A row that lacks anything else keeps its nulls: :func:`complete_rows` drops it.

    The day-level features are gathered in one small table by date and joined once."""
    base = calendar_features(dense, holidays)
    groups = lag_groups or {1: None, 2: None, 3: None, 4: None, 5: None}
    f = lags(base, "qty", groups)
    outside = {f"qty_lag{k}": F.when(~F.col("item").isin(list(g)), F.lit(0)).otherwise(F.col(f"qty_lag{k}")) for k, g in groups.items() if g is not None}
    f = f.withColumns(outside | {f"qty_lag{k}": F.lit(0) for k in range(1, 6) if k not in groups})
    f = sales_ratio_dow(f, train_year)      # weekday profile as window aggregates
    f = dow_std_feature(f, train_year)
    # means of the target's own weekday, without the target itself
    f = dow_rolling_mean(f, 6, exclude_current=bool(as_of_lag))
    f = trend(f, (7, 14, 21), exclude_current=bool(as_of_lag))
    f = season_interactions(f)
    f = f.withColumn("weekend_interaction", F.when(F.col("item").isin(list(high_demand)), F.col("is_weekend") * F.col("qty")).otherwise(F.lit(0)))
    if as_of_lag:  # a known day's ratio (by its own weekday) and interactions, moved to the target
        for c in ("sales_ratio_dow", "month_interaction", "quarter_interaction", "holiday_interaction", "weekend_interaction"):
            f = lags(f, c, {as_of_lag: None}, prefix="_known").withColumn(c, F.col(f"_known{as_of_lag}")).drop(f"_known{as_of_lag}")
    # the item by its training-year statistics: any number of items
    of_year = F.when(F.year("date") == train_year, F.col("qty"))
    own = Window.partitionBy("item")
    f = f.withColumn("item_mean", F.coalesce(F.avg(of_year).over(own), F.lit(0.0))).withColumn(
        "item_std", F.coalesce(F.stddev_samp(of_year).over(own), F.lit(0.0)))
    f = calendar_dummies(f).withColumns({f"dow_{d}": flag(F.col("dow") == d) for d in WEEKDAYS if d != "Wednesday"})

    of_day = day_features(dense, item_type, watched)
    norms = norm_columns(weather)
    w = weather.select("date", *WEATHER, *norms)

    def moved(df: DataFrame, days: int, **cols: str) -> DataFrame:
        return df.select(F.date_add("date", days).alias("date"), *[F.col(c).cast("double").alias(n) for n, c in cols.items()])

    known = [w, moved(w, 1, temp_avg_lag1="temp_avg", precipitation_lag1="precipitation"),
             moved(of_day, as_of_lag, **{c: c for c in DAY_COLUMNS}), moved(of_day, 7 * as_of_lag, side_total="side_total")]
    days = known[0]
    for part in known[1:]:
        days = days.unionByName(part, allowMissingColumns=True)
    days = days.groupBy("date").agg(*[F.max(c).alias(c) for c in days.columns if c != "date"])  # a row for each day
    f = f.join(days, "date", "left")
    saturday = flag(F.col("dow") == "Saturday")
    return f.withColumns({"temp_holiday_interaction": F.col("temp_avg") * F.col("is_holiday"),
                          "precipitation_saturday_interaction": saturday * F.col("precipitation"),
                          "side_saturday_interaction": saturday * F.col("side_total")}).drop("side_total")


def complete_rows(matrix: DataFrame, features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """The rows that have every feature (18): those before the first lags and without weather go."""
    return drop_incomplete(matrix, features)


def _prep_stages(features: Sequence[str]):
    """Scaler of the continuous features, then vector assembly. A null feature fails: rows are made complete before."""
    from pyspark.ml.feature import VectorAssembler

    from shelfwise.operators.pipeline import Standardizer
    scaler = Standardizer(inputCols=[c for c in features if c in CONTINUOUS or c.endswith("_norm")])
    names = dict(zip(scaler.getInputCols(), scaler.scaled_names()))
    return [scaler, VectorAssembler(inputCols=[names.get(c, c) for c in features], outputCol="features", handleInvalid="error")]


def _mb(size: str) -> int:
    units = {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1024 * 1024}
    s = size.strip().lower().rstrip("b")
    return int(float(s[:-1]) * units[s[-1]]) if s[-1] in units else int(s) // (1024 * 1024)


def forest_engine(spark) -> dict:
    """Split-statistics memory per task (``maxMemoryInMB``): about 30% of the heap that
    runs tasks, shared by its concurrent task slots, between 64 and 1024 MB. Larger
    groups mean fewer passes over the data; the bound keeps all slots inside the heap."""
    sc = spark.sparkContext
    conf = sc.getConf()
    if sc.master.startswith("local"):
        heap, slots = conf.get("spark.driver.memory", "1g"), sc.defaultParallelism
    else:
        heap, slots = conf.get("spark.executor.memory", "1g"), int(conf.get("spark.executor.cores", "1"))
    per_task = int(_mb(heap) * 0.3 / max(slots, 1))
    return {**FOREST_ENGINE, "maxMemoryInMB": max(64, min(1024, per_task))}


def _forest(spark, label: str, overrides: dict):
    from pyspark.ml.regression import RandomForestRegressor
    params = {**FOREST, **forest_engine(spark), **overrides}
    return RandomForestRegressor(featuresCol="features", labelCol=label, predictionCol="rf_pred", featureSubsetStrategy="all", **params)


def _boosted(label: str, overrides: dict):
    from pyspark.ml.regression import GBTRegressor
    return GBTRegressor(featuresCol="features", labelCol=label, predictionCol="gbt_pred", **{**BOOSTING, **overrides})


# ------------------------------------------------------------------ 52. fit_forest
def fit_forest(train: DataFrame, features: Sequence[str] = FEATURE_COLUMNS, label: str = "qty",
               **overrides):
    """Random forest (150 trees, depth 8, min 3 rows per leaf, seed 42) in a pipeline with its scaler."""
    from pyspark.ml import Pipeline
    return Pipeline(stages=[*_prep_stages(features), _forest(train.sparkSession, label, overrides)]).fit(train)


# ----------------------------------------------------------------- 53. fit_boosted
def fit_boosted(train: DataFrame, features: Sequence[str] = FEATURE_COLUMNS, label: str = "qty",
                **overrides):
    """Gradient-boosted trees (120 rounds, depth 4, step 0.03, 0.8 row and column
    sampling, seed 42) in a pipeline with its scaler."""
    from pyspark.ml import Pipeline
    return Pipeline(stages=[*_prep_stages(features), _boosted(label, overrides)]).fit(train)


def fit_all(train: DataFrame, override_items: Sequence[str] = (), features: Sequence[str] = FEATURE_COLUMNS, label: str = "qty",
            forest: dict | None = None, boosted: dict | None = None):
    """One pipeline from features to the corrected forecast: scaler, forest, boosting, blend, bias factors of the
    training rows. Fitted in one go: the scaled features are the same for both learners."""
    from pyspark.ml import Pipeline

    from shelfwise.operators.pipeline import BiasCorrection, Blend
    return Pipeline(stages=[*_prep_stages(features), _forest(train.sparkSession, label, forest or {}), _boosted(label, boosted or {}),
                            Blend(overrideItems=list(override_items)), BiasCorrection(labelCol=label)]).fit(train)


# --------------------------------------------------------------------- 54. predict
SCORES = ("rf_pred", "gbt_pred", "pred", "pred_adj")


def predict(models: Sequence, df: DataFrame, keep: Sequence[str] = ("date", "item", "qty")) -> DataFrame:
    """Score all days and items at once with each fitted pipeline: the kept columns and the scores that the
    pipelines make (rf_pred, gbt_pred, and from :func:`fit_all` pred and pred_adj)."""
    out = df
    for m in models:
        own = set(out.columns)
        scored = m.transform(out)
        out = scored.drop(*[c for c in scored.columns if c not in own and c not in SCORES])
    return out.select(*keep, *[c for c in SCORES if c in out.columns])


def same_scores(a, b, df: DataFrame, keep: Sequence[str] = ("date", "item", "qty")) -> DataFrame:
    """The kept columns, the scores of ``a`` and whether those of ``b`` are equal. Each row is scored by both in one pass
    over df: two scored tables are never joined."""
    own = {c: f"_a_{c}" for c in SCORES}
    first = predict([a], df, df.columns).withColumnsRenamed(own)
    names = [n for n in own.values() if n in first.columns]
    both = predict([b], first, [*keep, *names])
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(n[3:]))
    return both.select(*keep, *[F.col(n).alias(n[3:]) for n in names], same.alias("same_scores"))


# ----------------------------------------------------------------------- 55. blend
def blend(df: DataFrame, override_items: Sequence[str], rf: str = "rf_pred", gbt: str = "gbt_pred",
          weights: tuple[float, float] = BLEND_WEIGHTS, item_col: str = "item", out: str = "pred") -> DataFrame:
    """w_rf*rf + w_gbt*gbt; override items take the boosting score alone."""
    mix = F.col(rf) * weights[0] + F.col(gbt) * weights[1]
    return df.withColumn(out, F.when(F.col(item_col).isin(list(override_items)), F.col(gbt)).otherwise(mix))


# ------------------------------------------------------------------ 56. apply_bias
def apply_bias(fc: DataFrame, factors: DataFrame, default: float = DEFAULT_BIAS, floor: float = 0.0,
               pred: str = "pred", item_col: str = "item", out: str = "pred_adj") -> DataFrame:
    """Multiply by the item's bias factor (``default`` when it has none), clip at floor."""
    j = fc.join(factors.select(item_col, F.col("bias_factor").alias("_bf")), item_col, "left")
    v = F.col(pred) * F.coalesce(F.col("_bf"), F.lit(default))
    return j.withColumn(out, F.greatest(v, F.lit(float(floor)))).drop("_bf")

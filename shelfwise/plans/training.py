"""The training path over the test tables: feature matrix, one saved pipeline, learner forecasts, orders.

The matrix is written once and the pipeline fitted and saved once per application and input; every query after the first
loads them. Both live in the shared checkpoint folder, so a lost executor costs a re-read.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import forecast as fc
from shelfwise.operators import policy as po
from shelfwise.operators import stats as st
from shelfwise.operators import stock as sk
from shelfwise.plans import params as P
from shelfwise.plans.inputs import Inputs
from shelfwise.session import scratch_path
from shelfwise.sources import daily

ROWS_A_PARTITION = 2_500  # of the training rows: a layout that depends on the data, not on the cluster
SERIES_ROWS = 20_000  # of the sales per task of the feature windows; a whole item is the least that a task holds

_done: dict[tuple[str, str, str], str] = {}
_lock = threading.RLock()  # the pipeline is made from the matrix


def _once(spark: SparkSession, sf_dir: str, what: str, make) -> str:
    """The folder that ``make`` has written for this application and input, made at the first call."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    with _lock:
        if key not in _done:
            _done[key] = make()
        return _done[key]


def spread(dense: DataFrame, n_sales: int) -> DataFrame:
    """The dense series dealt by item over a number of tasks that grows with the sales. The adaptive plan merges small shuffle
    parts up to 64 MB, which the sorts of the feature windows multiply in the task's memory; a given number stays."""
    return dense.repartition(max(64, -(-n_sales // SERIES_ROWS)), "item")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complete rows of the feature matrix, every year, stored by year."""
    def make() -> str:
        i = Inputs(spark, sf_dir)
        m = fc.complete_rows(fc.feature_matrix(spread(i.dense, i.sales.count()), i.weather, i.holidays, P.TRAIN_YEAR, P.LAG_GROUPS, item_type=i.item_type,
                                               high_demand=P.HIGH_DEMAND, watched=P.WATCHED))
        path = scratch_path(spark, "matrix")
        m.select("date", "item", "dish", "qty", "year", *fc.FEATURE_COLUMNS).write.partitionBy("year").parquet(path)
        return path
    return spark.read.parquet(_once(spark, sf_dir, "matrix", make))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training year in a row layout that only the rows decide, so that the seeded draws repeat on any cluster."""
    train = matrix(spark, sf_dir).where(F.col("year") == P.TRAIN_YEAR)
    parts = max(1, -(-train.count() // ROWS_A_PARTITION))
    return train.repartition(parts, "item", "date").sortWithinPartitions("item", "date")


def saved_pipeline(spark: SparkSession, sf_dir: str, keep=None) -> str:
    """The folder of the fitted pipeline; ``keep`` gets the model in memory if this call fits it."""
    def make() -> str:
        train = training_rows(spark, sf_dir).persist()  # recomputable from the stored matrix
        model = fc.fit_all(train, P.HARD)
        path = daily.save_pipeline(model, scratch_path(spark, "pipeline"))
        train.unpersist()
        if keep is not None:
            keep.append(model)
        return path
    return _once(spark, sf_dir, "pipeline", make)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All complete rows with the saved pipeline's scores: date, item, dish, qty, rf_pred, gbt_pred, pred, pred_adj."""
    model = daily.load_pipeline(saved_pipeline(spark, sf_dir))
    return fc.predict([model], matrix(spark, sf_dir), ("date", "item", "dish", "qty"))


def learner_accuracy(scores: DataFrame, year: int = P.TEST_YEAR) -> DataFrame:
    """RMSE, MAE and R2 per item of the corrected forecast on the test year."""
    return st.accuracy_by_item(scores.where(F.year("date") == year), actual="qty", pred="pred_adj")


def learner_orders(i: Inputs, scores: DataFrame, as_of=P.AS_OF) -> DataFrame:
    """Forecast to order with the learners: corrected item forecasts of the day rolled up to dishes (23), buffers from the
    learners' own error (57), usable stock (36), order (27, 59)."""
    day = scores.where(F.col("date") == F.lit(as_of).cast("date"))
    forecast = sk.dish_rollup(day, values=("pred_adj",)).select("dish", "date", F.col("pred_adj").alias("forecast"))
    buffers = po.buffers_rmse(i.dish_item, st.item_stats(i.dense, P.TRAIN_YEAR), learner_accuracy(scores), P.OVERRIDE_A, P.OVERRIDE_B,
                              high=P.RMSE_BUFFER_HIGH)
    usable = sk.usable_stock(i.stock, as_of).withColumnRenamed("item", "dish")
    return po.order_quantity(po.order_inputs(forecast, buffers, usable))

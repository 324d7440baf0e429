"""Training path on a weekly series: every feature, row removal, one saved pipeline, forecasts better than the mean.

(On the test tables quantities are drawn independently, so nothing beats the training mean there: see the README.)"""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from conftest import SF001, rows
from shelfwise.operators import forecast as fc
from shelfwise.operators import stats as st
from shelfwise.operators.pipeline import Standardizer
from shelfwise.plans import training as tr
from shelfwise.plans.inputs import Inputs
from shelfwise.sources import daily, tables

START, DAYS, YEAR = dt.date(2021, 12, 1), 500, 2022
ITEMS = {"A1": ("A", "Main", 10), "B1": ("B", "Side", 30), "C1": ("C", "Starter", 5)}


def _qty(item, day):
    return ITEMS[item][2] + 4 * day.weekday() + (7 if day.weekday() == 5 else 0) + day.toordinal() % 3


@pytest.fixture(scope="module")
def matrix(spark):
    days = [START + dt.timedelta(days=k) for k in range(DAYS)]
    dense = spark.createDataFrame([(x, i, ITEMS[i][0], _qty(i, x)) for x in days for i in ITEMS], "date date, item string, dish string, qty long")
    weather = spark.createDataFrame([(x, float(x.day), float(x.day % 4), 3.0, 50.0, x.day / 31) for x in days if x.day != 13],
                                    "date date, temp_avg double, precipitation double, windspeed double, humidity double, temp_avg_norm double")
    types = spark.createDataFrame([(v[0], v[1]) for v in ITEMS.values()], "dish string, type string")
    holidays = spark.createDataFrame([(dt.date(2022, 12, 25),)], "date date")
    m = fc.feature_matrix(dense, weather, holidays, YEAR, {1: None, 2: ["B1"], 3: ["B1"]}, item_type=types, high_demand=["B1"], watched=["A1"])
    return m.cache()


def test_every_feature(matrix):
    day = dt.date(2022, 6, 11)  # a Saturday
    ago = lambda k: day - dt.timedelta(days=k)
    r = {x.item: x for x in matrix.where(F.col("date") == day).collect()}
    b = r["B1"]
    assert (b.qty_lag1, b.qty_lag2, b.qty_lag3, b.qty_lag4) == (_qty("B1", ago(1)), _qty("B1", ago(2)), _qty("B1", ago(3)), 0)
    assert r["A1"].qty_lag2 == 0  # outside the group
    assert b.total_daily_sales == sum(_qty(i, ago(1)) for i in ITEMS)
    assert b.side_saturday_interaction == _qty("B1", ago(7)) and (b.has_side, b.has_starter, b.low_demand) == (1, 1, 0)
    assert b.trend_7 == pytest.approx(sum(_qty("B1", ago(k)) for k in range(1, 8)) / 7)
    assert b.trend_21 == pytest.approx(sum(_qty("B1", ago(k)) for k in range(1, 22)) / 21)
    assert b.dow_avg == pytest.approx(sum(_qty("B1", ago(7 * k)) for k in range(1, 7)) / 6)
    of_year = [dt.date(2022, 1, 1) + dt.timedelta(days=k) for k in range(365)]
    fridays = [_qty("B1", x) for x in of_year if x.weekday() == 4]
    assert b.sales_ratio_dow == pytest.approx(_qty("B1", ago(1)) / (sum(fridays) / len(fridays)))
    assert b.month_interaction == 6 * _qty("B1", ago(1)) and b.quarter_interaction == 2 * _qty("B1", ago(1))
    assert b.weekend_interaction == 0  # the day before is a Friday
    sunday = matrix.where((F.col("date") == dt.date(2022, 6, 12)) & (F.col("item") == "B1")).first()
    assert sunday.weekend_interaction == _qty("B1", day) and sunday.side_saturday_interaction == 0
    assert (b.temp_avg, b.precipitation, b.temp_avg_lag1, b.precipitation_lag1, b.temp_avg_norm) == (11.0, 3.0, 10.0, 2.0, 11 / 31)
    assert b.precipitation_saturday_interaction == 3.0 and b.temp_holiday_interaction == 0.0
    assert (b.dow_Saturday, b.dow_Friday, b.Month_6, b.Month_7, b.Quarter_2, b.is_weekend) == (1, 0, 1, 0, 1, 1)
    assert b.item_mean == pytest.approx(sum(_qty("B1", x) for x in of_year) / 365)
    assert matrix.where((F.col("date") == dt.date(2022, 12, 25)) & (F.col("temp_holiday_interaction") != 25.0)).count() == 0


def test_incomplete_rows_go(matrix):
    whole = fc.complete_rows(matrix)
    got = {r.date for r in whole.select("date").distinct().collect()}
    want = {START + dt.timedelta(days=k) for k in range(7, DAYS)}
    assert got == {x for x in want if x.day not in (13, 14)}  # no weather, or none the day before
    assert whole.count() == 3 * len(got)


def _rmse(df, pred):
    return math.sqrt(df.select(F.avg((F.col(pred) - F.col("qty")) ** 2)).first()[0])


def test_one_saved_pipeline_beats_the_mean(spark, matrix, tmp_path):
    whole = fc.complete_rows(matrix)
    features = [*fc.FEATURE_COLUMNS, "temp_avg_norm"]
    train = whole.where(F.year("date") == YEAR).repartition(2, "item", "date").sortWithinPartitions("item", "date")
    test = whole.where(F.year("date") == YEAR + 1)
    fit = lambda: fc.fit_all(train, ["C1"], features, forest={"numTrees": 12}, boosted={"maxIter": 12, "stepSize": 0.3})
    model = fit()
    loaded = daily.load_pipeline(daily.save_pipeline(model, str(tmp_path / "p")))
    assert [type(s).__name__ for s in loaded.stages] == ["StandardizerModel", "VectorAssembler", "RandomForestRegressionModel", "GBTRegressionModel", "Blend", "BiasCorrectionModel"]
    a, b = (rows(fc.predict([x], test), "date", "item", *fc.SCORES) for x in (model, loaded))
    assert a == b and len(a) == test.count()
    # a factor is a mean of all training rows, summed in another order: equal to rounding
    assert rows(fc.predict([fit()], test), "date", "item", "rf_pred", "gbt_pred") == [r[:4] for r in a]
    scored = fc.predict([loaded], test).cache()
    item_mean = test.select("date", "item", "qty", "item_mean")
    assert _rmse(scored, "pred_adj") < 0.7 * _rmse(item_mean, "item_mean")
    assert scored.where((F.col("item") == "C1") & (F.col("pred") != F.col("gbt_pred"))).count() == 0
    mix = F.abs(F.col("pred") - (F.col("rf_pred") * 0.6 + F.col("gbt_pred") * 0.4)) > 1e-9
    assert scored.where((F.col("item") != "C1") & mix).count() == 0
    by_item = st.accuracy_by_item(scored, actual="qty", pred="pred_adj")
    assert by_item.count() == 3 and by_item.agg(F.min("r2")).first()[0] > 0.5


def test_standardizer_stage(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "a double, b double")
    model = Standardizer(inputCols=["a", "b"]).fit(df)
    want = rows(st.standardize(df, ["a", "b"], suffix="_z"), "a_z", "b_z")
    assert rows(model.transform(df), "a_z", "b_z") == want and want[0][1] == 0.0  # a constant column divides by 1
    path = str(tmp_path / "s")
    model.write().save(path)
    again = type(model).load(path)
    assert rows(again.transform(df), "a_z", "b_z") == want
    assert "Join" not in again.transform(df)._jdf.queryExecution().optimizedPlan().toString()


def test_two_models_score_in_one_pass(spark, matrix, tmp_path):
    fc.complete_rows(matrix).where(F.year("date") == YEAR).write.parquet(f"{tmp_path}/rows")
    train = spark.read.parquet(f"{tmp_path}/rows")
    model, other = (daily.load_pipeline(daily.save_pipeline(fc.fit_all(train, ["C1"], forest={"numTrees": n}, boosted={"maxIter": 1}), f"{tmp_path}/{n}"))
                    for n in (1, 2))
    same = fc.same_scores(model, daily.load_pipeline(f"{tmp_path}/1"), train)
    assert rows(same, "date", "item", *fc.SCORES) == rows(fc.predict([model], train), "date", "item", *fc.SCORES)
    assert same.where("not same_scores").count() == 0 and fc.same_scores(model, other, train).where("not same_scores").count() > 0
    plan = same._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and plan.count("Relation ") == 3  # those with the bias factors; the rows are read once


def test_series_are_dealt_over_tasks(spark, matrix):
    dealt = tr.spread(matrix.select("date", "item", "qty"), 1_500).withColumn("task", F.spark_partition_id())
    assert dealt.select("task").distinct().count() == len(ITEMS) and dealt.select("item", "task").distinct().count() == len(ITEMS)
    assert tr.spread(matrix.select("item"), 5_000_000).rdd.getNumPartitions() == 250  # more sales, more tasks


def test_orders_are_read_once_for_the_weather(spark):
    i = Inputs(spark, SF001)
    plan = i.weather.unionByName(i.weather)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan.lower()
    want = tables.weather(spark, SF001)
    assert i.weather.exceptAll(want).count() == want.exceptAll(i.weather).count() == 0

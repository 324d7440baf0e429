"""Stock at the as-of date, save folders, header and item checks, folder streams, many items."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF001, d, rows
from shelfwise.operators import forecast as fc
from shelfwise.operators import reshape as rs
from shelfwise.operators import stock as sk
from shelfwise.plans import params as P
from shelfwise.plans.catalog import QUERIES
from shelfwise.plans.inputs import Inputs
from shelfwise.sources import daily
from shelfwise.streaming.daily import event_stream


def test_lots_left_are_what_was_not_sold(spark):
    dl = spark.createDataFrame([(d("2023-01-01"), "x", 5), (d("2023-01-03"), "x", 4)], "date date, item string, qty bigint")
    dm = spark.createDataFrame([(d("2023-01-02"), "x", 3), (d("2023-01-04"), "x", 1)], "date date, item string, qty bigint")
    led = sk.stock_ledger(dl, dm, with_left=True)
    # day 4 sells one of the two left from day 1, which expires that day; four of day 3 stay
    assert rows(sk.lots_left(led, "2023-01-05")) == [("x", d("2023-01-04"), 1), ("x", d("2023-01-06"), 4)]


def test_registered_orders_are_real(spark):
    got = QUERIES["order_quantity"](spark, SF001).collect()
    assert any(r.order_qty > 0 for r in got)
    left = QUERIES["stock_on_hand"](spark, SF001).agg(F.max("days_left")).first()[0]
    assert left is None or left <= 3


def test_ledger_does_not_lean_on_inherited_partitioning(spark):
    i = Inputs(spark, SF001)
    want = sk.stock_ledger(i.deliveries, i.demand).agg(F.sum("waste")).first()[0]
    spark.conf.set("spark.sql.requireAllClusterKeysForDistribution", "true")
    try:
        got = sk.stock_ledger(i.deliveries, i.demand).agg(F.sum("waste")).first()[0]
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForDistribution")
    assert got == want


def test_two_saves_in_a_second_are_two_folders(spark, tmp_path):
    df = spark.range(3)
    assert daily.write_forecast(df, str(tmp_path)) != daily.write_forecast(df, str(tmp_path))


def test_scan_checks_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Day,B,A\n2023-01-01,1,2\n")
    with pytest.raises(ValueError, match="Date"):
        daily.scan_daily(spark, str(tmp_path / "a.csv"), "Date date, A int, B int")
    (tmp_path / "b.csv").write_text("Date,B,A\n2023-01-01,1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        daily.scan_daily(spark, str(tmp_path / "b.csv"), "Date date, A int, B int").collect()


def test_unknown_items_fail(spark):
    df = spark.createDataFrame([(d("2023-01-01"), "z", 1)], "date date, item string, qty bigint")
    with pytest.raises(Exception, match="outside the given list"):
        rs.pivot_items(df, "qty", ["x"]).collect()


def test_stream_reads_folder_and_file(spark, tmp_path):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    ev.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for where in (str(tmp_path), SF001):
        q = (event_stream(spark, where).writeStream.format("memory").queryName("folder_or_file")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        assert spark.table("folder_or_file").count() == ev.count()


def test_features_use_the_targets_weekday_and_any_number_of_items(spark):
    start = dt.date(P.TRAIN_YEAR, 1, 4)  # a Monday
    data = [(start + dt.timedelta(days=k), f"i{n}", 10 * (k % 7 + 1)) for n in range(80) for k in range(70)]
    dense = spark.createDataFrame(data, "date date, item string, qty bigint")
    weather = spark.createDataFrame([(start + dt.timedelta(days=k), 1.0, 1.0, 1.0, 1.0) for k in range(70)],
                                    "date date, temp_avg double, precipitation double, windspeed double, humidity double")
    holidays = spark.createDataFrame([], "date date")
    m = fc.complete_rows(fc.feature_matrix(dense, weather, holidays, P.TRAIN_YEAR)).cache()
    tuesday = m.where((F.col("item") == "i0") & (F.col("date") == start + dt.timedelta(days=36))).first()
    assert tuesday.dow_avg == 20.0 and tuesday.sales_ratio_dow == 1.0 and tuesday.qty_lag1 == 10
    model = fc.fit_forest(m, numTrees=5)
    got = fc.predict([model], m)
    assert got.agg(F.avg(F.abs(F.col("rf_pred") - F.col("qty")))).first()[0] < 10  # the mean predictor errs by 17

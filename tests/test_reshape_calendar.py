"""Wide/long reshaping, weekday decoding and calendar operators on hand fixtures."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import d, rows
from shelfwise.operators import calendar as cal
from shelfwise.operators import reshape as rs
from shelfwise.sources import daily

WEEKDAY_COLS = ["Day of the Week_" + x for x in
                ["Friday", "Monday", "Saturday", "Sunday", "Thursday", "Tuesday", "Wednesday"]]


@pytest.fixture
def wide(spark):
    schema = T.StructType(
        [T.StructField("Date", T.DateType())]
        + [T.StructField(c, T.IntegerType()) for c in WEEKDAY_COLS]
        + [T.StructField("Qty (Sales)_PASTA - 1", T.DoubleType()),
           T.StructField("Qty (Sales)_TA PASTA - 2", T.DoubleType()),
           T.StructField("Gross Rev._PASTA - 1", T.DoubleType()),
           T.StructField("Gross Rev._TA PASTA - 2", T.DoubleType())])
    data = [
        (d("2023-01-02"), 0, 1, 0, 0, 0, 0, 0, 3.0, None, 30.0, None),   # Monday
        (d("2023-01-06"), 1, 0, 0, 0, 0, 0, 0, 0.0, 2.0, 0.0, 19.0),     # Friday
        (d("2023-01-07"), 0, 0, 0, 0, 0, 0, 0, 5.0, 1.0, 50.0, 9.5),     # all zero -> Unknown
    ]
    return spark.createDataFrame(data, schema)


def test_unpivot_keeps_nulls_and_strips_prefix(wide):
    long = rs.unpivot_measures(wide, "Qty (Sales)_", "qty")
    got = rows(long, "Date", "item", "qty")
    assert (d("2023-01-02"), "TA PASTA - 2", None) in got
    assert (d("2023-01-06"), "PASTA - 1", 0.0) in got
    assert len(got) == 6


def test_pair_qty_revenue_without_join(wide):
    p = rs.pair_qty_revenue(wide)
    got = rows(p, "Date", "item", "qty", "revenue")
    assert (d("2023-01-06"), "TA PASTA - 2", 2, 19.0) in got
    assert len(got) == 6
    assert "Join" not in p._jdf.queryExecution().executedPlan().toString()


def test_pivot_round_trip(spark):
    long = spark.createDataFrame([(d("2023-01-02"), "a", 1), (d("2023-01-02"), "b", 2), (d("2023-01-03"), "a", 4)],
                                 "date date, item string, qty int")
    p = rs.pivot_items(long, "qty", ["a", "b", "c"])
    assert rows(p) == [(d("2023-01-02"), 1, 2, None), (d("2023-01-03"), 4, None, None)]


def test_decode_weekday_first_match_and_unknown(wide):
    got = dict(rows(rs.decode_weekday(wide), "Date", "dow"))
    assert got == {d("2023-01-02"): "Monday", d("2023-01-06"): "Friday", d("2023-01-07"): "Unknown"}


def test_decode_weekday_fallback_from_date(spark):
    df = spark.createDataFrame([(d("2023-01-07"),)], "Date date")
    assert rows(rs.decode_weekday(df), "dow") == [("Saturday",)]


def test_calendar_features_jan1_and_weekend(spark):
    days = spark.createDataFrame([(d("2023-01-01"),), (d("2023-01-02"),), (d("2023-12-26"),)], "date date")
    hol = cal.holiday_calendar(days, [(1, 1), (12, 25), (12, 26)])
    got = rows(cal.calendar_features(days, hol), "date", "dow", "month", "quarter", "year", "is_weekend", "is_holiday")
    assert got == [(d("2023-01-01"), "Sunday", 1, 1, 2023, 1, 1),
                   (d("2023-01-02"), "Monday", 1, 1, 2023, 0, 0),
                   (d("2023-12-26"), "Tuesday", 12, 4, 2023, 0, 1)]
    # list form of the holiday argument gives the same flags
    got2 = rows(cal.calendar_features(days, ["2023-01-01", "2023-12-26"]), "date", "is_holiday")
    assert got2 == [(d("2023-01-01"), 1), (d("2023-01-02"), 0), (d("2023-12-26"), 1)]


def test_calendar_dummies_fixed_levels(spark):
    days = spark.createDataFrame([(d("2023-01-15"),), (d("2023-11-15"),)], "date date")
    dm = cal.calendar_dummies(cal.calendar_features(days))
    r = {x["date"]: x for x in dm.collect()}
    assert sum(r[d("2023-01-15")][f"Month_{m}"] for m in range(2, 13)) == 0
    assert r[d("2023-11-15")]["Month_11"] == 1 and r[d("2023-11-15")]["Quarter_4"] == 1


def test_date_slice_empty_on_jan1(spark):
    df = spark.createDataFrame([(d("2022-12-31"),), (d("2023-01-01"),), (d("2023-01-02"),)], "date date")
    assert cal.date_slice(df, "2023-01-01").count() == 0
    assert rows(cal.date_slice(df, "2023-01-02")) == [(d("2023-01-02"),)]


def test_point_in_time_absent_and_next_day(spark):
    w = spark.createDataFrame([(d("2023-01-02"), 5.0), (d("2023-01-03"), 7.0), (d("2023-01-05"), 1.0)],
                              "date date, temp double")
    assert rows(cal.point_in_time(w, "2023-01-02", ["temp"])) == [(d("2023-01-02"), 5.0, 7.0)]
    assert rows(cal.point_in_time(w, "2023-01-03", ["temp"])) == [(d("2023-01-03"), 7.0, None)]
    assert cal.point_in_time(w, "2023-01-04", ["temp"]).count() == 0


def test_densify_fills_absent_days(spark):
    s = spark.createDataFrame([(d("2023-01-01"), "a", 2), (d("2023-01-03"), "a", 1), (d("2023-01-02"), "b", 4)],
                              "date date, item string, qty bigint")
    got = rows(cal.densify(s), "date", "item", "qty")
    assert len(got) == 6
    assert (d("2023-01-02"), "a", 0) in got and (d("2023-01-03"), "b", 0) in got
    per_key = rows(cal.densify(s, span="key"), "date", "item", "qty")
    assert len(per_key) == 4


def test_parse_dates_modes(spark):
    df = spark.createDataFrame([("2023-01-02", 1), ("bad", 2), (None, 3)], "Date string, v int")
    assert rows(daily.parse_dates(df, mode="coerce"), "Date", "v") == [(d("2023-01-02"), 1)]
    with pytest.raises(Exception):
        daily.parse_dates(df, mode="strict").collect()


def test_scan_daily_requires_date(spark, tmp_path):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    p = str(tmp_path / "x")
    df.write.option("header", True).csv(p)
    with pytest.raises(ValueError):
        daily.scan_daily(spark, p)


def test_csv_round_trip_keeps_dotted_names(spark, tmp_path):
    s = spark.createDataFrame([(d("2023-01-02"), "A. B", 3, 12.5)], "date date, item string, qty bigint, revenue double")
    wide = daily.daily_wide(s, ["A. B"])
    p = daily.write_daily_csv(wide, str(tmp_path / "w"))
    back = daily.scan_daily(spark, p, daily.wide_schema(["A. B"]))
    assert back.select(F.col("`Qty (Sales)_A. B`"), F.col("`Gross Rev._A. B`")).first() == (3, 12.5)


def test_wide_file_to_long_with_presets(spark):
    from shelfwise.functions import presets
    from shelfwise.plans.wide_file import long_sales, weather_days
    cols = (["Date"] + WEEKDAY_COLS
            + ["Qty (Sales)_LASAGNE - 3513", "Qty (Sales)_TA LASAGNE - 25200", "Qty (Sales)_RIBEYE STEAK - 6501",
               "Gross Rev._LASAGNE - 3513", "Gross Rev._TA LASAGNE - 25200",
               "Temp Avg (°C)", "Temp Avg (°C)_norm", "Precipitation (mm)"])
    rows_ = [("2023-01-02", 0, 1, 0, 0, 0, 0, 0, 3.0, 1.0, 0.0, 45.0, 12.5, 7.5, 0.1, 0.0),
             ("2023-01-03", 0, 0, 0, 0, 0, 0, 0, None, 2.0, 1.0, None, 25.0, 8.0, 0.2, 1.5),
             ("not a date", 0, 0, 0, 0, 0, 0, 0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    schema = ", ".join([f"`{c}` string" if c == "Date" else f"`{c}` double" if not c.startswith("Day") else f"`{c}` int"
                        for c in cols])
    wide = spark.createDataFrame(rows_, schema)
    dims = presets.frames(spark)
    long = long_sales(wide, dims["dish_item"], date_mode="coerce")
    got = rows(long, "date", "item", "dish", "channel", "dow", "qty", "revenue")
    assert (d("2023-01-02"), "LASAGNE - 3513", "LASAGNE", "DINE_IN", "Monday", 3, 45.0) in got
    assert (d("2023-01-03"), "TA LASAGNE - 25200", "LASAGNE", "TAKEAWAY", "Unknown", 2, 25.0) in got
    assert (d("2023-01-03"), "RIBEYE STEAK - 6501", "RIBEYE STEAK", "DINE_IN", "Unknown", 1, None) in got
    assert len(got) == 6                                   # the unparseable date is dropped
    w = rows(weather_days(wide, "coerce"), "date", "temp_avg", "temp_avg_norm", "precipitation")
    assert w == [(d("2023-01-02"), 7.5, 0.1, 0.0), (d("2023-01-03"), 8.0, 0.2, 1.5)]
    assert dims["holiday"].count() == 19 and dims["dish_item"].count() == 26

"""Window features, per-date features and statistics on hand fixtures."""

import math

import pytest

from conftest import d, rows
from shelfwise.operators import calendar as cal
from shelfwise.operators import features as fe
from shelfwise.operators import stats as st


@pytest.fixture
def series(spark):
    # item a: 1..8 Jan 2023 (Sunday..Sunday); item b: constant 2
    data = [(d(f"2023-01-0{i}"), "a", i) for i in range(1, 9)] + [(d(f"2023-01-0{i}"), "b", 2) for i in range(1, 9)]
    return spark.createDataFrame(data, "date date, item string, qty bigint")


def test_lags_null_edge_groups_and_clamp(series):
    f = fe.lags(series, "qty", {1: None, 2: ["a"]})
    f = fe.lags(f, "qty", (2,), edge="clamp", prefix="c")
    got = {(r.item, r.date): r for r in f.collect()}
    first = got[("a", d("2023-01-01"))]
    assert first.qty_lag1 is None and first.qty_lag2 is None and first.c2 == 1   # first rows of a lag
    assert got[("a", d("2023-01-02"))].c2 == 1                                     # row max(0, i-2) = row 0
    assert got[("a", d("2023-01-05"))].qty_lag2 == 3 and got[("a", d("2023-01-05"))].c2 == 3
    assert got[("b", d("2023-01-05"))].qty_lag2 is None                            # outside the group


def test_trend_and_dow_mean(series):
    t = fe.trend(series, (3,))
    got = {(r.item, r.date): r.trend_3 for r in t.collect()}
    assert got[("a", d("2023-01-01"))] == 1.0 and got[("a", d("2023-01-02"))] == 1.5     # min 1 row
    assert got[("a", d("2023-01-05"))] == 4.0
    c = cal.calendar_features(series)
    m = fe.dow_rolling_mean(c, 6)
    g = {(r.item, r.date): r.dow_avg for r in m.collect()}
    assert g[("a", d("2023-01-08"))] == 4.5                                               # Sundays 1 and 8
    ex = fe.dow_rolling_mean(c, 6, exclude_current=True)
    g2 = {(r.item, r.date): r.dow_avg for r in ex.collect()}
    assert g2[("a", d("2023-01-01"))] is None and g2[("a", d("2023-01-08"))] == 1.0


def test_sales_ratio_mean_zero_and_missing(spark):
    df = spark.createDataFrame([(d("2023-01-02"), "a", "Monday", 4), (d("2023-01-03"), "a", "Tuesday", 6),
                                (d("2023-01-04"), "a", "Wednesday", 5)],
                               "date date, item string, dow string, qty bigint")
    prof = spark.createDataFrame([("a", "Monday", 2.0, 1.0), ("a", "Tuesday", 0.0, None)],
                                 "item string, dow string, dow_mean double, dow_std double")
    got = dict(rows(fe.sales_ratio_dow(df, prof), "dow", "sales_ratio_dow"))
    assert got == {"Monday": 2.0, "Tuesday": 6.0, "Wednesday": 1.0}      # mean 0 -> /1; no mean -> 1.0
    serving = dict(rows(fe.sales_ratio_dow(df, prof, zero_mean="one"), "dow", "sales_ratio_dow"))
    assert serving == {"Monday": 2.0, "Tuesday": 1.0, "Wednesday": 5.0}
    std = dict(rows(fe.dow_std_feature(df, prof), "dow", "dow_std"))
    assert std == {"Monday": 1.0, "Tuesday": 0.0, "Wednesday": 0.0}     # missing std -> 0


def test_low_demand_modes(spark):
    df = spark.createDataFrame([(d("2023-01-01"), "x", 0), (d("2023-01-01"), "y", 0),
                                (d("2023-01-02"), "x", 0), (d("2023-01-02"), "y", 3),
                                (d("2023-01-03"), "x", 1), (d("2023-01-03"), "y", 1)],
                               "date date, item string, qty bigint")
    anyt = dict(rows(fe.low_demand_flag(df, ["x", "y"], "any_today"), "date", "low_demand"))
    assert anyt == {d("2023-01-01"): 1, d("2023-01-02"): 1, d("2023-01-03"): 0}
    prev = dict(rows(fe.low_demand_flag(df, ["x", "y"], "all_yesterday"), "date", "low_demand"))
    assert prev == {d("2023-01-01"): 1, d("2023-01-02"): 1, d("2023-01-03"): 0}


def test_course_flags_zero_counts_as_seen(spark):
    s = spark.createDataFrame([(d("2023-01-01"), "fries", 0), (d("2023-01-02"), "soup", None)],
                              "date date, dish string, qty bigint")
    t = spark.createDataFrame([("fries", "Side"), ("soup", "Starter")], "dish string, type string")
    got = rows(fe.course_flags(s, t), "date", "has_side", "has_starter")
    assert got == [(d("2023-01-01"), 1, 0), (d("2023-01-02"), 0, 0)]


def test_total_daily_sales_null_is_zero(spark):
    s = spark.createDataFrame([(d("2023-01-01"), None), (d("2023-01-02"), 3)], "date date, qty bigint")
    assert rows(fe.total_daily_sales(s)) == [(d("2023-01-01"), 0), (d("2023-01-02"), 3)]


def test_accuracy_constant_actuals(spark):
    pairs = spark.createDataFrame([("c", 2.0, 2), ("c", 2.0, 2), ("p", 3.0, 2), ("p", 1.0, 2),
                                   ("v", 1.0, 1), ("v", 3.0, 3)], "item string, pred double, actual bigint")
    got = {r.item: r for r in st.accuracy_by_item(pairs).collect()}
    assert got["c"].r2 == 1.0 and got["c"].rmse == 0.0     # constant and perfect
    assert got["p"].r2 == 0.0 and got["p"].mae == 1.0      # constant, not perfect
    assert got["v"].r2 == 1.0
    m = st.accuracy_macro(st.accuracy_by_item(pairs)).first()
    assert math.isclose(m.avg_r2, 2 / 3)


def test_bias_factor_default_when_pred_not_positive(spark):
    pairs = spark.createDataFrame([("a", 2.0, 3), ("a", 2.0, 1), ("z", 0.0, 5)],
                                  "item string, pred double, actual bigint")
    assert dict(rows(st.bias_factors(pairs), "item", "bias_factor")) == {"a": 1.0, "z": 1.0}


def test_unit_price_zero_quantity_item_and_default(spark):
    sales = spark.createDataFrame([("A", "A1", 2, 10.0), ("A", "A2", 0, 99.0), ("B", "B1", 0, 5.0)],
                                  "dish string, item string, qty bigint, revenue double")
    di = spark.createDataFrame([("A", "A1"), ("A", "A2"), ("B", "B1"), ("C", "C1")], "dish string, item string")
    got = dict(rows(st.unit_price(sales, di), "dish", "price"))
    assert got == {"A": 5.0, "B": 10.0, "C": 10.0}


def test_standardize_population_std_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    z = rows(st.standardize(df, ["x", "k"]), "x", "k")
    assert z == [(-1.0, 0.0), (1.0, 0.0)]


def test_item_stats_and_stable(spark):
    df = spark.createDataFrame([(d("2022-01-01"), "a", 1), (d("2022-01-02"), "a", 3), (d("2023-01-01"), "a", 100)],
                               "date date, item string, qty bigint")
    s = st.item_stats(df, 2022).first()
    assert s.avg_qty == 2.0 and math.isclose(s.std_qty, math.sqrt(2))
    assert st.stable_items(st.item_stats(df, 2022), 3.0, 1.5).count() == 1
    assert st.stable_items(st.item_stats(df, 2022), 3.0, 1.0).count() == 0

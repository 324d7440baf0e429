"""Ordering ladders, FIFO stock, ledger fold, back-test and reports on hand fixtures."""

import datetime as dt
import itertools

import pandas as pd
import pytest

from conftest import d, rows
from shelfwise.operators import policy as po
from shelfwise.operators import stock as sk


@pytest.mark.parametrize("ratio,factor", [(0.25, 0.7), (0.2500001, 0.6), (0.2, 0.8), (0.15, 0.9), (0.1, 1.0),
                                          (0.05, 1.0), (0.0499, 1.05), (0.0, 1.05)])
def test_forecast_ladder_at_equality(spark, ratio, factor):
    assert po.forecast_factor(ratio) == factor
    fc = spark.createDataFrame([("A", 10.0)], "dish string, forecast double")
    r = spark.createDataFrame([("A", ratio)], "dish string, waste_ratio double")
    assert po.waste_adjust_forecast(fc, r).first().forecast_adj == pytest.approx(10.0 * factor)


@pytest.mark.parametrize("ratio,orders,expected", [(0.2, 5, 3.0), (0.21, 5, 2.4), (0.15, 5, 3.6), (0.1, 5, 4.0),
                                                   (0.05, 5, 4.0), (0.01, 5, 4.4), (0.9, 0, 4.0)])
def test_buffer_ladder_at_equality(spark, ratio, orders, expected):
    assert po.adjust_buffer(4.0, ratio, orders) == pytest.approx(expected)
    b = spark.createDataFrame([("A", 4.0)], "dish string, buffer double")
    r = spark.createDataFrame([("A", ratio, orders)], "dish string, waste_ratio double, orders bigint")
    assert po.waste_adjust_buffer(b, r).first().buffer_adj == pytest.approx(expected)


def test_no_history_unchanged(spark):
    fc = spark.createDataFrame([("A", 10.0)], "dish string, forecast double")
    r = spark.createDataFrame([], "dish string, waste_ratio double")
    assert po.waste_adjust_forecast(fc, r).first().forecast_adj == 10.0


def test_buffers_share_and_rmse(spark):
    di = spark.createDataFrame([("A", "A1", "DINE_IN", 1), ("A", "A2", "TAKEAWAY", 2), ("B", "B1", "DINE_IN", 1),
                                ("C", "C1", "DINE_IN", 1), ("R", "R1", "DINE_IN", 1), ("N", "N1", "DINE_IN", 1),
                                ("Z", "Z1", "DINE_IN", 1)], "dish string, item string, channel string, ord int")
    means = spark.createDataFrame([("A1", 6.0), ("A2", 100.0), ("B1", 3.0), ("C1", 1.0), ("R1", 9.0), ("N1", 9.0),
                                   ("Z1", 0.0)], "item string, avg_qty double")
    got = dict(rows(po.buffers_share(di, means, ["R"], ["N"]), "dish", "buffer"))
    assert got == {"A": 2.0, "B": 1.0, "C": 1.0, "R": 0.3, "N": 1.5, "Z": 0.0}
    rmse = spark.createDataFrame([("A1", 1.2), ("B1", 9.0)], "item string, rmse double")
    got2 = dict(rows(po.buffers_rmse(di, means, rmse, ["R"], ["N"]), "dish", "buffer"))
    assert got2 == {"A": 2.0, "B": 1.0, "C": 1.0, "R": 0.3, "N": 2.0, "Z": 0.25}


def test_order_quantity(spark):
    i = spark.createDataFrame([("A", 2.2, 1.0, 5), ("B", 3.1, 1.0, 1)],
                              "dish string, forecast double, buffer double, usable bigint")
    assert rows(po.order_quantity(i), "dish", "order_qty") == [("A", 0), ("B", 4)]
    assert rows(po.order_quantity(i, submit_only=True), "dish") == [("B",)]


def _ledger(spark, deliveries, demand):
    dl = spark.createDataFrame(deliveries, "date date, item string, qty bigint")
    dm = spark.createDataFrame(demand, "date date, item string, qty bigint")
    return {r.date: r for r in sk.stock_ledger(dl, dm).collect()}


def test_ledger_fifo_expiry_and_waste(spark):
    # lot of 5 on day 1 (sellable days 1..4), lot of 4 on day 3
    led = _ledger(spark, [(d("2023-01-01"), "x", 5), (d("2023-01-03"), "x", 4)],
                  [(d("2023-01-02"), "x", 2), (d("2023-01-04"), "x", 4), (d("2023-01-05"), "x", 1),
                   (d("2023-01-08"), "x", 9)])
    assert led[d("2023-01-04")].sold == 4 and led[d("2023-01-04")].closing == 3   # across two expiries
    assert led[d("2023-01-05")].waste == 0 and led[d("2023-01-05")].sold == 1    # first lot fully sold on its last day
    assert led[d("2023-01-07")].waste == 2                                        # second lot: waste the day after expiry
    assert led[d("2023-01-08")].short == 9                                        # demand above stock
    total_in = sum(r.delivered for r in led.values())
    assert total_in == sum(r.sold for r in led.values()) + sum(r.waste for r in led.values()) + led[d("2023-01-08")].closing


def test_ledger_sold_on_expiry_day(spark):
    led = _ledger(spark, [(d("2023-01-01"), "x", 3)], [(d("2023-01-04"), "x", 2), (d("2023-01-05"), "x", 5)])
    assert led[d("2023-01-04")].sold == 2
    assert led[d("2023-01-05")].sold == 0 and led[d("2023-01-05")].waste == 1 and led[d("2023-01-05")].short == 5


def test_fifo_allocate_matches_brute_force(spark):
    lots = [("x", d("2023-01-03"), 4), ("x", d("2023-01-05"), 3), ("x", d("2023-01-04"), 0), ("y", d("2023-01-02"), 2)]
    dem = [("x", d("2023-01-01"), 2), ("x", d("2023-01-02"), 3), ("x", d("2023-01-03"), 5), ("y", d("2023-01-01"), 1)]
    L = spark.createDataFrame(lots, "item string, expiry date, qty bigint")
    D = spark.createDataFrame(dem, "item string, date date, qty bigint")
    got = rows(sk.fifo_allocate(L, D), "item", "lot_expiry", "demand_date", "qty")
    expected = []
    for item in ("x", "y"):
        units_l = list(itertools.chain.from_iterable([e] * q for i, e, q in sorted(lots, key=lambda t: t[1]) if i == item))
        units_d = list(itertools.chain.from_iterable([e] * q for i, e, q in sorted(dem, key=lambda t: t[1]) if i == item))
        pairs = pd.Series(list(zip(units_l, units_d))).value_counts()
        expected += [(item, a, b, int(n)) for (a, b), n in pairs.items()]
    assert got == sorted(expected)


def test_lots_usable_on_hand_near_expiry(spark):
    lots = spark.createDataFrame([("x", d("2023-01-05"), 3), ("x", d("2023-01-09"), 2), ("x", d("2023-01-03"), 0)],
                                 "item string, expiry date, qty bigint")
    assert rows(sk.usable_stock(lots, "2023-01-05")) == [("x", 5)]
    assert rows(sk.stock_on_hand(lots, "2023-01-05"), "expiry", "days_left") == [(d("2023-01-05"), 0), (d("2023-01-09"), 4)]
    assert rows(sk.near_expiry(lots, "2023-01-03"), "expiry", "days_left") == [(d("2023-01-03"), 0), (d("2023-01-05"), 2)]
    assert rows(sk.lots_by_expiry(lots, seq="qty"), "expiry", "lot_rank") == [
        (d("2023-01-03"), 1), (d("2023-01-05"), 2), (d("2023-01-09"), 3)]


def test_receive_makes_lots(spark):
    o = spark.createDataFrame([(d("2023-01-01"), "x", 4), (d("2023-01-02"), "x", 0)], "date date, item string, qty bigint")
    assert rows(sk.receive(o)) == [("x", d("2023-01-04"), 4)]


def test_pending_orders_book(spark):
    ev = spark.createDataFrame([
        ("s", d("2023-01-01"), 1, "A", "add", 5),
        ("s", d("2023-01-02"), 1, "A", "replace", 2), ("s", d("2023-01-02"), 2, "B", "replace", 0),
        ("s", d("2023-01-02"), 3, "C", "replace", 4),
        ("s", d("2023-01-03"), 1, "C", "accept", 4), ("s", d("2023-01-03"), 2, "D", "add", 0),
        ("s", d("2023-01-03"), 3, "E", "add", 7), ("s", d("2023-01-04"), 1, "A", "add", 9),
    ], "site string, ts date, seq int, dish string, action string, qty bigint")
    assert rows(sk.pending_orders(ev, site="site"), "dish", "qty") == [("A", 9), ("E", 7)]


def _plan(spark, days, forecast, actual, buffer=1.0):
    data = [("x", d(dd), float(f), a, buffer) for dd, f, a in zip(days, forecast, actual)]
    return spark.createDataFrame(data, "dish string, date date, forecast double, actual bigint, buffer double")


def test_backtest_standard_orders_and_waste(spark):
    days = [f"2023-01-0{i}" for i in range(1, 7)]
    plan = _plan(spark, days, [3, 3, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0], buffer=0.0)
    r = {x.date: x for x in sk.policy_backtest(plan, adaptive=False).collect()}
    assert r[d("2023-01-01")].order_qty == 3 and r[d("2023-01-01")].sold == 1
    assert r[d("2023-01-02")].usable == 2 and r[d("2023-01-02")].order_qty == 1
    assert r[d("2023-01-05")].waste == 1        # day-1 lot (expiry Jan 4) is waste on Jan 5
    assert r[d("2023-01-06")].waste == 1        # day-2 lot
    assert r[d("2023-01-06")].waste_ratio == pytest.approx(2 / 4)


def test_backtest_skips_days_without_actuals(spark):
    days = ["2023-01-01", "2023-01-02", "2023-01-03"]
    plan = _plan(spark, days, [2, 2, 2], [1, None, 1], buffer=0.0)
    r = {x.date: x for x in sk.policy_backtest(plan, adaptive=True).collect()}
    assert d("2023-01-02") not in r
    assert r[d("2023-01-01")].forecast_adj == pytest.approx(2.1)   # ratio 0 -> x1.05 from the first day


def test_reports_and_compare(spark):
    led = spark.createDataFrame([("A", d("2023-01-05"), 4, 10, 2, 1), ("A", d("2023-02-01"), 6, 8, 0, 3)],
                                "dish string, date date, order_qty bigint, actual bigint, short bigint, waste bigint")
    price = spark.createDataFrame([("A", 4.0)], "dish string, price double")
    w = sk.waste_ratio(led).first()
    assert w.waste_ratio == 0.4 and w.waste_pct == 40.0
    m = {r.month: r for r in sk.monthly_losses(led, price).collect()}
    assert len(m) == 12 and m[1].waste_money == 1.0 and m[1].stockout_money == 8.0 and m[7].waste_money == 0.0
    k = sk.year_kpis(led, price).first()
    assert k.revenue == 72.0 and k.cost_of_sales == 18.0 and k.waste_money == 4.0
    base = spark.createDataFrame([(100.0, 0.0, 10.0)], "revenue double, waste_money double, stockout_money double")
    new = spark.createDataFrame([(110.0, 5.0, 5.0)], "revenue double, waste_money double, stockout_money double")
    c = sk.policy_compare(base, new).first()
    assert c.revenue_change_pct == pytest.approx(10.0) and c.waste_reduction_pct == 0.0
    assert c.stockout_change_pct == pytest.approx(-50.0)


def test_fold_chunking_keeps_keys_whole(spark):
    """Tiny Arrow batches and chunks split keys across batches; results must not change."""
    import random
    rnd = random.Random(7)
    dl, dm = [], []
    for k in range(6):
        for i in range(40):
            day = d("2023-01-01") + dt.timedelta(days=i)
            if rnd.random() < 0.5:
                dl.append((day, f"k{k}", rnd.randint(1, 9)))
            if rnd.random() < 0.7:
                dm.append((day, f"k{k}", rnd.randint(1, 6)))
    D = spark.createDataFrame(dl, "date date, item string, qty bigint")
    M = spark.createDataFrame(dm, "date date, item string, qty bigint")
    whole = sorted(tuple(r) for r in sk.stock_ledger(D, M).collect())
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        split = sorted(tuple(r) for r in sk.stock_ledger(D, M, chunk_rows=15).collect())
        plan = spark.createDataFrame([(f"k{k}", d("2023-01-01") + dt.timedelta(days=i),
                                       float(rnd.randint(0, 8)), rnd.randint(0, 8) if i % 9 else None, 1.0)
                                      for k in range(5) for i in range(30)],
                                     "dish string, date date, forecast double, actual bigint, buffer double")
        bt_split = sorted(tuple(r) for r in sk.policy_backtest(plan, chunk_rows=11).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    bt_whole = sorted(tuple(r) for r in sk.policy_backtest(plan).collect())
    assert split == whole and len(whole) == 6 * 40
    assert bt_split == bt_whole and len(bt_whole) == 5 * (30 - 4)

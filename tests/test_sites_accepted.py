"""Accepted orders against a replay, and the operators per (site, dish)."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001, d, rows
from shelfwise.operators import calendar as cal
from shelfwise.operators import features as fe
from shelfwise.operators import policy as po
from shelfwise.operators import slices
from shelfwise.operators import stats as st
from shelfwise.operators import stock as sk

EVENTS = "site string, ts timestamp, seq long, dish string, action string, qty long"


def _accepted(events):
    """Event by event: the book per site, a batch after the other events of its instant."""
    book, batch, out = {}, {}, []
    for site, ts, seq, dish, action, qty in sorted(events, key=lambda e: (e[1], e[4] == "replace", e[2])):
        if action == "replace":
            if batch.get(site) != ts:
                batch[site] = ts
                for k in [k for k in book if k[0] == site]:
                    del book[k]
            book[site, dish] = qty
        elif action == "add" and qty is not None and qty > 0:
            book[site, dish] = qty
        elif action == "accept":
            had = book.pop((site, dish), None)
            got = had if qty is None else qty
            if had is not None and had > 0 and got > 0:
                out.append((site, dish, seq, had, got))
    return sorted(out)


def _events(seed, n=300):
    rnd = random.Random(seed)
    events, ts, seq = [], dt.datetime(2023, 1, 1), 0
    for _ in range(n):
        ts += dt.timedelta(minutes=rnd.choice((0, 1)))  # several events share an instant, batches too
        site = rnd.choice("ssst")
        dishes = rnd.sample("ABCDEF", 3) if rnd.random() < 0.15 else [rnd.choice("ABCDEF")]
        action = "replace" if len(dishes) == 3 else rnd.choice(["add", "add", "accept", "accept", "other"])
        for dish in dishes:
            seq += 1
            qty = rnd.randint(0, 4)
            events.append((site, ts, seq, dish, action, None if action in ("accept", "add") and rnd.random() < 0.4 else qty))
    return events


@pytest.mark.parametrize("seed", range(4))
def test_accepted_orders_against_replay(spark, seed):
    events = _events(seed)
    df = spark.createDataFrame(events, EVENTS).repartition(7)
    cols = ("site", "dish", "seq", "ordered", "qty")
    want = _accepted(events)
    assert rows(sk.accepted_orders(df, site="site"), *cols) == want and len(want) > 10
    one = [e for e in events if e[0] == "t"]
    assert rows(sk.accepted_orders(df.where("site = 't'")), *cols[1:]) == [r[1:] for r in _accepted(one)]


def test_a_hot_site_is_split(spark):
    rnd = random.Random(1)
    start = dt.datetime(2023, 1, 1)
    events = [("hot", start + dt.timedelta(minutes=k), k, rnd.choice("AB"), "replace" if k % 97 == 0 else rnd.choice(["add", "accept"]), rnd.randint(1, 4))
              for k in range(4000)]
    df = spark.createDataFrame(events, EVENTS)
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = slices.sliced(df, ["site"], ["ts", "seq"]).groupBy(slices.SLICE).count().toPandas()["count"]
        assert len(sizes) >= 6 and sizes.max() < 1300  # one site, no task with a third of its events
        assert rows(sk.accepted_orders(df, site="site"), "site", "dish", "seq", "ordered", "qty") == _accepted(events)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_accepted_orders_edge_cases(spark):
    t = dt.datetime(2023, 1, 1)
    empty = spark.createDataFrame([], EVENTS)
    assert sk.accepted_orders(empty, site="site").count() == 0
    events = [(None, t, 1, "A", "add", 5), (None, t, 2, "A", "accept", None), (None, t, 3, "A", "accept", 4),  # null site; accepted once
              ("s", t, 4, None, "add", 2), ("s", t, 5, None, "accept", 0),                                     # null dish; nothing delivered
              ("s", t, 6, None, "accept", 3), ("s", t, 7, "B", None, 3)]                                       # order gone all the same
    assert rows(sk.accepted_orders(spark.createDataFrame(events, EVENTS), site="site"), "dish", "seq", "ordered", "qty") == [("A", 2, 5, 5)]


def test_accepted_orders_become_lots_and_stock(spark):
    t = dt.datetime(2023, 1, 1, 9)
    ev = spark.createDataFrame([("s", t, 1, "A", "add", 5), ("s", t, 2, "A", "accept", None)], EVENTS)
    got = sk.accepted_orders(ev, site="site").withColumn("date", F.to_date("ts")).withColumnRenamed("dish", "item")
    lots = sk.receive(got.select("site", "item", "date", "qty"))
    assert rows(lots, "site", "item", "expiry", "qty") == [("s", "A", d("2023-01-04"), 5)]
    assert rows(sk.usable_stock(lots, "2023-01-04", ("site", "item")), "site", "item", "usable") == [("s", "A", 5)]
    assert rows(sk.stock_on_hand(lots, "2023-01-04", ("site", "item"))) == [("s", "A", 5, d("2023-01-04"), 0)]
    assert rows(sk.near_expiry(lots, "2023-01-03", 2, ("site", "item"))) == [("s", "A", 5, d("2023-01-04"), 1)]


def test_a_site_has_its_own_numbers(spark):
    """Each site's buffers, prices and orders equal those of a run on that site alone."""
    sales = spark.createDataFrame([(s, dish, f"{dish} {c}", "DINE_IN" if c == "O" else "TAKEAWAY", d("2023-01-02"), q * k, 10 * k)
                                   for k, s in enumerate(("n", "s"), 1) for q, dish in ((4, "A"), (2, "B"), (9, "X")) for c in "OF"],
                                  "site string, dish string, item string, channel string, date date, qty long, revenue long")
    di = sales.select("site", "dish", "item", "channel", F.when(F.col("channel") == "DINE_IN", 1).otherwise(2).alias("ord"))
    stats = st.item_stats(sales, keys=("site", "item"))
    rmse = stats.withColumn("rmse", F.col("avg_qty") / 3)
    site = ("site",)
    both = {"share": po.buffers_share(di, stats, ["X"], [], site=site), "rmse": po.buffers_rmse(di, stats, rmse, ["X"], [], site=site),
            "price": st.unit_price(sales, di, site=site)}
    for s in "ns":
        one = lambda f: f.where(F.col("site") == s).drop("site")
        alone = {"share": po.buffers_share(one(di), one(stats), ["X"], []), "rmse": po.buffers_rmse(one(di), one(stats), one(rmse), ["X"], []),
                 "price": st.unit_price(one(sales), one(di))}
        for name, frame in both.items():
            assert rows(one(frame)) == rows(alone[name]), (s, name)
    forecast = sk.dish_rollup(sales, site=site).withColumn("forecast", F.col("qty").cast("double")).drop("qty")
    usable = spark.createDataFrame([("n", "A", 2.5)], "site string, dish string, usable double")
    keys = ("site", "dish")
    o = po.order_quantity(po.order_inputs(forecast, both["share"], usable, keys, keys))
    got = {(r.site, r.dish): (r.usable, r.order_qty) for r in o.collect()}
    assert got["n", "A"] == (2.5, 7)   # ceil(8 + ceil(0.25 * 4) - 2.5): the half stays
    assert got["s", "A"] == (0.0, 19)  # 16 + ceil(0.3 * 8): the other site's stock does not count


def test_rollup_follows_the_mapping(spark):
    df = spark.createDataFrame([(d("2023-01-01"), "a", "old", 1), (d("2023-01-01"), "b", "old", 2), (d("2023-01-01"), "c", "old", 4)],
                               "date date, item string, dish string, qty long")
    mapping = spark.createDataFrame([("a", "X"), ("b", "X"), ("b", "X")], "item string, dish string")
    assert rows(sk.dish_rollup(df, mapping), "dish", "qty") == [("X", 3)]
    assert rows(sk.dish_rollup(df), "dish", "qty") == [("old", 7)]


def test_only_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, t string")
    assert rows(cal.only_row(df.where("n = 2"))) == [(2, "b")]
    for n in (0, 2):
        with pytest.raises(Exception, match=f"exactly one row, got {n}"):
            cal.only_row(df.limit(n)).collect()
    kpi = spark.createDataFrame([(1.0, 1.0, 1.0)] * 2, "revenue double, waste_money double, stockout_money double")
    with pytest.raises(Exception, match="exactly one row"):
        sk.policy_compare(kpi, kpi.limit(1)).collect()


def test_assembled_blocks_share_one_exchange(spark):
    from shelfwise.plans.catalog import QUERIES
    plan = QUERIES["assemble_features"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") >= 2 and "qty_lag1" in plan
    base = spark.createDataFrame([("a", d("2023-01-01"), 1), ("a", d("2023-01-02"), 3)], "item string, date date, qty long")
    lag = fe.lags(base, "qty", (1,)).select("date", "item", "qty_lag1")
    joined = fe.assemble_features([base, lag, fe.trend(base, (7,)).select("date", "item", "trend_7")])
    chained = fe.assemble_features([base, lambda s: fe.lags(s, "qty", (1,)), lambda s: fe.trend(s, (7,))])
    assert rows(joined, "item", "date", "qty", "qty_lag1", "trend_7") == rows(chained, "item", "date", "qty", "qty_lag1", "trend_7")
    assert "Join" not in chained._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("span", ["global", "events"])
def test_lots_left_after_days_without_a_row(spark, span):
    dl = spark.createDataFrame([(d("2023-01-01"), "x", 3), (d("2023-01-02"), "x", 4), (d("2022-12-20"), "old", 9)], "date date, item string, qty long")
    dm = spark.createDataFrame([(d("2023-01-02"), "x", 1)], "date date, item string, qty long")
    led = sk.stock_ledger(dl, dm, span=span, with_left=True)
    both = [("x", d("2023-01-04"), 2), ("x", d("2023-01-05"), 4)]
    for as_of, want in (("2023-01-03", both), ("2023-01-05", both), ("2023-01-06", both[1:]), ("2023-01-07", [])):
        assert rows(sk.lots_left(led, as_of)) == want, as_of

"""Distributed prefix sums and ranks, FIFO over many slices, the one-pass order book, ragged folds."""

import collections
import datetime as dt
import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import d, rows
from shelfwise.operators import folds, slices
from shelfwise.operators import stock as sk
from shelfwise.plans.catalog import QUERIES


@pytest.fixture
def many_slices(spark):
    """Shuffles stay cut as on a cluster."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _hot_lots(spark, n=3000):
    """A third of the lots are of one item; several lots share an item and an expiry."""
    day = F.expr("date_add(DATE'2023-01-01', CAST(id % 40 AS INT))")
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("i"), F.col("id") % 50)).alias("item"),
                                 day.alias("expiry"), (F.col("id") % 7).alias("qty"), F.col("id").alias("lot"))


def test_running_over_slices(spark, many_slices):
    lots = _hot_lots(spark)
    got = slices.running(lots, ["item"], ["expiry", "lot"], "qty").toPandas().sort_values(["item", "expiry", "lot"])
    assert len(got) == 3000
    for _, g in got.groupby("item"):
        assert g["rank"].tolist() == list(range(1, len(g) + 1)) and g["upto"].tolist() == g["qty"].cumsum().tolist()
    sizes = slices.sliced(lots, ["item"], ["expiry", "lot"]).groupBy("item", slices.SLICE).count().toPandas()
    hot = sizes[sizes["item"] == "hot"]["count"]
    assert hot.sum() == 1000 and len(hot) >= 6 and hot.max() <= 250  # no task has a third of the rows, nor the hot item


def test_ties_and_null_keys(spark, many_slices):
    null_key = spark.createDataFrame([(None, 1, 2), (None, 2, 3), ("a", 1, 5)], "item string, o int, qty long")
    assert rows(slices.running(null_key, ["item"], ["o"], "qty"), "item", "o", "rank", "upto") == [("a", 1, 1, 5), (None, 1, 1, 2), (None, 2, 2, 5)]
    tie = spark.createDataFrame([("a", 1, 2), ("a", 1, 3)], "item string, o int, qty long")
    with pytest.raises(Exception, match="tie on o"):
        slices.running(tie, ["item"], ["o"], "qty").collect()
    assert slices.running(tie.limit(0), ["item"], ["o"], "qty").count() == 0


def test_lots_by_expiry_needs_a_unique_lot(spark, many_slices):
    lots = _hot_lots(spark, 300)
    got = sk.lots_by_expiry(lots).toPandas().sort_values(["item", "expiry", "lot"])
    assert all(g["lot_rank"].tolist() == list(range(1, len(g) + 1)) for _, g in got.groupby("item"))
    with pytest.raises(Exception, match="tie"):
        sk.lots_by_expiry(lots.withColumn("lot", F.lit(1))).collect()


@pytest.fixture
def repeated_lines(spark, tmp_path):
    """Lines whose number comes again: in whole copies, with another quantity, and without a number."""
    day = dt.datetime(2000, 1, 1)
    lines = [(1, 1, 7.0), (1, 1, 7.0), (1, 1, 7.0), (1, 1, 4.0), (1, 2, 5.0), (None, 1, 2.0), (None, 1, 2.0), (None, 1, 1.0)]
    made = [(o, 1, 1, n, q, 10.0, 0.0, "R", "F", day) for o, n, q in lines]
    spark.createDataFrame(made, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "Brand#1")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_lots_of_repeated_lines_are_ranked(spark, many_slices, repeated_lines):
    got = QUERIES["lots_by_expiry"](spark, repeated_lines)
    assert [r[1:] for r in rows(got, "item", "lot_rank", "lot", "qty")] == [
        (1, None, 1), (2, None, 2), (3, None, 2), (4, 11, 4), (5, 11, 7), (6, 11, 7), (7, 11, 7), (8, 12, 5)]


def test_ties_of_rows_that_differ_fail(spark, many_slices):
    lots = spark.createDataFrame([("a", 1, 2), ("a", 1, 2), ("a", 1, 3)], "item string, expiry int, qty long")
    assert rows(sk.lots_by_expiry(lots.where("qty = 2"), seq=()), "lot_rank", "qty") == [(1, 2), (2, 2)]
    with pytest.raises(Exception, match="tie"):
        sk.lots_by_expiry(lots, seq=()).collect()


def test_fifo_over_slices_tells_lots_apart(spark, many_slices):
    lots = _hot_lots(spark, 900)
    demand = spark.range(400).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("i"), F.col("id") % 50)).alias("item"),
                                     F.expr("date_add(DATE'2023-01-01', CAST(id AS INT))").alias("date"), (F.col("id") % 5).alias("qty"))
    got = collections.Counter()
    for r in sk.fifo_allocate(lots, demand, lot_order=("expiry", "lot")).collect():
        got[r.item, r.lot_lot, r.demand_date] += r.qty
    L, D = collections.defaultdict(list), collections.defaultdict(list)
    for r in sorted(lots.collect(), key=lambda r: (r.expiry, r.lot)):
        L[r.item] += [r.lot] * r.qty
    for r in sorted(demand.collect(), key=lambda r: r.date):
        D[r.item] += [r.date] * r.qty
    want = collections.Counter((i, a, b) for i in L for a, b in zip(L[i], D[i]))
    assert got == want and len({k[1] for k in want if k[0] == "hot"}) > 100


def test_fifo_fractions_and_one_sided_keys(spark):
    lots = spark.createDataFrame([("x", 1, 2.5), ("x", 2, 1.5), ("only_lots", 1, 1.0)], "item string, expiry int, qty double")
    dem = spark.createDataFrame([("x", 1, 3.0), ("x", 2, 9.0), ("only_demand", 1, 1.0), ("x", 3, None)], "item string, date int, qty double")
    assert rows(sk.fifo_allocate(lots, dem), "item", "lot_expiry", "demand_date", "qty") == [("x", 1, 1, 2.5), ("x", 2, 1, 0.5), ("x", 2, 2, 1.0)]


def _book(events):
    """The order book event by event, per site."""
    book, batch = {}, {}
    for site, ts, _, dish, action, qty in sorted(events, key=lambda e: (e[1], e[2])):
        if action == "replace" and batch.get(site) != ts:
            batch[site] = ts
            for k in [k for k in book if k[0] == site]:
                del book[k]
        if action == "accept" or (action == "replace" and qty <= 0):
            book.pop((site, dish), None)
        elif action == "replace" or qty > 0:
            book[site, dish] = qty
    return sorted((s, x, q) for (s, x), q in book.items())


@pytest.mark.parametrize("seed", range(4))
def test_pending_orders_against_replay(spark, seed):
    rnd = random.Random(seed)
    events, ts = [], dt.datetime(2023, 1, 1)
    for n in range(120):  # a batch has its own instant: nothing else happens in it
        ts += dt.timedelta(minutes=1)
        site = rnd.choice("st")
        if rnd.random() < 0.1:
            events += [(site, ts, n * 10 + k, dish, "replace", rnd.randint(0, 3)) for k, dish in enumerate(rnd.sample("ABCDEF", 3))]
        else:
            events.append((site, ts, n * 10, rnd.choice("ABCDEF"), rnd.choice(["add", "add", "accept"]), rnd.randint(0, 4)))
    df = spark.createDataFrame(events, "site string, ts timestamp, seq long, dish string, action string, qty long")
    book = sk.pending_orders(df, site="site")
    assert rows(book, "site", "dish", "qty") == _book(events)
    plan = book._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan  # one scan, nothing joined
    one = [e for e in events if e[0] == "s"]
    assert rows(sk.pending_orders(df.where("site = 's'")), "dish", "qty") == [(x, q) for _, x, q in _book(one)]


def _replay(days, shelf=3):
    """Ledger of one key from {day: (delivered, demand)}, event days only."""
    lots, out, wasted = [], [], 0
    for day in sorted(days):
        wasted = sum(q for e, q in lots if e < day)
        lots = [(e, q) for e, q in lots if e >= day]
        delivered, demand = days[day]
        lots.append((day + shelf, delivered))
        need, left = demand, []
        for e, q in lots:
            took = min(q, need)
            need -= took
            left.append((e, q - took))
        lots = left
        out.append((day, delivered, demand, demand - need, need, wasted, sum(q for _, q in lots)))
    return out


def test_sparse_keys_stay_sparse(spark):
    """20,000 keys with a few days each over ten years: a dense chunk would hold 73 million cells."""
    n = 20_000
    ev = spark.range(n).select(F.col("id").alias("item"), F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k")).select(
        "item", "k", F.expr("date_add(DATE'2013-01-01', CAST((item * 37 + k * (item % 5 + 1)) % 3650 AS INT))").alias("date"), ((F.col("item") + F.col("k")) % 6).alias("qty"))
    led = sk.stock_ledger(ev.where("k < 2"), ev.where("k >= 2"), key="item", span="events")
    got = led.toPandas()
    assert len(got) == ev.select("item", "date").distinct().count() <= 4 * n
    assert (got["sold"] + got["short"] == got["demand"]).all()
    flows = collections.defaultdict(lambda: collections.defaultdict(lambda: [0, 0]))
    for r in ev.where("item < 40").collect():
        flows[r.item][r.date.toordinal()][r.k >= 2] += r.qty
    for item, days in flows.items():
        mine = got[got["item"] == item].sort_values("date")
        assert [(x.date.toordinal(), x.delivered, x.demand, x.sold, x.short, x.waste, x.closing) for x in mine.itertuples()] == _replay(days)


def test_ragged_memory_is_the_rows(spark):
    """A chunk of keys far apart in time allocates by rows, not by keys x days."""
    import tracemalloc
    n = 5000
    pdf = pd.DataFrame({"item": [f"k{i:05d}" for i in range(n) for _ in range(2)], "date": [dt.date(2000, 1, 1) + dt.timedelta(days=i + j) for i in range(n) for j in range(2)],
                        "delivered": 3, "demand": 1})
    tracemalloc.start()
    out = folds.ledger_fold(pdf, 3, ["item"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 2 * n and out["closing"].tolist()[:2] == [2, 4]
    assert peak < 40e6  # keys x days in one 64-bit array alone would be 200 MB


@pytest.mark.parametrize("chunk", [7, 200_000])
def test_two_sites_do_not_mix(spark, chunk):
    rnd = random.Random(5)
    events = [(site, dish, dt.date(2023, 1, 1) + dt.timedelta(days=k), rnd.randint(0, 5), rnd.randint(0, 5)) for site in ("n", "s") for dish in ("A", "B") for k in range(0, 30, rnd.choice((1, 2)))]
    df = spark.createDataFrame(events, "site string, dish string, date date, a long, b long")
    led = sk.stock_ledger(df.select("site", "dish", "date", F.col("a").alias("qty")), df.select("site", "dish", "date", F.col("b").alias("qty")),
                          key=("site", "dish"), span="key", chunk_rows=chunk)
    for site, dish in itertools.product("ns", "AB"):
        alone = df.where((F.col("site") == site) & (F.col("dish") == dish))
        want = sk.stock_ledger(alone.select("dish", "date", F.col("a").alias("qty")), alone.select("dish", "date", F.col("b").alias("qty")), key="dish", span="key")
        cols = ("date", "delivered", "demand", "sold", "short", "waste", "closing")
        assert rows(led.where((F.col("site") == site) & (F.col("dish") == dish)), *cols) == rows(want, *cols)
    plan = df.select("site", "dish", "date", F.lit(3.0).alias("forecast"), F.col("b").alias("actual"), F.lit(1.0).alias("buffer"))
    bt = sk.policy_backtest(plan, key=("site", "dish"), chunk_rows=chunk)
    one = sk.policy_backtest(plan.where("site = 's'").drop("site"))
    assert rows(bt.where("site = 's'"), *one.columns) == rows(one)


def test_fractions_in_the_ledger(spark):
    lots = sk.receive(spark.createDataFrame([(d("2023-01-01"), "x", 2.7, 9)], "date date, item string, qty double, lot int"))
    assert rows(lots, "item", "expiry", "qty", "lot") == [("x", d("2023-01-04"), 2.7, 9)]
    dl = spark.createDataFrame([(d("2023-01-01"), "x", 2.75)], "date date, item string, qty double")
    dm = spark.createDataFrame([(d("2023-01-02"), "x", 0.5)], "date date, item string, qty double")
    got = sk.stock_ledger(dl, dm).orderBy("date").collect()
    assert [r.closing for r in got] == [2.75, 2.25] and got[1].sold == 0.5


def test_duplicate_days_fail(spark):
    plan = spark.createDataFrame([("x", d("2023-01-01"), 1.0, 1, 0.0), ("x", d("2023-01-01"), 2.0, None, 0.0)],
                                 "dish string, date date, forecast double, actual long, buffer double")
    with pytest.raises(Exception, match="more than one row"):
        sk.policy_backtest(plan).collect()
    with pytest.raises(ValueError, match="more than one row"):
        folds.ledger_fold(pd.DataFrame({"item": ["a", "a"], "date": [dt.date(2023, 1, 1)] * 2, "delivered": 1, "demand": 0}), 3, ["item"])

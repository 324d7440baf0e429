"""Staged publish of several tables, gap runs of densify, the wide file as text."""

import collections
import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import d, rows
from shelfwise.functions import presets
from shelfwise.operators import calendar as cal
from shelfwise.operators import reshape as rs
from shelfwise.plans.wide_file import long_sales, weather_days
from shelfwise.sources import daily


def _set(spark, n=3):
    return {"predictions": spark.range(n).select(F.col("id").alias("item"), F.lit(1.5).alias("pred")),
            "orders": spark.range(2).select(F.col("id").alias("dish"), F.lit(4).alias("order_qty"))}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_publish_reads_back_both(spark, tmp_path, fmt):
    tables = _set(spark)
    folders = daily.publish(tables, str(tmp_path), "run-1", fmt)
    back = daily.read_published(spark, str(tmp_path), "run-1", {n: t.schema for n, t in tables.items()})
    assert {n: rows(t) for n, t in back.items()} == {n: rows(t) for n, t in tables.items()}
    assert daily.publish(_set(spark, 9), str(tmp_path), "run-1", fmt) == folders  # a published run is not written again
    assert back["predictions"].count() == 3
    with pytest.raises(ValueError):
        daily.publish({"orders": tables["orders"]}, str(tmp_path), "run-1", fmt)
    daily.publish(_set(spark, 5), str(tmp_path), "run-2", fmt)
    assert daily.read_published(spark, str(tmp_path), "run-2")["predictions"].count() == 5


def test_lost_attempt_leaves_no_half_set(spark, tmp_path):
    broken = _set(spark) | {"orders": spark.range(2).select(F.raise_error(F.lit("executor lost")).cast("int").alias("x"))}
    with pytest.raises(Exception, match="executor lost"):
        daily.publish(broken, str(tmp_path), "run")
    with pytest.raises(daily.RunNotCommitted):
        daily.read_published(spark, str(tmp_path), "run")
    daily.publish(_set(spark), str(tmp_path), "run")
    back = daily.read_published(spark, str(tmp_path), "run")
    assert back["predictions"].count() == 3 and back["orders"].count() == 2
    assert len(list((tmp_path / "run").iterdir())) == 2 and len(list((tmp_path / "_commits").glob("*.json"))) == 1
    with pytest.raises(ValueError):
        daily.publish(_set(spark), str(tmp_path), "../elsewhere")


def _brute(events, keys, lo, hi):
    total = collections.Counter()
    for day, key, qty in events:
        total[key, day] += qty or 0
    return sorted((lo + dt.timedelta(days=i), k, total[k, lo + dt.timedelta(days=i)]) for k in keys for i in range((hi - lo).days + 1))


def test_gap_runs_from_events(spark):
    """Event-level input: many rows a day, gaps of any length, a hot key, null quantities, null dates."""
    start = d("2023-01-01")
    events = [(start + dt.timedelta(days=i * i % 53), "hot" if i % 3 else f"k{i % 7}", i % 4 if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(events + [(None, "hot", 1)], "date date, item string, qty long")
    lo, hi = min(e[0] for e in events), max(e[0] for e in events)
    keys = {e[1] for e in events}
    assert rows(cal.densify(df), "date", "item", "qty") == _brute(events, keys, lo, hi)
    own = []
    for k in keys:
        mine = [e for e in events if e[1] == k]
        own += _brute(mine, [k], min(e[0] for e in mine), max(e[0] for e in mine))
    assert rows(cal.densify(df, span="key"), "date", "item", "qty") == sorted(own)
    cut = [e for e in events if d("2023-01-10") <= e[0] <= d("2023-02-10")]
    table = spark.createDataFrame([(k,) for k in [*sorted(keys)[:3], "never sold"]], "item string")
    got = cal.densify(df, key_table=table, between=("2023-01-10", "2023-02-10"))
    want = [e for e in cut if e[1] in sorted(keys)[:3]]
    assert rows(got, "date", "item", "qty") == _brute(want, [*sorted(keys)[:3], "never sold"], d("2023-01-10"), d("2023-02-10"))
    assert cal.densify(df.limit(0)).count() == 0


def test_hot_key_spreads_before_it_is_ordered(spark):
    """The events are summed per key and day first; only daily rows are exchanged by key."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(1000).select(F.expr("date_add(DATE'2023-01-01', CAST(id % 50 AS INT))").alias("date"), F.when(F.col("id") % 3 > 0, "hot").otherwise("b").alias("item"), F.lit(1).cast("long").alias("qty"))
        plan = cal.densify(df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    lines = [x.strip() for x in plan.splitlines()]
    by_key = next(i for i, x in enumerate(lines) if "hashpartitioning(item#" in x and "date#" not in x.split("hashpartitioning(")[1].split(")")[0])
    by_day = next(i for i, x in enumerate(lines) if "hashpartitioning(item#" in x and "date#" in x.split("hashpartitioning(")[1].split(")")[0])
    assert by_key < by_day and any("partial_sum" in x for x in lines[by_day:]) and "Union" not in plan


def test_wide_csv_as_text(spark, tmp_path):
    """The file read without a schema: quantities as '3.0' and 2.7, blanks, one-hot weekdays as text."""
    (tmp_path / "daily.csv").write_text(
        "Date,Day of the Week_Monday,Day of the Week_Tuesday,Qty (Sales)_LASAGNE - 3513,Qty (Sales)_RIBEYE STEAK - 6501,Gross Rev._LASAGNE - 3513,Temp Avg (°C)\n"
        "2023-01-02,1.0,0.0,3.0,2.7,45.5,7.5\n2023-01-03,0,1, ,1,,\n", encoding="utf-8")
    wide = daily.scan_daily(spark, str(tmp_path / "daily.csv"))
    long = long_sales(wide, presets.frames(spark)["dish_item"])
    assert rows(long, "date", "item", "dow", "qty", "revenue") == [
        (d("2023-01-02"), "LASAGNE - 3513", "Monday", 3.0, 45.5), (d("2023-01-02"), "RIBEYE STEAK - 6501", "Monday", 2.7, None),
        (d("2023-01-03"), "LASAGNE - 3513", "Tuesday", None, None), (d("2023-01-03"), "RIBEYE STEAK - 6501", "Tuesday", 1.0, None)]
    assert rows(weather_days(wide), "date", "temp_avg") == [(d("2023-01-02"), 7.5), (d("2023-01-03"), None)]
    bad = wide.withColumn("Gross Rev._LASAGNE - 3513", F.lit("n/a"))
    with pytest.raises(Exception):
        long_sales(bad, presets.frames(spark)["dish_item"]).collect()


def test_pivot_adds_up(spark):
    df = spark.createDataFrame([(d("2023-01-01"), "x", 2), (d("2023-01-01"), "x", 3), (d("2023-01-01"), "y", 1)], "date date, item string, qty bigint")
    assert rows(rs.pivot_items(df, "qty", ["x", "y", "z"])) == [(d("2023-01-01"), 5, 1, None)]

"""Date ranges reach the Parquet scan."""

import datetime as dt

import pytest

from conftest import SF001
from shelfwise.plans.catalog import QUERIES
from shelfwise.plans.inputs import Inputs


@pytest.mark.parametrize("name", ["date_slice", "yoy_weekday_aligned", "split_by_year", "item_stats", "stable_items", "dow_profile"])
def test_ranges_are_pushed_to_the_scan(spark, name):
    plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x and "l_shipdate" in x]
    assert scans and all("GreaterThanOrEqual(l_shipdate" in x and "LessThan(l_shipdate" in x for x in scans)


def test_ranges_equal_filters(spark):
    i = Inputs(spark, SF001)
    a, b = dt.date(1999, 3, 1), dt.date(1999, 3, 31)
    c, d = dt.date(2000, 1, 1), dt.date(2000, 1, 1)
    got = sorted(tuple(r) for r in i.sales_of((a, b), (c, d)).collect())
    want = sorted(tuple(r) for r in i.sales.collect() if a <= r.date <= b or c <= r.date <= d)
    assert got == want and got
    year = i.dense_of(1999, 1999)
    assert sorted(tuple(r) for r in year.collect()) == sorted(tuple(r) for r in i.dense.where("year(date) = 1999").collect())

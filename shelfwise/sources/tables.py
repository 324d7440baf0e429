"""Canonical tables built from the driver's parquet tables.

The daily wide file of the original application is not shipped; its long-form
content is derived from ``lineitem``/``part``/``orders`` (see FIXTURES.md):

* ``sales(date, item, dish, channel, qty, revenue)`` -- item = dish + channel
* ``weather_day(date, temp_avg, precipitation, windspeed, humidity)``
* ``item_type(dish, type)`` and ``dish_item(dish, item, channel, ord)``
* ``delivery`` / ``demand`` ``(date, item, qty)`` keyed by dish (stock key)

Only the needed columns are read, so the parquet scan prunes columns; joins to
``part`` are left to AQE (broadcast when its runtime size is small, sort-merge
otherwise).
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources.daily import read_parquet


Days = Sequence[tuple[dt.date, dt.date]]


def in_days(df: DataFrame, column: str, days: Days) -> DataFrame:
    """The rows of the given inclusive day ranges, as comparisons of the stored column itself, so that the Parquet scan
    gets them (row groups and files outside are not read)."""
    kind = df.schema[column].dataType
    ranges = [(F.col(column) >= F.lit(str(a)).cast(kind)) & (F.col(column) < F.lit(str(b + dt.timedelta(days=1))).cast(kind)) for a, b in days]
    return df.where(functools.reduce(lambda x, y: x | y, ranges))


def _lineitem_part(spark: SparkSession, sf_dir: str, days: Days | None = None) -> DataFrame:
    li = read_parquet(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_returnflag", "l_linestatus", "l_shipdate")
    if days:
        li = in_days(li, "l_shipdate", days)
    pt = read_parquet(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(pt, li.l_partkey == pt.p_partkey, "inner")


def net_revenue_units() -> F.Column:
    """Exact net revenue, price x (1 - discount) with both at 2 decimals, as a BIGINT
    count of 1/10000 currency units: price in
    cents times the kept share in percent. Summing BIGINT stays on the fast path,
    while a DECIMAL sum widens past 18 digits and runs on BigDecimal."""
    cents = (F.col("l_extendedprice").cast("decimal(12,2)") * 100).cast("bigint")
    kept = ((F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")) * 100).cast("bigint")
    return cents * kept


def units_to_money(units: F.Column) -> F.Column:
    """Exact DECIMAL(38,4) from a sum of 1/10000 units (once per group, not per row)."""
    return (units.cast("decimal(38,4)") / 10000).cast("decimal(38,4)")


def sales(spark: SparkSession, sf_dir: str, days: Days | None = None) -> DataFrame:
    """Daily sales per item (= dish + channel), of the given day ranges or all days. Partial aggregation happens map-side;
    the grouping uses the raw columns, and the item and channel strings are built once
    per (day, item) group instead of once per line."""
    lp = _lineitem_part(spark, sf_dir, days)
    g = (lp.groupBy(F.to_date("l_shipdate").alias("date"), "p_brand", "l_linestatus")
         .agg(F.sum("l_quantity").cast("bigint").alias("qty"),
              units_to_money(F.sum(net_revenue_units())).alias("revenue")))
    return g.select(
        "date", F.concat_ws(" ", "p_brand", "l_linestatus").alias("item"), F.col("p_brand").alias("dish"),
        F.when(F.col("l_linestatus") == "O", F.lit("DINE_IN")).otherwise(F.lit("TAKEAWAY")).alias("channel"),
        "qty", "revenue")


def stock_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries ('R') and demand ('A') per (date, dish) in one pass over the lines;
    a side without lines that day is null."""
    lp = _lineitem_part(spark, sf_dir).where(F.col("l_returnflag").isin("R", "A"))
    q = F.col("l_quantity")
    return (lp.groupBy(F.to_date("l_shipdate").alias("date"), F.col("p_brand").alias("item"))
            .agg(F.sum(F.when(F.col("l_returnflag") == "R", q)).cast("bigint").alias("delivered"),
                 F.sum(F.when(F.col("l_returnflag") == "A", q)).cast("bigint").alias("demand")))


def site_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals per site and item in one pass over the lines: sales (qty, revenue), deliveries ('R') and demand ('A'),
    the last two null on days without such lines. The site is the supplier's region."""
    li = read_parquet(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    pt = read_parquet(spark, sf_dir, "part").select("p_partkey", "p_brand")
    su = read_parquet(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    na = read_parquet(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    re = read_parquet(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("site"))
    sites = su.join(na, su.s_nationkey == na.n_nationkey).join(re, na.n_regionkey == re.r_regionkey).select("s_suppkey", "site")
    lp = li.join(pt, li.l_partkey == pt.p_partkey).join(sites, li.l_suppkey == sites.s_suppkey)
    q = F.col("l_quantity")
    g = lp.groupBy(F.to_date("l_shipdate").alias("date"), "site", "p_brand", "l_linestatus").agg(
        F.sum(q).cast("bigint").alias("qty"), units_to_money(F.sum(net_revenue_units())).alias("revenue"),
        F.sum(F.when(F.col("l_returnflag") == "R", q)).cast("bigint").alias("delivered"),
        F.sum(F.when(F.col("l_returnflag") == "A", q)).cast("bigint").alias("demand"))
    return g.select("date", "site", F.concat_ws(" ", "p_brand", "l_linestatus").alias("item"), F.col("p_brand").alias("dish"),
                    F.when(F.col("l_linestatus") == "O", F.lit("DINE_IN")).otherwise(F.lit("TAKEAWAY")).alias("channel"),
                    "qty", "revenue", "delivered", "demand")


def delivery_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single deliveries (date, item, qty, lot): one lot per line, told apart by the line's number."""
    li = read_parquet(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select(
        "l_partkey", "l_quantity", "l_shipdate", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("lot"))
    pt = read_parquet(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return li.join(pt, li.l_partkey == pt.p_partkey).select(
        F.to_date("l_shipdate").alias("date"), F.col("p_brand").alias("item"), F.col("l_quantity").cast("bigint").alias("qty"), "lot")


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order date; stands in for the four weather columns."""
    o = read_parquet(spark, sf_dir, "orders").select(
        "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")
    n = F.count(F.lit(1))
    return (o.groupBy(F.to_date("o_orderdate").alias("date"))
            .agg((F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double") / n / 10000)
                 .alias("temp_avg"),
                 F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0))
                 .cast("double").alias("precipitation"),
                 F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
                 .cast("double").alias("windspeed"),
                 n.cast("double").alias("humidity")))


def item_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Course type per dish, from the brand number (rule of the test fixture)."""
    p = read_parquet(spark, sf_dir, "part").select("p_brand")
    num = F.substring("p_brand", 7, 8).cast("int") % 3
    return (p.select(F.col("p_brand").alias("dish"),
                     F.when(num == 0, "Side").when(num == 1, "Starter").otherwise("Main").alias("type"))
            .distinct())


def dish_item(sales_df: DataFrame, site: Sequence[str] = ()) -> DataFrame:
    """Dish -> item dimension (of each site); the dine-in item is the dish's representative (ord 1)."""
    return (sales_df.select(*site, "dish", "item", "channel").distinct()
            .withColumn("ord", F.when(F.col("channel") == "DINE_IN", 1).otherwise(2)))

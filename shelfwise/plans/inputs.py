"""Lazily built input frames of the registered queries (one set per call)."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import calendar as cal
from shelfwise.operators import stock
from shelfwise.operators.forecast import same_weekday_forecast
from shelfwise.operators.policy import buffers_share, order_inputs, order_quantity
from shelfwise.operators.stats import item_stats, unit_price
from shelfwise.plans import params as P
from shelfwise.session import cut_lineage
from shelfwise.sources import tables


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def sales(self) -> DataFrame:
        """Daily sales per item, materialised once in the shared checkpoint folder: every
        query below derives several frames from it (keys, day span, values), and without
        the cut Catalyst would re-aggregate the raw line table for each of them."""
        return cut_lineage(tables.sales(self.spark, self.sf_dir))

    def sales_of(self, *days: tuple[dt.date, dt.date]) -> DataFrame:
        """Daily sales of the given day ranges, the ranges pushed to the scan of the lines; for queries that need
        a few days or one year and use them once."""
        return tables.sales(self.spark, self.sf_dir, days)

    @cached_property
    def known_items(self) -> DataFrame:
        """The file's item list, as the original has it in its columns: also items without a sale in a range."""
        rows = [(f"{b} {c}", b, "DINE_IN" if c == "O" else "TAKEAWAY") for b in P.BRANDS for c in P.CHANNELS]
        return self.spark.createDataFrame(rows, "item string, dish string, channel string")

    def dense_of(self, first: int, last: int) -> DataFrame:
        """The dense series of whole years (that the table covers), from their days alone."""
        days = (dt.date(first, 1, 1), dt.date(last, 12, 31))
        return cal.densify(self.sales_of(days), ("item",), ("qty",), attrs=("dish", "channel"), key_table=self.known_items, between=days)

    @cached_property
    def dish_item(self) -> DataFrame:
        return tables.dish_item(self.sales)

    @cached_property
    def item_type(self) -> DataFrame:
        return tables.item_type(self.spark, self.sf_dir)

    @cached_property
    def weather(self) -> DataFrame:
        """A row a day, materialised once: the feature matrix needs it for the day and for the day after."""
        return cut_lineage(tables.weather(self.spark, self.sf_dir))

    @cached_property
    def flows(self) -> DataFrame:
        """Deliveries and demand per (date, dish) from one pass, materialised once."""
        return cut_lineage(tables.stock_flows(self.spark, self.sf_dir))

    @cached_property
    def deliveries(self) -> DataFrame:
        return (self.flows.where(F.col("delivered").isNotNull())
                .select("date", "item", F.col("delivered").alias("qty")))

    @cached_property
    def demand(self) -> DataFrame:
        return (self.flows.where(F.col("demand").isNotNull())
                .select("date", "item", F.col("demand").alias("qty")))

    @cached_property
    def lots(self) -> DataFrame:
        return stock.receive(self.deliveries)

    @cached_property
    def lot_lines(self) -> DataFrame:
        """One lot per delivered line, several to an item and expiry."""
        return stock.receive(tables.delivery_lines(self.spark, self.sf_dir))

    @cached_property
    def stock(self) -> DataFrame:
        """Lots left when the as-of date opens, from the recorded ledger up to the day before."""
        before = F.col("date") < F.lit(P.AS_OF).cast("date")
        led = stock.stock_ledger(self.deliveries.where(before), self.demand.where(before), with_left=True)
        return stock.lots_left(led, P.AS_OF)

    @cached_property
    def holidays(self) -> DataFrame:
        return cal.holiday_calendar(self.sales.select("date"), P.HOLIDAY_MONTH_DAYS)

    @cached_property
    def dense(self) -> DataFrame:
        return cal.densify(self.sales, ("item",), ("qty",), attrs=("dish", "channel"))

    @cached_property
    def dense_cal(self) -> DataFrame:
        return cal.calendar_features(self.dense, self.holidays)

    @cached_property
    def days(self) -> DataFrame:
        """Calendar of the sales days."""
        return cal.calendar(self.sales.select("date"), self.holidays)

    @cached_property
    def item_forecast(self) -> DataFrame:
        return same_weekday_forecast(self.dense_cal)

    @cached_property
    def dish_daily(self) -> DataFrame:
        return stock.dish_rollup(self.dense)  # the series carries its dish

    @cached_property
    def dish_forecast(self) -> DataFrame:
        return same_weekday_forecast(self.dish_daily, keys=("dish",), out="forecast")

    @cached_property
    def means_all(self) -> DataFrame:
        return item_stats(self.dense)

    @cached_property
    def share_buffers(self) -> DataFrame:
        return buffers_share(self.dish_item, self.means_all, P.OVERRIDE_A, P.OVERRIDE_B,
                             P.SHARE_BUFFER_HIGH, P.SHARE_BUFFER_MID)

    @cached_property
    def price(self) -> DataFrame:
        return unit_price(self.sales, self.dish_item)

    def backtest_plan(self, year: int = P.TEST_YEAR) -> DataFrame:
        f = self.dish_forecast.where(F.year("date") == year)
        return (f.join(self.share_buffers, "dish", "left")
                .select("dish", "date", "forecast", F.col("qty").alias("actual"), "buffer"))

    def backtest(self, adaptive: bool = True) -> DataFrame:
        return stock.policy_backtest(self.backtest_plan(), adaptive=adaptive)


class SiteInputs:
    """The same frames per site: every key is (site, item) or (site, dish)."""
    SITE, ITEM, DISH = ("site",), ("site", "item"), ("site", "dish")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def daily(self) -> DataFrame:
        """Sales, deliveries and demand per (date, site, item) from one pass over the lines, materialised once."""
        return cut_lineage(tables.site_daily(self.spark, self.sf_dir))

    @cached_property
    def dish_item(self) -> DataFrame:
        return tables.dish_item(self.daily, self.SITE)

    @cached_property
    def dense(self) -> DataFrame:
        return cal.densify(self.daily, self.ITEM, ("qty",), attrs=("dish", "channel"))

    @cached_property
    def dish_forecast(self) -> DataFrame:
        return same_weekday_forecast(stock.dish_rollup(self.dense, site=self.SITE), keys=self.DISH, out="forecast")

    @cached_property
    def buffers(self) -> DataFrame:
        return buffers_share(self.dish_item, item_stats(self.dense, keys=self.ITEM), P.OVERRIDE_A, P.OVERRIDE_B,
                             P.SITE_BUFFER_HIGH, P.SITE_BUFFER_MID, site=self.SITE)

    @cached_property
    def price(self) -> DataFrame:
        return unit_price(self.daily, self.dish_item, site=self.SITE)

    def _flow(self, column: str) -> DataFrame:
        return self.daily.where(F.col(column).isNotNull()).select("date", *self.DISH, F.col(column).alias("qty"))

    @cached_property
    def ledger(self) -> DataFrame:
        """The recorded stock ledger of every site's dishes."""
        return stock.stock_ledger(self._flow("delivered"), self._flow("demand"), key=self.DISH)

    @cached_property
    def stock(self) -> DataFrame:
        """Lots left when the as-of date opens."""
        before = F.col("date") < F.lit(P.AS_OF).cast("date")
        led = stock.stock_ledger(self._flow("delivered").where(before), self._flow("demand").where(before), key=self.DISH, with_left=True)
        return stock.lots_left(led, P.AS_OF, self.DISH)

    def orders(self) -> DataFrame:
        """Order quantities of the as-of date: the site's forecast, buffers and stock."""
        f = self.dish_forecast.where(F.col("date") == F.lit(P.AS_OF).cast("date")).select(*self.DISH, "date", "forecast")
        usable = stock.usable_stock(self.stock, P.AS_OF, self.DISH)
        return order_quantity(order_inputs(f, self.buffers, usable, keys=self.DISH, stock_key=self.DISH))

    def backtest(self, year: int = P.TEST_YEAR) -> DataFrame:
        f = self.dish_forecast.where(F.year("date") == year).join(self.buffers, list(self.DISH), "left")
        return stock.policy_backtest(f.select(*self.DISH, "date", "forecast", F.col("qty").alias("actual"), "buffer"), key=self.DISH)

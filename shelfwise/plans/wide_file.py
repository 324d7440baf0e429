"""From the original wide daily file to the long tables every operator takes.

``long_sales`` pairs each ``Qty (Sales)_<item>`` column with its ``Gross Rev._<item>``
twin in one generator per row, attaches the dish of each item from a dish_item table,
and ``weather_days`` renames the weather columns. With these two frames a user of the
original file runs the same operators as on any other sales table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.constants import DATE_COL, QTY_PREFIX, WEATHER_COLUMNS
from shelfwise.functions.exprs import number, quoted
from shelfwise.operators.reshape import decode_weekday, pair_qty_revenue, unpivot_measures
from shelfwise.sources.daily import parse_dates


def long_sales(wide: DataFrame, dish_item: DataFrame, date_mode: str = "strict") -> DataFrame:
    """``sales(date, item, dish, channel, dow, qty, revenue)`` from the wide file. Items
    without a revenue twin keep their quantity with a null revenue. Items missing from
    ``dish_item`` keep a null dish (they still count in daily totals). A file read without a schema has text in
    every column: '3.0' and '2.7' are quantities, blanks are null."""
    w = decode_weekday(parse_dates(wide, DATE_COL, date_mode))
    ids = (DATE_COL, "dow")
    paired = pair_qty_revenue(w, ids)
    qty_only = (unpivot_measures(w.select(*[quoted(c) for c in w.columns if c in ids or c.startswith(QTY_PREFIX)]),
                                 QTY_PREFIX, "qty", ids)
                .join(paired.select("item").distinct(), "item", "left_anti")
                .withColumn("revenue", F.lit(None).cast("double")))
    qty_only = qty_only.withColumn("qty", number(qty_only, "qty"))
    long = paired.unionByName(qty_only.select(*paired.columns))
    m = dish_item.select("item", "dish", "channel")
    return (long.join(m, "item", "left")
            .select(F.col(f"`{DATE_COL}`").alias("date"), "item", "dish", "channel", "dow",
                    "qty", "revenue"))


def weather_days(wide: DataFrame, date_mode: str = "strict") -> DataFrame:
    """``weather_day(date, temp_avg, precipitation, windspeed, humidity[, *_norm])``."""
    w = parse_dates(wide, DATE_COL, date_mode)
    cols = [F.col(f"`{DATE_COL}`").alias("date")]
    for src, dst in WEATHER_COLUMNS.items():
        if src in w.columns:
            cols.append(number(w, src).cast("double").alias(dst))
        if src + "_norm" in w.columns:
            cols.append(number(w, src + "_norm").cast("double").alias(dst + "_norm"))
    return w.select(*cols)

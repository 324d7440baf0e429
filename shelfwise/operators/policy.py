"""Ordering policy: 27 order_inputs, 57 buffers_rmse, 58 buffers_share,
59 order_quantity, 60 waste_adjust_forecast, 61 waste_adjust_buffer.

Ladders are ordered (cut-off, factor) lists given as arguments; the defaults are the
original cut-offs. The same ladders are evaluated in the keyed back-test fold
(:mod:`shelfwise.operators.stock`) through :func:`forecast_factor` and :func:`adjust_buffer`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: default ladders (ratio cut-offs and factors) ----------------------
# forecast: ratio > .25 x0.6, > .2 x0.7, > .15 x0.8, > .1 x0.9, < .05 x1.05, else x1
FORECAST_LADDER = ((0.25, 0.6), (0.2, 0.7), (0.15, 0.8), (0.1, 0.9))
FORECAST_LOW = (0.05, 1.05)
# buffer (only once something was ordered): > .2 x0.6, > .15 x0.75, > .1 x0.9, < .05 x1.1
BUFFER_LADDER = ((0.2, 0.6), (0.15, 0.75), (0.1, 0.9))
BUFFER_LOW = (0.05, 1.1)
BUFFER_CAP = 1.3


def forecast_factor_expr(ratio: Column, ladder=FORECAST_LADDER, low=FORECAST_LOW) -> Column:
    out = None
    for cut, f in ladder:
        out = F.when(ratio > cut, F.lit(f)) if out is None else out.when(ratio > cut, F.lit(f))
    return out.when(ratio < low[0], F.lit(low[1])).otherwise(F.lit(1.0))


def forecast_factor(ratio: float, ladder=FORECAST_LADDER, low=FORECAST_LOW) -> float:
    for cut, f in ladder:
        if ratio > cut:
            return f
    return low[1] if ratio < low[0] else 1.0


def adjust_buffer_expr(base: Column, ratio: Column, orders: Column, ladder=BUFFER_LADDER,
                       low=BUFFER_LOW, cap=BUFFER_CAP) -> Column:
    out = None
    for cut, f in ladder:
        val = F.greatest(F.lit(0.0), base * F.lit(f))
        out = F.when(ratio > cut, val) if out is None else out.when(ratio > cut, val)
    out = out.when(ratio < low[0], F.least(base * F.lit(low[1]), base * F.lit(cap))).otherwise(base)
    return F.when(orders > 0, out).otherwise(base)


def adjust_buffer(base: float, ratio: float, orders: float, ladder=BUFFER_LADDER,
                  low=BUFFER_LOW, cap=BUFFER_CAP) -> float:
    if not orders > 0:
        return base
    for cut, f in ladder:
        if ratio > cut:
            return max(0.0, base * f)
    if ratio < low[0]:
        return min(base * low[1], base * cap)
    return base


def representative_items(dish_item: DataFrame, site: Sequence[str] = ()) -> DataFrame:
    """First item (lowest ``ord``) of each dish (of each site) represents it."""
    return (dish_item.groupBy(*site, "dish")
            .agg(F.min_by("item", F.struct("ord", "item")).alias("item")))


# ---------------------------------------------------------------- 57. buffers_rmse
def buffers_rmse(dish_item: DataFrame, stats: DataFrame, rmse: DataFrame,
                 override_a: Sequence[str], override_b: Sequence[str], high: float = 3.0,
                 rmse_mult: float = 1.5, avg_mult: float = 0.25, floor_value: float = 0.25,
                 a_value: float = 0.3, b_value: float = 2.0, site: Sequence[str] = ()) -> DataFrame:
    """Training-time buffer per dish from its representative item's training mean
    (``stats.avg_qty``) and RMSE: A -> a_value; avg>high -> ceil(rmse_mult*rmse);
    avg>0 -> ceil(avg_mult*avg); else floor_value; then B -> b_value. ``site`` names further key columns that all
    three frames carry (a site's own means and errors)."""
    rep = representative_items(dish_item, site)
    j = (rep.join(stats.select(*site, "item", "avg_qty"), [*site, "item"], "left")
            .join(rmse.select(*site, "item", "rmse"), [*site, "item"], "left"))
    avg = F.coalesce(F.col("avg_qty"), F.lit(0.0))
    r = F.coalesce(F.col("rmse"), F.lit(0.0))
    buf = (F.when(F.col("dish").isin(list(override_b)), F.lit(float(b_value)))
           .when(F.col("dish").isin(list(override_a)), F.lit(float(a_value)))
           .when(avg > high, F.ceil(r * rmse_mult).cast("double"))
           .when(avg > 0, F.ceil(avg * avg_mult).cast("double"))
           .otherwise(F.lit(float(floor_value))))
    return j.select(*site, "dish", buf.alias("buffer"))


# --------------------------------------------------------------- 58. buffers_share
def buffers_share(dish_item: DataFrame, means: DataFrame, override_a: Sequence[str],
                  override_b: Sequence[str], high: float = 5.0, mid: float = 2.0,
                  shares: tuple[float, float, float] = (0.3, 0.25, 0.2),
                  a_value: float = 0.3, b_value: float = 1.5, site: Sequence[str] = ()) -> DataFrame:
    """Serving buffer per dish from its representative item's mean over all data
    (``means.avg_qty``; a missing item counts 0): A, B fixed; avg>high -> ceil(.3 avg);
    avg>mid -> ceil(.25 avg); else ceil(.2 avg). ``site`` as in :func:`buffers_rmse`."""
    rep = representative_items(dish_item, site)
    j = rep.join(means.select(*site, "item", "avg_qty"), [*site, "item"], "left")
    avg = F.coalesce(F.col("avg_qty"), F.lit(0.0))
    buf = (F.when(F.col("dish").isin(list(override_a)), F.lit(float(a_value)))
           .when(F.col("dish").isin(list(override_b)), F.lit(float(b_value)))
           .when(avg > high, F.ceil(avg * shares[0]).cast("double"))
           .when(avg > mid, F.ceil(avg * shares[1]).cast("double"))
           .otherwise(F.ceil(avg * shares[2]).cast("double")))
    return j.select(*site, "dish", buf.alias("buffer"))


# ---------------------------------------------------------------- 27. order_inputs
def order_inputs(fc: DataFrame, buffers: DataFrame, usable: DataFrame,
                 keys: Sequence[str] = ("dish",), stock_key: str | Sequence[str] = "dish") -> DataFrame:
    """Forecast left-joined to buffers and usable stock on the stock key (one column or several: a site and a dish);
    missing values are 0, fractions of stock stay."""
    on = [stock_key] if isinstance(stock_key, str) else list(stock_key)
    j = (fc.join(buffers.select(*on, F.col("buffer").alias("_b")), on, "left")
           .join(usable.select(*on, F.col("usable").alias("_u")), on, "left"))
    return j.select(*keys, *[c for c in fc.columns if c not in keys],
                    F.coalesce("_b", F.lit(0.0)).alias("buffer"),
                    F.coalesce("_u", F.lit(0)).alias("usable"))


# -------------------------------------------------------------- 59. order_quantity
def order_quantity(inputs: DataFrame, forecast: str = "forecast", submit_only: bool = False) -> DataFrame:
    """order = max(0, ceil(forecast + buffer - usable)); submit keeps orders > 0."""
    q = F.greatest(F.lit(0), F.ceil(F.col(forecast) + F.col("buffer") - F.col("usable")).cast("bigint"))
    out = inputs.withColumn("order_qty", q)
    return out.where(F.col("order_qty") > 0) if submit_only else out


# ------------------------------------------------------- 60. waste_adjust_forecast
def waste_adjust_forecast(fc: DataFrame, ratios: DataFrame, on: Sequence[str] = ("dish",),
                          forecast: str = "forecast", ladder=FORECAST_LADDER,
                          low=FORECAST_LOW) -> DataFrame:
    """Scale the forecast by the waste-ratio ladder; no history -> unchanged.
    ``on`` = ('dish',) for one ratio per dish, ('dish', 'date') for a ratio per day."""
    j = fc.join(ratios.select(*on, F.col("waste_ratio").alias("_r")), list(on), "left")
    f = F.when(F.col("_r").isNull(), F.lit(1.0)).otherwise(forecast_factor_expr(F.col("_r"), ladder, low))
    return j.withColumn("forecast_adj", F.col(forecast) * f).drop("_r")


# -------------------------------------------------------- 61. waste_adjust_buffer
def waste_adjust_buffer(buffers: DataFrame, ratios: DataFrame, on: Sequence[str] = ("dish",),
                        ladder=BUFFER_LADDER, low=BUFFER_LOW, cap=BUFFER_CAP) -> DataFrame:
    """Adjust the base buffer by the waste-ratio ladder, only once orders > 0."""
    j = buffers.join(ratios.select(*on, F.col("waste_ratio").alias("_r"), F.col("orders").alias("_o")),
                     list(on), "left")
    adj = adjust_buffer_expr(F.col("buffer"), F.col("_r"), F.coalesce(F.col("_o"), F.lit(0)),
                             ladder, low, cap)
    return j.withColumn("buffer_adj", adj).drop("_r", "_o")

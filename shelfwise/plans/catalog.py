"""Registered queries: one per operator of the inventory, each over the driver's tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame. The equivalent
DuckDB SQL of each lives in :mod:`shelfwise.plans.oracle` under the same key.
Floating results that two engines may sum in a different order are rounded to 6
places on both sides.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.constants import QTY_PREFIX
from shelfwise.operators import calendar as cal
from shelfwise.operators import features as fe
from shelfwise.operators import forecast as fc
from shelfwise.operators import policy as po
from shelfwise.operators import reshape as rs
from shelfwise.operators import stats as st
from shelfwise.operators import stock as sk
from shelfwise.operators import yoy
from shelfwise.plans import params as P
from shelfwise.plans import training as tr
from shelfwise.plans.inputs import Inputs, SiteInputs
from shelfwise.session import scratch_path
from shelfwise.sources import daily

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def r2(c) -> F.Column:
    """Money totals to the penny (sums of many doubles differ beyond that by engine)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 2)


# ---------------------------------------------------------------- sources / sinks
@query
def scan_daily(spark, sf_dir):
    """Wide daily table written as CSV with header and read back with its schema."""
    i = Inputs(spark, sf_dir)
    path = daily.write_daily_csv(daily.daily_wide(i.sales, P.ITEMS), scratch_path(spark, "daily_csv"))
    return daily.scan_daily(spark, path, daily.wide_schema(P.ITEMS))


@query
def parse_dates(spark, sf_dir):
    """Dates as text, unreadable where the day's quantity is 45 or more; coerce mode."""
    i = Inputs(spark, sf_dir)
    txt = i.sales.select(
        F.when(F.col("qty") >= 45, F.lit("n/a")).otherwise(F.col("date").cast("string")).alias("Date"),
        "item", "qty")
    return daily.parse_dates(txt, "Date", mode="coerce")


@query
def write_forecast(spark, sf_dir):
    """Predictions and orders published as one set under a run id, and read back."""
    i = Inputs(spark, sf_dir)
    orders = po.order_quantity(_order_inputs(i)).select("date", "dish", "order_qty")
    root = scratch_path(spark, "published")
    daily.publish({"predictions": i.item_forecast.select("date", "item", "pred"), "orders": orders}, root, "daily")
    back = daily.read_published(spark, root, "daily")
    p = back["predictions"].select(F.lit("predictions").alias("table"), "date", F.col("item").alias("key"), r6("pred").alias("value"))
    o = back["orders"].select(F.lit("orders").alias("table"), "date", F.col("dish").alias("key"), F.col("order_qty").cast("double").alias("value"))
    return p.unionByName(o)


@query
def save_pipeline(spark, sf_dir):
    """The whole pipeline fitted and saved, loaded back, and every complete row scored by both: equal scores."""
    fitted = []
    path = tr.saved_pipeline(spark, sf_dir, fitted)
    loaded = daily.load_pipeline(path)
    # fitted earlier in this application: a second save and load stands in for the model in memory
    memory = fitted[0] if fitted else daily.load_pipeline(daily.save_pipeline(loaded, scratch_path(spark, "pipeline")))
    rows = tr.matrix(spark, sf_dir).dropna(subset=["date", "item"])
    return fc.same_scores(loaded, memory, rows).select("date", "item", "qty", "same_scores")


# -------------------------------------------------------------------- reshape
@query
def unpivot_measures(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    wide = daily.daily_wide(i.sales, P.ITEMS)
    return rs.unpivot_measures(wide, QTY_PREFIX, "qty")


@query
def pivot_items(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return rs.pivot_items(i.sales, "qty", P.ITEMS)


@query
def pair_qty_revenue(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return rs.pair_qty_revenue(daily.daily_wide(i.sales, P.ITEMS))


@query
def decode_weekday(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    wide = daily.daily_wide(i.sales, P.ITEMS)
    return rs.decode_weekday(wide).select(F.col("Date"), F.col("dow"))


# ------------------------------------------------------------------- calendar
@query
def calendar_features(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return i.days.select("date", "dow", "month", "quarter", "year", "is_weekend", "is_holiday")


@query
def calendar_dummies(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    d = cal.calendar_dummies(i.days)
    return d.select("date", *[f"Month_{m}" for m in range(2, 13)], *[f"Quarter_{q}" for q in range(2, 5)])


@query
def date_slice(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    as_of = dt.date.fromisoformat(P.AS_OF)
    return cal.date_slice(fe.total_daily_sales(i.sales_of((dt.date(as_of.year, 1, 2), as_of))), P.AS_OF)


@query
def point_in_time(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return cal.point_in_time(i.weather, P.AS_OF, ["temp_avg", "precipitation", "windspeed", "humidity"])


@query
def densify(spark, sf_dir):
    return Inputs(spark, sf_dir).dense


# ------------------------------------------------------------------- features
@query
def total_daily_sales(spark, sf_dir):
    return fe.total_daily_sales(Inputs(spark, sf_dir).sales)


@query
def course_flags(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return fe.course_flags(i.sales, i.item_type)


@query
def season_interactions(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return fe.season_interactions(i.dense_cal).select(
        "date", "item", "month_interaction", "quarter_interaction", "holiday_interaction")


@query
def weekend_interaction(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return fe.weekend_interaction(i.dense_cal, P.HIGH_DEMAND).select("date", "item", "weekend_interaction")


@query
def weather_interactions(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return fe.weather_interactions(i.days, i.weather).select(
        "date", "temp_holiday_interaction", "precipitation_saturday_interaction")


@query
def side_saturday(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return fe.side_saturday(i.dense, i.item_type)


@query
def low_demand_flag(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    a = fe.low_demand_flag(i.dense, P.WATCHED, "any_today").withColumnRenamed("low_demand", "low_demand_any")
    b = fe.low_demand_flag(i.dense, P.WATCHED, "all_yesterday").withColumnRenamed("low_demand", "low_demand_prev")
    return a.join(b, "date", "inner")


@query
def drop_incomplete(spark, sf_dir):
    """Lags (null at the series start) and weather (missing days) then complete rows only."""
    i = Inputs(spark, sf_dir)
    f = fe.lags(i.dense, "qty", (1, 2)).join(i.weather.select("date", "temp_avg", "precipitation"), "date", "left")
    return fe.drop_incomplete(f.select("date", "item", "qty", "qty_lag1", "qty_lag2", "temp_avg", "precipitation"))


@query
def assemble_features(spark, sf_dir):
    """Three blocks of one series, each adding its columns: one exchange, no join."""
    f = fe.assemble_features([Inputs(spark, sf_dir).dense_cal, lambda s: fe.lags(s, "qty", (1,)), lambda s: fe.trend(s, (7,)),
                              lambda s: fe.dow_rolling_mean(s, 6)])
    return f.select("date", "item", "qty_lag1", r6("trend_7").alias("trend_7"), r6("dow_avg").alias("dow_avg"))


@query
def lags(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    f = fe.lags(i.dense, "qty", P.LAG_GROUPS)
    f = fe.lags(f, "qty", (1,), edge="clamp", prefix="clamp_lag")
    return f.select("date", "item", "qty_lag1", "qty_lag2", "qty_lag3", "qty_lag4", "qty_lag5", "clamp_lag1")


@query
def dow_rolling_mean(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return fe.dow_rolling_mean(i.dense_cal, 6).select("date", "item", r6("dow_avg").alias("dow_avg"))


@query
def trend(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    t = fe.trend(i.dense, (7, 14, 21))
    return t.select("date", "item", *[r6(f"trend_{n}").alias(f"trend_{n}") for n in (7, 14, 21)])


@query
def sales_ratio_dow(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    r = fe.sales_ratio_dow(i.dense_cal, P.TRAIN_YEAR)
    return r.select("date", "item", r6("sales_ratio_dow").alias("sales_ratio_dow"))


@query
def dow_std_feature(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return fe.dow_std_feature(i.dense_cal, P.TRAIN_YEAR).select("date", "item", r6("dow_std").alias("dow_std"))


# ---------------------------------------------------------------------- joins
@query
def map_stats(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    prof = st.dow_profile(i.dense_cal, P.TRAIN_YEAR)
    m = st.map_stats(i.dense_cal, prof, ("item", "dow"), ("dow_mean",), 0.0)
    return m.select("date", "item", r6("dow_mean").alias("dow_mean"))


@query
def dish_rollup(spark, sf_dir):
    """Item series without a dish, rolled up by the mapping."""
    i = Inputs(spark, sf_dir)
    return sk.dish_rollup(i.dense.select("date", "item", "qty"), i.dish_item)


@query
def split_by_year(spark, sf_dir):
    s = fc.split_by_year(Inputs(spark, sf_dir).dense_of(P.TRAIN_YEAR, P.TEST_YEAR), P.TRAIN_YEAR, P.TEST_YEAR)
    return s.select("date", "item", "qty", "split")


@query
def forecast_vs_actual(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    p = fc.forecast_vs_actual(i.item_forecast, i.dense)
    return p.select("date", "item", r6("pred").alias("pred"), "actual")


@query
def yoy_weekday_aligned(spark, sf_dir):
    return _aligned(Inputs(spark, sf_dir))


def _daily_revenue(i: Inputs) -> DataFrame:
    """The days that the comparison can meet: the base year (and the week after it, into which the last days of December
    can be aligned), and the current year up to the as-of date."""
    as_of = dt.date.fromisoformat(P.AS_OF)
    days = ((dt.date(P.BASE_YEAR, 1, 1), dt.date(P.BASE_YEAR + 1, 1, 7)), (dt.date(as_of.year, 1, 2), as_of))
    return (i.sales_of(*days).groupBy("date").agg(F.sum("revenue").cast("double").alias("sales")))


def _aligned(i: Inputs) -> DataFrame:
    return yoy.yoy_weekday_aligned(_daily_revenue(i), P.AS_OF, P.BASE_YEAR)


def _order_inputs(i: Inputs) -> DataFrame:
    f = i.dish_forecast.where(F.col("date") == F.lit(P.AS_OF).cast("date")).select("dish", "date", "forecast")
    usable = sk.usable_stock(i.stock, P.AS_OF).withColumnRenamed("item", "dish")   # stock key = dish
    return po.order_inputs(f, i.share_buffers, usable)


@query
def order_inputs(spark, sf_dir):
    o = _order_inputs(Inputs(spark, sf_dir))
    return o.select("dish", "date", "forecast", "buffer", "usable")


@query
def fifo_allocate(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return sk.fifo_allocate(i.lot_lines, i.demand, lot_order=("expiry", "lot"))


# --------------------------------------------------------------- aggregations
def _train_stats(i: Inputs) -> DataFrame:
    return st.item_stats(i.dense_of(P.TRAIN_YEAR, P.TRAIN_YEAR), P.TRAIN_YEAR)


@query
def item_stats(spark, sf_dir):
    s = _train_stats(Inputs(spark, sf_dir))
    return s.select("item", r6("avg_qty").alias("avg_qty"), r6("std_qty").alias("std_qty"))


@query
def stable_items(spark, sf_dir):
    s = st.stable_items(_train_stats(Inputs(spark, sf_dir)), P.STABLE_MAX_AVG, P.STABLE_MAX_STD)
    return s.select("item", r6("avg_qty").alias("avg_qty"), r6("std_qty").alias("std_qty"))


@query
def dow_profile(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    p = st.dow_profile(cal.calendar_features(i.dense_of(P.TRAIN_YEAR, P.TRAIN_YEAR), None), P.TRAIN_YEAR)
    return p.select("item", "dow", r6("dow_mean").alias("dow_mean"), r6("dow_std").alias("dow_std"))


@query
def unit_price(spark, sf_dir):
    return Inputs(spark, sf_dir).price.select("dish", r6("price").alias("price"))


def _test_pairs(i: Inputs, year: int = P.TEST_YEAR) -> DataFrame:
    return fc.forecast_vs_actual(i.item_forecast.where(F.year("date") == year), i.dense)


def _accuracy(i: Inputs) -> DataFrame:
    return st.accuracy_by_item(_test_pairs(i))


@query
def accuracy_by_item(spark, sf_dir):
    a = _accuracy(Inputs(spark, sf_dir))
    return a.select("item", r6("rmse").alias("rmse"), r6("mae").alias("mae"), r6("r2").alias("r2"))


@query
def accuracy_macro(spark, sf_dir):
    m = st.accuracy_macro(_accuracy(Inputs(spark, sf_dir)))
    return m.select(r6("avg_rmse").alias("avg_rmse"), r6("avg_mae").alias("avg_mae"),
                    r6("avg_r2").alias("avg_r2"), "n_items")


@query
def bias_factors(spark, sf_dir):
    b = st.bias_factors(_test_pairs(Inputs(spark, sf_dir), P.TRAIN_YEAR))
    return b.select("item", r6("bias_factor").alias("bias_factor"))


@query
def usable_stock(spark, sf_dir):
    return sk.usable_stock(Inputs(spark, sf_dir).stock, P.AS_OF)


def _ratios(i: Inputs) -> DataFrame:
    return sk.waste_ratio(i.backtest(True))


@query
def waste_ratio(spark, sf_dir):
    r = _ratios(Inputs(spark, sf_dir))
    return r.select("dish", "waste", "orders", r6("waste_ratio").alias("waste_ratio"), "waste_pct")


@query
def high_waste(spark, sf_dir):
    r = sk.high_waste(_ratios(Inputs(spark, sf_dir)), P.HIGH_WASTE)
    return r.select("dish", r6("waste_ratio").alias("waste_ratio"))


@query
def monthly_losses(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    m = sk.monthly_losses(i.backtest(True), i.price, year=P.TEST_YEAR)
    return m.select("month", r2("waste_money").alias("waste_money"), r2("stockout_money").alias("stockout_money"))


def _kpis(i: Inputs, adaptive: bool) -> DataFrame:
    return sk.year_kpis(i.backtest(adaptive), i.price)


@query
def year_kpis(spark, sf_dir):
    k = _kpis(Inputs(spark, sf_dir), True)
    money = ("revenue", "cost_of_sales", "waste_money", "stockout_money")
    return k.select(*[(r2(c) if c in money else r6(c)).alias(c) for c in k.columns])


@query
def yoy_weekday_report(spark, sf_dir):
    rep = yoy.yoy_weekday_report(_aligned(Inputs(spark, sf_dir)))
    # day means of revenue are money: to the penny (6 places exceed double precision at 1e7)
    return rep.select("weekday", "weekday_no", r2("current_avg").alias("current_avg"),
                      r2("base_avg").alias("base_avg"), "n_days", "current_rounded", "base_rounded",
                      "change_pct", r2("current_overall").alias("current_overall"),
                      r2("base_overall").alias("base_overall"), "days_analysed")


@query
def table_profile(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    m = tr.matrix(spark, sf_dir)
    return st.table_profile(i.dense_cal, train=m.where(F.col("year") == P.TRAIN_YEAR), test=m.where(F.col("year") == P.TEST_YEAR),
                            feature_cols=fc.FEATURE_COLUMNS)


# ------------------------------------------------------------ sort / latest row
@query
def lots_by_expiry(spark, sf_dir):
    # a line's number may repeat: the quantity tells such lots apart, and lots that share it too are interchangeable
    return sk.lots_by_expiry(Inputs(spark, sf_dir).lot_lines, seq=("lot", "qty"))


def order_events(spark, sf_dir) -> DataFrame:
    """Order events from ``lineitem``: site = supplier, dish = brand, action from the
    return flag (R replace batch, N add, A accept), ts = ship date."""
    li = daily.read_parquet(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_quantity")
    pt = daily.read_parquet(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(pt, li.l_partkey == pt.p_partkey)
    action = (F.when(F.col("l_returnflag") == "R", "replace")
              .when(F.col("l_returnflag") == "N", "add").otherwise("accept"))
    return j.select(F.col("l_suppkey").alias("site"), F.col("l_shipdate").alias("ts"),
                    (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
                    F.col("p_brand").alias("dish"), action.alias("action"),
                    F.col("l_quantity").cast("bigint").alias("qty"))


@query
def pending_orders(spark, sf_dir):
    return sk.pending_orders(order_events(spark, sf_dir), site="site")


@query
def accepted_lots(spark, sf_dir):
    """Accepted orders received as lots. The accept events with an odd number state the delivered quantity; the others
    accept what was ordered."""
    ev = order_events(spark, sf_dir)
    stated = (F.col("action") != "accept") | (F.col("seq") % 2 == 1)
    got = sk.accepted_orders(ev.withColumn("qty", F.when(stated, F.col("qty"))), site="site")
    return sk.receive(got.withColumn("date", F.to_date("ts")), key="dish").select("site", "dish", F.to_date("ts").alias("accepted_at"), "seq",
                                                                                  "ordered", "qty", "expiry")


# ----------------------------------------------------------------- models
@query
def standardize(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    f = fe.dow_rolling_mean(fe.trend(i.dense_cal, (7, 14)), 6)
    cols = ["trend_7", "trend_14", "dow_avg"]
    z = st.standardize(f, cols, fit=f.where(F.year("date") == P.TRAIN_YEAR))
    return z.select("date", "item", *[r6(c).alias(c) for c in cols])


# The learners' scores differ from any other engine's. Their queries return every complete row of the matrix, all years,
# with what must hold for its score.
@query
def fit_forest(spark, sf_dir):
    """A mean of training quantities: the forest's score lies within their range."""
    scores = tr.scored(spark, sf_dir)
    label = tr.matrix(spark, sf_dir).where(F.col("year") == P.TRAIN_YEAR).agg(F.min("qty").alias("_lo"), F.max("qty").alias("_hi"))
    return cal.attach_row(scores, label).select("date", "item", "qty", F.col("rf_pred").between(F.col("_lo"), F.col("_hi")).alias("in_range"))


@query
def fit_boosted(spark, sf_dir):
    """A finite score; and better than always the mean on the training year (one flag for all rows)."""
    scores = tr.scored(spark, sf_dir)
    e = F.col("gbt_pred") - F.col("qty")
    fit = scores.where(F.year("date") == P.TRAIN_YEAR).agg((F.avg(e * e) < F.var_pop("qty")).alias("beats_mean"))
    finite = F.col("gbt_pred").isNotNull() & ~F.isnan("gbt_pred") & (F.abs("gbt_pred") < 1e9)
    return cal.attach_row(scores, fit).select("date", "item", "qty", finite.alias("finite"), "beats_mean")


@query
def predict(spark, sf_dir):
    """Both learners by the saved pipeline, blended and bias-corrected: the blend and the correction recomputed from the
    scores and the training year's factors."""
    scores = tr.scored(spark, sf_dir)
    factors = st.bias_factors(scores.where(F.year("date") == P.TRAIN_YEAR), actual="qty")
    again = fc.apply_bias(fc.blend(scores.withColumnRenamed("pred_adj", "_adj").withColumnRenamed("pred", "_pred"), P.HARD), factors)
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(F.col(b)))
    return again.select("date", "item", "qty", close("_pred", "pred").alias("blended"), close("_adj", "pred_adj").alias("corrected"),
                        (F.col("_adj") >= 0).alias("not_negative"))


@query
def forecast_to_order(spark, sf_dir):
    """The learners' forecast of the as-of date through roll-up, buffers from the learners' error, stock and order."""
    i = Inputs(spark, sf_dir)
    scores = tr.scored(spark, sf_dir)
    o = tr.learner_orders(i, scores)
    day = scores.where(F.col("date") == F.lit(P.AS_OF).cast("date")).groupBy("dish").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("pred_adj").alias("_sum"))
    want = F.greatest(F.lit(0), F.ceil(F.col("forecast") + F.col("buffer") - F.col("usable")))
    return o.join(day, "dish").select("dish", "date", "n_items", "usable", (F.abs(F.col("forecast") - F.col("_sum")) < 1e-6).alias("rolled_up"),
                                      (F.col("buffer") > 0).alias("buffered"), (F.col("order_qty") == want).alias("ordered"))


def _two_scores(i: Inputs) -> DataFrame:
    """Two deterministic score columns standing in for the learners' outputs."""
    f = fe.trend(i.item_forecast, (7,), exclude_current=True)
    return f.select("date", "item", F.col("pred").alias("rf_pred"),
                    F.coalesce(F.col("trend_7"), F.lit(0.0)).alias("gbt_pred"))


@query
def blend(spark, sf_dir):
    b = fc.blend(_two_scores(Inputs(spark, sf_dir)), P.HARD)
    return b.select("date", "item", r6("pred").alias("pred"))


@query
def apply_bias(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    factors = st.bias_factors(_test_pairs(i, P.TRAIN_YEAR))
    f = fc.apply_bias(i.item_forecast, factors)
    return f.select("date", "item", r6("pred_adj").alias("pred_adj"))


# ----------------------------------------------------------------- policy
@query
def buffers_rmse(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return po.buffers_rmse(i.dish_item, _train_stats(i), _accuracy(i), P.OVERRIDE_A, P.OVERRIDE_B,
                           high=P.RMSE_BUFFER_HIGH)


@query
def buffers_share(spark, sf_dir):
    return Inputs(spark, sf_dir).share_buffers


@query
def order_quantity(spark, sf_dir):
    o = po.order_quantity(_order_inputs(Inputs(spark, sf_dir)))
    return o.select("dish", "date", "forecast", "buffer", "usable", "order_qty")


def _ratios_by_day(i: Inputs) -> DataFrame:
    """Waste history of the adaptive back-test as known at the start of each day:
    the cumulative ratio and orders at the close of the previous day."""
    led = i.backtest(True)
    return led.select("dish", F.date_add("date", 1).alias("date"), "waste_ratio",
                      F.col("orders_cum").alias("orders"))


@query
def waste_adjust_forecast(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    f = i.dish_forecast.select("dish", "date", "forecast")
    out = po.waste_adjust_forecast(f, _ratios_by_day(i), on=("dish", "date"))
    return out.select("dish", "date", r6("forecast").alias("forecast"), r6("forecast_adj").alias("forecast_adj"))


@query
def waste_adjust_buffer(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    days = i.dish_forecast.select("dish", "date")
    b = days.join(i.share_buffers, "dish", "left")
    out = po.waste_adjust_buffer(b, _ratios_by_day(i), on=("dish", "date"))
    return out.select("dish", "date", "buffer", r6("buffer_adj").alias("buffer_adj"))


# ------------------------------------------------------------------ stock
@query
def receive(spark, sf_dir):
    return Inputs(spark, sf_dir).lots


@query
def stock_ledger(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return sk.stock_ledger(i.deliveries, i.demand)


@query
def stock_on_hand(spark, sf_dir):
    return sk.stock_on_hand(Inputs(spark, sf_dir).stock, P.AS_OF)


@query
def near_expiry(spark, sf_dir):
    return sk.near_expiry(Inputs(spark, sf_dir).stock, P.AS_OF, P.NEAR_EXPIRY_DAYS)


@query
def policy_backtest(spark, sf_dir):
    b = Inputs(spark, sf_dir).backtest(True)
    return b.select(*[r6(c).alias(c) if c in ("forecast", "forecast_adj", "buffer_adj", "waste_ratio")
                      else F.col(c) for c in b.columns])


@query
def policy_compare(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    c = sk.policy_compare(_kpis(i, False), _kpis(i, True))
    return c.select(*[r6(x).alias(x) for x in c.columns])


# --------------------------------------- the same operators per (site, dish)
@query
def site_orders(spark, sf_dir):
    """The as-of date's order of every site and dish, at the site's own price."""
    i = SiteInputs(spark, sf_dir)
    o = i.orders().join(i.price, list(i.DISH))
    return o.select("site", "dish", "date", r6("forecast").alias("forecast"), "buffer", "usable", "order_qty", r6("price").alias("price"))


@query
def site_policy_backtest(spark, sf_dir):
    b = SiteInputs(spark, sf_dir).backtest()
    return b.select(*[r6(c).alias(c) if c in ("forecast", "forecast_adj", "buffer_adj", "waste_ratio") else F.col(c) for c in b.columns])


@query
def site_waste_ratio(spark, sf_dir):
    """Waste by what was delivered, from the recorded ledger."""
    i = SiteInputs(spark, sf_dir)
    r = sk.waste_ratio(i.ledger, i.DISH, "delivered")
    return r.select(*i.DISH, "waste", F.col("orders").alias("delivered"), r6("waste_ratio").alias("waste_ratio"), "waste_pct")


@query
def site_monthly_losses(spark, sf_dir):
    """Losses of the recorded ledger, the test year's months."""
    i = SiteInputs(spark, sf_dir)
    m = sk.monthly_losses(i.ledger, i.price, key=i.DISH, year=P.TEST_YEAR)
    return m.select("month", r2("waste_money").alias("waste_money"), r2("stockout_money").alias("stockout_money"))


@query
def site_year_kpis(spark, sf_dir):
    """KPIs of the recorded ledger, all years."""
    i = SiteInputs(spark, sf_dir)
    k = sk.year_kpis(i.ledger, i.price, key=i.DISH, actual="demand")
    return k.select(*[(r6(c) if c.startswith("waste_pct") else r2(c)).alias(c) for c in k.columns])


# --------------------------------------------------------------- streaming
@query
def stream_daily_sales(spark, sf_dir):
    from shelfwise.streaming.daily import run_daily_sales
    return run_daily_sales(spark, sf_dir)


@query
def stream_stock_ledger(spark, sf_dir):
    from shelfwise.streaming.ledger import run_stream_ledger
    return run_stream_ledger(spark, sf_dir)

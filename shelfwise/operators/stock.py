"""Perishable stock: 23 dish_rollup, 28 fifo_allocate, 36 usable_stock, 37-40 reports,
49 lots_by_expiry, 50 pending_orders (and what its accepted orders brought), 62 receive, 63 stock_ledger, 64 stock_on_hand,
65 near_expiry, 66 policy_backtest, 67 policy_compare.

Stock is keyed by the stock key (``dish`` in the app; ``item`` here is that key).
The two day-by-day folds (63, 66) carry state from one day to the next, which no
window can express. Spark hash-partitions the keys and sorts each partition by
(key, date); ``mapInPandas`` folds ragged chunks of whole keys with numpy arrays across keys
(:mod:`shelfwise.operators.folds`). A key has one row per day, so its history is
bounded by the calendar, not by the raw data volume; keys run in parallel. Orders of a key's
single lots and demands (28, 49) are cut into slices over tasks (:mod:`shelfwise.operators.slices`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.constants import COST_RATE, DEFAULT_PRICE, SHELF_DAYS
from shelfwise.functions.exprs import date_lit
from shelfwise.operators import folds, slices
from shelfwise.operators.calendar import attach_row, densify, only_row
from shelfwise.operators.policy import (
    BUFFER_CAP, BUFFER_LADDER, BUFFER_LOW, FORECAST_LADDER, FORECAST_LOW)


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


# ---------------------------------------------------------------- 23. dish_rollup
def dish_rollup(df: DataFrame, dish_item: DataFrame | None = None, values: Sequence[str] = ("qty",),
                date_col: str = "date", site: Sequence[str] = ()) -> DataFrame:
    """Item values summed to their dish per day (items absent from the data add 0), per site where ``site`` names columns.

    The mapping item -> dish decides (an item without a dish takes no part; a dish column of df is replaced); without
    one, df carries its dish itself (e.g. the dense item series) and is summed directly. Partial sums are
    taken map-side, so a dish with many items is spread over tasks by day."""
    src = df if dish_item is None else df.drop("dish").join(dish_item.select(*site, "item", "dish").distinct(), [*site, "item"], "inner")
    return src.groupBy(date_col, *site, "dish").agg(*[F.sum(v).alias(v) for v in values])


# --------------------------------------------------------------------- 62. receive
def receive(orders: DataFrame, shelf_days: int = SHELF_DAYS, date_col: str = "date",
            key: str = "item") -> DataFrame:
    """Accepted orders -> lots ``(item, expiry, qty)`` with expiry = date + shelf_days; quantities keep their type
    and fractions. Further columns of the orders (a lot's id, a site) are carried along."""
    rest = [c for c in orders.columns if c not in (key, date_col, "qty", "expiry")]
    return orders.where(F.col("qty") > 0).select(key, F.date_add(date_col, shelf_days).alias("expiry"), "qty", *rest)


# ---------------------------------------------------------------- 36. usable_stock
def usable_stock(lots: DataFrame, as_of, key: str | Sequence[str] = "item") -> DataFrame:
    """Sum of lot quantities with expiry >= as_of, per key (0 when none usable); fractions stay."""
    d = date_lit(as_of)
    return lots.groupBy(*_keys(key)).agg(
        F.sum(F.when(F.col("expiry") >= d, F.col("qty")).otherwise(F.lit(0))).alias("usable"))


# -------------------------------------------------------------- 64. stock_on_hand
def stock_on_hand(lots: DataFrame, as_of, key: str | Sequence[str] = "item") -> DataFrame:
    """Lots with qty > 0 and their days left (expiry - as_of)."""
    d = date_lit(as_of)
    return (lots.where(F.col("qty") > 0)
            .select(*_keys(key), "qty", "expiry", F.datediff("expiry", d).alias("days_left")))


# ---------------------------------------------------------------- 65. near_expiry
def near_expiry(lots: DataFrame, as_of, horizon: int = 2, key: str | Sequence[str] = "item") -> DataFrame:
    """Lots with 0 <= days_left <= horizon (no quantity test, as in the original)."""
    d = date_lit(as_of)
    dl = F.datediff("expiry", d)
    return lots.where(dl.between(0, horizon)).select(*_keys(key), "qty", "expiry", dl.alias("days_left"))


# ------------------------------------------------------------- 49. lots_by_expiry
def lots_by_expiry(lots: DataFrame, key: str = "item", seq: str | Sequence[str] = "lot") -> DataFrame:
    """Consumption order of lots within a key: by expiry, then ``seq``, which must tell lots of one expiry apart (a tie
    fails, but for lots equal in every column). The rank is distributed: counts of the key's earlier slices plus the place
    in the own slice."""
    order = ["expiry", *([seq] if isinstance(seq, str) else seq)]
    return slices.running(lots, [key], order, rank="lot_rank").withColumn("lot_rank", F.col("lot_rank").cast("int"))


# -------------------------------------------------------------- 28. fifo_allocate
def fifo_allocate(lots: DataFrame, demand: DataFrame, key: str = "item",
                  lot_order: Sequence[str] = ("expiry",), demand_order: Sequence[str] = ("date",)) -> DataFrame:
    """First-in-first-out matching of lots to demand (no expiry test): which lot served
    which demand and how much.

    Each side becomes a run of cumulative ranges per key by distributed prefix sums. The range starts of both sides are
    then merged in one order of (key, position), cut into slices: at every start the serving lot and the demand are the
    last ones started, in this slice or an earlier one, and the allocated amount runs to the next start (or to
    the smaller of the two totals). Output size = lots + demands; lots and demands are never paired.

    ``lot_order`` and ``demand_order`` must be unique within a key (add the lot's id where lots share an expiry); a tie
    fails. Quantities that are null or not above 0 take no part."""
    lot_order, demand_order = list(lot_order), list(demand_order)

    def starts(df: DataFrame, order: list[str], kind: int) -> DataFrame:
        ends = slices.running(df.where(F.col("qty") > 0).select(key, *order, "qty"), [key], order, "qty", upto="_hi")
        own, other = F.struct(*order), ("_dem", "_lot")[kind]
        return ends.select(key, (F.col("_hi") - F.col("qty")).alias("_pos"), F.lit(kind).alias("_kind"),
                           own.alias(("_lot", "_dem")[kind]),
                           F.lit(None).cast(struct_of((demand, lots)[kind], (demand_order, lot_order)[kind])).alias(other),
                           F.col("_hi").alias(("_lhi", "_dhi")[kind]), F.lit(None).cast(ends.schema["_hi"].dataType).alias(("_dhi", "_lhi")[kind]))

    cut = slices.sliced(starts(lots, lot_order, 0).unionByName(starts(demand, demand_order, 1)), [key], ["_pos", "_kind"])

    def last_started(c: str) -> Column:
        return F.max(F.when(F.col(c).isNotNull(), F.struct(slices.AT, c)))[c]

    per = cut.groupBy(key, slices.SLICE).agg(F.min("_pos").alias("_first"), F.max("_lhi").alias("_lhi"), F.max("_dhi").alias("_dhi"),
                                             last_started("_lot").alias("_lot"), last_started("_dem").alias("_dem"))
    whole = Window.partitionBy(key)
    per = per.select(key, slices.SLICE, F.least(*[F.coalesce(F.max(c).over(whole), F.lit(0)) for c in ("_lhi", "_dhi")]).alias("_end"),
                     F.lead("_first").over(whole.orderBy(slices.SLICE)).alias("_after"),
                     slices.last_before(per, [key], "_lot").alias("_lot0"), slices.last_before(per, [key], "_dem").alias("_dem0"))
    w = slices.within([key])
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    met = slices.with_summary(cut.drop("_lhi", "_dhi", "_kind"), per, [key])
    s = met.select(key, "_pos", "_end", F.coalesce(F.last("_lot", ignorenulls=True).over(run), "_lot0").alias("_cl"),
                   F.coalesce(F.last("_dem", ignorenulls=True).over(run), "_dem0").alias("_cd"),
                   F.coalesce(F.lead("_pos").over(w), "_after", "_end").alias("_next"))
    seg = F.least("_next", "_end") - F.col("_pos")
    out = s.where(F.col("_pos") < F.col("_end")).withColumn("qty", seg).where(F.col("qty") > 0)
    return out.select(key, *[F.col(f"_cl.{c}").alias(f"lot_{c}") for c in lot_order],
                      *[F.col(f"_cd.{c}").alias(f"demand_{c}") for c in demand_order], "qty")


def struct_of(df: DataFrame, cols: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, df.schema[c].dataType) for c in cols])


# -------------------------------------------------------------- 50. pending_orders
def pending_orders(events: DataFrame, site: str | None = None, dish: str = "dish",
                   ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Current order book from order events ``(ts, seq, dish, action, qty)``.

    action 'replace' (submit-all): the events of the latest replace batch (same ts)
    form a fresh book, earlier events no longer count, zero quantities are ignored;
    'add' overwrites one dish (only qty > 0); 'accept' removes the dish.

    One scan and one mergeable aggregate: per (site, dish) the latest event and the latest replace event, both as
    ``max(struct)``, which pre-aggregates map-side. They decide alone: an event after the site's latest replace counts if it
    is the dish's latest; otherwise only the dish's line in that replace batch does. The site's latest replace is the
    maximum over its aggregated dishes; raw events are never joined."""
    keys = [site] if site else []
    ev = events.where((F.col("action") != "add") | (F.col("qty") > 0))
    one = F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq"), F.col("action").alias("action"), F.col("qty").alias("qty"))
    per = ev.groupBy(*keys, dish).agg(F.max(one).alias("_last"), F.max(F.when(F.col("action") == "replace", one)).alias("_batch"))
    if keys:
        per = per.withColumn("_lr", F.max("_batch.ts").over(Window.partitionBy(*keys)))  # a site's dishes, not its events
    else:
        per = attach_row(per, per.agg(F.max("_batch.ts").alias("_lr")))  # a global aggregate: one row
    line = (F.when(F.col("_lr").isNull() | (F.col("_last.ts") > F.col("_lr")), F.col("_last"))
            .when(F.col("_batch.ts") == F.col("_lr"), F.col("_batch")))
    book = per.withColumn("_l", line)
    return (book.where((F.col("_l.action") != "accept") & (F.col("_l.qty") > 0))
            .select(*keys, dish, F.col("_l.qty").alias("qty"), F.col("_l.ts").alias("ordered_at")))


def accepted_orders(events: DataFrame, site: str | None = None, dish: str = "dish", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """What each 'accept' event brought into stock: ``(site, dish, ts, seq, ordered, qty)``, for :func:`receive`.

    ``ordered`` is the dish's quantity in the book just before the event, by the rules of :func:`pending_orders`; with nothing
    pending there is no row. ``qty`` is the event's own quantity (a delivery may differ from its order) or, where that is
    null, the ordered one; not above 0 there is no row, but the order is gone all the same. Events of one instant count by
    ``seq``, a replace batch after the others.

    Two prefix passes in slices (:mod:`shelfwise.operators.slices`), so neither a site's nor a dish's events meet in one
    task: the site's last batch before each event, then the dish's own last event. Nothing is paired."""
    sites = [site] if site else []
    order = ["_ts", "_batch", "_seq", "_action", "_qty"]
    ev = events.where(F.col("action").isin("replace", "add", "accept") & ((F.col("action") != "add") | (F.col("qty") > 0))).select(
        *sites, dish, F.col(ts).alias("_ts"), F.when(F.col("action") == "replace", 1).otherwise(0).alias("_batch"),
        F.col(seq).alias("_seq"), F.col("action").alias("_action"), F.col("qty").alias("_qty"))

    batch = F.max(F.when(F.col("_batch") == 1, F.col("_ts")))
    cut = slices.sliced(ev, sites, order)
    per = cut.groupBy(*sites, slices.SLICE).agg(batch.alias("_b"))
    per = per.select(*sites, slices.SLICE, F.max("_b").over(slices.earlier(sites)).alias("_b0"))
    before = slices.within(sites).rowsBetween(Window.unboundedPreceding, -1)
    ev = slices.with_summary(cut, per, sites).select(*ev.columns, F.greatest(batch.over(before), "_b0").alias("_wiped"))

    own = [*sites, dish]
    event = F.struct("_ts", "_batch", "_action", "_qty")
    cut = slices.sliced(ev, own, order)
    per = cut.groupBy(*own, slices.SLICE).agg(F.max_by(event, slices.AT).alias("_e"))
    per = per.select(*own, slices.SLICE, slices.last_before(per, own, "_e").alias("_e0"))
    last = F.coalesce(F.lag(event).over(slices.within(own)), "_e0")
    e = slices.with_summary(cut, per, own).withColumn("_last", last).where(F.col("_action") == "accept")
    stands = (F.col("_wiped").isNull() | (F.col("_last._ts") > F.col("_wiped"))
              | ((F.col("_last._ts") == F.col("_wiped")) & (F.col("_last._batch") == 1)))
    out = e.where((F.col("_last._action") != "accept") & (F.col("_last._qty") > 0) & stands).select(
        *own, F.col("_ts").alias(ts), F.col("_seq").alias(seq), F.col("_last._qty").alias("ordered"),
        F.coalesce("_qty", "_last._qty").alias("qty"))
    return out.where(F.col("qty") > 0)


# ---------------------------------------------------------------- 63. stock_ledger
def stock_ledger(deliveries: DataFrame, demand: DataFrame, shelf_days: int = SHELF_DAYS,
                 key: str | Sequence[str] = "item", span: str = "global", chunk_rows: int = folds.CHUNK_ROWS,
                 with_left: bool = False) -> DataFrame:
    """Day-by-day ledger per key over the dense calendar: lots arrive, demand is served
    first-in-first-out from unexpired lots, the shortfall is recorded, and a lot not
    sold by expiry (received + shelf_days) is waste the day after. Invariant:
    sum(delivered) = sum(sold) + sum(waste) + closing on the last day.

    ``key`` is one column or several (a site and a dish). ``span``: 'global' gives every key all days of the table, 'key'
    each key its own first to last day, and 'events' a row only where something was delivered or asked for (what
    expired since the row before is its waste): rows as many as the input's, for many sparse keys. Quantities keep
    their type, so fractions stay. ``with_left`` adds what is left of each lot at the day's close, the lot that
    expires that day first.

    Plan: daily flows by a partial aggregate -> gap-free per key unless 'events' -> hash-partitioned by key and sorted
    within partitions -> vectorised fold over ragged chunks of whole keys (:mod:`folds`)."""
    keys = _keys(key)
    whole = all(isinstance(d.schema["qty"].dataType, T.IntegralType) for d in (deliveries, demand))
    number = T.LongType() if whole else T.DoubleType()
    none = F.lit(0).cast(number)
    d = deliveries.select(*keys, "date", F.col("qty").cast(number).alias("delivered"), none.alias("demand"))
    m = demand.select(*keys, "date", none.alias("delivered"), F.col("qty").cast(number).alias("demand"))
    flows = d.unionByName(m).groupBy(*keys, "date").agg(F.sum("delivered").alias("delivered"), F.sum("demand").alias("demand"))
    daily = flows.na.fill(0, ["delivered", "demand"]) if span == "events" else densify(flows, keys, ("delivered", "demand"), span=span)
    # the fold needs whole keys in a partition: say so, whatever the plan below provides
    daily = daily.select(*keys, "date", "delivered", "demand").repartition(*keys).sortWithinPartitions(*keys, "date")
    schema = T.StructType([daily.schema[c] for c in [*keys, "date"]] + [T.StructField(c, number) for c in (
        "delivered", "demand", "sold", "short", "waste", "closing")] + [T.StructField("left", T.ArrayType(number))])

    def run(batches):
        return folds.keyed_chunks(batches, keys, lambda c: folds.ledger_fold(c, shelf_days, keys), chunk_rows)
    out = daily.mapInPandas(run, schema)
    return out if with_left else out.drop("left")


def lots_left(ledger: DataFrame, as_of, key: str | Sequence[str] = "item", shelf_days: int = SHELF_DAYS) -> DataFrame:
    """Lots on hand when ``as_of`` opens: what the ledger (``with_left``) has left at the close of
    the day before, as ``(item, expiry, qty)`` with qty > 0. A lot that expired that day is still listed, with an expiry before as_of.
    A ledger without a row for that day (nothing moved since) counts by the key's last row before it."""
    day = F.date_sub(date_lit(as_of), 1)
    # what an older row has left has expired before that day
    near = ledger.where(F.col("date").between(F.date_sub(day, shelf_days), day))
    last = near.groupBy(*_keys(key)).agg(F.max("date").alias("date"), F.max_by("left", "date").alias("left"))
    lots = last.select(*_keys(key), "date", F.posexplode("left").alias("age", "qty"))
    return lots.where("qty > 0").select(*_keys(key), F.expr("date_add(date, age)").alias("expiry"), "qty").where(F.col("expiry") >= day)


# -------------------------------------------------------------- 66. policy_backtest
_BACKTEST = ("forecast double, forecast_adj double, buffer_adj double, usable long, order_qty long, actual long, sold long, short long, "
             "waste long, orders_cum long, waste_cum long, waste_ratio double")


def policy_backtest(plan: DataFrame, adaptive: bool = True, shelf_days: int = SHELF_DAYS,
                    forecast_ladder=FORECAST_LADDER, forecast_low=FORECAST_LOW,
                    buffer_ladder=BUFFER_LADDER, buffer_low=BUFFER_LOW, buffer_cap=BUFFER_CAP,
                    chunk_rows: int = folds.CHUNK_ROWS, key: str | Sequence[str] = "dish") -> DataFrame:
    """Replay historic days per dish: waste-adjusted forecast (60) and buffer (61),
    usable stock (36), order (59), FIFO sale with expiry (63), waste-ratio feedback.

    ``plan`` has one row per (dish, date): forecast, actual (null or no row = no data
    that day: skipped, as the original does), buffer (base). Two rows of one dish and day fail. ``key`` is one column
    or several (a site and a dish). Emits the daily ledger.
    Plan: hash-partition by dish, sort by (dish, date), vectorised fold over ragged chunks of
    whole dishes; dishes run in parallel, no day loop on the driver."""
    keys = _keys(key)
    cols = (plan.select(*keys, "date", F.col("forecast").cast("double"), F.col("actual").cast("bigint"),
                        F.col("buffer").cast("double"))
            .repartition(*keys).sortWithinPartitions(*keys, "date"))
    schema = T.StructType([cols.schema[c] for c in [*keys, "date"]] + T.StructType.fromDDL(_BACKTEST).fields)

    def fold(c):
        return folds.backtest_fold(c, adaptive, shelf_days, forecast_ladder, forecast_low,
                                   buffer_ladder, buffer_low, buffer_cap, keys)

    def run(batches):
        return folds.keyed_chunks(batches, keys, fold, chunk_rows)
    return cols.mapInPandas(run, schema)


# ------------------------------------------------------------------ 37. waste_ratio
def waste_ratio(ledger: DataFrame, key: str | Sequence[str] = "dish", order_col: str = "order_qty") -> DataFrame:
    """waste/orders per key where orders > 0, else 0; display form x100 to 2 places. The ledger is the back-test's (66) or
    the recorded one (63; ``order_col`` = 'delivered')."""
    g = ledger.groupBy(*_keys(key)).agg(F.sum("waste").cast("bigint").alias("waste"),
                                F.sum(order_col).cast("bigint").alias("orders"))
    r = F.when(F.col("orders") > 0, F.col("waste") / F.col("orders")).otherwise(F.lit(0.0))
    return g.withColumn("waste_ratio", r).withColumn("waste_pct", F.round(F.col("waste_ratio") * 100, 2))


# ------------------------------------------------------------------- 38. high_waste
def high_waste(ratios: DataFrame, threshold: float = 0.15) -> DataFrame:
    return ratios.where(F.col("waste_ratio") > threshold)


def _priced(ledger: DataFrame, price: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return ledger.join(price.select(*_keys(key), "price"), _keys(key), "left").withColumn(
        "price", F.coalesce(F.col("price"), F.lit(DEFAULT_PRICE)))


# --------------------------------------------------------------- 39. monthly_losses
def monthly_losses(ledger: DataFrame, price: DataFrame, cost_rate: float = COST_RATE,
                   key: str | Sequence[str] = "dish", year: int | None = None) -> DataFrame:
    """Per month: waste money = waste*price*cost_rate, stock-out money = short*price;
    all 12 months present (0 when no data)."""
    led = ledger if year is None else ledger.where(F.year("date") == year)
    p = _priced(led, price, key)
    g = p.groupBy(F.month("date").alias("month")).agg(
        F.sum(F.col("waste") * (F.col("price") * cost_rate)).alias("_w"),
        F.sum(F.col("short") * F.col("price")).alias("_s"))
    months = ledger.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return (months.join(g, "month", "left")
            .select("month", F.coalesce("_w", F.lit(0.0)).alias("waste_money"),
                    F.coalesce("_s", F.lit(0.0)).alias("stockout_money")))


# -------------------------------------------------------------------- 40. year_kpis
def year_kpis(ledger: DataFrame, price: DataFrame, cost_rate: float = COST_RATE,
              key: str | Sequence[str] = "dish", actual: str = "actual") -> DataFrame:
    """Revenue (actual demand x price), cost of sales, waste and stock-out money and
    waste as a percentage of revenue and of cost of sales (null when the base is 0)."""
    p = _priced(ledger, price, key)
    g = p.agg(F.sum(F.col(actual) * F.col("price")).alias("revenue"),
              F.sum(F.col("waste") * (F.col("price") * cost_rate)).alias("waste_money"),
              F.sum(F.col("short") * F.col("price")).alias("stockout_money"))
    cost = F.col("revenue") * cost_rate
    return g.select("revenue", cost.alias("cost_of_sales"), "waste_money", "stockout_money",
                    (F.try_divide(F.col("waste_money"), F.col("revenue")) * 100).alias("waste_pct_revenue"),
                    (F.try_divide(F.col("waste_money"), cost) * 100).alias("waste_pct_cost"))


# --------------------------------------------------------------- 67. policy_compare
def policy_compare(base: DataFrame, new: DataFrame) -> DataFrame:
    """Revenue change %, waste reduction % and stock-out change % of ``new`` against
    ``base`` (two one-row KPI frames, anything else fails); 0 when the base value is 0."""
    base, new = only_row(base), only_row(new)
    b = base.select(*[F.col(c).alias("b_" + c) for c in ("revenue", "waste_money", "stockout_money")])
    n = new.select(*[F.col(c).alias("n_" + c) for c in ("revenue", "waste_money", "stockout_money")])
    j = attach_row(b, n)

    def pct(num, den):
        return F.when(F.col(den) > 0, num / F.col(den) * 100).otherwise(F.lit(0.0))
    return j.select(
        pct(F.col("n_revenue") - F.col("b_revenue"), "b_revenue").alias("revenue_change_pct"),
        pct(F.col("b_waste_money") - F.col("n_waste_money"), "b_waste_money").alias("waste_reduction_pct"),
        pct(F.col("n_stockout_money") - F.col("b_stockout_money"), "b_stockout_money").alias("stockout_change_pct"))

"""DuckDB oracle SQL per registered query.

Each statement runs on the driver's tables (views ``lineitem part orders events``)
and re-derives the fixture views of FIXTURES.md as CTEs, so the check is independent
of the Spark code. Types are cast to match Spark's (DuckDB sums integers to HUGEINT,
``month`` gives BIGINT, ``ceil`` keeps DOUBLE). Constants in the recursive folds are
written as ``::DOUBLE`` because DuckDB literals are decimals.
"""

from __future__ import annotations

from shelfwise.functions.constants import (
    QTY_PREFIX, REV_PREFIX, WEEKDAY_ONEHOT_ORDER, WEEKDAY_PREFIX)
from shelfwise.operators.forecast import FEATURE_COLUMNS
from shelfwise.operators.policy import (
    BUFFER_CAP, BUFFER_LADDER, BUFFER_LOW, FORECAST_LADDER, FORECAST_LOW)
from shelfwise.plans import params as P


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _ident(s: str) -> str:
    return '"' + s.replace('"', '""') + '"'


AS_OF = f"DATE {_q(P.AS_OF)}"
HOLIDAY = " OR ".join(f"(month(date) = {m} AND day(date) = {d})" for m, d in P.HOLIDAY_MONTH_DAYS)

# name -> (sql, dependencies)
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "fx_sales": ("""
        SELECT CAST(l_shipdate AS DATE) AS date, concat(p_brand, ' ', l_linestatus) AS item, p_brand AS dish,
               CASE WHEN l_linestatus = 'O' THEN 'DINE_IN' ELSE 'TAKEAWAY' END AS channel,
               CAST(sum(l_quantity) AS BIGINT) AS qty,
               sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))) AS revenue
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4""", ()),
    "fx_weather": ("""
        SELECT CAST(o_orderdate AS DATE) AS date,
               CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) / count(*) / 10000 AS temp_avg,
               CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS DOUBLE) AS precipitation,
               CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS windspeed,
               CAST(count(*) AS DOUBLE) AS humidity
        FROM orders GROUP BY 1""", ()),
    "fx_item_type": ("""
        SELECT DISTINCT p_brand AS dish,
               CASE CAST(substr(p_brand, 7) AS INT) % 3 WHEN 0 THEN 'Side' WHEN 1 THEN 'Starter' ELSE 'Main' END AS type
        FROM part""", ()),
    "fx_delivery": ("""
        SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS item, CAST(sum(l_quantity) AS BIGINT) AS qty
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2""", ()),
    "fx_demand": ("""
        SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS item, CAST(sum(l_quantity) AS BIGINT) AS qty
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' GROUP BY 1, 2""", ()),
    "dish_item": ("""
        SELECT DISTINCT dish, item, channel, CASE WHEN channel = 'DINE_IN' THEN 1 ELSE 2 END AS ord
        FROM fx_sales""", ("fx_sales",)),
    "dense": ("""
        SELECT g.date, g.item, g.dish, g.channel, CAST(coalesce(s.qty, 0) AS BIGINT) AS qty
        FROM (SELECT i.item, i.dish, i.channel, CAST(d.d AS DATE) AS date
              FROM (SELECT DISTINCT item, dish, channel FROM fx_sales) i,
                   (SELECT unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP),
                                                  INTERVAL 1 DAY)) AS d FROM fx_sales) d) g
        LEFT JOIN fx_sales s ON s.date = g.date AND s.item = g.item""", ("fx_sales",)),
    "dense_cal": (f"""
        SELECT *, dayname(date) AS dow, CAST(month(date) AS INT) AS month, CAST(quarter(date) AS INT) AS quarter,
               CAST(year(date) AS INT) AS year,
               CAST(dayname(date) IN ('Saturday', 'Sunday') AS INT) AS is_weekend,
               CAST({HOLIDAY} AS INT) AS is_holiday
        FROM dense""", ("dense",)),
    "days": (f"""
        SELECT date, dayname(date) AS dow, CAST(month(date) AS INT) AS month, CAST(quarter(date) AS INT) AS quarter,
               CAST(year(date) AS INT) AS year,
               CAST(dayname(date) IN ('Saturday', 'Sunday') AS INT) AS is_weekend,
               CAST({HOLIDAY} AS INT) AS is_holiday
        FROM (SELECT DISTINCT date FROM fx_sales)""", ("fx_sales",)),
    "lots": ("""
        SELECT item, date + 3 AS expiry, qty FROM fx_delivery WHERE qty > 0""", ("fx_delivery",)),
    "lot_lines": ("""
        SELECT p_brand AS item, CAST(l_shipdate AS DATE) + 3 AS expiry, CAST(l_quantity AS BIGINT) AS qty, l_orderkey * 10 + l_linenumber AS lot
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND CAST(l_quantity AS BIGINT) > 0""", ()),
    "complete": ("""
        SELECT date, item, dish, qty FROM dense
        WHERE date >= (SELECT min(date) + 7 FROM dense) AND date IN (SELECT date FROM fx_weather)
          AND date - 1 IN (SELECT date FROM fx_weather)""", ("dense", "fx_weather")),
    "dow_prof": (f"""
        SELECT item, dow, avg(qty) AS dow_mean, stddev_samp(qty) AS dow_std
        FROM dense_cal WHERE year = {P.TRAIN_YEAR} GROUP BY item, dow""", ("dense_cal",)),
    "item_fc": ("""
        SELECT date, item, dow, qty,
               coalesce(avg(qty) OVER (PARTITION BY item, dow ORDER BY date
                                       ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0.0) AS pred
        FROM dense_cal""", ("dense_cal",)),
    "test_pairs": (f"""
        SELECT date, item, pred, qty AS actual FROM item_fc WHERE year(date) = {P.TEST_YEAR}""", ("item_fc",)),
    "train_pairs": (f"""
        SELECT date, item, pred, qty AS actual FROM item_fc WHERE year(date) = {P.TRAIN_YEAR}""", ("item_fc",)),
    "accuracy": ("""
        SELECT item, sqrt(sum((pred - actual) * (pred - actual)) / count(*)) AS rmse,
               avg(abs(pred - actual)) AS mae,
               CASE WHEN var_pop(CAST(actual AS DOUBLE)) * count(*) = 0
                    THEN CASE WHEN sum((pred - actual) * (pred - actual)) = 0 THEN 1.0 ELSE 0.0 END
                    ELSE 1.0 - sum((pred - actual) * (pred - actual)) / (var_pop(CAST(actual AS DOUBLE)) * count(*))
               END AS r2
        FROM test_pairs GROUP BY item""", ("test_pairs",)),
    "train_stats": (f"""
        SELECT item, avg(qty) AS avg_qty, stddev_samp(qty) AS std_qty
        FROM dense WHERE year(date) = {P.TRAIN_YEAR} GROUP BY item""", ("dense",)),
    "means_all": ("""
        SELECT item, avg(qty) AS avg_qty FROM dense GROUP BY item""", ("dense",)),
    "rep": ("""
        SELECT dish, arg_min(item, ord) AS item FROM dish_item GROUP BY dish""", ("dish_item",)),
    "share_buffers": (f"""
        SELECT r.dish,
               CASE WHEN r.dish IN {_in(P.OVERRIDE_A)} THEN 0.3::DOUBLE
                    WHEN r.dish IN {_in(P.OVERRIDE_B)} THEN 1.5::DOUBLE
                    WHEN coalesce(m.avg_qty, 0) > {P.SHARE_BUFFER_HIGH}::DOUBLE THEN CAST(ceil(coalesce(m.avg_qty, 0) * 0.3::DOUBLE) AS DOUBLE)
                    WHEN coalesce(m.avg_qty, 0) > {P.SHARE_BUFFER_MID}::DOUBLE THEN CAST(ceil(coalesce(m.avg_qty, 0) * 0.25::DOUBLE) AS DOUBLE)
                    ELSE CAST(ceil(coalesce(m.avg_qty, 0) * 0.2::DOUBLE) AS DOUBLE) END AS buffer
        FROM rep r LEFT JOIN means_all m ON m.item = r.item""", ("rep", "means_all")),
    "dish_daily": ("""
        SELECT d.date, m.dish, CAST(sum(d.qty) AS BIGINT) AS qty
        FROM dense d JOIN dish_item m ON d.item = m.item GROUP BY d.date, m.dish""", ("dense", "dish_item")),
    "dish_fc": ("""
        SELECT dish, date, qty,
               coalesce(avg(qty) OVER (PARTITION BY dish, dayname(date) ORDER BY date
                                       ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0.0) AS forecast
        FROM dish_daily""", ("dish_daily",)),
    "price": ("""
        SELECT d.dish, coalesce(CAST(p.rev AS DOUBLE) / CAST(nullif(p.q, 0) AS DOUBLE), 10.0::DOUBLE) AS price
        FROM (SELECT DISTINCT dish FROM dish_item) d
        LEFT JOIN (SELECT dish, sum(rev) AS rev, sum(q) AS q
                   FROM (SELECT dish, item, sum(revenue) AS rev, sum(qty) AS q FROM fx_sales GROUP BY dish, item)
                   WHERE q > 0 GROUP BY dish) p ON p.dish = d.dish""", ("dish_item", "fx_sales")),
    "bt_plan": (f"""
        SELECT f.dish, f.date, f.forecast, f.qty AS actual, b.buffer,
               row_number() OVER (PARTITION BY f.dish ORDER BY f.date) AS n
        FROM dish_fc f LEFT JOIN share_buffers b ON b.dish = f.dish
        WHERE year(f.date) = {P.TEST_YEAR}""", ("dish_fc", "share_buffers")),
}


def _fifo(old_to_new: list[str], demand: str) -> tuple[list[str], str]:
    """Remaining quantity per bucket after a first-in-first-out sale, and the shortfall."""
    rem, cum = [], []
    for b in old_to_new:
        cum.append(b)
        total = " + ".join(cum)
        rem.append(f"least(greatest({total} - {demand}, 0), {b})")
    return rem, f"greatest({demand} - ({' + '.join(old_to_new)}), 0)"


def _ladder_sql(ratio: str) -> str:
    parts = " ".join(f"WHEN {ratio} > {c}::DOUBLE THEN {f}::DOUBLE" for c, f in FORECAST_LADDER)
    return (f"CASE {parts} WHEN {ratio} < {FORECAST_LOW[0]}::DOUBLE THEN {FORECAST_LOW[1]}::DOUBLE "
            f"ELSE 1.0::DOUBLE END")


def _buffer_sql(base: str, ratio: str, orders: str) -> str:
    parts = " ".join(f"WHEN {ratio} > {c}::DOUBLE THEN greatest(0.0::DOUBLE, {base} * {f}::DOUBLE)"
                     for c, f in BUFFER_LADDER)
    inner = (f"CASE {parts} WHEN {ratio} < {BUFFER_LOW[0]}::DOUBLE "
             f"THEN least({base} * {BUFFER_LOW[1]}::DOUBLE, {base} * {BUFFER_CAP}::DOUBLE) ELSE {base} END")
    return f"CASE WHEN {orders} > 0 THEN {inner} ELSE {base} END"


def _backtest_cte(name: str, adaptive: bool, plan: str = "bt_plan") -> str:
    """Recursive replay of the dense test year per dish. State: lots by expiry offset
    e0..e3 relative to the last processed day, cumulative orders and waste, ratio."""
    adj = f"(p.forecast * ({_ladder_sql('b.waste_ratio')}))" if adaptive else "p.forecast"
    buf = _buffer_sql("p.buffer", "b.waste_ratio", "b.orders_cum") if adaptive else "p.buffer"
    usable = "(b.e1 + b.e2 + b.e3)"
    order = f"CAST(greatest(0, ceil({adj} + {buf} - {usable})) AS BIGINT)"
    rem, short = _fifo(["b.e1", "b.e2", "b.e3", order], "p.actual")
    orders_cum = f"(b.orders_cum + {order})"
    waste_cum = "(b.waste_cum + b.e0)"
    ratio = f"CASE WHEN {orders_cum} > 0 THEN CAST({waste_cum} AS DOUBLE) / {orders_cum} ELSE b.waste_ratio END"
    return f"""{name}(dish, n, date, forecast, forecast_adj, buffer_adj, usable, order_qty, actual, sold, short,
              waste, orders_cum, waste_cum, waste_ratio, e0, e1, e2, e3) AS (
        SELECT dish, CAST(0 AS BIGINT), CAST(NULL AS DATE), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE,
               CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT),
               CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0.0::DOUBLE,
               CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
        FROM (SELECT DISTINCT dish FROM {plan})
        UNION ALL
        SELECT p.dish, p.n, p.date, p.forecast, {adj}, {buf}, CAST({usable} AS BIGINT), {order}, p.actual,
               CAST(p.actual - {short} AS BIGINT), CAST({short} AS BIGINT), CAST(b.e0 AS BIGINT),
               CAST({orders_cum} AS BIGINT), CAST({waste_cum} AS BIGINT), {ratio},
               CAST({rem[0]} AS BIGINT), CAST({rem[1]} AS BIGINT), CAST({rem[2]} AS BIGINT), CAST({rem[3]} AS BIGINT)
        FROM {name} b JOIN {plan} p ON p.dish = b.dish AND p.n = b.n + 1)"""


def _ledger_cte(name: str = "ledger_rec", flows: str = "flows") -> str:
    """Recursive stock ledger over the global dense day span per item (buckets by age)."""
    rem, short = _fifo(["l.b2", "l.b1", "l.b0", "f.delivered"], "f.demand")
    return f"""{name}(item, n, date, delivered, demand, sold, short, waste, b0, b1, b2, b3) AS (
        SELECT item, CAST(-1 AS BIGINT), CAST(NULL AS DATE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT),
               CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT),
               CAST(0 AS BIGINT)
        FROM (SELECT DISTINCT item FROM {flows})
        UNION ALL
        SELECT f.item, f.n, f.date, f.delivered, f.demand, CAST(f.demand - {short} AS BIGINT), CAST({short} AS BIGINT),
               l.b3, CAST({rem[3]} AS BIGINT), CAST({rem[2]} AS BIGINT), CAST({rem[1]} AS BIGINT), CAST({rem[0]} AS BIGINT)
        FROM {name} l JOIN {flows} f ON f.item = l.item AND f.n = l.n + 1)"""


CTES["flows"] = ("""
    SELECT k.item, CAST(g.i AS BIGINT) AS n, CAST(b.lo + CAST(g.i AS INT) AS DATE) AS date,
           CAST(coalesce(dl.qty, 0) AS BIGINT) AS delivered, CAST(coalesce(dm.qty, 0) AS BIGINT) AS demand
    FROM (SELECT item FROM fx_delivery UNION SELECT item FROM fx_demand) k,
         (SELECT min(date) AS lo, max(date) AS hi FROM (SELECT date FROM fx_delivery UNION ALL SELECT date FROM fx_demand)) b,
         (SELECT unnest(range(0, 100000)) AS i) g
    LEFT JOIN fx_delivery dl ON dl.item = k.item AND dl.date = b.lo + CAST(g.i AS INT)
    LEFT JOIN fx_demand dm ON dm.item = k.item AND dm.date = b.lo + CAST(g.i AS INT)
    WHERE g.i <= b.hi - b.lo""", ("fx_delivery", "fx_demand"))
CTES["lots_left"] = (f"""
    SELECT item, CAST(date + age AS DATE) AS expiry, qty
    FROM (SELECT item, date, 0 AS age, b3 AS qty FROM ledger_rec UNION ALL SELECT item, date, 1, b2 FROM ledger_rec
          UNION ALL SELECT item, date, 2, b1 FROM ledger_rec UNION ALL SELECT item, date, 3, b0 FROM ledger_rec)
    WHERE date = {AS_OF} - 1 AND qty > 0""", ("ledger_rec",))
# per site: (site, dish) as one text, split where the result is returned
CTES["site_lines"] = ("""
    SELECT CAST(l_shipdate AS DATE) AS date, r_name AS site, p_brand AS dish, concat(p_brand, ' ', l_linestatus) AS item,
           concat(r_name, '|', p_brand) AS site_dish, concat(r_name, '|', p_brand, ' ', l_linestatus) AS site_item,
           CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS ord, l_returnflag AS flag, l_quantity AS qty,
           CAST(l_extendedprice AS DECIMAL(12,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))) AS revenue
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""", ())
CTES["site_days"] = ("""
    SELECT CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date
    FROM site_lines""", ("site_lines",))
CTES["site_dense"] = ("""
    SELECT d.date, k.site_dish, k.site_item, k.ord, coalesce(s.qty, 0) AS qty
    FROM (SELECT DISTINCT site_dish, site_item, ord FROM site_lines) k CROSS JOIN site_days d
    LEFT JOIN (SELECT date, site_item, sum(qty) AS qty FROM site_lines GROUP BY 1, 2) s ON s.date = d.date AND s.site_item = k.site_item""",
    ("site_lines", "site_days"))
CTES["site_fc"] = ("""
    SELECT site_dish, date, qty,
           coalesce(avg(qty) OVER (PARTITION BY site_dish, dayname(date) ORDER BY date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), 0.0) AS forecast
    FROM (SELECT site_dish, date, CAST(sum(qty) AS BIGINT) AS qty FROM site_dense GROUP BY 1, 2)""", ("site_dense",))
CTES["site_buffers"] = (f"""
    SELECT site_dish, CASE WHEN split_part(site_dish, '|', 2) IN {_in(P.OVERRIDE_A)} THEN 0.3::DOUBLE
        WHEN split_part(site_dish, '|', 2) IN {_in(P.OVERRIDE_B)} THEN 1.5::DOUBLE
        WHEN m > {P.SITE_BUFFER_HIGH}::DOUBLE THEN CAST(ceil(m * 0.3::DOUBLE) AS DOUBLE)
        WHEN m > {P.SITE_BUFFER_MID}::DOUBLE THEN CAST(ceil(m * 0.25::DOUBLE) AS DOUBLE)
        ELSE CAST(ceil(m * 0.2::DOUBLE) AS DOUBLE) END AS buffer
    FROM (SELECT site_dish, arg_min(m, ord) AS m FROM (SELECT site_dish, site_item, ord, avg(qty) AS m FROM site_dense GROUP BY 1, 2, 3) GROUP BY 1)""",
    ("site_dense",))
CTES["site_price"] = ("""
    SELECT site_dish, coalesce(CAST(sum(rev) FILTER (WHERE q > 0) AS DOUBLE) / CAST(nullif(sum(q) FILTER (WHERE q > 0), 0) AS DOUBLE),
                               10.0::DOUBLE) AS price
    FROM (SELECT site_dish, site_item, sum(revenue) AS rev, sum(qty) AS q FROM site_lines GROUP BY 1, 2) GROUP BY 1""", ("site_lines",))
CTES["site_flows"] = ("""
    SELECT k.item, CAST(d.date - b.lo AS BIGINT) AS n, d.date, CAST(coalesce(f.delivered, 0) AS BIGINT) AS delivered, CAST(coalesce(f.demand, 0) AS BIGINT) AS demand
    FROM (SELECT DISTINCT site_dish AS item FROM site_lines WHERE flag IN ('R', 'A')) k
    CROSS JOIN (SELECT min(date) AS lo, max(date) AS hi FROM site_lines WHERE flag IN ('R', 'A')) b
    JOIN site_days d ON d.date BETWEEN b.lo AND b.hi
    LEFT JOIN (SELECT date, site_dish AS item, sum(qty) FILTER (WHERE flag = 'R') AS delivered, sum(qty) FILTER (WHERE flag = 'A') AS demand
               FROM site_lines GROUP BY 1, 2) f ON f.date = d.date AND f.item = k.item""", ("site_lines", "site_days"))
CTES["site_plan"] = (f"""
    SELECT f.site_dish AS dish, f.date, f.forecast, f.qty AS actual, b.buffer, row_number() OVER (PARTITION BY f.site_dish ORDER BY f.date) AS n
    FROM site_fc f JOIN site_buffers b USING (site_dish) WHERE year(f.date) = {P.TEST_YEAR}""", ("site_fc", "site_buffers"))
RECURSIVE = {
    "bt_adaptive": (_backtest_cte("bt_adaptive", True), ("bt_plan",)),
    "bt_standard": (_backtest_cte("bt_standard", False), ("bt_plan",)),
    "ledger_rec": (_ledger_cte(), ("flows",)),
    "site_ledger": (_ledger_cte("site_ledger", "site_flows"), ("site_flows",)),
    "site_bt": (_backtest_cte("site_bt", True, "site_plan"), ("site_plan",)),
}


def with_ctes(*names: str) -> str:
    """WITH clause holding the named CTEs and everything they depend on, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        deps = CTES[n][1] if n in CTES else RECURSIVE[n][1]
        for d in deps:
            visit(d)
        order.append(n)
    for n in names:
        visit(n)
    parts = [RECURSIVE[n][0] if n in RECURSIVE else f"{n} AS ({CTES[n][0]})" for n in order]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def _wide_select() -> str:
    cols = ["date AS \"Date\""]
    cols += [f"CAST(dayname(date) = {_q(d)} AS INTEGER) AS {_ident(WEEKDAY_PREFIX + d)}" for d in WEEKDAY_ONEHOT_ORDER]
    cols += [f"max(qty) FILTER (WHERE item = {_q(i)}) AS {_ident(QTY_PREFIX + i)}" for i in P.ITEMS]
    cols += [f"max(CAST(revenue AS DOUBLE)) FILTER (WHERE item = {_q(i)}) AS {_ident(REV_PREFIX + i)}" for i in P.ITEMS]
    return "SELECT " + ", ".join(cols) + " FROM fx_sales GROUP BY date"


ITEM_VALUES = "(VALUES " + ", ".join(f"({_q(i)})" for i in P.ITEMS) + ") AS it(item)"
WIDE_GRID = f"""(SELECT d.date, it.item FROM (SELECT DISTINCT date FROM fx_sales) d CROSS JOIN {ITEM_VALUES}) g
    LEFT JOIN fx_sales s ON s.date = g.date AND s.item = g.item"""


def r6(expr: str, alias: str) -> str:
    return f"round({expr}, 6) AS {alias}"


BACKTEST_OUT = """dish, date, round(forecast, 6) AS forecast, round(forecast_adj, 6) AS forecast_adj,
    round(buffer_adj, 6) AS buffer_adj, usable, order_qty, actual, sold, short, waste, orders_cum, waste_cum,
    round(waste_ratio, 6) AS waste_ratio"""


def _ratio_sql(src: str, where: str = "") -> str:
    return f"""SELECT dish, CAST(sum(waste) AS BIGINT) AS waste, CAST(sum(order_qty) AS BIGINT) AS orders,
        CASE WHEN sum(order_qty) > 0 THEN CAST(sum(waste) AS DOUBLE) / sum(order_qty) ELSE 0.0 END AS waste_ratio
        FROM {src} WHERE n > 0 {where} GROUP BY dish"""


def _kpi_sql(src: str) -> str:
    return f"""SELECT sum(b.actual * p.price) AS revenue,
        sum(b.waste * (p.price * 0.25::DOUBLE)) AS waste_money, sum(b.short * p.price) AS stockout_money
        FROM {src} b LEFT JOIN price p ON p.dish = b.dish WHERE b.n > 0"""


ORACLE_SQL: dict[str, str] = {}


def _add(name: str, ctes: tuple[str, ...], body: str) -> None:
    ORACLE_SQL[name] = (with_ctes(*ctes) if ctes else "") + body


# ------------------------------------------------------------- sources / sinks
_add("scan_daily", ("fx_sales",), _wide_select())
_add("parse_dates", ("fx_sales",), """
SELECT TRY_CAST(txt AS DATE) AS "Date", item, qty
FROM (SELECT CASE WHEN qty >= 45 THEN 'n/a' ELSE CAST(date AS VARCHAR) END AS txt, item, qty FROM fx_sales)
WHERE TRY_CAST(txt AS DATE) IS NOT NULL""")
_add("write_forecast", ("item_fc", "dish_fc", "share_buffers", "lots_left"), f"""
SELECT 'predictions' AS "table", date, item AS key, round(pred, 6) AS value FROM item_fc
UNION ALL
SELECT 'orders', f.date, f.dish, CAST(greatest(0, ceil(f.forecast + coalesce(b.buffer, 0.0) - coalesce(u.usable, 0))) AS DOUBLE)
FROM dish_fc f LEFT JOIN share_buffers b ON b.dish = f.dish
LEFT JOIN (SELECT item AS dish, sum(CASE WHEN expiry >= {AS_OF} THEN qty ELSE 0 END) AS usable FROM lots_left GROUP BY item) u
  ON u.dish = f.dish
WHERE f.date = {AS_OF}""")

# --------------------------------------------------------------------- reshape
_add("unpivot_measures", ("fx_sales",), f"""
SELECT g.date AS "Date", g.item, s.qty FROM {WIDE_GRID}""")
_add("pivot_items", ("fx_sales",), "SELECT date, " + ", ".join(
    f"max(qty) FILTER (WHERE item = {_q(i)}) AS {_ident(i)}" for i in P.ITEMS) + " FROM fx_sales GROUP BY date")
_add("pair_qty_revenue", ("fx_sales",), f"""
SELECT g.date AS "Date", g.item, s.qty, CAST(s.revenue AS DOUBLE) AS revenue FROM {WIDE_GRID}""")
_add("decode_weekday", ("fx_sales",), """
SELECT DISTINCT date AS "Date", dayname(date) AS dow FROM fx_sales""")

# -------------------------------------------------------------------- calendar
_add("calendar_features", ("days",), """
SELECT date, dow, month, quarter, year, is_weekend, is_holiday FROM days""")
_add("calendar_dummies", ("days",), "SELECT date, " + ", ".join(
    [f"CAST(month = {m} AS INTEGER) AS Month_{m}" for m in range(2, 13)]
    + [f"CAST(quarter = {q} AS INTEGER) AS Quarter_{q}" for q in range(2, 5)]) + " FROM days")
_add("date_slice", ("fx_sales",), f"""
SELECT date, CAST(coalesce(sum(qty), 0) AS BIGINT) AS total_daily_sales FROM fx_sales
WHERE date BETWEEN make_date(year({AS_OF}), 1, 2) AND {AS_OF} GROUP BY date""")
_add("point_in_time", ("fx_weather",), f"""
SELECT t.date, t.temp_avg, t.precipitation, t.windspeed, t.humidity,
       n.temp_avg AS next_temp_avg, n.precipitation AS next_precipitation,
       n.windspeed AS next_windspeed, n.humidity AS next_humidity
FROM fx_weather t LEFT JOIN fx_weather n ON n.date = t.date + 1 WHERE t.date = {AS_OF}""")
_add("densify", ("dense",), "SELECT date, item, dish, channel, qty FROM dense")

# -------------------------------------------------------------------- features
_add("total_daily_sales", ("fx_sales",), """
SELECT date, CAST(coalesce(sum(qty), 0) AS BIGINT) AS total_daily_sales FROM fx_sales GROUP BY date""")
_add("course_flags", ("fx_sales", "fx_item_type"), """
SELECT s.date,
       max(CASE WHEN t.type = 'Side' AND s.qty IS NOT NULL THEN 1 ELSE 0 END) AS has_side,
       max(CASE WHEN t.type = 'Starter' AND s.qty IS NOT NULL THEN 1 ELSE 0 END) AS has_starter
FROM fx_sales s LEFT JOIN fx_item_type t ON t.dish = s.dish GROUP BY s.date""")
_add("season_interactions", ("dense_cal",), """
SELECT date, item, qty * month AS month_interaction, qty * quarter AS quarter_interaction,
       qty * is_holiday AS holiday_interaction FROM dense_cal""")
_add("weekend_interaction", ("dense_cal",), f"""
SELECT date, item, is_weekend * qty AS weekend_interaction FROM dense_cal WHERE item IN {_in(P.HIGH_DEMAND)}""")
_add("weather_interactions", ("days", "fx_weather"), """
SELECT d.date, w.temp_avg * d.is_holiday AS temp_holiday_interaction,
       (CASE WHEN d.dow = 'Saturday' THEN 1 ELSE 0 END) * w.precipitation AS precipitation_saturday_interaction
FROM days d LEFT JOIN fx_weather w ON w.date = d.date""")
_add("side_saturday", ("dense", "fx_item_type"), """
SELECT d.date, CAST((CASE WHEN dayname(d.date) = 'Saturday' THEN 1 ELSE 0 END)
                    * coalesce(sum(CASE WHEN t.type = 'Side' THEN d.qty END), 0) AS BIGINT) AS side_saturday_interaction
FROM dense d LEFT JOIN fx_item_type t ON t.dish = d.dish GROUP BY d.date""")
_add("low_demand_flag", ("dense",), f"""
, w AS (SELECT date, max(CASE WHEN qty = 0 THEN 1 ELSE 0 END) AS any0, min(CASE WHEN qty = 0 THEN 1 ELSE 0 END) AS all0
        FROM dense WHERE item IN {_in(P.WATCHED)} GROUP BY date)
SELECT a.date, a.any0 AS low_demand_any,
       CASE WHEN a.date = (SELECT min(date) FROM w) THEN a.all0 ELSE coalesce(p.all0, 0) END AS low_demand_prev
FROM w a LEFT JOIN w p ON p.date + 1 = a.date""")
_add("drop_incomplete", ("dense", "fx_weather"), """
SELECT * FROM (
  SELECT d.date, d.item, d.qty, lag(d.qty, 1) OVER (PARTITION BY d.item ORDER BY d.date) AS qty_lag1,
         lag(d.qty, 2) OVER (PARTITION BY d.item ORDER BY d.date) AS qty_lag2, w.temp_avg, w.precipitation
  FROM dense d LEFT JOIN fx_weather w ON w.date = d.date)
WHERE qty_lag1 IS NOT NULL AND qty_lag2 IS NOT NULL AND temp_avg IS NOT NULL AND precipitation IS NOT NULL""")
_add("assemble_features", ("dense_cal",), """
SELECT date, item, lag(qty, 1) OVER (PARTITION BY item ORDER BY date) AS qty_lag1,
       round(avg(qty) OVER (PARTITION BY item ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS trend_7,
       round(avg(qty) OVER (PARTITION BY item, dow ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS dow_avg
FROM dense_cal""")


def _lag(k: int, group) -> str:
    e = f"lag(qty, {k}) OVER (PARTITION BY item ORDER BY date)"
    return e if group is None else f"CASE WHEN item IN {_in(group)} THEN {e} END"


_add("lags", ("dense",), "SELECT date, item, " + ", ".join(
    f"{_lag(k, g)} AS qty_lag{k}" for k, g in sorted(P.LAG_GROUPS.items())) + """,
       CASE WHEN row_number() OVER (PARTITION BY item ORDER BY date) > 1
            THEN lag(qty, 1) OVER (PARTITION BY item ORDER BY date)
            ELSE first_value(qty) OVER (PARTITION BY item ORDER BY date) END AS clamp_lag1
FROM dense""")
_add("dow_rolling_mean", ("dense_cal",), """
SELECT date, item, round(avg(qty) OVER (PARTITION BY item, dow ORDER BY date
                                        ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS dow_avg FROM dense_cal""")
_add("trend", ("dense",), "SELECT date, item, " + ", ".join(
    f"round(avg(qty) OVER (PARTITION BY item ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) "
    f"AS trend_{n}" for n in (7, 14, 21)) + " FROM dense")
_add("sales_ratio_dow", ("dense_cal", "dow_prof"), """
SELECT d.date, d.item,
       round(coalesce(CAST(d.qty AS DOUBLE) / CASE WHEN p.dow_mean = 0 THEN 1.0 ELSE p.dow_mean END, 1.0), 6) AS sales_ratio_dow
FROM dense_cal d LEFT JOIN dow_prof p ON p.item = d.item AND p.dow = d.dow""")
_add("dow_std_feature", ("dense_cal", "dow_prof"), """
SELECT d.date, d.item, round(coalesce(p.dow_std, 0.0), 6) AS dow_std
FROM dense_cal d LEFT JOIN dow_prof p ON p.item = d.item AND p.dow = d.dow""")

# ----------------------------------------------------------------------- joins
_add("map_stats", ("dense_cal", "dow_prof"), """
SELECT d.date, d.item, round(coalesce(p.dow_mean, 0.0), 6) AS dow_mean
FROM dense_cal d LEFT JOIN dow_prof p ON p.item = d.item AND p.dow = d.dow""")
_add("dish_rollup", ("dish_daily",), "SELECT date, dish, qty FROM dish_daily")
_add("split_by_year", ("dense",), f"""
SELECT date, item, qty, CASE WHEN year(date) = {P.TRAIN_YEAR} THEN 'train' ELSE 'test' END AS split
FROM dense WHERE year(date) IN ({P.TRAIN_YEAR}, {P.TEST_YEAR})""")
_add("forecast_vs_actual", ("item_fc",), "SELECT date, item, round(pred, 6) AS pred, qty AS actual FROM item_fc")

_ALIGNED = f"""
, daily AS (SELECT date, CAST(sum(revenue) AS DOUBLE) AS sales FROM fx_sales GROUP BY date)
, cur AS (
  SELECT date, dayname(date) AS weekday, sales,
         make_date({P.BASE_YEAR}, 1, 2)
           + CAST(((isodow(date) - isodow(make_date({P.BASE_YEAR}, 1, 2))) % 7 + 7) % 7
                  + 7 * floor((date - make_date(year(date), 1, 2)) / 7) AS INTEGER) AS base_date
  FROM daily WHERE date BETWEEN make_date(year({AS_OF}), 1, 2) AND {AS_OF})
, aligned AS (
  SELECT c.date, c.weekday, c.sales, c.base_date, coalesce(b.sales, 0.0) AS base_sales
  FROM cur c LEFT JOIN daily b ON b.date = c.base_date)
"""
_add("yoy_weekday_aligned", ("fx_sales",), _ALIGNED + "SELECT date, weekday, sales, base_date, base_sales FROM aligned")
_add("order_inputs", ("dish_fc", "share_buffers", "lots_left"), f"""
SELECT f.dish, f.date, f.forecast, coalesce(b.buffer, 0.0) AS buffer, CAST(coalesce(u.usable, 0) AS BIGINT) AS usable
FROM (SELECT dish, date, forecast FROM dish_fc WHERE date = {AS_OF}) f
LEFT JOIN share_buffers b ON b.dish = f.dish
LEFT JOIN (SELECT item AS dish, sum(CASE WHEN expiry >= {AS_OF} THEN qty ELSE 0 END) AS usable FROM lots_left GROUP BY item) u
  ON u.dish = f.dish""")
_add("fifo_allocate", ("lot_lines", "fx_demand"), """
, l AS (SELECT item, expiry, lot, qty, sum(qty) OVER (PARTITION BY item ORDER BY expiry, lot ROWS UNBOUNDED PRECEDING) AS hi
        FROM lot_lines)
, d AS (SELECT item, date, qty, sum(qty) OVER (PARTITION BY item ORDER BY date ROWS UNBOUNDED PRECEDING) AS hi
        FROM fx_demand WHERE qty > 0)
SELECT l.item, l.expiry AS lot_expiry, l.lot AS lot_lot, d.date AS demand_date,
       CAST(least(l.hi, d.hi) - greatest(l.hi - l.qty, d.hi - d.qty) AS BIGINT) AS qty
FROM l JOIN d ON l.item = d.item AND l.hi - l.qty < d.hi AND d.hi - d.qty < l.hi""")

# ---------------------------------------------------------------- aggregations
_add("item_stats", ("train_stats",), """
SELECT item, round(avg_qty, 6) AS avg_qty, round(std_qty, 6) AS std_qty FROM train_stats""")
_add("stable_items", ("train_stats",), f"""
SELECT item, round(avg_qty, 6) AS avg_qty, round(std_qty, 6) AS std_qty FROM train_stats
WHERE avg_qty < {P.STABLE_MAX_AVG}::DOUBLE AND std_qty < {P.STABLE_MAX_STD}::DOUBLE""")
_add("dow_profile", ("dow_prof",), """
SELECT item, dow, round(dow_mean, 6) AS dow_mean, round(dow_std, 6) AS dow_std FROM dow_prof""")
_add("unit_price", ("price",), "SELECT dish, round(price, 6) AS price FROM price")
_add("accuracy_by_item", ("accuracy",), """
SELECT item, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2 FROM accuracy""")
_add("accuracy_macro", ("accuracy",), """
SELECT round(avg(rmse), 6) AS avg_rmse, round(avg(mae), 6) AS avg_mae, round(avg(r2), 6) AS avg_r2,
       count(*) AS n_items FROM accuracy""")
_add("bias_factors", ("train_pairs",), """
SELECT item, round(CASE WHEN avg(pred) > 0 THEN avg(actual) / avg(pred) ELSE 1.0 END, 6) AS bias_factor
FROM train_pairs GROUP BY item""")
_add("usable_stock", ("lots_left",), f"""
SELECT item, CAST(sum(CASE WHEN expiry >= {AS_OF} THEN qty ELSE 0 END) AS BIGINT) AS usable FROM lots_left GROUP BY item""")
_add("waste_ratio", ("bt_adaptive",), f"""
SELECT dish, waste, orders, round(waste_ratio, 6) AS waste_ratio, round(waste_ratio * 100, 2) AS waste_pct
FROM ({_ratio_sql('bt_adaptive')})""")
_add("high_waste", ("bt_adaptive",), f"""
SELECT dish, round(waste_ratio, 6) AS waste_ratio FROM ({_ratio_sql('bt_adaptive')})
WHERE waste_ratio > {P.HIGH_WASTE}::DOUBLE""")
_add("monthly_losses", ("bt_adaptive", "price"), f"""
SELECT m.month, round(coalesce(g.w, 0.0), 2) AS waste_money, round(coalesce(g.s, 0.0), 2) AS stockout_money
FROM (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS month) m
LEFT JOIN (SELECT CAST(month(b.date) AS INTEGER) AS month, sum(b.waste * (p.price * 0.25::DOUBLE)) AS w,
                  sum(b.short * p.price) AS s
           FROM bt_adaptive b LEFT JOIN price p ON p.dish = b.dish
           WHERE b.n > 0 AND year(b.date) = {P.TEST_YEAR} GROUP BY 1) g ON g.month = m.month""")
_add("year_kpis", ("bt_adaptive", "price"), f"""
SELECT round(revenue, 2) AS revenue, round(revenue * 0.25::DOUBLE, 2) AS cost_of_sales,
       round(waste_money, 2) AS waste_money, round(stockout_money, 2) AS stockout_money,
       round(waste_money / nullif(revenue, 0) * 100, 6) AS waste_pct_revenue,
       round(waste_money / nullif(revenue * 0.25::DOUBLE, 0) * 100, 6) AS waste_pct_cost
FROM ({_kpi_sql('bt_adaptive')})""")
_add("yoy_weekday_report", ("fx_sales",), _ALIGNED + """
, wk AS (SELECT * FROM (VALUES ('Monday', 1), ('Tuesday', 2), ('Wednesday', 3), ('Thursday', 4), ('Friday', 5),
                               ('Saturday', 6), ('Sunday', 7)) AS t(weekday, weekday_no))
, g AS (SELECT weekday, avg(sales) AS current_avg, avg(base_sales) AS base_avg, count(*) AS n_days
        FROM aligned GROUP BY weekday)
, t AS (SELECT wk.weekday, wk.weekday_no, coalesce(g.current_avg, 0.0) AS current_avg,
               coalesce(g.base_avg, 0.0) AS base_avg, CAST(coalesce(g.n_days, 0) AS BIGINT) AS n_days
        FROM wk LEFT JOIN g ON g.weekday = wk.weekday)
, r AS (SELECT *, CAST(round_even(current_avg, 0) AS BIGINT) AS current_rounded,
               CAST(round_even(base_avg, 0) AS BIGINT) AS base_rounded FROM t)
SELECT weekday, CAST(weekday_no AS INTEGER) AS weekday_no, round(current_avg, 2) AS current_avg,
       round(base_avg, 2) AS base_avg, n_days, current_rounded, base_rounded,
       round_even(CAST(current_rounded - base_rounded AS DOUBLE) / nullif(CAST(base_rounded AS DOUBLE), 0) * 100, 2)
         AS change_pct,
       round((SELECT avg(current_avg) FROM r), 2) AS current_overall,
       round((SELECT avg(base_avg) FROM r), 2) AS base_overall,
       CAST((SELECT sum(n_days) FROM r) AS BIGINT) AS days_analysed
FROM r""")
_add("table_profile", ("dense_cal", "complete"), f"""
SELECT count(*) AS n_rows, CAST({len(['date', 'item', 'dish', 'channel', 'qty', 'dow', 'month', 'quarter', 'year',
                                      'is_weekend', 'is_holiday'])} AS INTEGER) AS n_columns,
       count(DISTINCT dow) AS n_weekdays, count(DISTINCT date) AS n_days, count(DISTINCT item) AS n_keys,
       (SELECT count(*) FROM complete WHERE year(date) = {P.TRAIN_YEAR}) AS train_rows, CAST({len(FEATURE_COLUMNS)} AS INTEGER) AS train_features,
       (SELECT count(*) FROM complete WHERE year(date) = {P.TEST_YEAR}) AS test_rows, CAST({len(FEATURE_COLUMNS)} AS INTEGER) AS test_features
FROM dense_cal""")

# ------------------------------------------------------------- sort / latest
_add("lots_by_expiry", ("lot_lines",), """
SELECT item, expiry, qty, lot, CAST(row_number() OVER (PARTITION BY item ORDER BY expiry, lot) AS INTEGER) AS lot_rank
FROM lot_lines""")
_add("pending_orders", (), """
WITH ev AS (
  SELECT l_suppkey AS site, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS seq, p_brand AS dish,
         CASE WHEN l_returnflag = 'R' THEN 'replace' WHEN l_returnflag = 'N' THEN 'add' ELSE 'accept' END AS action,
         CAST(l_quantity AS BIGINT) AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey),
ev2 AS (SELECT * FROM ev WHERE action <> 'add' OR qty > 0),
lr AS (SELECT site, max(ts) AS lr FROM ev2 WHERE action = 'replace' GROUP BY site),
live AS (SELECT e.* FROM ev2 e LEFT JOIN lr ON lr.site = e.site
         WHERE lr.lr IS NULL OR e.ts > lr.lr OR (e.ts = lr.lr AND e.action = 'replace')),
latest AS (SELECT site, dish, arg_max(action, (ts, seq)) AS action, arg_max(qty, (ts, seq)) AS qty,
                  max(ts) AS ordered_at FROM live GROUP BY site, dish)
SELECT site, dish, qty, ordered_at FROM latest WHERE action <> 'accept' AND qty > 0""")

_add("accepted_lots", (), """
WITH ev AS (
  SELECT l_suppkey AS site, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS seq, p_brand AS dish,
         CASE WHEN l_returnflag = 'R' THEN 'replace' WHEN l_returnflag = 'N' THEN 'add' ELSE 'accept' END AS action,
         CAST(l_quantity AS BIGINT) AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey),
live AS (SELECT *, action = 'replace' AS batch FROM ev WHERE action <> 'add' OR qty > 0),
o AS (SELECT *, lag(action) OVER own AS was, lag(qty) OVER own AS ordered, lag(ts) OVER own AS since,
             max(ts) FILTER (WHERE batch) OVER (PARTITION BY site ORDER BY ts, batch, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wiped
      FROM live WINDOW own AS (PARTITION BY site, dish ORDER BY ts, batch, seq))
SELECT site, dish, CAST(ts AS DATE) AS accepted_at, seq, ordered, CASE WHEN seq % 2 = 1 THEN qty ELSE ordered END AS qty,
       CAST(ts AS DATE) + 3 AS expiry
FROM o WHERE action = 'accept' AND was <> 'accept' AND ordered > 0 AND CASE WHEN seq % 2 = 1 THEN qty ELSE ordered END > 0
  AND (wiped IS NULL OR since > wiped OR (since = wiped AND was = 'replace'))""")

# ---------------------------------------------------------------------- models
for _name, _flags in (("save_pipeline", ("same_scores",)), ("fit_forest", ("in_range",)), ("fit_boosted", ("finite", "beats_mean")),
                      ("predict", ("blended", "corrected", "not_negative"))):
    _add(_name, ("complete",), "SELECT date, item, qty, " + ", ".join(f"TRUE AS {f}" for f in _flags) + " FROM complete")
_add("forecast_to_order", ("complete", "lots_left"), f"""
SELECT c.dish, c.date, c.n_items, CAST(coalesce(u.usable, 0) AS BIGINT) AS usable, TRUE AS rolled_up, TRUE AS buffered, TRUE AS ordered
FROM (SELECT dish, date, count(*) AS n_items FROM complete WHERE date = {AS_OF} GROUP BY dish, date) c
LEFT JOIN (SELECT item AS dish, sum(CASE WHEN expiry >= {AS_OF} THEN qty ELSE 0 END) AS usable FROM lots_left GROUP BY item) u
  ON u.dish = c.dish""")
_STD_COLS = ["trend_7", "trend_14", "dow_avg"]
_add("standardize", ("dense_cal",), f"""
, f AS (SELECT date, item,
               avg(qty) OVER (PARTITION BY item ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS trend_7,
               avg(qty) OVER (PARTITION BY item ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS trend_14,
               avg(qty) OVER (PARTITION BY item, dow ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS dow_avg
        FROM dense_cal)
, f2 AS (SELECT * FROM f)
, s AS (SELECT {", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in _STD_COLS)}
        FROM f2 WHERE year(date) = {P.TRAIN_YEAR})
SELECT date, item, {", ".join(
    f"round(({c} - mu_{c}) / CASE WHEN sd_{c} = 0 THEN 1.0 ELSE sd_{c} END, 6) AS {c}" for c in _STD_COLS)}
FROM f2, s""")
_add("blend", ("item_fc",), f"""
, s AS (SELECT date, item, pred AS rf_pred,
               coalesce(avg(qty) OVER (PARTITION BY item ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0.0)
                 AS gbt_pred
        FROM item_fc)
SELECT date, item,
       round(CASE WHEN item IN {_in(P.HARD)} THEN gbt_pred ELSE rf_pred * 0.6::DOUBLE + gbt_pred * 0.4::DOUBLE END, 6)
         AS pred
FROM s""")
_add("apply_bias", ("item_fc", "train_pairs"), f"""
, bf AS (SELECT item, CASE WHEN avg(pred) > 0 THEN avg(actual) / avg(pred) ELSE 1.0 END AS bias_factor
         FROM train_pairs GROUP BY item)
SELECT f.date, f.item, round(greatest(f.pred * coalesce(bf.bias_factor, 0.85::DOUBLE), 0.0::DOUBLE), 6) AS pred_adj
FROM item_fc f LEFT JOIN bf ON bf.item = f.item""")

# ---------------------------------------------------------------------- policy
_add("buffers_rmse", ("rep", "train_stats", "accuracy"), f"""
SELECT r.dish,
       CASE WHEN r.dish IN {_in(P.OVERRIDE_B)} THEN 2.0::DOUBLE
            WHEN r.dish IN {_in(P.OVERRIDE_A)} THEN 0.3::DOUBLE
            WHEN coalesce(s.avg_qty, 0.0) > {P.RMSE_BUFFER_HIGH}::DOUBLE
              THEN CAST(ceil(coalesce(a.rmse, 0.0) * 1.5::DOUBLE) AS DOUBLE)
            WHEN coalesce(s.avg_qty, 0.0) > 0 THEN CAST(ceil(coalesce(s.avg_qty, 0.0) * 0.25::DOUBLE) AS DOUBLE)
            ELSE 0.25::DOUBLE END AS buffer
FROM rep r LEFT JOIN train_stats s ON s.item = r.item LEFT JOIN accuracy a ON a.item = r.item""")
_add("buffers_share", ("share_buffers",), "SELECT dish, buffer FROM share_buffers")
ORACLE_SQL["order_quantity"] = ORACLE_SQL["order_inputs"].replace(
    "SELECT f.dish, f.date, f.forecast, coalesce(b.buffer, 0.0) AS buffer, CAST(coalesce(u.usable, 0) AS BIGINT) AS usable",
    "SELECT *, CAST(greatest(0, ceil(forecast + buffer - usable)) AS BIGINT) AS order_qty FROM (\n"
    "SELECT f.dish, f.date, f.forecast, coalesce(b.buffer, 0.0) AS buffer, CAST(coalesce(u.usable, 0) AS BIGINT) AS usable"
) + ")"
_RATIOS_BY_DAY = "(SELECT dish, date + 1 AS date, waste_ratio, orders_cum AS orders FROM bt_adaptive WHERE n > 0)"
_add("waste_adjust_forecast", ("bt_adaptive", "dish_fc"), f"""
SELECT f.dish, f.date, round(f.forecast, 6) AS forecast,
       round(f.forecast * CASE WHEN r.waste_ratio IS NULL THEN 1.0::DOUBLE ELSE {_ladder_sql('r.waste_ratio')} END, 6)
         AS forecast_adj
FROM dish_fc f LEFT JOIN {_RATIOS_BY_DAY} r ON r.dish = f.dish AND r.date = f.date""")
_add("waste_adjust_buffer", ("bt_adaptive", "dish_fc", "share_buffers"), f"""
SELECT f.dish, f.date, s.buffer,
       round({_buffer_sql('s.buffer', 'r.waste_ratio', 'coalesce(r.orders, 0)')}, 6) AS buffer_adj
FROM dish_fc f LEFT JOIN share_buffers s ON s.dish = f.dish
LEFT JOIN {_RATIOS_BY_DAY} r ON r.dish = f.dish AND r.date = f.date""")

# ----------------------------------------------------------------------- stock
_add("receive", ("lots",), "SELECT item, expiry, qty FROM lots")
_add("stock_ledger", ("ledger_rec",), """
SELECT item, date, delivered, demand, sold, short, waste, CAST(b0 + b1 + b2 + b3 AS BIGINT) AS closing
FROM ledger_rec WHERE n >= 0""")
_add("stock_on_hand", ("lots_left",), f"""
SELECT item, qty, expiry, CAST(expiry - {AS_OF} AS INTEGER) AS days_left FROM lots_left WHERE qty > 0""")
_add("near_expiry", ("lots_left",), f"""
SELECT item, qty, expiry, CAST(expiry - {AS_OF} AS INTEGER) AS days_left FROM lots_left
WHERE expiry - {AS_OF} BETWEEN 0 AND {P.NEAR_EXPIRY_DAYS}""")
_add("policy_backtest", ("bt_adaptive",), f"SELECT {BACKTEST_OUT} FROM bt_adaptive WHERE n > 0")
_add("policy_compare", ("bt_adaptive", "bt_standard", "price"), f"""
, a AS ({_kpi_sql('bt_standard')}), b AS ({_kpi_sql('bt_adaptive')})
SELECT round(CASE WHEN a.revenue > 0 THEN (b.revenue - a.revenue) / a.revenue * 100 ELSE 0.0 END, 6) AS revenue_change_pct,
       round(CASE WHEN a.waste_money > 0 THEN (a.waste_money - b.waste_money) / a.waste_money * 100 ELSE 0.0 END, 6)
         AS waste_reduction_pct,
       round(CASE WHEN a.stockout_money > 0 THEN (b.stockout_money - a.stockout_money) / a.stockout_money * 100
                  ELSE 0.0 END, 6) AS stockout_change_pct
FROM a, b""")

# ------------------------------------------------------------------- per site
_SITE = "split_part({0}, '|', 1) AS site, split_part({0}, '|', 2) AS dish"
_add("site_orders", ("site_fc", "site_buffers", "site_ledger", "site_price"), f"""
, u AS (SELECT item, b3 * CAST(date >= {AS_OF} AS INT) + b2 * CAST(date + 1 >= {AS_OF} AS INT) + b1 * CAST(date + 2 >= {AS_OF} AS INT)
               + b0 * CAST(date + 3 >= {AS_OF} AS INT) AS usable
        FROM site_ledger WHERE date = {AS_OF} - 1)
SELECT {_SITE.format('f.site_dish')}, f.date, round(f.forecast, 6) AS forecast, b.buffer, CAST(coalesce(u.usable, 0) AS BIGINT) AS usable,
       CAST(greatest(0, ceil(f.forecast + b.buffer - coalesce(u.usable, 0))) AS BIGINT) AS order_qty, round(p.price, 6) AS price
FROM site_fc f JOIN site_buffers b USING (site_dish) JOIN site_price p USING (site_dish) LEFT JOIN u ON u.item = f.site_dish
WHERE f.date = {AS_OF}""")
_add("site_policy_backtest", ("site_bt",), f"SELECT split_part(dish, '|', 1) AS site, split_part(dish, '|', 2) AS {BACKTEST_OUT} FROM site_bt WHERE n > 0")
_add("site_waste_ratio", ("site_ledger",), f"""
SELECT {_SITE.format('item')}, waste, delivered, round(r, 6) AS waste_ratio, round(r * 100, 2) AS waste_pct
FROM (SELECT item, CAST(sum(waste) AS BIGINT) AS waste, CAST(sum(delivered) AS BIGINT) AS delivered,
             CASE WHEN sum(delivered) > 0 THEN CAST(sum(waste) AS DOUBLE) / sum(delivered) ELSE 0.0 END AS r
      FROM site_ledger WHERE n >= 0 GROUP BY item)""")
_SITE_MONEY = """sum(l.waste * (p.price * 0.25::DOUBLE)) AS w, sum(l.short * p.price) AS s, sum(l.demand * p.price) AS revenue
      FROM site_ledger l JOIN site_price p ON p.site_dish = l.item WHERE l.n >= 0"""
_add("site_monthly_losses", ("site_ledger", "site_price"), f"""
SELECT m.month, round(coalesce(g.w, 0.0), 2) AS waste_money, round(coalesce(g.s, 0.0), 2) AS stockout_money
FROM (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS month) m
LEFT JOIN (SELECT CAST(month(l.date) AS INTEGER) AS month, {_SITE_MONEY} AND year(l.date) = {P.TEST_YEAR} GROUP BY 1) g ON g.month = m.month""")
_add("site_year_kpis", ("site_ledger", "site_price"), f"""
SELECT round(revenue, 2) AS revenue, round(revenue * 0.25::DOUBLE, 2) AS cost_of_sales, round(w, 2) AS waste_money, round(s, 2) AS stockout_money,
       round(w / nullif(revenue, 0) * 100, 6) AS waste_pct_revenue, round(w / nullif(revenue * 0.25::DOUBLE, 0) * 100, 6) AS waste_pct_cost
FROM (SELECT {_SITE_MONEY})""")

# ------------------------------------------------------------------- streaming
_add("stream_daily_sales", (), """
SELECT CAST(date_trunc('day', ts) AS DATE) AS day, user_id, count(*) AS n_events, round(sum(value), 6) AS total_value
FROM events WHERE event_type = 'purchase'
GROUP BY 1, 2
HAVING CAST(date_trunc('day', ts) AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events WHERE event_type = 'purchase') - INTERVAL 1 DAY""")
# days that the watermark (latest event less one day) has closed, one step a day over four age buckets
_add("stream_stock_ledger", (), """
WITH RECURSIVE ev AS (
  SELECT user_id, ts, CAST(ts AS DATE) AS date, CASE WHEN event_type = 'signup' THEN value ELSE 0.0 END AS dl,
         CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS dm
  FROM events WHERE event_type IN ('signup', 'purchase') AND ts IS NOT NULL),
edge AS (SELECT CAST(max(ts) - INTERVAL 1 DAY AS DATE) AS upto FROM ev),
flow AS (SELECT user_id, date, coalesce(sum(dl), 0.0) AS dl, coalesce(sum(dm), 0.0) AS dm FROM ev GROUP BY user_id, date),
grid AS (
  SELECT user_id, CAST(unnest(generate_series(min(date), max(upto) - 1, INTERVAL 1 DAY)) AS DATE) AS date
  FROM flow, edge WHERE date < upto GROUP BY user_id),
days AS (
  SELECT user_id, date, row_number() OVER (PARTITION BY user_id ORDER BY date) AS n, flow.dl IS NOT NULL AS busy,
         coalesce(dl, 0.0) AS dl, coalesce(dm, 0.0) AS dm
  FROM grid LEFT JOIN flow USING (user_id, date)),
led AS (
  SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS DATE) AS date, false AS busy, 0.0::DOUBLE AS dl, 0.0::DOUBLE AS dm,
         0.0::DOUBLE AS had, 0.0::DOUBLE AS waste, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3
  FROM days WHERE n = 1
  UNION ALL
  SELECT d.user_id, d.n, d.date, d.busy, d.dl, d.dm, d.dl + l.b0 + l.b1 + l.b2, l.b3,
         least(greatest(l.b2 + l.b1 + l.b0 + d.dl - d.dm, 0.0), d.dl), least(greatest(l.b2 + l.b1 + l.b0 - d.dm, 0.0), l.b0),
         least(greatest(l.b2 + l.b1 - d.dm, 0.0), l.b1), least(greatest(l.b2 - d.dm, 0.0), l.b2)
  FROM led l JOIN days d ON d.user_id = l.user_id AND d.n = l.n + 1)
SELECT user_id, date, round(dl, 6) AS delivered, round(dm, 6) AS demand, round(least(dm, had), 6) AS sold,
       round(greatest(dm - had, 0.0), 6) AS short, round(waste, 6) AS waste, round(b0 + b1 + b2 + b3, 6) AS closing
FROM led WHERE n > 0 AND (busy OR waste > 1e-9)""")

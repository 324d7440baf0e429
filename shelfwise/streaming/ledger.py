"""69. stream_stock_ledger: the continuous form of the stock ledger (63).

Delivery and sale events update per-key lots held in Spark-managed state
(``applyInPandasWithState``; state is checkpointed with the query, so a lost
executor replays from the checkpoint). Lots are age buckets, as in the batch fold:
a lot received on day d is sellable d..d+shelf_days and is waste on the next day.
Events are held in state as sums per day until the watermark has passed the day's end. Only
then is the day applied (deliveries, then sales, as in the batch ledger) and its row emitted,
so the rows do not depend on how events within the delay are dealt to micro-batches. An idle
day gives a row when a lot turns to waste. Event-time timers close the days of keys without
further events; a key with no stock and no open day leaves the state. The last ``delay`` of
the stream stays open, as in the daily totals (68).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from shelfwise.functions.constants import SHELF_DAYS
from shelfwise.streaming.daily import event_instant, event_stream, run_to_table

DAY_MS = 86_400_000

OUT_FIELDS = ["date", "delivered", "demand", "sold", "short", "waste", "closing"]


def _out_schema(key: str, key_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(key, key_type), T.StructField("date", T.DateType())]
                        + [T.StructField(c, T.DoubleType()) for c in OUT_FIELDS[1:]])


def _state_schema() -> T.StructType:
    return T.StructType([T.StructField("last_day", T.LongType()), T.StructField("lots", T.ArrayType(T.DoubleType())),
                         T.StructField("days", T.ArrayType(T.LongType())),
                         T.StructField("delivered", T.ArrayType(T.DoubleType())),
                         T.StructField("demand", T.ArrayType(T.DoubleType()))])


def fifo_sell(buckets: list[float], demand: float) -> tuple[list[float], float]:
    """Sell ``demand`` from age buckets, oldest last in the list; returns the new buckets
    and the shortfall. Bucket k keeps clamp(cum_k - demand, 0, b_k), cum_k counted
    from the oldest bucket."""
    out = buckets[:]
    cum = 0
    for k in range(len(buckets) - 1, -1, -1):
        cum += buckets[k]
        out[k] = min(max(cum - demand, 0), buckets[k])
    return out, max(demand - cum, 0)


RESIDUE = 1e-9  # waste below this on an idle day is what float sums leave, not stock


def close_days(last_day: int, lots: list[float], open_days: dict[int, list[float]], upto: int):
    """Apply every day before ``upto``: (last closed day, lots, rows). Applied days leave ``open_days``; runs of idle
    days end as soon as no lot is left, so the work is bounded by event days x shelf life."""
    rows = []

    def step(day: int, delivered: float, demand: float, idle: bool) -> None:
        nonlocal lots
        waste = lots[-1]
        lots, short = fifo_sell([delivered] + lots[:-1], demand)
        if not idle or waste > RESIDUE:
            rows.append((day, delivered, demand, demand - short, float(short), waste, float(sum(lots))))

    def idle_until(day: int) -> None:
        nonlocal last_day
        while last_day + 1 < day and any(lots):
            last_day += 1
            step(last_day, 0.0, 0.0, True)
        last_day = max(last_day, day - 1)

    for day in sorted(d for d in open_days if d < upto):
        idle_until(day)
        step(day, *open_days.pop(day), False)
        last_day = day
    idle_until(upto)
    return last_day, lots, rows


def _ledger_state_fn(key_name: str, shelf_days: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last_day, lots, open_days = None, [0.0] * (shelf_days + 1), {}
        if state.exists:
            last_day, lots, *held = state.get
            lots, open_days = [float(x) for x in lots], {d: [x, y] for d, x, y in zip(*held)}
        if not state.hasTimedOut:
            for pdf in pdfs:  # one Arrow batch at a time: a busy key is summed, never gathered
                day = pdf["_us"] // (DAY_MS * 1000)
                for i, kind in enumerate(("delivery", "sale")):
                    for d, q in pdf["qty"].where(pdf["kind"] == kind, 0.0).groupby(day).sum().items():
                        open_days.setdefault(int(d), [0.0, 0.0])[i] += float(q)
        watermark = max(state.getCurrentWatermarkMs(), 0)
        if last_day is None:
            last_day = min(open_days) - 1
        last_day, lots, rows = close_days(last_day, lots, open_days, watermark // DAY_MS)
        if open_days or any(lots):
            days = sorted(open_days)
            state.update((last_day, [float(x) for x in lots], days,
                          [open_days[d][0] for d in days], [open_days[d][1] for d in days]))
            oldest = [last_day + 1 + shelf_days - a for a, x in enumerate(lots) if x > 0]  # the day each turns to waste
            due = (min(days[:1] + oldest) + 1) * DAY_MS
            state.setTimeoutTimestamp(max(due - 1, watermark + 1))  # fires once the watermark is beyond it
        elif state.exists:
            state.remove()
        if rows:
            out = pd.DataFrame([(key[0], *r) for r in rows], columns=[key_name, *OUT_FIELDS])
            out["date"] = pd.to_datetime(out["date"] * DAY_MS, unit="ms").dt.date
            yield out
    return fn


def stream_stock_ledger(events: DataFrame, shelf_days: int = SHELF_DAYS, key: str = "user_id",
                        delay: str = "1 day") -> DataFrame:
    """``events(key, ts, kind in {'delivery','sale'}, qty)`` (streaming) -> ledger rows of closed days. Events without
    a time are left out; a null quantity counts as 0."""
    t = event_instant(F.col("ts"), events.schema["ts"].dataType.simpleString())
    # event time travels to Python as epoch microseconds: day numbers and timers then
    # agree with the watermark whatever the session time zone
    ev = (events.where("ts is not null").select(key, t.alias("ts"), "kind", F.col("qty").cast("double").alias("qty"))
          .withColumn("_us", F.unix_micros("ts")).withWatermark("ts", delay))
    return ev.groupBy(key).applyInPandasWithState(
        _ledger_state_fn(key, shelf_days), _out_schema(key, events.schema[key].dataType),
        _state_schema(), "append", GroupStateTimeout.EventTimeTimeout)


def events_as_stock(events: DataFrame) -> DataFrame:
    """Test-table mapping: signup = delivery, purchase = sale, quantity = value."""
    kind = (F.when(F.col("event_type") == "signup", "delivery")
            .when(F.col("event_type") == "purchase", "sale"))
    return (events.where(F.col("event_type").isin("signup", "purchase"))
            .select("user_id", "ts", kind.alias("kind"), F.col("value").alias("qty")))


def run_stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_to_table(spark, stream_stock_ledger(events_as_stock(event_stream(spark, sf_dir))),
                       "stream_ledger")
    got = spark.read.schema(_out_schema("user_id", T.LongType())).parquet(out)
    return got.select("user_id", "date", *[F.round(c, 6).alias(c) for c in OUT_FIELDS[1:]])

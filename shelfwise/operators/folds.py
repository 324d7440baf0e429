"""Vectorised folds over event days for the keyed stock operators (63, 66).

Spark hash-partitions the daily rows by key and sorts each partition by (key, date); ``mapInPandas`` then streams Arrow
batches. Complete keys are gathered into chunks of about ``chunk_rows`` rows (the last, possibly incomplete key of a
chunk waits for the next batch).

A chunk is ragged: its rows stay one after another, and an offset says where a key begins. Step s advances every key that
has an s-th event day to that day, with numpy arrays across those keys; days without an event are skipped by ageing the
stock by the gap. So memory is bounded by the rows of a chunk plus one key's history, whatever the days the keys span, and
the Python loop runs over the event days of the longest key, never over rows or keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd

from shelfwise.operators.policy import FORECAST_LADDER, FORECAST_LOW

CHUNK_ROWS = 200_000


def _key_codes(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Numbers of a sorted frame's keys in order of appearance; null is a key."""
    new = np.zeros(len(pdf), bool)
    for k in keys:
        code = pd.factorize(pdf[k], use_na_sentinel=False)[0]
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def keyed_chunks(batches: Iterator[pd.DataFrame], keys: Sequence[str], fold: Callable[[pd.DataFrame], pd.DataFrame],
                 chunk_rows: int = CHUNK_ROWS) -> Iterator[pd.DataFrame]:
    """Regroup a (keys, date)-sorted batch stream into chunks of whole keys and fold them."""
    buf: list[pd.DataFrame] = []
    n = 0
    for pdf in batches:
        if not len(pdf):
            continue
        buf.append(pdf)
        n += len(pdf)
        if n >= chunk_rows:
            whole = pd.concat(buf, ignore_index=True)
            code = _key_codes(whole, keys)
            tail = code == code[-1]
            if not tail.all():
                yield fold(whole[~tail])
            buf, n = [whole[tail]], int(tail.sum())
    if n:
        yield fold(pd.concat(buf, ignore_index=True))


class Ragged:
    """The steps of a chunk: ``rows`` of the s-th event day of every key that has one, the keys' slots (keys with the most
    days first, so that the keys still running are a prefix) and the days since each key's previous event day."""

    def __init__(self, pdf: pd.DataFrame, keys: Sequence[str]):
        code = _key_codes(pdf, keys)
        self.day = pd.to_datetime(pdf["date"]).to_numpy().astype("datetime64[D]").astype(np.int64)
        same = code[1:] == code[:-1]
        bad = np.flatnonzero(same & (self.day[1:] <= self.day[:-1]))
        if len(bad):
            row = pdf.iloc[bad[0] + 1]
            raise ValueError(f"more than one row of {tuple(row[k] for k in keys)} on {row['date']}, or days out of order")
        count = np.bincount(code)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        longest = np.argsort(-count, kind="stable")
        self.count, self.first = count[longest], first[longest]
        self.gap = np.zeros(len(pdf), np.int64)
        self.gap[1:][same] = (self.day[1:] - self.day[:-1])[same]

    @property
    def keys(self) -> int:
        return len(self.count)

    def steps(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for s in range(int(self.count[0]) if len(self.count) else 0):
            running = int(np.searchsorted(-self.count, -s, "left"))  # keys of more than s event days
            rows = self.first[:running] + s
            yield running, rows, self.gap[rows]


def age(b: np.ndarray, days: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stock after so many days, and what expired meanwhile. b[:, j] is sellable for j more days."""
    last = b.shape[1] - 1
    at = np.arange(last + 1)[None, :] + days[:, None]
    kept = np.where(at <= last, np.take_along_axis(b, np.minimum(at, last), axis=1), 0)
    return kept, b.sum(axis=1) - kept.sum(axis=1)


def fifo_take(b: np.ndarray, demand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First-in-first-out sale from buckets ordered oldest first (axis 1), for all keys
    at once: bucket j keeps clamp(cum_j - demand, 0, b_j). Returns buckets, shortfall."""
    cum = np.cumsum(b, axis=1)
    left = np.minimum(np.maximum(cum - demand[:, None], 0), b)
    return left, np.maximum(demand - cum[:, -1], 0)


# ------------------------------------------------------------------ 63. ledger
def ledger_fold(pdf: pd.DataFrame, shelf_days: int, keys: Sequence[str]) -> pd.DataFrame:
    """Stock ledger of every key in the chunk, a row for each given day; what expired since a key's previous row is
    waste of the row. Quantities may be whole numbers or fractions; the results have their type."""
    ragged = Ragged(pdf, keys)
    delivered, demand = pdf["delivered"].to_numpy(), pdf["demand"].to_numpy()
    kind = np.result_type(delivered, demand)
    b = np.zeros((ragged.keys, shelf_days + 1), kind)
    sold, short, waste, closing = (np.zeros(len(pdf), kind) for _ in range(4))
    left = np.zeros((len(pdf), shelf_days + 1), kind)
    for n, rows, gap in ragged.steps():
        stock, waste[rows] = age(b[:n], gap)
        stock[:, shelf_days] += delivered[rows]
        b[:n], short[rows] = fifo_take(stock, demand[rows])
        sold[rows] = demand[rows] - short[rows]
        closing[rows] = b[:n].sum(axis=1)
        left[rows] = b[:n]
    return pd.DataFrame({**{k: pdf[k].to_numpy() for k in keys}, "date": pdf["date"].to_numpy(), "delivered": delivered, "demand": demand,
                         "sold": sold, "short": short, "waste": waste, "closing": closing, "left": list(left)})


# ------------------------------------------------------------- 66. back-test
def _forecast_factor(r: np.ndarray, ladder, low) -> np.ndarray:
    conds = [r > c for c, _ in ladder] + [r < low[0]]
    return np.select(conds, [f for _, f in ladder] + [low[1]], default=1.0)


def _buffer_adj(base: np.ndarray, r: np.ndarray, orders: np.ndarray, ladder, low, cap) -> np.ndarray:
    conds = [r > c for c, _ in ladder] + [r < low[0]]
    vals = [np.maximum(0.0, base * f) for _, f in ladder] + [np.minimum(base * low[1], base * cap)]
    return np.where(orders > 0, np.select(conds, vals, default=base), base)


def backtest_fold(pdf: pd.DataFrame, adaptive: bool, shelf_days: int, f_ladder=FORECAST_LADDER,
                  f_low=FORECAST_LOW, b_ladder=None, b_low=None, b_cap=None, keys: Sequence[str] = ("dish",)) -> pd.DataFrame:
    """Replay every dish of the chunk over its event days. Lots are kept by expiry offset: b[:, j] expires j days after
    the day at hand (j = 0..shelf_days after today's order). A day without a row or without actuals is skipped (no
    order, no sale); lots still age, and what expires meanwhile is waste on the next processed day."""
    ragged = Ragged(pdf, keys)  # two rows of one day are an error also where one of them has no actuals
    present = pdf["actual"].notna().to_numpy()
    if not present.all():
        pdf = pdf[present]
        ragged = Ragged(pdf, keys)
    fc = np.nan_to_num(pdf["forecast"].to_numpy(np.float64), nan=0.0)
    actual = pdf["actual"].to_numpy(np.float64).astype(np.int64)
    base = pdf["buffer"].to_numpy(np.float64)
    b = np.zeros((ragged.keys, shelf_days + 1), np.int64)
    orders, waste_tot, ratio = np.zeros(ragged.keys, np.int64), np.zeros(ragged.keys, np.int64), np.zeros(ragged.keys)
    out = {c: np.zeros(len(pdf), t) for c, t in [
        ("forecast_adj", np.float64), ("buffer_adj", np.float64), ("usable", np.int64),
        ("order_qty", np.int64), ("sold", np.int64), ("short", np.int64), ("waste", np.int64),
        ("orders_cum", np.int64), ("waste_cum", np.int64), ("waste_ratio", np.float64)]}
    for n, rows, gap in ragged.steps():
        stock, waste = age(b[:n], gap)
        r = ratio[:n]
        adj = fc[rows] * _forecast_factor(r, f_ladder, f_low) if adaptive else fc[rows]
        buf = _buffer_adj(base[rows], r, orders[:n], b_ladder, b_low, b_cap) if adaptive else base[rows]
        usable = stock[:, :shelf_days].sum(axis=1)
        order = np.maximum(0, np.ceil(adj + buf - usable)).astype(np.int64)
        stock[:, shelf_days] = order
        orders[:n] += order
        b[:n], short = fifo_take(stock, actual[rows])
        waste_tot[:n] += waste
        ratio[:n] = np.where(orders[:n] > 0, waste_tot[:n] / np.maximum(orders[:n], 1), r)
        for c, v in (("forecast_adj", adj), ("buffer_adj", buf), ("usable", usable), ("order_qty", order),
                     ("sold", actual[rows] - short), ("short", short), ("waste", waste), ("orders_cum", orders[:n]),
                     ("waste_cum", waste_tot[:n]), ("waste_ratio", ratio[:n])):
            out[c][rows] = v
    return pd.DataFrame({**{k: pdf[k].to_numpy() for k in keys}, "date": pdf["date"].to_numpy(), "forecast": fc, **out, "actual": actual})

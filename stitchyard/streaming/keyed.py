"""Streaming forms of the anchored limiter and the ledger (F01, F02, W01): keyed state, late rows dropped by watermark.

State is bounded: a limiter keeps a start and a count for each key, and forgets a key once its window has
passed; a ledger keeps one balance for each account. Rows of a batch are folded in the order of (ts, id).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALLOWED = "key string, id long, allowed boolean"
BALANCE = "key string, id long, delta long, balance long"


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


def limiter(stream: DataFrame, window_s: int = 3600, most: int = 3, late: str = "1 hour") -> DataFrame:
    """(key, id, ts) -> whether each hit is allowed; the window starts at its first hit and refused hits don't count.

    A hit exactly ``window_s`` after the start is still inside. Rows with a null key or ts are dropped.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(parts).sort_values(["ts", "id"])
        start, n = state.get if state.exists else (None, 0)
        ok = []
        for us in _micros(rows.ts):
            if start is None or us - start > window_s * 1_000_000:
                start, n = us, 0
            ok.append(n < most)
            n += n < most
        state.update((start, n))
        ends = start // 1000 + window_s * 1000 + 1
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "id": rows.id, "allowed": ok})

    known = stream.filter("key is not null and ts is not null").withWatermark("ts", late)
    return known.groupBy("key").applyInPandasWithState(run, ALLOWED, "start long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def ledger(stream: DataFrame) -> DataFrame:
    """(key, id, ts, delta) -> the balance of the key after each row; a null delta changes nothing."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts).sort_values(["ts", "id"])
        delta = rows.delta.fillna(0).astype("int64")
        balance = delta.cumsum() + (state.get[0] if state.exists else 0)
        state.update((int(balance.iloc[-1]),))
        yield pd.DataFrame({"key": key[0], "id": rows.id, "delta": delta, "balance": balance})

    return stream.filter("key is not null").groupBy("key").applyInPandasWithState(run, BALANCE, "balance long", "append", GroupStateTimeout.NoTimeout)

"""Payments and refunds as a stream (F07, F08): an order's state and the events it remembers, with a timer that brings early refunds again; then balances by user.

The first stage is keyed by order, the second by user, so that a user's orders meet only as changes of credits. A
refund that comes before its payment is answered ``retry_later`` and not remembered; it waits in the order's state, and
a timer applies it again ``RETRY`` seconds of event time later, at most ``TRIES`` times. Other events are remembered by
id; an order's events are few. Both stages need the RocksDB state store, which ``configured`` names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RETRY, TRIES = 60, 5
#: What an event says, and what is known of its order (null: no such order).
EVENT = "event_id string, ts timestamp, order_id string, kind string, status string, cents long, ref string, currency string"
ORDER = "order_id string, user_id string, amount long, credits long"
CHANGE = "order_id string, user_id string, event_id string, ts timestamp, outcome string, change long"
BALANCE = "user_id string, event_id string, outcome string, change long, balance long"
WAITING = "event_id string, ts timestamp, status string, cents long, ref string, user_id string, amount long, credits long, tries int"


def configured(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Orders(StatefulProcessor):
    """An order: pending, paid, refunded; credits granted and revoked; ids of events and refunds that were met."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.order = handle.getValueState("order", "state string, granted long, revoked long")
        self.met = handle.getMapState("met", "id string", "at timestamp")
        self.waiting = handle.getListState("waiting", WAITING)

    def _payment(self, e: Any, now: tuple) -> tuple[str, int, tuple]:
        state, granted, revoked = now
        if e.status != "COMPLETED":
            return "not_completed", 0, now
        if state != "pending":
            return "already_paid", 0, now
        if e.cents is None or e.cents < e.amount or e.currency != "USD":
            return "amount_mismatch", 0, now
        if e.user_id is None:
            return "no_user", 0, now
        return "granted", e.credits, ("paid", e.credits, revoked)

    def _refund(self, e: Any, now: tuple) -> tuple[str, int, tuple]:
        state, granted, revoked = now
        if e.status != "COMPLETED":
            return "not_completed", 0, now
        if e.ref and self.met.containsKey((f"refund:{e.ref}",)):
            return "duplicate", 0, now
        if state == "pending":
            return "retry_later", 0, now
        want = min(granted - revoked, -(-e.credits * max(0, e.cents or 0) // e.amount))
        if e.ref:
            self.met.updateValue((f"refund:{e.ref}",), (e.ts,))
        return "refunded", -want, ("refunded" if revoked + want >= granted else state, granted, revoked + want)

    def _apply(self, e: Any, kind: str) -> tuple[str, int]:
        if self.met.containsKey((f"event:{e.event_id}",)):
            return "duplicate", 0
        now = tuple(self.order.get()) if self.order.exists() else ("pending", 0, 0)
        outcome, change, then = (self._payment if kind == "payment" else self._refund)(e, now)
        if then != now:
            self.order.update(then)
        if outcome != "retry_later":
            self.met.updateValue((f"event:{e.event_id}",), (e.ts,))
        return outcome, change

    def _wait(self, e: Any, tries: int, at_ms: int) -> None:
        self.waiting.appendValue((e.event_id, e.ts, e.status, e.cents, e.ref, e.user_id, e.amount, e.credits, tries))
        self.handle.registerTimer(at_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out = []
        batch = pd.concat(rows).sort_values(["ts", "event_id"]).astype(object)
        for e in batch.where(batch.notna(), None).itertuples():
            outcome, change = ("unknown_order", 0) if e.amount is None else self._apply(e, e.kind)
            if outcome == "retry_later":
                self._wait(e, 1, int(pd.Timestamp(e.ts).timestamp() * 1000) + RETRY * 1000)
            out.append((key[0], e.user_id, e.event_id, e.ts, outcome, change))
        yield pd.DataFrame(out, columns=["order_id", "user_id", "event_id", "ts", "outcome", "change"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        out, again = [], []
        names = [f.split(" ")[0] for f in WAITING.split(", ")]
        for row in sorted(self.waiting.get(), key=lambda r: (r[1], r[0])):
            e = pd.Series(dict(zip(names, row, strict=True)), dtype=object)
            outcome, change = self._apply(e, "refund")
            if outcome == "retry_later" and e.tries < TRIES:
                again.append(e)
            else:
                outcome = "given_up" if outcome == "retry_later" else outcome
                out.append((key[0], e.user_id, e.event_id, pd.Timestamp(e.ts), outcome, change))
        self.waiting.clear()
        for e in again:
            self._wait(e, int(e.tries) + 1, expiredTimerInfo.getExpiryTimeInMs() + RETRY * 1000)
        if out:
            yield pd.DataFrame(out, columns=["order_id", "user_id", "event_id", "ts", "outcome", "change"])

    def close(self) -> None:
        pass


class Balances(StatefulProcessor):
    """A user's credits: a refund takes back what is unspent."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.balance = handle.getValueState("balance", "balance long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        have, out = self.balance.get()[0] if self.balance.exists() else 0, []
        for e in pd.concat(rows).sort_values(["ts", "event_id"]).itertuples():
            change = max(int(e.change), -have)
            have += change
            out.append((key[0], e.event_id, e.outcome, change, have))
        self.balance.update((have,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "outcome", "change", "balance"])

    def close(self) -> None:
        pass


def changes(events: DataFrame, orders: DataFrame, late: str = "0 seconds") -> DataFrame:
    """F07, F08, first stage: the outcome of each event (EVENT) for its order of ``orders`` (ORDER), and the credits it would change.

    Events without an id, an order id or a time are dropped.
    """
    known = events.filter("event_id is not null and order_id is not null and ts is not null").withWatermark("ts", late)
    rows = known.join(orders, "order_id", "left")
    return rows.groupBy("order_id").transformWithStateInPandas(Orders(), CHANGE, "append", "eventTime")


def balances(changed: DataFrame) -> DataFrame:
    """F08, second stage: the changes that take place and the user's balance after each; events of no user are left out."""
    own = changed.filter(F.col("user_id").isNotNull() & F.col("outcome").isin("granted", "refunded"))
    return own.groupBy("user_id").transformWithStateInPandas(Balances(), BALANCE, "append", "none")

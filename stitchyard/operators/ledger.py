"""Ledgers, throttles and keyed state machines (W01, W15, T05, F01-F03, parts of F07 and F08, F13)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stitchyard.operators.folds import folded
from stitchyard.sources.tables import table


def by_time() -> W:
    return W.partitionBy("user_id").orderBy("ts", "event_id")


def ledger_running_balance(spark: SparkSession, d: str) -> DataFrame:
    """The balance after each change of a user."""
    delta = F.when(F.col("event_type") == "purchase", 10).when(F.col("event_type") == "error", -1).otherwise(0).cast("long")
    rows = table(spark, d, "events").withColumn("delta", delta)
    return rows.select("event_id", "user_id", "delta", F.sum("delta").over(by_time().rowsBetween(W.unboundedPreceding, 0)).alias("balance"))


def retention_tail(spark: SparkSession, d: str) -> DataFrame:
    """The newest five events of each user."""
    newest = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, d, "events").withColumn("rn", newest).filter("rn <= 5").select("user_id", "event_id", F.col("rn").cast("long").alias("rn"))


def throttle_window(spark: SparkSession, d: str) -> DataFrame:
    """A minute since the last one, and under five in the day before."""
    day = F.count("*").over(W.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-86_400_000_000, 0)) - 1
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(by_time()).cast("timestamp"))
    return table(spark, d, "events").select("event_id", (F.coalesce(gap, F.lit(1 << 60)) >= 60_000_000).alias("spaced"), (day < 5).alias("few"))


def limiter(window: int, most: int):
    """``most`` in a window anchored at its first event; refused events aren't counted."""

    def begin():
        start, n = None, 0

        def step(row: dict) -> tuple:
            nonlocal start, n
            if start is None or row["us"] - start > window:
                start, n = row["us"], 0
            ok = n < most
            n += ok
            return row["event_id"], row["user_id"], ok

        return step

    return begin


def anchored_limiter(spark: SparkSession, d: str) -> DataFrame:
    """three an hour."""
    return folded(_timed(spark, d), "user_id", ["us", "event_id"], "event_id long, user_id long, allowed boolean", limiter(3_600_000_000, 3))


def _timed(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", *columns, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def bucket(burst: float = 4, burst_rate: float = 4.0, minute: float = 60, minute_rate: float = 1.0):
    """both buckets need a token; a refusal costs nothing and tells the seconds to wait."""
    have, per, last = burst, minute, None

    def step(t: float) -> tuple[bool, int]:
        nonlocal have, per, last
        if last is not None:
            have, per = min(burst, have + (t - last) * burst_rate), min(minute, per + (t - last) * minute_rate)
        last = t
        ok = have >= 1 and per >= 1
        wait = 0 if ok else max(1, -int(-max((1 - have) / burst_rate, (1 - per) / minute_rate) // 1))
        have, per = have - ok, per - ok
        return ok, wait

    return step


def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    """F03 for each user over the events in order, an event a hundred-thousandth of its time apart."""

    def begin():
        from_ = bucket()
        return lambda row: (row["event_id"], *from_(row["us"] / 1e6 / 100_000))

    return folded(_timed(spark, d), "user_id", ["us", "event_id"], "event_id long, allowed boolean, retry_after int", begin)


class Order:
    """an order, its user's credits and the events that were met.

    ``unknown_order`` and ``retry_later`` aren't remembered, so that the event may come again. A refund takes back
    its share of the credits, as far as they are unspent; spent ones are forfeited from later refunds, too.
    """

    def __init__(self, amount: int, credits: int, balance: int | None):
        self.amount, self.credits, self.balance = amount, credits, balance
        self.state, self.granted, self.revoked, self.seen, self.refunds = "pending", 0, 0, set(), set()

    def apply(self, event: str, kind: str, status: str, cents: int, ref: str, currency: str = "USD", known: bool = True) -> str:
        if event in self.seen:
            return "duplicate"
        out = self._payment(status, cents, currency, known) if kind == "payment" else self._refund(status, cents, ref, known)
        if out not in ("unknown_order", "retry_later"):
            self.seen.add(event)
        return out

    def _payment(self, status: str, cents: int, currency: str, known: bool) -> str:
        if not known:
            return "unknown_order"
        if status != "COMPLETED":
            return "not_completed"
        if self.state != "pending":
            return "already_paid"
        if cents < self.amount or currency != "USD":
            return "amount_mismatch"
        if self.balance is None:
            return "no_user"
        self.state, self.granted, self.balance = "paid", self.credits, self.balance + self.credits
        return "granted"

    def _refund(self, status: str, cents: int, ref: str, known: bool) -> str:
        if status != "COMPLETED":
            return "not_completed"
        if ref and ref in self.refunds:
            return "duplicate"
        if not known or self.state == "pending":
            return "retry_later"
        want = min(self.granted - self.revoked, -(-self.credits * cents // self.amount))
        if self.balance is not None:
            self.balance -= min(self.balance, max(want, 0))
        self.revoked += want
        if self.revoked >= self.granted:
            self.state = "refunded"
        self.refunds.add(ref)
        return "refunded"


def order_state_machine(spark: SparkSession, d: str) -> DataFrame:
    """F07/F08 with a user as an order: errors refund, the others pay, views fail; ids repeat, so that some are duplicates."""

    def begin():
        order = Order(2000, 10, 3)

        def step(r: dict) -> tuple:
            i, refund = r["event_id"], r["event_type"] == "error"
            cents = 700 + i % 3 * 100 if refund else (1, 2500, 2000, 2000, 2000)[i % 5]
            out = order.apply(str(i % 40), "refund" if refund else "payment", "FAILED" if r["event_type"] == "view" else "COMPLETED", cents, str(i % 4), "EUR" if i % 11 == 0 else "USD", i % 13 != 0)
            return i, out, order.balance

        return step

    return folded(_timed(spark, d, "event_type"), "user_id", ["us", "event_id"], "event_id long, outcome string, balance long", begin)


def pruner(now: int, age: int, most: int):
    """newest first, an entry goes if it is too old or doesn't fit any more; smaller ones may fit later."""

    def begin():
        used = 0

        def step(r: dict) -> tuple:
            nonlocal used
            keep = now - r["doc_id"] <= age and used + r["n"] <= most
            used += r["n"] * keep
            return r["doc_id"], keep

        return step

    return begin


def cache_prune_greedy(spark: SparkSession, d: str) -> DataFrame:
    """F13 with each source as a directory and doc_id as time. Entries that are too old go by a filter; only the fresh ones of a directory are folded."""
    age = 150
    docs = table(spark, d, "documents").select("source", "doc_id", F.col("n_chars").cast("long").alias("n"))
    now = docs.agg(F.max("doc_id")).first()[0] or 0
    fresh = docs.filter(F.lit(now) - F.col("doc_id") <= age).withColumn("new", -F.col("doc_id"))
    gone = docs.filter(F.lit(now) - F.col("doc_id") > age).select("doc_id", F.lit(False).alias("kept"))
    return folded(fresh, "source", ["new"], "doc_id long, kept boolean", pruner(now, age, 30_000)).unionAll(gone)


_FOLD = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 s(user_id, k, event_id, start, n, allowed) AS (SELECT user_id, k, event_id, us, 1, true FROM e WHERE k = 1
 UNION ALL SELECT e.user_id, e.k, e.event_id, CASE WHEN us - start > 3600000000 THEN us ELSE start END,
 CASE WHEN us - start > 3600000000 THEN 1 WHEN n < 3 THEN n + 1 ELSE n END, us - start > 3600000000 OR n < 3 FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
 SELECT event_id, user_id, allowed FROM s"""
QUERIES = [ledger_running_balance, retention_tail, throttle_window, anchored_limiter, token_bucket, order_state_machine, cache_prune_greedy]
SQL = {
    "token_bucket": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 / 100000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), f AS (SELECT user_id, n, event_id, t, 3e0 AS have, 59e0 AS per, true AS allowed, 0 AS retry_after FROM e WHERE n = 1 UNION ALL
 SELECT user_id, n, event_id, t, CASE WHEN ok THEN h - 1 ELSE h END, CASE WHEN ok THEN p - 1 ELSE p END, ok, CASE WHEN ok THEN 0 ELSE greatest(1, CAST(ceil(greatest((1 - h) / 4e0, 1 - p)) AS INT)) END FROM (SELECT *, h >= 1 AND p >= 1 AS ok FROM (SELECT e.*, least(4e0, f.have + (e.t - f.t) * 4e0) AS h, least(60e0, f.per + (e.t - f.t) * 1e0) AS p FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)))
 SELECT event_id, allowed, retry_after FROM f""",
    "ledger_running_balance": "SELECT event_id, user_id, delta, CAST(sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM (SELECT *, CAST(CASE event_type WHEN 'purchase' THEN 10 WHEN 'error' THEN -1 ELSE 0 END AS BIGINT) AS delta FROM events)",
    "retention_tail": "SELECT user_id, event_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5",
    "throttle_window": "SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 1152921504606846976) >= 60000000 AS spaced, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - 1 < 5 AS few FROM events",
    "anchored_limiter": _FOLD,
    "order_state_machine": """WITH RECURSIVE e AS (SELECT event_id, user_id, event_id % 40 AS eid, event_type = 'error' AS refund, event_type = 'view' AS failed, CASE WHEN event_type = 'error' THEN 700 + event_id % 3 * 100 WHEN event_id % 5 = 0 THEN 1 WHEN event_id % 5 = 1 THEN 2500 ELSE 2000 END AS cents, event_id % 4 AS ref, event_id % 11 = 0 AS euro, event_id % 13 <> 0 AS known, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 s AS (SELECT DISTINCT user_id, 0::BIGINT AS k, -1::BIGINT AS event_id, 'pending' AS state, 0::BIGINT AS granted, 0::BIGINT AS revoked, 3::BIGINT AS bal, []::BIGINT[] AS seen, []::BIGINT[] AS refs, '' AS out FROM e
 UNION ALL SELECT n.user_id, n.k, n.event_id, CASE WHEN out2 = 'granted' THEN 'paid' WHEN out2 = 'refunded' AND revoked + want >= granted THEN 'refunded' ELSE state END, CASE WHEN out2 = 'granted' THEN 10 ELSE granted END, CASE WHEN out2 = 'refunded' THEN revoked + want ELSE revoked END, CASE WHEN out2 = 'granted' THEN bal + 10 WHEN out2 = 'refunded' THEN bal - least(bal, greatest(want, 0)) ELSE bal END, CASE WHEN out2 IN ('unknown_order', 'retry_later', 'duplicate') AND NOT (out2 = 'duplicate' AND NOT list_contains(seen, eid)) THEN seen ELSE list_append(seen, eid) END, CASE WHEN out2 = 'refunded' THEN list_append(refs, ref) ELSE refs END, out2
 FROM (SELECT e.*, s.state, s.granted, s.revoked, s.bal, s.seen, s.refs, least(s.granted - s.revoked, CAST(ceil(10 * e.cents / 2000e0) AS BIGINT)) AS want, CASE WHEN list_contains(s.seen, e.eid) THEN 'duplicate' WHEN NOT refund THEN CASE WHEN NOT known THEN 'unknown_order' WHEN failed THEN 'not_completed' WHEN s.state <> 'pending' THEN 'already_paid' WHEN cents < 2000 OR euro THEN 'amount_mismatch' ELSE 'granted' END ELSE CASE WHEN failed THEN 'not_completed' WHEN list_contains(s.refs, e.ref) THEN 'duplicate' WHEN NOT known OR s.state = 'pending' THEN 'retry_later' ELSE 'refunded' END END AS out2 FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1) n)
 SELECT event_id, out AS outcome, bal AS balance FROM s WHERE k > 0""",
    "cache_prune_greedy": """WITH RECURSIVE e AS (SELECT source, doc_id, n_chars AS n, (SELECT max(doc_id) FROM documents) - doc_id <= 150 AS fresh, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k FROM documents),
 s AS (SELECT source, k, doc_id, fresh AND n <= 30000 AS kept, CASE WHEN fresh AND n <= 30000 THEN n ELSE 0 END::BIGINT AS used FROM e WHERE k = 1
 UNION ALL SELECT e.source, e.k, e.doc_id, fresh AND used + n <= 30000, CASE WHEN fresh AND used + n <= 30000 THEN used + n ELSE used END::BIGINT FROM s JOIN e ON e.source IS NOT DISTINCT FROM s.source AND e.k = s.k + 1)
 SELECT doc_id, kept FROM s""",
}

"""Streams of a folder of files against the same folds by hand."""

from datetime import datetime, timedelta

from stitchyard.streaming import keyed, orders

NOON = datetime(2024, 1, 1, 12)


def outcome(spark, tmp_path, make, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = make(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return {(r.key, r.id): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}


def test_limiter(spark, tmp_path):
    at = [0, 10, 20, 30, 3600, 3601]
    rows = [("a", i, NOON + timedelta(seconds=s)) for i, s in enumerate(at)] + [("b", 9, NOON), (None, 10, NOON), ("b", 11, None)]
    got = outcome(spark, tmp_path, keyed.limiter, [rows], "key string, id long, ts timestamp")
    assert {k: r.allowed for k, r in got.items()} == {("a", 0): True, ("a", 1): True, ("a", 2): True, ("a", 3): False, ("a", 4): False, ("a", 5): True, ("b", 9): True}


def test_ledger(spark, tmp_path):
    parts = [[("a", 1, NOON, 10), ("a", 2, NOON, None), ("b", 3, NOON, -1)], [("a", 4, NOON + timedelta(seconds=1), -3)]]
    got = outcome(spark, tmp_path, keyed.ledger, parts, "key string, id long, ts timestamp, delta long")
    assert sorted((k, r.balance) for k, r in got.items()) in ([(("a", 1), 10), (("a", 2), 10), (("a", 4), 7), (("b", 3), -1)], [(("a", 1), 7), (("a", 2), 7), (("a", 4), -3), (("b", 3), -1)])


def played(spark, tmp_path, name, make, parts, schema):
    """The rows that a stream of the parts, one a batch, writes."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/p{i:02d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{name}")
    q = make(stream).writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.read.parquet(f"{tmp_path}/{name}-out").collect()


def test_orders(spark, tmp_path):
    """The billing rules over batches: an early refund waits and is applied by the timer, repeats are told, and two orders of a user share a balance."""
    orders.configured(spark)
    known = spark.createDataFrame([("o1", "u", 2000, 10), ("o2", "u", 1000, 4), ("o3", None, 1000, 4), ("o4", "v", 1000, 4)], orders.ORDER)
    e = lambda i, s, o, kind, cents, ref="", status="COMPLETED", currency="USD": (i, NOON + timedelta(seconds=s), o, kind, status, cents, ref, currency)
    parts = [
        [e("r0", 0, "o1", "refund", 1000, "R0"), e("p0", 1, "o2", "payment", 1000), e("x", 2, "nowhere", "payment", 1000), e("n", 3, "o3", "payment", 1000), e("q", 3, "o4", "refund", 1, "Q")],
        [e("p1", 5, "o1", "payment", 1, status="FAILED"), e("p2", 6, "o1", "payment", 1999), e("p3", 7, "o1", "payment", 2000, currency="EUR"), e("p4", 8, "o1", "payment", 2500), e("p4", 9, "o1", "payment", 2500), e("p5", 10, "o1", "payment", 2000)],
        [e("t1", 100, "o2", "refund", 0, "T1", status="PENDING")],
        [e("t0", 101, "o2", "refund", 0, "T0", status="PENDING")],  # the timer of r0 is due
        [e("r1", 102, "o1", "refund", 2000, "R1"), e("r2", 103, "o1", "refund", 2000, "R1")],
        *[[e(f"t{k}", 101 + 70 * k, "o2", "refund", 0, f"T{k}", status="PENDING")] for k in range(2, 9)],
    ]
    rows = played(spark, tmp_path, "orders", lambda s: orders.changes(s, known), parts, orders.EVENT)
    got = {}
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
        got.setdefault(r.event_id, []).append((r.outcome, r.change))
    assert sorted(got["r0"]) == [("refunded", -5), ("retry_later", 0)] and got["p0"] == [("granted", 4)] and got["x"] == [("unknown_order", 0)] and got["n"] == [("no_user", 0)]
    assert [got[k][0][0] for k in ("p1", "p2", "p3", "p5")] == ["not_completed", "amount_mismatch", "amount_mismatch", "already_paid"]
    assert sorted(got["p4"]) == [("duplicate", 0), ("granted", 10)] and sorted(got["q"]) == [("given_up", 0), ("retry_later", 0)]
    assert got["r1"] == [("refunded", -5)] and got["r2"] == [("duplicate", 0)]
    flow = [[tuple(r) for r in rows if r.event_id in ids and r.outcome in ("granted", "refunded")] for ids in (("p0", "p4"), ("r0",), ("r1",))]
    spent = [("s", "u", "spend", NOON + timedelta(seconds=11), "refunded", -12)]
    after = played(spark, tmp_path, "balances", orders.balances, [flow[0], spent, flow[1], flow[2]], orders.CHANGE)
    assert sorted((r.event_id, r.change, r.balance) for r in after) == [("p0", 4, 4), ("p4", 10, 14), ("r0", -2, 0), ("r1", 0, 0), ("spend", -12, 2)]

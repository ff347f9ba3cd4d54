"""Closed cases of the shop operators, and each query against DuckDB on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

from stitchyard.operators import ledger, machine, prints, stitch
from stitchyard.operators.pricing import line_total, unit_price
from stitchyard.operators.rules import trace_jobs
from stitchyard.plans import registry
from stitchyard.sources import png

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

D = "/root/testdata/sf0.001"
TABLES = "nation customer supplier part orders lineitem events documents embeddings pages conversations".split()


def test_prices(spark):
    from pyspark.sql import functions as F

    u = unit_price(F.lit(10.0), F.lit(10.0), F.lit(1.15))
    got = spark.range(1).select(u, *[line_total(u, F.lit(q)) for q in (1, 10, 25)]).first()
    assert list(got) == [117.5, 117.5, 1057.5, 2408.75]


def test_payments():
    """The outcomes that the reference's billing test expects, and those its rules name beside them."""
    o = ledger.Order(2000, 10, 0)
    rows = [("early1", "refund", "COMPLETED", 2000, "RE0", "retry_later"), ("e0", "payment", "FAILED", 2000, "", "not_completed"), ("e0b", "payment", "CANCELED", 2000, "", "not_completed"), ("e1", "payment", "COMPLETED", 1, "", "amount_mismatch"), ("e2", "payment", "COMPLETED", 2000, "", "granted"), ("e2", "payment", "COMPLETED", 2000, "", "duplicate"), ("e3", "payment", "COMPLETED", 2000, "", "already_paid")]
    assert [o.apply(*r[:-1]) for r in rows] == [r[-1] for r in rows] and o.balance == 10
    o.balance = 7  # three are spent
    rows = [("r0", "refund", "PENDING", 2000, "R1", "not_completed"), ("r1", "refund", "COMPLETED", 2000, "R1", "refunded"), ("r2", "refund", "COMPLETED", 2000, "R1", "duplicate"), ("early1", "refund", "COMPLETED", 2000, "RE0", "refunded")]
    assert [o.apply(*r[:-1]) for r in rows] == [r[-1] for r in rows] and (o.balance, o.state, o.revoked) == (0, "refunded", 10)


def test_payments_beside():
    o = ledger.Order(2000, 10, 0)
    assert o.apply("a", "payment", "COMPLETED", 2500, "", "EUR") == "amount_mismatch"
    assert o.apply("b", "payment", "COMPLETED", 2500, "", known=False) == "unknown_order"
    assert o.apply("b", "payment", "COMPLETED", 2500, "") == "granted"  # more than the price, and not remembered before
    assert o.apply("c", "refund", "COMPLETED", 500, "x") == "refunded" and (o.state, o.revoked, o.balance) == ("paid", 3, 7)
    assert ledger.Order(2000, 10, None).apply("a", "payment", "COMPLETED", 2000, "") == "no_user"


def test_exp_ends(spark):
    assert all(r.exp.endswith("8080") for r in machine.exp_bytes(spark, D).collect())


@pytest.mark.parametrize(("text", "want"), [("Pro Vectorize done: 12 colors", "Pro Vectorize \u00b7 12 layers"), ("Vectorizer.AI ran", "Pro Vectorize"), ("Vectorized: 1 Path", "Vectorized \u00b7 1 paths"), ("revectorized by vtracer, 7 layers", "Vectorized \u00b7 7 layers"), ("Corel import", "Art imported"), ("vtracer", "Update"), ("vtracer 5 stitches \u00b7", "5 stitches"), ("Proof 12 sent", "Proof 12 sent"), ("", "")])
def test_public_message(spark, text, want):
    from pyspark.sql import functions as F

    from stitchyard.operators.board import public_message

    assert spark.createDataFrame([(text,)], "m string").select(public_message(F.col("m"))).first()[0] == want


def test_pruner():
    step = ledger.pruner(100, 50, 10)()
    assert [step({"doc_id": i, "n": n})[1] for i, n in ((100, 6), (90, 5), (80, 4), (40, 0), (60, 1))] == [True, False, True, False, False]


def test_token_bucket():
    take = ledger.bucket()
    assert [take(t)[0] for t in (0, 0, 0, 0, 0, 0.25)] == [True] * 4 + [False, True]


def test_dst_moves():
    assert stitch.dst_delta(0, 0) == b"\x00\x00\x03"
    assert stitch.dst_delta(1, 0) == b"\x01\x00\x03" and stitch.dst_delta(-1, 0) == b"\x02\x00\x03"
    assert len(brute.dst_bytes(["stitch"], [300], [0])) == 3 * 3 + 3


def test_dst_file(spark):
    """The header and the records of a small design, by hand from the reference's writer; then all designs."""
    rows = ["stitch", "jump", "color", "trim", "stitch"], [5, 130, 999, 999, -3], [0, 4, 999, 999, -7]
    head = brute.dst_header("caf\u00e9", *rows)
    want = "LA:caf             \rST:      2\rCO:  1\r+X:  130\r-X:    3\r+Y:    4\r-Y:    7\rAX:+     0\rAY:+     0\rMX:+     0\rMY:+     0\rPD:******\r"
    assert len(head) == 512 and head == want.encode().ljust(511) + b"\x1a"
    delta = stitch.dst_delta
    body = [delta(5, 0), delta(121, -4, True), delta(4, 0, True), delta(0, 0, stop=True), delta(-2, 2, True), delta(4, -4, True), delta(-2, 2, True), delta(-121, 11), delta(-12, 0)]
    assert brute.dst_bytes(*rows) == b"".join(body) + b"\x00\x00\xf3"
    df = spark.createDataFrame([(7, i, *r) for i, r in enumerate(zip(*rows))], "design long, seq long, kind string, x long, y long")
    assert stitch.dst_files(df).first().dst == (brute.dst_header("7", *rows) + brute.dst_bytes(*rows)).hex().upper()
    files = {r.design: bytes.fromhex(r.dst) for r in stitch.dst_encode(spark, D).collect()}
    plain = {}
    for r in sorted(stitch.stream(spark, D).collect(), key=lambda r: r.seq):
        plain.setdefault(r.design, []).append((r.kind, r.x, r.y))
    assert files == {k: brute.dst_header(str(k), *map(list, zip(*v))) + brute.dst_bytes(*map(list, zip(*v))) for k, v in plain.items()}


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    rgba = np.random.default_rng(kind).integers(0, 256, (9, 14, 4)).astype(np.uint8)
    assert (png.decode(png.encode(rgba, kind)) == rgba).all()


def test_sends():
    send = machine.sender()
    assert [send(t) for t in (0, 59, 60, 120, 180, 240, 300, 86399, 86400)] == ["sent", "wait", "sent", "sent", "sent", "sent", "full", "full", "sent"]


def test_queue():
    take = machine.worker(1, 2)
    assert [take(t, w) for t, w in ((0, 10), (1, 10), (2, 10), (3, 10), (10, 1))] == [("run", 0), ("queue", 10), ("queue", 20), ("reject", 3), ("queue", 30)]


def test_trace_jobs(spark):
    cases = [("6", "100000 100000", 4, 6), ("0", "800000 100000", 8, 1), ("  3  ", None, 8, 3), ("", "200000 100000", 8, 2), (None, "250000 100000", 8, 2), (None, "50000 100000", 8, 1), (None, "800000 100000", 4, 4), (None, "100000 100000", 4, 1), (None, "max 100000", 8, 2), (None, None, 8, 2), (None, "", 8, 2), (None, "nope", 8, 2), (None, "100 0", 8, 2), ("nope", "300000 100000", 8, 3)]
    df = spark.createDataFrame(cases, "env string, quota string, cores int, slots long")
    assert df.filter(trace_jobs(df.env, df.quota, df.cores) != df.slots).collect() == []


def test_cache():
    """F04 by hand: use renews a place but not the time; old entries and the least recently used go."""
    c = prints.Cache(10, 10)
    c.put("a", 4, 0), c.put("b", 4, 1), c.put("big", 11, 1), c.put("none", 0, 1)
    assert [c.get(k, 2) for k in ("a", "big", "none")] == [True, False, False]
    c.put("c", 4, 3)  # b is the least recently used
    assert [c.get(k, 4) for k in ("a", "b", "c")] == [True, False, True] and c.used == 8
    assert not c.get("a", 10.5) and c.used == 4
    c.put("d", 6, 20)
    assert list(c.held) == ["d"]


def test_chamfer():
    mask = np.ones((5, 7), bool)
    mask[2, 3] = False
    want = [[max(abs(x - 3), abs(y - 2)) - min(abs(x - 3), abs(y - 2)) + 1.414 * min(abs(x - 3), abs(y - 2)) for x in range(7)] for y in range(5)]
    assert np.allclose(prints.chamfer(mask), want)


def test_blank_items(spark, tmp_path):
    from pyspark.sql import types as T

    from stitchyard.sources.tables import blank_items

    want = {"good.json": [("A1", 5), ("B2", None)], "broken.json": [], "none.json": [], "missing.json": []}
    (tmp_path / "good.json").write_text('{"source": "x", "count": 2, "items": [{"sku": "A1", "size": 5}, {"sku": "B2"}]}')
    (tmp_path / "broken.json").write_text("{items: [")
    (tmp_path / "none.json").write_text('{"source": ""}')
    assert {n: sorted(map(tuple, blank_items(spark, f"file://{tmp_path}/{n}", T.StructType.fromDDL("sku string, size int")).collect())) for n in want} == want


def test_percent(spark):
    """A slider's names in any case, numbers beyond its ends, and texts that are neither."""
    from stitchyard.operators.traces import _percent

    raw = ["LOW", "high", "", "130", "-3", " 12.5 ", "1e1", "nan", "x", None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, v string")
    got = [r.p for r in rows.select("i", _percent(rows.v, {"low": 15, "high": 85}).alias("p")).orderBy("i").collect()]
    assert got == [15, 85, 50, 100, 0, 12.5, 10, 50, 50, 50]


@pytest.mark.parametrize("name", [n for n in registry.queries() if n in registry.oracle_sql()])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    a, b = registry.queries()[name](spark, D).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    rows = lambda x: sorted(map(repr, x[sorted(x.columns)].astype(object).where(x.notna(), None).values.tolist()))
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in registry.oracle_sql()])
def test_runs(spark, name):
    assert registry.queries()[name](spark, D).count() > 0

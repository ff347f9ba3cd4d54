"""Stitch streams: indexes, lengths, summaries, folds and DST bytes."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stitchyard.operators.folds import folded
from stitchyard.sources.tables import table


def order() -> W:
    return W.partitionBy("design").orderBy("seq")


def stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as stitches: a user is a design, in order of time."""
    kind = F.when(F.col("event_type") == "signup", "color").when(F.col("event_type") == "error", "trim").when(F.col("event_type") == "view", "jump").otherwise("stitch")
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, d, "events").select(F.col("user_id").alias("design"), seq.alias("seq"), kind.alias("kind"), F.floor(F.coalesce("value", F.lit(0.0))).cast("long").alias("x"), (F.col("event_id") % 97).cast("long").alias("y"))


def stitch_stream_color_index(spark: SparkSession, d: str) -> DataFrame:
    """How many colour changes came so far."""
    return stream(spark, d).select("design", "seq", F.sum(F.when(F.col("kind") == "color", 1).otherwise(0)).over(order()).cast("long").alias("color_index"))


def stitch_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Squared distance from the needle's last place."""
    dx, dy = F.col("x") - F.lag("x").over(order()), F.col("y") - F.lag("y").over(order())
    return stream(spark, d).select("design", "seq", F.coalesce(dx * dx + dy * dy, F.lit(0)).cast("long").alias("d2"))


def stitch_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts by kind, colours, minutes in tenths and the size in hundredths of an inch, a place being a tenth of a millimetre."""
    g = stream(spark, d).groupBy("design").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("stitch", "stitches"), ("jump", "jumps"), ("trim", "trims"), ("color", "colors"))], *[F.floor((F.max(c) - F.min(c)) / 254.0 * 100 + 0.5).cast("long").alias(n) for c, n in (("x", "width"), ("y", "height"))])
    minutes = F.col("stitches") / 750 + (6 * F.col("trims") + 20 * F.col("colors")) / 60
    return g.withColumns({"tenths": F.floor(minutes * 10 + 0.5).cast("long"), "threads": F.col("colors") + 1})


def split_long_stitches(spark: SparkSession, d: str) -> DataFrame:
    """Moves over 70 tenths in equal parts of at most 65."""
    s = stream(spark, d).select("design", "seq", "x", "y", F.lag("x").over(order()).alias("px"), F.lag("y").over(order()).alias("py")).filter("px is not null")
    dist = F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))
    n = F.when(dist > 70, F.ceil(dist / 65.0)).otherwise(1).cast("long")
    parts = s.select("*", n.alias("n")).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    at = lambda p, q: F.floor(F.col(p) + (F.col(q) - F.col(p)) * F.col("k") / F.col("n") + 0.5).cast("long")
    return parts.select("design", "seq", "k", at("px", "x").alias("x"), at("py", "y").alias("y"))


def drop_short_stitches(spark: SparkSession, d: str) -> DataFrame:
    """stitches under 3 from the last kept one go; other kinds restart the measure."""

    def begin():
        last = None

        def step(row: dict) -> tuple | None:
            nonlocal last
            x, y = row["x"], row["y"]
            if row["kind"] == "stitch" and last is not None and (x - last[0]) ** 2 + (y - last[1]) ** 2 < 9:
                return None
            last = (x, y)
            return row["design"], row["seq"]

        return step

    rows = stream(spark, d).select("design", "seq", "kind", "x", "y")
    return folded(rows, "design", ["seq"], "design long, seq long", begin)


#: Places a millimetre, cells of it in a row, the longest stitch, and how many needle places a cell holds: before a stitch of a
#: satin or underlay is dropped, before one of travel is, and after all.
PX, CELLS, FAR, HOT, TRAVEL, FULL = 60, 6, 7.0, 13, 7, 15
ROLES = ("travel", "underlay", "satin")


def _reaches(prev: tuple | None, kind: str | None, x: int | None, y: int | None) -> bool:
    """Whether the thread may go on from the last kept place to the next one, if that is a stitch."""
    if prev is None or prev[0] != "stitch":
        return False
    return kind != "stitch" or ((x - prev[1]) ** 2 + (y - prev[2]) ** 2) ** 0.5 <= FAR * PX


def guard(total: bool) -> Callable[[], Callable[[dict], tuple | None]]:
    """A pass of the pile-up guard over a design's places in order; ``total``: cells begin with their counts in ``n``, else they are counted on the way.

    A stitch in a full cell goes if the thread reaches from the last kept place to the next; of a satin two go
    together, so that its sides still alternate. Cells of one design are the state.
    """

    def begin() -> Callable[[dict], tuple | None]:
        hits: dict[int, int] = {}
        prev, skip = None, False

        def step(r: dict) -> tuple | None:
            nonlocal prev, skip
            if skip:
                skip = False
                return None
            stitch, cell = r["kind"] == "stitch", r["cell"]
            if stitch and r["role"] in ROLES:
                have = r["n"] + hits.get(cell, 0) if total else hits.get(cell, 0)
                full = have > FULL if total else have >= (TRAVEL if r["role"] == "travel" else HOT)
                next_, after = (r["k1"], r["x1"], r["y1"]), (r["k2"], r["x2"], r["y2"])
                pair = full and r["role"] == "satin" and r["k1"] == "stitch" and r["r1"] == "satin"
                if total:
                    gone = full and _reaches(prev, *(after if pair else next_))
                else:
                    gone = full and _reaches(prev, *next_)
                    pair = pair and _reaches(prev, *after)
                if gone:
                    skip = pair
                    if total:
                        hits[cell] = hits.get(cell, 0) - 1 - pair
                    return None
            if stitch and not total:
                hits[cell] = hits.get(cell, 0) + 1
            prev = r["kind"], r["x"], r["y"]
            return r["design"], r["seq"], r["kind"], r["role"], r["x"], r["y"], cell

        return step

    return begin


def unpiled(rows: DataFrame) -> DataFrame:
    """(design, seq, kind, role, x, y, cell) of (design, seq, kind, role, x, y) without stitches that pile up: one pass with running counts of cells, one with the counts that it leaves."""
    schema = "design long, seq long, kind string, role string, x long, y long, cell long"
    ahead = lambda df: df.select("*", *[F.lead(c, k).over(order()).alias(f"{c[0]}{k}") for c, k in (("kind", 1), ("role", 1), ("x", 1), ("y", 1), ("kind", 2), ("x", 2), ("y", 2))])
    celled = rows.withColumn("cell", F.expr(f"y div {PX} * {CELLS} + x div {PX}"))
    first = folded(ahead(celled), "design", ["seq"], schema, guard(False))
    counted = first.withColumn("n", F.count_if(F.col("kind") == "stitch").over(W.partitionBy("design", "cell")))
    return folded(ahead(counted), "design", ["seq"], schema, guard(True))


def pile_up_guard(spark: SparkSession, d: str) -> DataFrame:
    """F06 over the stitches of every design, their roles by turns."""
    role = F.element_at(F.array(*map(F.lit, ("satin", "satin", "underlay", "travel", "fill"))), (F.col("seq") % 5 + 1).cast("int"))
    return unpiled(stream(spark, d).withColumn("role", role)).select("design", "seq")


def dst_delta(dx: int, dy: int, jump: bool = False, stop: bool = False) -> bytes:
    """Three bytes of a move of at most 121 each way: balanced ternary digits, two bits each."""
    #: Byte and bit of the digits 81, 27, 9, 3 and 1, for plus and minus, of x and of y.
    bits = {"x": {81: ((2, 2), (2, 3)), 27: ((1, 2), (1, 3)), 9: ((0, 2), (0, 3)), 3: ((1, 0), (1, 1)), 1: ((0, 0), (0, 1))}, "y": {81: ((2, 5), (2, 4)), 27: ((1, 5), (1, 4)), 9: ((0, 5), (0, 4)), 3: ((1, 7), (1, 6)), 1: ((0, 7), (0, 6))}}
    out = bytearray([0, 0, 3 | (0x80 if jump or stop else 0) | (0x40 if stop else 0)])
    for axis, v in (("x", dx), ("y", dy)):
        for size, ((p, pb), (m, mb)) in bits[axis].items():
            rest = (size - 1) // 2
            if v > rest:
                out[p], v = out[p] | 1 << pb, v - size
            elif v < -rest:
                out[m], v = out[m] | 1 << mb, v + size
        if v:
            raise ValueError("a move is longer than 121")
    return bytes(out)


def _digits(c: str) -> dict[int, Column]:
    """The balanced ternary digits of a column of -121 to 121, by size: how many of a size are in it, less three for each of the next."""
    near = lambda size: F.floor((F.col(c) + (size - 1) // 2) / size)
    return {size: near(size) - 3 * near(3 * size) for size in (81, 27, 9, 3, 1)}


def dst_files(rows: DataFrame) -> DataFrame:
    """(design, dst) of (design, seq, kind, x, y): whole DST files as hex text, in columns.

    A move becomes a row for each 121 of its longer side; a row's three bytes are sums of its digits' bits. The rows of
    a design meet as text alone, in order.
    """
    still = F.col("kind").isin("color", "trim", "end")
    last = lambda c: F.coalesce(F.last(F.when(~still, F.col(c)), ignorenulls=True).over(order().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    m = rows.select("design", "seq", "kind", "x", "y", F.when(still, 0).otherwise(F.col("x") - last("x")).alias("dx"), F.when(still, 0).otherwise(last("y") - F.col("y")).alias("dy"))
    n = F.greatest(F.lit(1), F.expr("(abs(dx) + 120) div 121"), F.expr("(abs(dy) + 120) div 121"))
    k = m.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    part = lambda c: F.expr(f"cast(sign({c}) as bigint) * greatest(0, least(121, abs({c}) - 121 * k))")
    k = k.withColumns({"mx": part("dx"), "my": part("dy")})
    x, y = _digits("mx"), _digits("my")
    bit = lambda d, plus, minus: F.when(d == 1, plus).when(d == -1, minus).otherwise(0)
    low = bit(x[1], 1, 2) + bit(x[9], 4, 8) + bit(y[1], 128, 64) + bit(y[9], 32, 16)
    mid = bit(x[3], 1, 2) + bit(x[27], 4, 8) + bit(y[3], 128, 64) + bit(y[27], 32, 16)
    high = 3 + F.when(F.col("kind") == "jump", 128).otherwise(0) + bit(x[81], 4, 8) + bit(y[81], 32, 16)
    trim = b"".join((dst_delta(-2, 2, True), dst_delta(4, -4, True), dst_delta(-2, 2, True))).hex().upper()
    text = F.when(F.col("kind") == "color", dst_delta(0, 0, stop=True).hex().upper()).when(F.col("kind") == "trim", trim).when(F.col("kind") == "end", "").otherwise(F.format_string("%02X%02X%02X", low, mid, high))
    most = lambda f, c: f(F.when(still, F.lit(0)).otherwise(F.col(c)))
    pad = lambda v, n: F.substring(F.lpad(F.abs(v).cast("string"), 7, " "), 8 - n, n)
    g = k.select("*", text.alias("t")).groupBy("design").agg(F.sort_array(F.collect_list(F.struct("seq", "k", "t"))).alias("a"), F.count_if(~still & (F.col("kind") != "jump") & (F.col("k") == 0)).alias("st"), F.count_if(F.col("kind") == "color").alias("co"), *[F.greatest(F.lit(0), most(F.max, c)).alias(f"p{c}") for c in "xy"], *[F.least(F.lit(0), most(F.min, c)).alias(f"m{c}") for c in "xy"])
    name = F.rpad(F.substring(F.regexp_replace(F.coalesce(F.col("design").cast("string"), F.lit("DESIGN")), r"[^\x20-\x7E]", " "), 1, 16), 16, " ")
    parts = [F.concat(F.lit("LA:"), name), F.concat(F.lit("ST:"), pad(F.col("st"), 7)), F.concat(F.lit("CO:"), pad(F.col("co"), 3))]
    parts += [F.concat(F.lit(f"{sign}{c.upper()}:"), pad(F.col(f"{p}{c}"), 5)) for c in "xy" for sign, p in (("+", "p"), ("-", "m"))]
    parts += [F.lit(f"{z}:+     0") for z in ("AX", "AY", "MX", "MY")] + [F.lit("PD:******\r")]
    head = F.hex(F.rpad(F.concat_ws("\r", *parts), 511, " ").cast("binary"))
    return g.select("design", F.concat(head, F.lit("1A"), F.array_join("a.t", ""), F.lit("0000F3")).alias("dst"))


def dst_encode(spark: SparkSession, d: str) -> DataFrame:
    """K10 for each design: the DST file, named by its number, as hex text."""
    return dst_files(stream(spark, d))


_S = "WITH s AS (SELECT user_id AS design, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE event_type WHEN 'signup' THEN 'color' WHEN 'error' THEN 'trim' WHEN 'view' THEN 'jump' ELSE 'stitch' END AS kind, CAST(floor(coalesce(value, 0)) AS BIGINT) AS x, event_id % 97 AS y FROM events)"
_P = _S + ", p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM s WINDOW w AS (PARTITION BY design ORDER BY seq))"
_DIG = {81: 40, 27: 13, 9: 4, 3: 1, 1: 0}


def _digit_sql(c: str) -> str:
    """SQL: the digits of ``c`` as {c}81 to {c}1, each from what the larger ones leave, which is the value less its nearest multiple."""
    return ", ".join(f"CAST(floor(({c}+{r})/{s}e0) AS BIGINT) - 3*CAST(floor(({c}+{3 * r + 1})/{3 * s}e0) AS BIGINT) AS {c}{s}" for s, r in _DIG.items())


_BIT = lambda d, p, m: f"CASE {d} WHEN 1 THEN {p} WHEN -1 THEN {m} ELSE 0 END"
_LOW, _MID = ("+".join((_BIT(f"mx{a}", 1, 2), _BIT(f"mx{b}", 4, 8), _BIT(f"my{a}", 128, 64), _BIT(f"my{b}", 32, 16))) for a, b in ((1, 9), (3, 27)))
_PAD = "substr(lpad(CAST(abs({0}) AS VARCHAR), 7, ' '), {1})"
_REACH = "pk = 'stitch' AND ({0} IS NULL OR {0} <> 'stitch' OR sqrt(CAST(({1}-px)*({1}-px)+({2}-py)*({2}-py) AS DOUBLE)) <= " + str(FAR * PX) + ")"
_AHEAD = ", ".join(f"lead({c}, {k}) OVER w AS {c[0]}{k}" for c, k in (("kind", 1), ("role", 1), ("x", 1), ("y", 1), ("kind", 2), ("x", 2), ("y", 2)))


def _guard_sql(t: int, start: str, full: str, gone: str, pair: str, count: str) -> str:
    """SQL: a pass over the rows p{t} (design, k, ...): w{t} says what is kept; a cell's count is an entry of a list."""
    return f"""w{t}(design, k, seq, keep, skip, pk, px, py, hits) AS (SELECT design, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, false, '', CAST(0 AS BIGINT), CAST(0 AS BIGINT), {start} FROM (SELECT DISTINCT design FROM p{t}) q UNION ALL
 SELECT design, k, seq, NOT (skip OR gone), NOT skip AND gone AND pair, CASE WHEN skip OR gone THEN pk ELSE kind END, CASE WHEN skip OR gone THEN px ELSE x END, CASE WHEN skip OR gone THEN py ELSE y END, list_transform(hits, lambda v, i: CASE WHEN i = cell+1 AND NOT skip THEN v + ({count}) ELSE v END) FROM (SELECT *, {gone} AS gone FROM (SELECT *, {pair} AS pair FROM (SELECT p.*, skip, pk, px, py, hits, kind = 'stitch' AND role <> 'fill' AND hits[cell+1] {full} AS brim FROM w{t} JOIN p{t} p ON p.design = w{t}.design AND p.k = w{t}.k+1))))"""


_SATIN = "brim AND role = 'satin' AND k1 = 'stitch' AND r1 = 'satin'"
QUERIES = [stitch_stream_color_index, stitch_lengths, stitch_summary, split_long_stitches, drop_short_stitches, dst_encode, pile_up_guard]
SQL = {
    "pile_up_guard": _S.replace("WITH s", "WITH RECURSIVE s", 1) + f""", r AS (SELECT *, ['satin', 'satin', 'underlay', 'travel', 'fill'][seq%5+1] AS role, y//{PX}*{CELLS}+x//{PX} AS cell FROM s), p1 AS MATERIALIZED (SELECT *, CAST(seq AS BIGINT) AS k, {_AHEAD} FROM r WINDOW w AS (PARTITION BY design ORDER BY seq)),
 {_guard_sql(1, "list_transform(range(24), lambda z: CAST(0 AS BIGINT))", f">= CASE WHEN role = 'travel' THEN {TRAVEL} ELSE {HOT} END", "brim AND " + _REACH.format("k1", "x1", "y1"), f"{_SATIN} AND " + _REACH.format("k2", "x2", "y2"), "CASE WHEN kind = 'stitch' AND NOT gone THEN 1 ELSE 0 END")},
 r2 AS MATERIALIZED (SELECT r.* FROM r JOIN w1 ON w1.design = r.design AND w1.seq = r.seq AND w1.keep), p2 AS MATERIALIZED (SELECT *, row_number() OVER w AS k, {_AHEAD} FROM r2 WINDOW w AS (PARTITION BY design ORDER BY seq)),
 {_guard_sql(2, "(SELECT list(n ORDER BY z) FROM (SELECT z, (SELECT count(*) FROM r2 WHERE r2.design = q.design AND r2.cell = z AND r2.kind = 'stitch') AS n FROM range(24) t(z)))", f"> {FULL}", f"brim AND CASE WHEN pair THEN {_REACH.format('k2', 'x2', 'y2')} ELSE {_REACH.format('k1', 'x1', 'y1')} END", _SATIN, "CASE WHEN gone THEN CASE WHEN pair THEN -2 ELSE -1 END ELSE 0 END")} SELECT design, seq FROM w2 WHERE keep""",
    "dst_encode": _S + f""", l AS (SELECT *, kind IN ('color', 'trim') AS still FROM s), m AS (SELECT *, CASE WHEN still THEN 0 ELSE x-coalesce(last_value(CASE WHEN NOT still THEN x END IGNORE NULLS) OVER w, 0) END AS dx, CASE WHEN still THEN 0 ELSE coalesce(last_value(CASE WHEN NOT still THEN y END IGNORE NULLS) OVER w, 0)-y END AS dy FROM l WINDOW w AS (PARTITION BY design ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), k AS (SELECT *, unnest(range(greatest(1, (abs(dx)+120)//121, (abs(dy)+120)//121))) AS k FROM m),
 v AS (SELECT design, seq, kind, still, x, y, k, sign(dx)*greatest(0, least(121, abs(dx)-121*k)) AS mx, sign(dy)*greatest(0, least(121, abs(dy)-121*k)) AS my FROM k), g AS (SELECT *, {_digit_sql('mx')}, {_digit_sql('my')} FROM v), t AS (SELECT *, CASE kind WHEN 'color' THEN '0000C3' WHEN 'trim' THEN '418283414183418283' ELSE printf('%02X%02X%02X', CAST({_LOW} AS INT), CAST({_MID} AS INT), CAST(3 + CASE WHEN kind = 'jump' THEN 128 ELSE 0 END + {_BIT('mx81', 4, 8)} + {_BIT('my81', 32, 16)} AS INT)) END AS t FROM g),
 h AS (SELECT design, string_agg(t, '' ORDER BY seq, k) AS body, count(*) FILTER (kind = 'stitch' AND k = 0) AS st, count(*) FILTER (kind = 'color') AS co, greatest(0, max(x) FILTER (NOT still)) AS px, least(0, min(x) FILTER (NOT still)) AS nx, greatest(0, max(y) FILTER (NOT still)) AS py, least(0, min(y) FILTER (NOT still)) AS ny FROM t GROUP BY design)
 SELECT design, hex(rpad('LA:' || rpad(CAST(design AS VARCHAR), 16, ' ') || chr(13) || 'ST:' || {_PAD.format('st', 1)} || chr(13) || 'CO:' || {_PAD.format('co', 5)} || chr(13) || '+X:' || {_PAD.format('coalesce(px, 0)', 3)} || chr(13) || '-X:' || {_PAD.format('coalesce(nx, 0)', 3)} || chr(13) || '+Y:' || {_PAD.format('coalesce(py, 0)', 3)} || chr(13) || '-Y:' || {_PAD.format('coalesce(ny, 0)', 3)} || chr(13) || 'AX:+     0' || chr(13) || 'AY:+     0' || chr(13) || 'MX:+     0' || chr(13) || 'MY:+     0' || chr(13) || 'PD:******' || chr(13), 511, ' ')) || '1A' || body || '0000F3' AS dst FROM h""",
    "stitch_stream_color_index": _S + " SELECT design, seq, CAST(sum(CASE WHEN kind = 'color' THEN 1 ELSE 0 END) OVER (PARTITION BY design ORDER BY seq) AS BIGINT) AS color_index FROM s",
    "stitch_lengths": _P + " SELECT design, seq, coalesce((x-px)*(x-px)+(y-py)*(y-py), 0) AS d2 FROM p",
    "drop_short_stitches": _S.replace("WITH s", "WITH RECURSIVE s", 1) + ", k AS (SELECT design, seq, x, y, true AS kept FROM s WHERE seq = 1 UNION ALL SELECT s.design, s.seq, CASE WHEN go THEN k.x ELSE s.x END, CASE WHEN go THEN k.y ELSE s.y END, NOT go FROM k JOIN s ON s.design = k.design AND s.seq = k.seq + 1, LATERAL (SELECT s.kind = 'stitch' AND (s.x-k.x)*(s.x-k.x)+(s.y-k.y)*(s.y-k.y) < 9 AS go)) SELECT design, seq FROM k WHERE kept",
    "stitch_summary": _S + ", g AS (SELECT design, count(*) FILTER (kind='stitch') AS stitches, count(*) FILTER (kind='jump') AS jumps, count(*) FILTER (kind='trim') AS trims, count(*) FILTER (kind='color') AS colors, CAST(floor((max(x)-min(x))/254e0*100+0.5e0) AS BIGINT) AS width, CAST(floor((max(y)-min(y))/254e0*100+0.5e0) AS BIGINT) AS height FROM s GROUP BY 1) SELECT *, colors+1 AS threads, CAST(floor((stitches/750 + (6*trims+20*colors)/60)*10+0.5) AS BIGINT) AS tenths FROM g",
    "split_long_stitches": _P + ", q AS (SELECT *, CAST(CASE WHEN sqrt((x-px)*(x-px)+(y-py)*(y-py)) > 70 THEN ceil(sqrt((x-px)*(x-px)+(y-py)*(y-py))/65.0e0) ELSE 1 END AS BIGINT) AS n FROM p WHERE px IS NOT NULL), r AS (SELECT *, unnest(range(1, n+1)) AS k FROM q) SELECT design, seq, k, CAST(floor(px+(x-px)*k/n+0.5) AS BIGINT) AS x, CAST(floor(py+(y-py)*k/n+0.5) AS BIGINT) AS y FROM r",
}

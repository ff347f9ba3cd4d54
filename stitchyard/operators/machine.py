"""Machine files, neighbours and folds over requests."""

import math
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stitchyard.operators.folds import folded
from stitchyard.operators.geometry import points
from stitchyard.operators.stitch import order, stream
from stitchyard.sources.tables import table


def exp_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The EXP bytes of a design, as hex text: moves since the last needle place or jump, y upwards, at most 127 each; marks for jumps, trims and colours, and for the end."""
    s = stream(spark, d)
    still = F.col("kind").isin("color", "trim")
    last = lambda c: F.coalesce(F.last(F.when(~still, F.col(c)), ignorenulls=True).over(order().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    m = s.select("design", "seq", "kind", (F.col("x") - last("x")).alias("dx"), (last("y") - F.col("y")).alias("dy"))
    n = m.withColumn("n", F.greatest(F.lit(1), F.expr("(abs(dx) + 126) div 127"), F.expr("(abs(dy) + 126) div 127")))
    part = lambda c: f"lpad(hex(cast(sign({c}) as long) * greatest(0, least(127, abs({c}) - 127 * k)) & 255), 2, '0')"
    moves = F.expr(f"array_join(transform(sequence(0L, n - 1), k -> concat({part('dx')}, {part('dy')})), '')")
    text = F.when(F.col("kind") == "color", "8004").when(F.col("kind") == "trim", "80800700").when(F.col("kind") == "jump", F.concat(F.lit("8001"), moves)).otherwise(moves)
    rows = n.select("design", "seq", text.alias("t")).groupBy("design").agg(F.array_sort(F.collect_list(F.struct("seq", "t"))).alias("a"))
    return rows.select("design", F.concat(F.array_join("a.t", ""), F.lit("8080")).alias("exp"))


def eps_pages(spark: SparkSession, d: str) -> DataFrame:
    """A design's closed line as EPS, in points of a page 97 inches high, y upwards."""
    at = F.concat(F.col("x") * 72, F.lit(" "), (97 - F.col("y")) * 72, F.when(F.col("seq") == 1, " moveto").otherwise(" lineto"))
    p = points(spark, d).groupBy("design").agg(F.max("x").alias("w"), F.array_sort(F.collect_list(F.struct("seq", at.alias("t")))).alias("a"))
    head = F.concat(F.lit("%!PS-Adobe-3.0 EPSF-3.0\n%%BoundingBox: 0 0 "), F.col("w") * 72, F.lit(" 6984\n%%Pages: 1\n%%EndComments\ngsave\nnewpath\n"))
    return p.select("design", F.concat(head, F.concat_ws("\n", "a.t"), F.lit("\nclosepath\n0 0 0 setrgbcolor\nfill\ngrestore\n%%EOF\n")).alias("eps"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """A box for each part, forty to a page, its colour its key's rest. Its cells are many more than its file tells: none are broadcast."""
    return table(spark, d, "part").select(F.expr("p_partkey div 40").alias("page"), F.col("p_partkey").alias("i"), *[F.expr(f"p_partkey * {m} % {n}").alias(c) for c, m, n in (("x", 7, 90), ("y", 11, 80), ("w", 3, 41), ("h", 5, 37), ("k", 1, 5))]).hint("merge")


def near_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a page's boxes under 3 apart on both axes, or of which one has the other's centre as its nearest, under 25 off.

    Boxes meet by the cells of 32 that they reach, grown by as much as they may be apart. A page has a fixed number of boxes.
    """
    b = _boxes(spark, d)
    cell = lambda c, s, by: F.explode(F.expr(f"sequence((2 * {c} + {s} - {by}) div 64, (2 * {c} + {s} + {by}) div 64)"))
    boxes = b.withColumn("cx", F.explode(F.expr("sequence(x div 32, (x + w + 3) div 32)"))).withColumn("cy", F.explode(F.expr("sequence(y div 32, (y + h + 3) div 32)")))
    other = boxes.select("page", "cx", "cy", *[F.col(c).alias(f"{c}2") for c in "ixywh"])
    near = F.expr("i < i2 and x <= x2 + w2 + 3 and x2 <= x + w + 3 and y <= y2 + h2 + 3 and y2 <= y + h + 3")
    touching = boxes.join(other, ["page", "cx", "cy"]).filter(near).select("i", F.col("i2").alias("j"))
    # centres, in halves: those within 25 lie in the cell of one and in the grown cells of the other
    centre = b.select("page", "i", (2 * F.col("x") + F.col("w")).alias("mx"), (2 * F.col("y") + F.col("h")).alias("my"), F.expr("(2 * x + w) div 64").alias("cx"), F.expr("(2 * y + h) div 64").alias("cy"))
    grown = b.withColumn("cx", cell("x", "w", 50)).withColumn("cy", cell("y", "h", 50)).select("page", "cx", "cy", F.col("i").alias("of"), (2 * F.col("x") + F.col("w")).alias("ox"), (2 * F.col("y") + F.col("h")).alias("oy"))
    dist = (F.col("mx") - F.col("ox")) * (F.col("mx") - F.col("ox")) + (F.col("my") - F.col("oy")) * (F.col("my") - F.col("oy"))
    found = grown.join(centre, ["page", "cx", "cy"]).filter("i <> of").withColumn("d", dist).filter("d < 2500")
    nearest = found.groupBy("of").agg(F.min(F.struct("d", "i")).alias("m")).select(F.least("of", "m.i").alias("i"), F.greatest("of", "m.i").alias("j"))
    return touching.union(nearest).distinct()


def visit_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of different colours that share a cell of 10: the lower key is sewn first."""
    b = _boxes(spark, d)
    cells = b.withColumn("cx", F.explode(F.expr("sequence(x div 10, (x + w) div 10)"))).withColumn("cy", F.explode(F.expr("sequence(y div 10, (y + h) div 10)"))).select("page", "cx", "cy", "i", "k")
    other = cells.select("page", "cx", "cy", F.col("i").alias("j"), F.col("k").alias("k2"))
    return cells.join(other, ["page", "cx", "cy"]).filter("i < j and k <> k2").groupBy("i", "j").agg(F.count("*").alias("cells"))


def directory_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Files and bytes by place."""
    return table(spark, d, "pages").groupBy(F.substring_index(F.substring_index("url", "/", 3), "/", -1).alias("place")).agg(F.count("*").alias("files"), F.sum(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")).alias("bytes"))


def sender():
    """A step that tells of a mail's time (times in order) if it goes, waits a minute after the last, or is past five in a day."""
    sent: deque[float] = deque()

    def step(t: float) -> str:
        while sent and t - sent[0] >= 86400:
            sent.popleft()
        why = "wait" if sent and t - sent[-1] < 60 else "full" if len(sent) >= 5 else "sent"
        if why == "sent":
            sent.append(t)
        return why

    return step


def worker(most: int, waiting: int):
    """a step that tells of a job, in order of arrival, (run, queue or reject, when it begins); a job that ends as another arrives has ended."""
    ends: list[float] = []
    starts: list[float] = []

    def step(t: float, work: float) -> tuple[str, float]:
        nonlocal ends, starts
        busy = sorted(e for e in ends if e > t)
        starts = [s for s in starts if s > t]
        if len(busy) >= most and len(starts) >= waiting:
            return "reject", t
        state, at = ("run", t) if len(busy) < most else ("queue", busy[len(busy) - most])
        ends = [*busy, at + work]
        starts.append(at)
        return state, at

    return step


def _requests(spark: SparkSession, d: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("user_id", "event_id", (micros / 1e6).alias("t"), (60 * F.greatest(F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))).alias("work"))


def mail_throttle(spark: SparkSession, d: str) -> DataFrame:
    """W15 for each user, in order of time."""

    def begin():
        send = sender()
        return lambda row: (row["event_id"], send(row["t"]))

    return folded(_requests(spark, d), "user_id", ["t", "event_id"], "event_id long, outcome string", begin)


def worker_queue(spark: SparkSession, d: str) -> DataFrame:
    """F12 for each user's jobs as a server of two workers and three places, a job a minute long for each unit of value."""

    def begin():
        take = worker(2, 3)
        return lambda row: (row["event_id"], take(row["t"], row["work"])[0])

    return folded(_requests(spark, d), "user_id", ["t", "event_id"], "event_id long, state string", begin)


_S = "s AS (SELECT user_id AS design, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, CASE event_type WHEN 'signup' THEN 'color' WHEN 'error' THEN 'trim' WHEN 'view' THEN 'jump' ELSE 'stitch' END AS kind, CAST(floor(coalesce(value, 0)) AS BIGINT) AS x, CAST(event_id % 97 AS BIGINT) AS y FROM events)"
_B = "b AS (SELECT p_partkey//40 AS page, p_partkey AS i, p_partkey*7%90 AS x, p_partkey*11%80 AS y, p_partkey*3%41 AS w, p_partkey*5%37 AS h, p_partkey%5 AS k FROM part)"
_AT = "coalesce(last_value(CASE WHEN kind NOT IN ('color', 'trim') THEN {0} END IGNORE NULLS) OVER (PARTITION BY design ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
_HEX = "format('{{:02X}}', (CAST(sign({0}) AS BIGINT)*greatest(0, least(127, abs({0})-127*k))) & 255)"

#: Lines of a DXF file before its size, its layers and its outlines, and at its end.
DXF_HEAD = "0 SECTION 2 HEADER 9 $ACADVER 1 AC1009 9 $INSUNITS 70 1 9 $EXTMIN 10 0 20 0 9 $EXTMAX 10"
DXF_TABLE = "0 ENDSEC 0 SECTION 2 TABLES 0 TABLE 2 LAYER 70"
DXF_ENTITIES = "0 ENDTAB 0 ENDSEC 0 SECTION 2 ENTITIES"
DXF_END = "0 ENDSEC 0 EOF"
DXF_FILLS = [(0, 0, 0), (255, 255, 255), (204, 34, 17), (17, 170, 51), (34, 68, 204), (200, 180, 0)]


def dxf_color(r: Column, g: Column, b: Column) -> Column:
    """The number of a layer's colour: 7 for black and white, or one of six hues."""
    turn = F.degrees(F.atan2(math.sqrt(3) * (g - b), 2 * r - g - b))
    return F.when((F.greatest(r, g, b) < 40) | (F.least(r, g, b) > 215), 7).otherwise(1 + F.floor(F.pmod(turn, F.lit(360.0)) / 60)).cast("int")


def dxf_files(spark: SparkSession, d: str) -> DataFrame:
    """Outlines of a design as a DXF file in inches, y upwards, with a layer for each fill in order of its first outline."""
    words = lambda t: F.lit(t.replace(" ", "\n"))
    lines = lambda *c: F.concat_ws("\n", *c)
    fill = F.element_at(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("rgb", f, strict=True)]) for f in DXF_FILLS]), (F.col("l_partkey") % len(DXF_FILLS) + 1).cast("int"))
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_suppkey", fill.alias("f"))
    s = s.select("id", "l_linenumber", "l_partkey", "l_suppkey", dxf_color(F.col("f.r"), F.col("f.g"), F.col("f.b")).alias("aci"), (F.col("l_partkey") % len(DXF_FILLS)).alias("fill"))
    x, y = F.col("l_partkey") % 90, F.col("l_suppkey") % 80
    x2, y2 = x + F.col("l_partkey") % 13 + 1, y + F.col("l_suppkey") % 11 + 1
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.when(F.col("l_linenumber") % 3 != 0, F.array(point(x, y), point(x2, y), point(x2, y2), point(x, y2))).otherwise(F.array(point(x, y), point(x2, y2)))
    shapes = s.select("id", F.struct("l_linenumber", "l_partkey", "l_suppkey", "fill", "aci", ring.alias("p")).alias("s")).groupBy("id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    wide, high = 4 + F.col("id") % 5, 3 + F.col("id") % 3
    shapes = shapes.withColumn("fills", F.array_distinct(F.transform("s", lambda q: F.struct(q.fill, q.aci)))).withColumn("wide", wide.cast("double")).withColumn("high", high.cast("double"))
    layers = F.array_join(F.transform("fills", lambda f, i: lines(words("0 LAYER 2"), F.concat(F.lit("INK_"), (i + 1).cast("string")), words("70 0 62"), f.aci.cast("string"), words("6 CONTINUOUS"))), "\n")

    def outline(q: Column) -> Column:
        layer = F.concat(F.lit("INK_"), F.array_position("fills", F.struct(q.fill, q.aci)).cast("string"))
        corner = lambda v: lines(words("0 VERTEX 8"), layer, F.lit("10"), F.format_string("%.5f", v.x * F.col("wide") / 100), F.lit("20"), F.format_string("%.5f", F.col("high") - v.y * F.col("high") / 100), words("30 0"))
        return lines(words("0 POLYLINE 8"), layer, words("66 1 10 0 20 0 30 0 70"), F.when(F.size(q.p) > 2, "1").otherwise("0"), F.array_join(F.transform(q.p, corner), "\n"), words("0 SEQEND 8"), layer)

    text = lines(words(DXF_HEAD), F.format_string("%.4f", "wide"), F.lit("20"), F.format_string("%.4f", "high"), words(DXF_TABLE), F.size("fills").cast("string"), layers, words(DXF_ENTITIES), F.array_join(F.transform("s", outline), "\n"), words(DXF_END))
    return shapes.select("id", F.concat(text, F.lit("\n")).alias("dxf"))


QUERIES = [dxf_files, exp_bytes, eps_pages, near_boxes, visit_precedence, directory_bytes, mail_throttle, worker_queue]
_L = lambda t: "'" + t.replace(" ", "\n") + "'"
_CORNER = lambda x, y: f"{_L('0 VERTEX 8')} || t || 'INK_' || n || t || '10' || t || printf('%.5f', {x} * wide / 100) || t || '20' || t || printf('%.5f', high - {y} * high / 100) || t || {_L('30 0')} || t"
_ACI = "CASE fill " + " ".join(f"WHEN {k} THEN {7 if max(f) < 40 or min(f) > 215 else 1 + int(math.degrees(math.atan2(math.sqrt(3) * (f[1] - f[2]), 2 * f[0] - f[1] - f[2])) % 360) // 60}" for k, f in enumerate(DXF_FILLS)) + " END"
_TIMES = "e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, 60 * greatest(coalesce(value, 0e0), 0e0) AS work, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"
SQL = {
    "mail_throttle": f"""WITH RECURSIVE {_TIMES}, f AS (SELECT user_id, n, event_id, [t] AS sent, 'sent' AS outcome FROM e WHERE n = 1 UNION ALL
 SELECT user_id, n, event_id, CASE WHEN outcome = 'sent' THEN list_append(live, t) ELSE live END, outcome FROM (SELECT *, CASE WHEN len(live) > 0 AND t - live[len(live)] < 60 THEN 'wait' WHEN len(live) >= 5 THEN 'full' ELSE 'sent' END AS outcome FROM (SELECT e.*, [x FOR x IN f.sent IF e.t - x < 86400] AS live FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)))
 SELECT event_id, outcome FROM f""",
    "worker_queue": f"""WITH RECURSIVE {_TIMES}, f AS (SELECT user_id, n, event_id, [t + work] AS ends, [t] AS starts, 'run' AS state FROM e WHERE n = 1 UNION ALL
 SELECT user_id, n, event_id, CASE WHEN state = 'reject' THEN busy ELSE list_append(busy, start + work) END, CASE WHEN state = 'reject' THEN behind ELSE list_append(behind, start) END, state FROM (SELECT *, CASE WHEN len(busy) < 2 THEN 'run' WHEN len(behind) >= 3 THEN 'reject' ELSE 'queue' END AS state, CASE WHEN len(busy) < 2 THEN t ELSE busy[len(busy) - 1] END AS start FROM (SELECT e.*, list_sort([x FOR x IN f.ends IF x > e.t]) AS busy, [x FOR x IN f.starts IF x > e.t] AS behind FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)))
 SELECT event_id, state FROM f""",
    "dxf_files": f"""WITH s AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k, l_partkey % 6 AS fill, l_linenumber % 3 <> 0 AS ring, l_partkey % 90 AS x, l_suppkey % 80 AS y, l_partkey % 90 + l_partkey % 13 + 1 AS x2, l_suppkey % 80 + l_suppkey % 11 + 1 AS y2, CAST(4 + l_orderkey % 5 AS DOUBLE) AS wide, CAST(3 + l_orderkey % 3 AS DOUBLE) AS high, chr(10) AS t FROM lineitem),
 f AS (SELECT id, fill, {_ACI} AS aci, row_number() OVER (PARTITION BY id ORDER BY min(k)) AS n FROM s GROUP BY id, fill),
 e AS (SELECT id, wide, high, string_agg({_L('0 POLYLINE 8')} || t || 'INK_' || n || t || {_L('66 1 10 0 20 0 30 0 70')} || t || CASE WHEN ring THEN '1' ELSE '0' END || t || {_CORNER('x', 'y')} || CASE WHEN ring THEN {_CORNER('x2', 'y')} ELSE '' END || {_CORNER('x2', 'y2')} || CASE WHEN ring THEN {_CORNER('x', 'y2')} ELSE '' END || {_L('0 SEQEND 8')} || t || 'INK_' || n, chr(10) ORDER BY k) AS e FROM s JOIN f USING (id, fill) GROUP BY ALL),
 l AS (SELECT id, count(*) AS c, string_agg({_L('0 LAYER 2')} || chr(10) || 'INK_' || n || chr(10) || {_L('70 0 62')} || chr(10) || aci || chr(10) || {_L('6 CONTINUOUS')}, chr(10) ORDER BY n) AS l FROM f GROUP BY id)
 SELECT id, concat_ws(chr(10), {_L(DXF_HEAD)}, printf('%.4f', wide), '20', printf('%.4f', high), {_L(DXF_TABLE)}, c, l, {_L(DXF_ENTITIES)}, e, {_L(DXF_END)}) || chr(10) AS dxf FROM e JOIN l USING (id)""",
    "exp_bytes": f"WITH {_S}, m AS (SELECT design, seq, kind, x-{_AT.format('x')} AS dx, {_AT.format('y')}-y AS dy FROM s), c AS (SELECT *, unnest(range(greatest(1, (abs(dx)+126)//127, (abs(dy)+126)//127))) AS k FROM m), t AS (SELECT design, seq, kind, string_agg({_HEX.format('dx')} || {_HEX.format('dy')}, '' ORDER BY k) AS v FROM c GROUP BY ALL) SELECT design, string_agg(CASE kind WHEN 'color' THEN '8004' WHEN 'trim' THEN '80800700' WHEN 'jump' THEN '8001' || v ELSE v END, '' ORDER BY seq) || '8080' AS exp FROM t GROUP BY design",
    "eps_pages": f"WITH {_S} SELECT design, '%!PS-Adobe-3.0 EPSF-3.0' || chr(10) || '%%BoundingBox: 0 0 ' || (max(x)*72) || ' 6984' || chr(10) || '%%Pages: 1' || chr(10) || '%%EndComments' || chr(10) || 'gsave' || chr(10) || 'newpath' || chr(10) || string_agg((x*72) || ' ' || ((97-y)*72) || CASE WHEN seq = 1 THEN ' moveto' ELSE ' lineto' END, chr(10) ORDER BY seq) || chr(10) || 'closepath' || chr(10) || '0 0 0 setrgbcolor' || chr(10) || 'fill' || chr(10) || 'grestore' || chr(10) || '%%EOF' || chr(10) AS eps FROM s GROUP BY design",
    "near_boxes": f"WITH {_B}, c AS (SELECT p.i, q.i AS j, (2*p.x+p.w-2*q.x-q.w)*(2*p.x+p.w-2*q.x-q.w)+(2*p.y+p.h-2*q.y-q.h)*(2*p.y+p.h-2*q.y-q.h) AS d, p.x <= q.x+q.w+3 AND q.x <= p.x+p.w+3 AND p.y <= q.y+q.h+3 AND q.y <= p.y+p.h+3 AS near FROM b p JOIN b q ON p.page = q.page AND p.i <> q.i), n AS (SELECT i, arg_min(j, d*100000000+j) AS j FROM c WHERE d < 2500 GROUP BY i) SELECT i, j FROM c WHERE near AND i < j UNION SELECT least(i, j), greatest(i, j) FROM n",
    "visit_precedence": f"WITH {_B}, c AS (SELECT page, i, k, cx, cy FROM b, range(20) u(cx), range(20) v(cy) WHERE cx BETWEEN x//10 AND (x+w)//10 AND cy BETWEEN y//10 AND (y+h)//10) SELECT p.i, q.i AS j, count(*) AS cells FROM c p JOIN c q USING (page, cx, cy) WHERE p.i < q.i AND p.k <> q.k GROUP BY 1, 2",
    "directory_bytes": "SELECT split_part(url, '/', 3) AS place, count(*) AS files, CAST(sum(coalesce(octet_length(encode(html)), 0)) AS BIGINT) AS bytes FROM pages GROUP BY 1",
}

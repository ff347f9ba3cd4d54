"""Outlines of label maps: unit edges, lines of edges between junctions, rings and how they nest."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchyard.functions.steps import dropped, walks, written
from stitchyard.operators.images import _IMG, pictures
from stitchyard.sources.tables import table

#: Directions of half edges, by number: right, down, left, up.
TURNS = [(1, 0), (0, 1), (-1, 0), (0, -1)]
#: Corners of a row of a label map are numbered with this many places.
SPAN = 1 << 16


def picture_edges(images: DataFrame) -> DataFrame:
    """(id, x0, y0, x1, y1, l, r), the unit edges between different labels: rightward ones have the upper pixel on the left, downward ones the right pixel.

    Neighbours are found in an image's own row; no pixel meets another in a join.
    """
    down = F.expr("filter(transform(sequence(0, w * h - 1), i -> if(i % w < w - 1 and label[i] <> label[i + 1], struct(cast(i % w + 1 as int) as x0, cast(i div w as int) as y0, cast(i % w + 1 as int) as x1, cast(i div w + 1 as int) as y1, label[i + 1] as l, label[i] as r), null)), e -> e is not null)")
    right = F.expr("filter(transform(sequence(0, w * h - 1), i -> if(i div w < h - 1 and label[i] <> label[i + w], struct(cast(i % w as int) as x0, cast(i div w + 1 as int) as y0, cast(i % w + 1 as int) as x1, cast(i div w + 1 as int) as y1, label[i] as l, label[i + w] as r), null)), e -> e is not null)")
    return images.select("id", F.explode(F.concat(down, right)).alias("e")).select("id", "e.*")


def unit_edges(spark: SparkSession, d: str) -> DataFrame:
    """L03 of every picture."""
    return picture_edges(pictures(spark, d))


def crack_junctions(spark: SparkSession, d: str) -> DataFrame:
    """The corners where other than two unit edges meet; lines of edges end there."""
    e = picture_edges(pictures(spark, d))
    ends = e.select("id", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("v"))
    return ends.groupBy("id", "v.x", "v.y").agg(F.count("*").alias("degree")).filter("degree <> 2")


def crack_lines(edges: DataFrame) -> DataFrame:
    """(id, crack, at, x, y, left, right, closed): the points of each line of edges between junctions, or of each ring, in order.

    A half edge is (corner, direction); it goes on to the one other half edge that leaves its end, if just two edges
    meet there. Of a line's two directions that with the smaller first half edge stays, and ``crack`` is it.
    """
    node = lambda x, y, k: (F.col(y).cast("long") * SPAN + F.col(x)) * 4 + k
    turn = F.when(F.col("x1") > F.col("x0"), 0).otherwise(1)
    forth = edges.select("id", node("x0", "y0", turn).alias("node"), node("x1", "y1", turn + 2).alias("back"), F.col("l").alias("left"), F.col("r").alias("right"))
    half = written(forth.unionAll(forth.select("id", F.col("back").alias("node"), F.col("node").alias("back"), F.col("right").alias("left"), F.col("left").alias("right"))), "crack_half")
    corner = half.groupBy("id", F.expr("node div 4").alias("corner")).agg(F.count("*").alias("n"), F.min("node").alias("p"), F.max("node").alias("q"))
    through = corner.filter("n = 2").select("id", "corner", "p", "q")
    ends = half.withColumn("corner", F.expr("back div 4")).join(through, ["id", "corner"], "left")
    steps = ends.select("id", "node", F.when(F.col("back") == F.col("p"), F.col("q")).when(F.col("back") == F.col("q"), F.col("p")).alias("next"))
    ranked = written(walks(steps, "id", "crack"), "crack_ranked")
    whole = half.join(ranked, ["id", "node"])
    other = ranked.select("id", F.col("node").alias("back"), F.col("first").alias("other"))
    one = whole.join(other, ["id", "back"]).filter("first < other")
    lines = one.select("id", F.col("first").alias("crack"), "at", F.expr("cast(node div 4 % 65536 as int)").alias("x"), F.expr("cast(node div 262144 as int)").alias("y"), "left", "right", "closed", "back")
    last = lines.groupBy("id", "crack").agg(F.max_by(F.struct("at", "left", "right", "closed", "back"), "at").alias("z")).select("id", "crack", (F.col("z.at") + 1).alias("at"), F.expr("cast(z.back div 4 % 65536 as int)").alias("x"), F.expr("cast(z.back div 262144 as int)").alias("y"), "z.left", "z.right", "z.closed")
    return lines.drop("back").unionAll(last)


def crack_polylines(spark: SparkSession, d: str) -> DataFrame:
    """L04 of every picture."""
    return crack_lines(picture_edges(pictures(spark, d)))


#: Height of the bands that edges of rings are dealt to.
BAND = 32


def ring_points(spark: SparkSession, d: str) -> DataFrame:
    """(page, ring, seq, x, y): rings from parts, 40 a page; a ring has four to eight corners around a centre of its key."""
    p = table(spark, d, "part").select(F.expr("p_partkey div 40").alias("page"), F.col("p_partkey").alias("ring"))
    k = p.withColumns({"cx": F.expr("200 + (ring * 7 % 5) * 240 + ring * 13 % 11"), "cy": F.expr("200 + (ring * 3 % 4) * 240 + ring * 17 % 7"), "size": F.expr("6 + (ring * 29 % 97) * 2"), "n": F.expr("4 + ring % 5")})
    # corners of a circle by whole numbers: sixteenths of a turn, in hundredths
    turns = "array(100, 92, 71, 38, 0, -38, -71, -92, -100, -92, -71, -38, 0, 38, 71, 92)"
    at = lambda shift: f"{turns}[cast((seq * 16 div n + {shift}) % 16 as int)]"
    e = k.withColumn("seq", F.explode(F.expr("sequence(0, cast(n as int) - 1)")))
    return e.select("page", "ring", "seq", F.expr(f"cx + size * {at(0)} div 100").cast("long").alias("x"), F.expr(f"cy + size * {at(12)} div 100").cast("long").alias("y"))


def ring_parents(points: DataFrame) -> DataFrame:
    """(page, ring, parent, depth, area2): for each ring the least larger one that holds its middle corner, or -1, and how deep it lies.

    Edges are dealt to the bands they pass; a probe meets the edges of its own band, of rings whose box holds it, and
    counts those that cross the ray to its right. Parents' parents are followed by doubling.
    """
    ring = points.groupBy("page", "ring").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    after = "p[(i + 1) % size(p)]"
    ring = ring.withColumn("twice", F.expr(f"abs(aggregate(sequence(0, size(p) - 1), 0L, (s, i) -> s + p[i].x * {after}.y - {after}.x * p[i].y))"))
    ring = written(ring.select("page", "ring", "p", "twice", F.expr("array_min(transform(p, q -> q.x))").alias("x0"), F.expr("array_max(transform(p, q -> q.x))").alias("x1")), "rings")
    edge = ring.select("page", F.col("ring").alias("around"), F.col("twice").alias("area"), "x0", "x1", F.explode(F.expr(f"transform(sequence(0, size(p) - 1), i -> struct(p[i].x as ax, p[i].y as ay, {after}.x as bx, {after}.y as by))")).alias("e")).filter("e.ay <> e.by")
    edge = edge.withColumn("band", F.explode(F.expr(f"sequence(least(e.ay, e.by) div {BAND}, greatest(e.ay, e.by) div {BAND})")))
    probe = ring.select("page", "ring", "twice", F.expr("p[cast(size(p) div 2 as int)].x").alias("px"), F.expr("p[cast(size(p) div 2 as int)].y").alias("py")).withColumn("band", F.expr(f"py div {BAND}"))
    met = probe.join(edge, ["page", "band"]).filter("area > twice and px between x0 and x1 and (e.ay > py) <> (e.by > py)")
    # px < ax + (bx - ax) * (py - ay) / (by - ay), without a quotient
    crosses = F.expr("if(e.by > e.ay, (px - e.ax) * (e.by - e.ay) < (e.bx - e.ax) * (py - e.ay), (px - e.ax) * (e.by - e.ay) > (e.bx - e.ax) * (py - e.ay))")
    holds = met.filter(crosses).groupBy("page", "ring", "around", "area").agg(F.count("*").alias("n")).filter("n % 2 = 1")
    parent = holds.groupBy("page", "ring").agg(F.min_by("around", F.struct("area", "around")).alias("parent"))
    up = written(ring.select("page", "ring", "twice").join(parent, ["page", "ring"], "left").select("page", "ring", "twice", "parent", F.col("parent").alias("jump"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")), "ring_up")
    while up.filter("jump is not null").limit(1).count():
        top = up.select("page", F.col("ring").alias("jump"), F.col("jump").alias("far"), F.col("depth").alias("more"))
        new = written(up.join(top, ["page", "jump"], "left").select("page", "ring", "twice", "parent", F.col("far").alias("jump"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "ring_up")
        dropped(up)
        up = new
    return up.select("page", "ring", F.coalesce("parent", F.lit(-1)).alias("parent"), "depth", F.col("twice").alias("area2"))


def ring_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Rings with their parents; even depths are outlines, odd ones holes."""
    return ring_parents(ring_points(spark, d)).withColumn("outline", F.col("depth") % 2 == 0)


_PICTURE_EDGES = f"{_IMG}, e AS (SELECT a.id, a.x+1 AS x0, a.y AS y0, a.x+1 AS x1, a.y+1 AS y1, b.label AS l, a.label AS r FROM img a JOIN img b ON b.id = a.id AND b.x = a.x+1 AND b.y = a.y AND a.label <> b.label UNION ALL SELECT a.id, a.x, a.y+1, a.x+1, a.y+1, a.label, b.label FROM img a JOIN img b ON b.id = a.id AND b.x = a.x AND b.y = a.y+1 AND a.label <> b.label)"
_HALF = f"""{_PICTURE_EDGES}, h AS MATERIALIZED (SELECT id, (y0*65536+x0)*4 + CASE WHEN x1 > x0 THEN 0 ELSE 1 END AS node, (y1*65536+x1)*4 + CASE WHEN x1 > x0 THEN 2 ELSE 3 END AS back, l, r FROM e UNION ALL SELECT id, (y1*65536+x1)*4 + CASE WHEN x1 > x0 THEN 2 ELSE 3 END, (y0*65536+x0)*4 + CASE WHEN x1 > x0 THEN 0 ELSE 1 END, r, l FROM e),
 dg AS (SELECT id, node//4 AS c, count(*) AS n FROM h GROUP BY ALL), nx AS MATERIALIZED (SELECT h.id, h.node, h.back, h.l, h.r, o.node AS nxt, s.n <> 2 AS head FROM h JOIN dg s ON s.id = h.id AND s.c = h.node//4 JOIN dg t ON t.id = h.id AND t.c = h.back//4 LEFT JOIN h o ON t.n = 2 AND o.id = h.id AND o.node//4 = h.back//4 AND o.node <> h.back)"""
_POLY = "k AS (SELECT p_partkey//40 AS page, p_partkey AS ring, 200+(p_partkey*7%5)*240+p_partkey*13%11 AS cx, 200+(p_partkey*3%4)*240+p_partkey*17%7 AS cy, 6+(p_partkey*29%97)*2 AS size, CAST(4+p_partkey%5 AS INT) AS n FROM part), t AS (SELECT [100, 92, 71, 38, 0, -38, -71, -92, -100, -92, -71, -38, 0, 38, 71, 92] AS c), v AS MATERIALIZED (SELECT page, ring, n, s, cx + CAST(trunc(size*c[(s*16//n)%16+1]/100e0) AS BIGINT) AS x, cy + CAST(trunc(size*c[(s*16//n+12)%16+1]/100e0) AS BIGINT) AS y FROM k, t, range(8) q(s) WHERE s < n)"
QUERIES = [unit_edges, crack_junctions, crack_polylines, ring_outlines]
SQL = {
    "unit_edges": f"WITH {_PICTURE_EDGES} SELECT * FROM e",
    "crack_junctions": f"WITH {_PICTURE_EDGES} SELECT id, x, y, count(*) AS degree FROM (SELECT id, x0 AS x, y0 AS y FROM e UNION ALL SELECT id, x1, y1 FROM e) GROUP BY ALL HAVING count(*) <> 2",
    "crack_polylines": f"""WITH RECURSIVE {_HALF}, wk(id, first, node, pos) AS (SELECT id, node, node, 0 FROM nx WHERE head UNION ALL SELECT wk.id, first, nxt, pos+1 FROM wk JOIN nx USING (id, node) WHERE nxt IS NOT NULL),
 rest AS MATERIALIZED (SELECT * FROM nx ANTI JOIN wk USING (id, node)), lp(id, first, node, pos) AS (SELECT id, node, node, 0 FROM rest UNION ALL SELECT lp.id, first, nxt, pos+1 FROM lp JOIN rest USING (id, node) WHERE nxt <> first),
 lw AS (SELECT id, node, min(first) AS low FROM lp GROUP BY ALL), a AS (SELECT id, first, node, pos, false AS closed FROM wk UNION ALL SELECT lp.id, first, lp.node, pos, true FROM lp JOIN lw ON lw.id = lp.id AND lw.node = lp.node AND lw.low = lp.first),
 f AS (SELECT a.*, nx.back, nx.l, nx.r FROM a JOIN nx USING (id, node)), g AS (SELECT f.*, o.first AS other FROM f JOIN a o ON o.id = f.id AND o.node = f.back), z AS (SELECT * FROM g WHERE first < other)
 SELECT id, first AS crack, CAST(pos AS BIGINT) AS "at", CAST(node//4%65536 AS INT) AS x, CAST(node//262144 AS INT) AS y, l AS "left", r AS "right", closed FROM z UNION ALL SELECT id, first, CAST(pos+1 AS BIGINT), CAST(back//4%65536 AS INT), CAST(back//262144 AS INT), l, r, closed FROM z QUALIFY row_number() OVER (PARTITION BY id, first ORDER BY pos DESC) = 1""",
    "ring_outlines": f"""WITH RECURSIVE {_POLY}, e AS (SELECT a.page, a.ring, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by" FROM v a JOIN v b ON b.ring = a.ring AND b.s = (a.s+1)%a.n), ar AS (SELECT page, ring, CAST(abs(sum(ax*"by"-bx*ay)) AS BIGINT) AS area2 FROM e GROUP BY ALL),
 pr AS (SELECT v.page, v.ring, x AS px, y AS py, area2 FROM v JOIN ar USING (ring) WHERE s = n//2), hit AS (SELECT pr.page, pr.ring, e.ring AS around, ar.area2 FROM pr JOIN ar ON ar.page = pr.page AND ar.area2 > pr.area2 JOIN e ON e.ring = ar.ring WHERE (ay > py) <> ("by" > py) AND px < ax + (bx-ax)*(py-ay)/CAST("by"-ay AS DOUBLE)),
 hd AS (SELECT page, ring, around, area2 FROM hit GROUP BY ALL HAVING count(*) % 2 = 1), pa AS (SELECT ring, arg_min(around, {{'a': area2, 'r': around}}) AS parent FROM hd GROUP BY ring), up(ring, top, depth) AS (SELECT ring, ring, 0 FROM ar UNION ALL SELECT up.ring, parent, depth+1 FROM up JOIN pa ON pa.ring = up.top)
 SELECT page, ring, coalesce(parent, -1) AS parent, max(depth) AS depth, any_value(area2) AS area2, max(depth)%2 = 0 AS outline FROM ar LEFT JOIN pa USING (ring) JOIN up USING (ring) GROUP BY page, ring, parent""",
}

"""Paths, edges and sewing lines."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stitchyard.operators.images import picture_pixels, pictures, pixels
from stitchyard.operators.raster import NINE, SHOT, beside
from stitchyard.operators.regions import components, reach_sql, row_runs
from stitchyard.operators.stitch import order, stream

#: Tenths of a sewing line between two samples, and their thousandths.
STEP = 25
#: Plotter units of an inch.
UNIT = 1016


def points(spark: SparkSession, d: str) -> DataFrame:
    return stream(spark, d).select("design", "seq", "x", "y")


def length(dx: Column, dy: Column) -> Column:
    """In thousandths, so that sums are exact in any order."""
    return F.floor(F.sqrt((dx * dx + dy * dy).cast("double")) * 1000).cast("long")


def smooth_polyline(spark: SparkSession, d: str) -> DataFrame:
    """Each inner point by a quarter, a half and a quarter, in quarters; ends stay."""
    out = [F.coalesce(F.lag(c).over(order()) + 2 * F.col(c) + F.lead(c).over(order()), 4 * F.col(c)).alias(f"{c}4") for c in "xy"]
    return points(spark, d).select("design", "seq", *out)


def chaikin(spark: SparkSession, d: str) -> DataFrame:
    """Two points on each segment, at a quarter and three quarters, in quarters."""
    p = points(spark, d).select("*", F.lead("x").over(order()).alias("nx"), F.lead("y").over(order()).alias("ny")).filter("nx is not null")
    return p.withColumn("k", F.explode(F.array(F.lit(1), F.lit(3)))).select("design", "seq", "k", *[((4 - F.col("k")) * F.col(c) + F.col("k") * F.col(f"n{c}")).alias(f"{c}4") for c in "xy"])


def resample_arc(spark: SparkSession, d: str) -> DataFrame:
    """A point at every ``STEP`` of the length along the line."""
    p = points(spark, d).select("*", F.lag("x").over(order()).alias("px"), F.lag("y").over(order()).alias("py")).filter("px is not null")
    p = p.withColumn("len", length(F.col("x") - F.col("px"), F.col("y") - F.col("py")))
    p = p.withColumn("cum", F.sum("len").over(order())).withColumn("start", F.col("cum") - F.col("len"))
    step = STEP * 1000
    p = p.withColumn("lo", F.expr(f"(start + {step - 1}) div {step}")).withColumn("hi", F.expr(f"(cum + {step - 1}) div {step} - 1")).filter("hi >= lo")
    at = lambda c: F.floor(F.col(f"p{c}") + (F.col(c) - F.col(f"p{c}")) * ((F.col("k") * step - F.col("start")) / F.col("len")) + 0.5).cast("long").alias(c)
    return p.withColumn("k", F.explode(F.sequence("lo", "hi"))).select("design", "k", at("x"), at("y"))


def polygon_measures(spark: SparkSession, d: str) -> DataFrame:
    """Bounding box, twice the area and the outline's thousandths of the closed polygon of each design."""
    last = order().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    p = points(spark, d).select("*", *[F.coalesce(F.lead(c).over(order()), F.first(c).over(last)).alias(f"n{c}") for c in "xy"])
    box = [f(c).alias(f"{n}_{c}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max"))]
    return p.groupBy("design").agg(*box, F.abs(F.sum(F.expr("x * ny - nx * y"))).alias("area2"), F.sum(length(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))).alias("outline"))


def path_text(spark: SparkSession, d: str) -> DataFrame:
    """(design, d): each design's line as the text of a path."""
    at = F.concat(F.when(F.col("seq") == 1, "M").otherwise("L"), F.col("x"), F.lit(","), F.col("y"))
    rows = points(spark, d).groupBy("design").agg(F.array_sort(F.collect_list(F.struct("seq", at.alias("t")))).alias("a"))
    return rows.select("design", F.concat_ws(" ", F.col("a.t")).alias("d"))


def path_bounds(spark: SparkSession, d: str) -> DataFrame:
    """C14: the numbers of a path's text, and the bounds of its points."""
    n = path_text(spark, d).select("design", F.expr(r"transform(regexp_extract_all(d, '-?[0-9]+[.]?[0-9]*', 0), t -> cast(t as long))").alias("n"))
    side = lambda f, odd, name: F.expr(f"array_{f}(filter(n, (t, i) -> i % 2 = {odd}))").alias(name)
    return n.select("design", F.size("n").cast("long").alias("numbers"), side("min", 0, "min_x"), side("max", 0, "max_x"), side("min", 1, "min_y"), side("max", 1, "max_y"))


def plotter_lines(spark: SparkSession, d: str) -> DataFrame:
    """The plotter's commands for each design in hundredths of an inch, 97 high, y upwards."""
    unit = lambda c: F.floor(c * UNIT / 100.0 + 0.5).cast("long")
    xy = F.concat(unit(F.col("x")), F.lit(","), unit(97 - F.col("y")), F.lit(";"))
    line = F.when(F.col("seq") == 1, F.concat(F.lit("PU"), xy)).when(F.col("seq") == 2, F.concat(F.lit("PD;\nPD"), xy)).otherwise(F.concat(F.lit("PD"), xy))
    rows = points(spark, d).groupBy("design").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("t")))).alias("a"))
    return rows.select("design", F.concat(F.lit("IN;\nSP1;\n"), F.concat_ws("\n", F.col("a.t")), F.lit("\nPU;\nSP0;\n")).alias("plt"))


def bezier_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Every four points from each third one on as a cubic, at eighths, in 512ths."""
    p = points(spark, d).select("design", "seq", *[(F.lead(c, i).over(order()) if i else F.col(c)).alias(f"{c}{i}") for c in "xy" for i in range(4)]).filter("seq % 3 = 1 and x3 is not null")
    k = p.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))))
    return k.select("design", "seq", "k", *[F.expr(f"(8-k)*(8-k)*(8-k)*{c}0 + 3*(8-k)*(8-k)*k*{c}1 + 3*(8-k)*k*k*{c}2 + k*k*k*{c}3").alias(c) for c in "xy"])


def affine_stack(spark: SparkSession, d: str) -> DataFrame:
    """A scale and a move composed with a quarter turn, and each point under both."""
    m = points(spark, d).withColumns({"a": F.lit(0), "b": 1 + F.col("seq") % 3, "c": -(1 + F.col("seq") % 3), "e": 5 * F.col("seq"), "f": -F.col("seq")})
    return m.select("design", "seq", F.expr("a * x + c * y + e").alias("x"), F.expr("b * x + a * y + f").alias("y"))


def bean_stitches(spark: SparkSession, d: str) -> DataFrame:
    """There, back and there again for each move."""
    p = points(spark, d).select("design", "seq", F.struct("x", "y").alias("here"), F.struct(*[F.lag(c).over(order()).alias(c) for c in "xy"]).alias("last"))
    three = F.when(F.col("seq") == 1, F.array("here")).otherwise(F.array("here", "last", "here"))
    return p.select("design", "seq", F.posexplode(three).alias("k", "p")).select("design", "seq", "k", "p.x", "p.y")


def _stripes(spark: SparkSession, d: str) -> DataFrame:
    """The runs of the bright part of every picture's mask."""
    return row_runs(pixels(pictures(spark, d), "r", "inside").filter("r >= 128 and inside = 1").withColumn("label", F.lit(0))).drop("label")


def mask_row_runs(spark: SparkSession, d: str) -> DataFrame:
    """W14 on the bright part of the masks."""
    return _stripes(spark, d)


def row_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a row that overlap runs of the next one."""
    runs = _stripes(spark, d)
    below = runs.select("id", (F.col("y") - 1).alias("y"), F.col("first").alias("first2"), F.col("last").alias("last2"))
    return runs.join(below, ["id", "y"]).filter("first <= last2 and first2 <= last")


def tatami_rows(spark: SparkSession, d: str) -> DataFrame:
    """Needle places of each run, in thousandths: its ends, and between them a lattice of 4 whose phase goes round in five rows; odd rows are sewn backwards."""
    r = _stripes(spark, d).select("id", "y", F.col("first").cast("double").alias("u0"), (F.col("last") + 1.0).alias("u1"), (F.col("y") * 2 % 5 / 5.0).alias("frac"))
    r = r.withColumns({"k0": F.ceil((F.col("u0") + 0.5) / 4 - F.col("frac")), "k1": F.floor((F.col("u1") - 0.5) / 4 - F.col("frac"))})
    mids = F.when(F.col("k1") >= F.col("k0"), F.expr("transform(sequence(k0, k1), k -> (k + frac) * 4)")).otherwise(F.expr("cast(array() as array<double>)"))
    line = F.concat(F.array("u0"), mids, F.array("u1"))
    sewn = r.select("id", "y", "u0", F.posexplode(F.when(F.col("y") % 2 == 0, line).otherwise(F.reverse(line))).alias("place", "u"))
    mill = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(c)
    return sewn.select("id", "y", mill("u0"), "place", mill("u"))


def exterior_paper(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of paper by whether their component reaches the border."""
    paper = picture_pixels(spark, d, "r", "g", "inside").filter("r < 96 or inside = 0 and g < 200").withColumn("label", F.lit(1))
    found = components(paper, "paper")
    rim = F.max(F.expr("x in (0, w - 1) or y in (0, h - 1)"))
    return found.join(found.groupBy("id", "comp").agg(rim.alias("outside")), ["id", "comp"]).select("id", "x", "y", "outside")


def sobel(spark: SparkSession, d: str) -> DataFrame:
    """The squared gradient of the red channel, away from the rim."""
    v = pixels(pictures(spark, d).withColumn("v", beside("r", NINE)), "v").filter("x between 1 and w - 2 and y between 1 and h - 2")
    total = lambda w: sum((F.col("v")[k] * w(*at) for k, at in enumerate(NINE) if w(*at)), F.lit(0))
    gx, gy = total(lambda i, j: i * (2 - abs(j))), total(lambda i, j: j * (2 - abs(i)))
    return v.select("id", "x", "y", gx.alias("gx"), gy.alias("gy")).select("id", "x", "y", (F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("long").alias("g2"))


_S = "s AS (SELECT user_id AS design, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, CAST(floor(coalesce(value, 0)) AS BIGINT) AS x, CAST(event_id % 97 AS BIGINT) AS y FROM events)"
_O = "OVER (PARTITION BY design ORDER BY seq)"
_PREV = f"p AS (SELECT *, lag(x) {_O} AS px, lag(y) {_O} AS py FROM s), q AS (SELECT *, CAST(floor(sqrt(CAST((x-px)*(x-px)+(y-py)*(y-py) AS DOUBLE))*1000) AS BIGINT) AS len FROM p WHERE px IS NOT NULL)"
_RUNS = f"{SHOT}, runs AS (SELECT id, y, min(x) AS first, max(x) AS last FROM (SELECT id, x, y, x - row_number() OVER (PARTITION BY id, y ORDER BY x) AS g FROM img WHERE r >= 128 AND a > 0) GROUP BY id, y, g)"
_CUBE = ", ".join(f"(8-k)*(8-k)*(8-k)*{c} + 3*(8-k)*(8-k)*k*{c}1 + 3*(8-k)*k*k*{c}2 + k*k*k*{c}3 AS {c}" for c in "xy")
QUERIES = [smooth_polyline, chaikin, resample_arc, polygon_measures, path_bounds, plotter_lines, bezier_flatten, affine_stack, bean_stitches, mask_row_runs, row_overlap, tatami_rows, exterior_paper, sobel]
SQL = {
    "smooth_polyline": f"WITH {_S} SELECT design, seq, coalesce(lag(x) {_O} + 2*x + lead(x) {_O}, 4*x) AS x4, coalesce(lag(y) {_O} + 2*y + lead(y) {_O}, 4*y) AS y4 FROM s",
    "chaikin": f"WITH {_S}, p AS (SELECT *, lead(x) {_O} AS nx, lead(y) {_O} AS ny FROM s) SELECT design, seq, k, (4-k)*x+k*nx AS x4, (4-k)*y+k*ny AS y4 FROM p, (VALUES (1),(3)) t(k) WHERE nx IS NOT NULL",
    "resample_arc": f"WITH {_S}, {_PREV}, c AS (SELECT *, CAST(sum(len) {_O} AS BIGINT) AS cum FROM q), e AS (SELECT *, cum-len AS start, unnest(range((cum-len+24999)//25000, (cum+24999)//25000)) AS k FROM c) SELECT design, k, CAST(floor(px+(x-px)*((k*25000-start)/len)+0.5e0) AS BIGINT) AS x, CAST(floor(py+(y-py)*((k*25000-start)/len)+0.5e0) AS BIGINT) AS y FROM e",
    "polygon_measures": f"WITH {_S}, p AS (SELECT *, coalesce(lead(x) {_O}, first(x) OVER (PARTITION BY design ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nx, coalesce(lead(y) {_O}, first(y) OVER (PARTITION BY design ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ny FROM s) SELECT design, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, CAST(abs(sum(x*ny-nx*y)) AS BIGINT) AS area2, CAST(sum(CAST(floor(sqrt(CAST((nx-x)*(nx-x)+(ny-y)*(ny-y) AS DOUBLE))*1000) AS BIGINT)) AS BIGINT) AS outline FROM p GROUP BY design",
    "path_bounds": f"WITH {_S} SELECT design, 2*count(*) AS numbers, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM s GROUP BY design",
    "plotter_lines": f"WITH {_S}, t AS (SELECT design, seq, CASE seq WHEN 1 THEN 'PU' WHEN 2 THEN 'PD;' || chr(10) || 'PD' ELSE 'PD' END || CAST(floor(x*1016/100.0e0+0.5e0) AS BIGINT) || ',' || CAST(floor((97-y)*1016/100.0e0+0.5e0) AS BIGINT) || ';' AS c FROM s) SELECT design, 'IN;' || chr(10) || 'SP1;' || chr(10) || string_agg(c, chr(10) ORDER BY seq) || chr(10) || 'PU;' || chr(10) || 'SP0;' || chr(10) AS plt FROM t GROUP BY design",
    "bezier_flatten": f"WITH {_S}, p AS (SELECT *, " + ", ".join(f"lead({c}, {i}) {_O} AS {c}{i}" for c in "xy" for i in (1, 2, 3)) + f" FROM s) SELECT design, seq, k, {_CUBE} FROM p, range(9) t(k) WHERE seq % 3 = 1 AND x3 IS NOT NULL",
    "affine_stack": f"WITH {_S} SELECT design, seq, 5*seq-(1+seq%3)*y AS x, (1+seq%3)*x-seq AS y FROM s",
    "bean_stitches": f"WITH {_S}, p AS (SELECT *, lag(x) {_O} AS px, lag(y) {_O} AS py FROM s) SELECT design, seq, CAST(k AS INT) AS k, CASE k WHEN 1 THEN px ELSE x END AS x, CASE k WHEN 1 THEN py ELSE y END AS y FROM p, range(3) t(k) WHERE k = 0 OR seq > 1",
    "mask_row_runs": f"WITH {_RUNS} SELECT id, y, first, last FROM runs",
    "row_overlap": f"WITH {_RUNS} SELECT a.id, a.y, a.first, a.last, b.first AS first2, b.last AS last2 FROM runs a JOIN runs b ON b.id = a.id AND b.y = a.y+1 AND a.first <= b.last AND b.first <= a.last",
    "tatami_rows": f"WITH {_RUNS}, r AS (SELECT id, y, first*1e0 AS u0, last+1e0 AS u1, (y*2%5)/5e0 AS frac FROM runs), u AS (SELECT id, y, u0, u0 AS u FROM r UNION ALL SELECT id, y, u0, u1 FROM r UNION ALL SELECT id, y, u0, (k+frac)*4 FROM (SELECT *, unnest(range(CAST(ceil((u0+0.5e0)/4-frac) AS BIGINT), CAST(floor((u1-0.5e0)/4-frac) AS BIGINT)+1)) AS k FROM r)) SELECT id, y, CAST(floor(u0*1000+0.5e0) AS BIGINT) AS u0, CAST(row_number() OVER (PARTITION BY id, y, u0 ORDER BY CASE WHEN y % 2 = 0 THEN u ELSE -u END) - 1 AS INT) AS place, CAST(floor(u*1000+0.5e0) AS BIGINT) AS u FROM u",
    "exterior_paper": f"WITH RECURSIVE {SHOT}, p AS MATERIALIZED (SELECT id, w, h, x, y, 1 AS label FROM img WHERE r < 96 OR a = 0 AND g < 200), {reach_sql('p')} SELECT id, x, y, bool_or(x IN (0, w-1) OR y IN (0, h-1)) OVER (PARTITION BY id, comp) AS outside FROM found",
    "sobel": f"WITH {SHOT}, o AS (SELECT i, j, i*(2-abs(j)) AS p, j*(2-abs(i)) AS q FROM (VALUES (-1),(0),(1)) a(i), (VALUES (-1),(0),(1)) b(j)), g AS (SELECT c.id, c.x, c.y, sum(n.r*p) AS gx, sum(n.r*q) AS gy FROM img c, o JOIN img n ON n.id = c.id AND n.x = c.x+i AND n.y = c.y+j WHERE c.x BETWEEN 1 AND c.w-2 AND c.y BETWEEN 1 AND c.h-2 GROUP BY ALL) SELECT id, x, y, CAST(gx*gx+gy*gy AS BIGINT) AS g2 FROM g",
}

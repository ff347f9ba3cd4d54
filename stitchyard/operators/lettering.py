"""Lettering: rows of letters and text lines, found by joins of boxes in cells and connected components."""

from collections.abc import Callable
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchyard.functions.steps import components, thousandths, written
from stitchyard.operators.folds import folded
from stitchyard.sources.tables import table

#: Which of a pair of boxes, ``a`` no lower than ``b``, are letters of one row: like heights and centres, or the lower in the taller's band.
ROW = "10 * greatest(a.x0 - b.x1, b.x0 - a.x1) <= 12 * a.h and ((10 * b.h >= 6 * a.h and 10 * abs(a.cy - b.cy) < 6 * a.h) or (10 * b.h < 6 * a.h and 100 * b.y0 >= 100 * a.y0 - 15 * a.h and 100 * b.y1 <= 100 * a.y1 + 15 * a.h))"
#: The same for glyphs of a text line, in the order of their left sides.
LINE = "100 * a.h < 135 * b.h and 10 * abs(a.y1 - b.y1) <= 2 * a.h and 100 * abs(a.y0 - b.y0) <= 25 * a.h and 100 * if(b.x0 >= a.x0, b.x0 - a.x1, a.x0 - b.x1) between -15 * a.h and 120 * a.h"


def letters(spark: SparkSession, d: str) -> DataFrame:
    """(page, color, id, x0, y0, x1, y1) in tenths of a millimetre: boxes of parts, 40 a page. Joins of their cells are never broadcasts."""
    k = table(spark, d, "part").select(F.expr("p_partkey div 40").alias("page"), F.expr("cast(p_partkey % 2 as int)").alias("color"), F.col("p_partkey").alias("id"))
    k = k.withColumns({"h": F.expr("if(id % 9 = 4, 12, 40 + id * 7 % 13 + if(id % 11 = 0, 60, 0))"), "base": F.expr("100 + (id * 3 % 4) * 90")})
    k = k.withColumns({"x0": F.expr("(id % 40 div 4) * 55 + id * 5 % 23"), "y1": F.expr("base - if(id % 9 = 4, id % 3 * 10, id % 3)")})
    return k.select("page", "color", "id", F.col("x0").cast("long"), F.expr("y1 - h").cast("long").alias("y0"), F.expr("x0 + 25 + id % 17").cast("long").alias("x1"), F.col("y1").cast("long")).hint("merge")


def letter_pairs(boxes: DataFrame, rule: str) -> DataFrame:
    """(page, color, a, b): boxes that ``rule`` pairs; it may allow a gap of 1.2 and a shift of 0.3 of the taller height.

    Heights fall into powers of two. At each power that is some box's own, taller boxes cover the cells of that size
    where partners can be, and all boxes no taller stand in the cells they cover; boxes meet in cells, not by page.
    """
    box = boxes.withColumn("h", F.col("y1") - F.col("y0")).filter("h > 0")
    box = box.withColumn("level", F.expr("cast(ceil(log2(h)) as int)")).withColumn("cy", F.expr("y0 + y1"))
    levels = box.select("page", "color", F.col("level").alias("at")).distinct()
    cell = lambda lo, hi: F.explode(F.expr(f"sequence(cast(floor({lo}) as bigint), cast(floor({hi}) as bigint))"))
    tall = box.withColumn("at", F.col("level")).withColumn("s", F.expr("pow(2D, at)")).withColumn("lo", F.expr("cast(floor((x0 - 1.2D * h) / s) as bigint)"))
    tall = tall.withColumn("gx", cell("(x0 - 1.2D * h) / s", "(x1 + 1.2D * h) / s")).withColumn("gy", cell("(y0 - 0.3D * h) / s", "(y1 + 0.3D * h) / s"))
    small = box.join(levels, ["page", "color"]).filter("at >= level").withColumn("s", F.expr("pow(2D, at)")).withColumn("lo", F.expr("cast(floor(x0 / s) as bigint)"))
    small = small.withColumn("gx", cell("x0 / s", "x1 / s")).withColumn("gy", F.expr("cast(floor(cy / 2D / s) as bigint)"))
    met = tall.alias("a").join(small.alias("b"), F.expr(" and ".join(f"a.{c} = b.{c}" for c in ("page", "color", "at", "gx", "gy"))))
    once = "a.gx = greatest(a.lo, b.lo) and (b.h < a.h or b.h = a.h and b.id > a.id)"
    return met.filter(f"{once} and {rule}").select("a.page", "a.color", F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def rows_of_letters(boxes: DataFrame) -> DataFrame:
    """(page, color, line, place, id): rows of three letters or more, two of them over 0.6 of the tallest, from left to right; ``line`` is the smallest id."""
    pairs = letter_pairs(boxes, ROW).select(F.struct("page", "color").alias("key"), "a", "b")
    found = components(pairs, "key", "letters").select("key.*", F.col("node").alias("id"), F.col("comp").alias("line"))
    own = boxes.join(found, ["page", "color", "id"]).withColumn("h", F.col("y1") - F.col("y0"))
    tops = own.groupBy("page", "color", "line").agg(F.max("h").alias("top"))
    good = own.join(tops, ["page", "color", "line"]).groupBy("page", "color", "line").agg(F.count("*").alias("n"), F.count_if(F.expr("10 * h > 6 * top")).alias("high"), F.sort_array(F.collect_list(F.struct("x0", "id"))).alias("row")).filter("n >= 3 and high >= 2")
    return good.select("page", "color", "line", F.posexplode("row").alias("place", "q")).select("page", "color", "line", "place", "q.id")


def letter_rows(spark: SparkSession, d: str) -> DataFrame:
    """J26 of every page."""
    return rows_of_letters(letters(spark, d))


#: Pixels a millimetre, inches of the design, and the least height and stroke in millimetres that sew legibly.
PPM, WIDTH, HEIGHT, STROKE = 10, 4.0, 5.0, 1.2


def glyphs(spark: SparkSession, d: str) -> DataFrame:
    """The boxes of letters with the area and the stroke of each, in pixels; strokes as a skeleton would give them."""
    k = letters(spark, d).filter("id % 9 <> 4")
    return k.withColumns({"h": F.expr("y1 - y0"), "area": F.expr("(x1 - x0) * (y1 - y0) div 2"), "stroke": F.expr("cast(if(id % 13 = 5, 2, 8 + id * 11 % 9 + if(id % 17 = 3, 30, 0)) as bigint)")})


def merger() -> Callable[[dict], tuple]:
    """Goes over a layer's lines by their left ends: a line on the last one's baseline within 2.5 heights goes on with it."""
    heights, bases, right, number = [], [], 0, -1

    def step(r: dict) -> tuple:
        nonlocal heights, bases, right, number
        if heights:
            hp, hg = median(heights), median(r["hs"])
            gap = r["x0"] - right
            if max(hp, hg) / max(1.0, min(hp, hg)) < 1.35 and abs(median(bases) - median(r["ys"])) < 0.2 * max(hp, hg) and -0.15 * hp <= gap <= 2.5 * max(hp, hg):
                heights, bases, right = heights + r["hs"], bases + r["ys"], max(right, r["x1"])
                return r["page"], r["color"], r["line"], number
        heights, bases, right, number = list(r["hs"]), list(r["ys"]), r["x1"], number + 1
        return r["page"], r["color"], r["line"], number

    return step


def lines_of_text(marks: DataFrame) -> DataFrame:
    """Text lines of three glyphs or more with steady strokes, merged across small marks; sizes in thousandths, ``width`` in quarter inches.

    Glyphs are 0.8 to 30 mm high; strokes are at least 7 % of the height and 0.25 mm, and within half and twice
    their line's median. ``small`` and ``thin`` say what would not sew legibly, ``width`` from which width it would.
    """
    fit = marks.filter(f"h between {0.8 * PPM}D and {30 * PPM} and x1 - x0 between {0.25 * PPM}D and {30 * PPM} and area >= {0.25 * PPM * PPM}D and 100 * h between 35 * (x1 - x0) and 900 * (x1 - x0)")
    fit = written(fit, "glyphs")
    found = components(letter_pairs(fit, LINE).select(F.struct("page", "color").alias("key"), "a", "b"), "key", "text")
    own = fit.join(found.select("key.*", F.col("node").alias("id"), F.col("comp").alias("line")), ["page", "color", "id"])
    steady = own.filter(f"100 * stroke >= 7 * h and stroke >= {0.25 * PPM}D").join(own.groupBy("page", "color", "line").count().filter("count >= 3").drop("count"), ["page", "color", "line"])
    typical = steady.groupBy("page", "color", "line").agg(F.expr("percentile(stroke, 0.5D)").alias("ms"), F.count("*").alias("n")).filter("n >= 3").drop("n")
    kept = written(steady.join(typical, ["page", "color", "line"]).filter("stroke between 0.5D * ms and 2 * ms").drop("ms"), "steady")
    lines = kept.groupBy("page", "color", "line").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.collect_list("h").alias("hs"), F.collect_list("y1").alias("ys")).filter("size(hs) >= 3")
    layer = lines.withColumn("layer", F.concat_ws(" ", "page", "color"))
    joined = folded(layer, "layer", ["x0", "line"], "page long, color int, line long, number long", merger)
    g = kept.join(joined, ["page", "color", "line"]).groupBy("page", "color", "number")
    mid = lambda c: F.expr(f"percentile({c}, 0.5D)") / PPM
    inch = lambda c: thousandths(c / PPM / 25.4)
    out = g.agg(F.count("*").alias("glyphs"), mid("h").alias("tall"), mid("stroke").alias("wide"), *[inch(f(c)).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    grow = F.greatest(HEIGHT / F.greatest("tall", F.lit(1e-6)), STROKE / F.greatest("wide", F.lit(1e-6)))
    return out.select("page", "color", "number", "glyphs", "x0", "y0", "x1", "y1", thousandths(F.col("tall")).alias("height"), thousandths(F.col("wide")).alias("stroke"), (F.col("tall") < HEIGHT).alias("small"), (F.col("wide") < STROKE).alias("thin"), F.ceil(WIDTH * grow / 0.25 - 1e-9).cast("long").alias("width"))


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """L32 of every page and layer."""
    return lines_of_text(glyphs(spark, d))


_BOX = "bx AS (SELECT p_partkey//40 AS page, CAST(p_partkey%2 AS INT) AS color, p_partkey AS id, CAST(CASE WHEN p_partkey%9 = 4 THEN 12 ELSE 40+p_partkey*7%13+CASE WHEN p_partkey%11 = 0 THEN 60 ELSE 0 END END AS BIGINT) AS h, (p_partkey%40//4)*55+p_partkey*5%23 AS x0, 100+(p_partkey*3%4)*90 - CASE WHEN p_partkey%9 = 4 THEN p_partkey%3*10 ELSE p_partkey%3 END AS y1 FROM part), b AS (SELECT page, color, id, h, x0, y1-h AS y0, x0+25+id%17 AS x1, y1 FROM bx)"
QUERIES = [letter_rows, text_lines]
SQL = {
    "letter_rows": f"""WITH RECURSIVE {_BOX}, p AS (SELECT a.page, a.color, a.id AS a, c.id AS b FROM b a JOIN b c ON a.page = c.page AND a.color = c.color AND (c.h < a.h OR c.h = a.h AND c.id > a.id) WHERE 10*greatest(a.x0-c.x1, c.x0-a.x1) <= 12*a.h AND ((10*c.h >= 6*a.h AND 10*abs(a.y0+a.y1-c.y0-c.y1) < 6*a.h) OR (10*c.h < 6*a.h AND 100*c.y0 >= 100*a.y0-15*a.h AND 100*c.y1 <= 100*a.y1+15*a.h))),
 e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(o, n) AS (SELECT a, a FROM e UNION SELECT o, b FROM r JOIN e ON e.a = r.n), c AS (SELECT n AS id, min(o) AS line FROM r GROUP BY n), g AS (SELECT b.*, line, max(h) OVER (PARTITION BY line) AS top, count(*) OVER (PARTITION BY line) AS n FROM b JOIN c USING (id)), w AS (SELECT *, count(*) FILTER (10*h > 6*top) OVER (PARTITION BY line) AS high FROM g)
 SELECT page, color, line, CAST(row_number() OVER (PARTITION BY line ORDER BY x0, id) - 1 AS INT) AS place, id FROM w WHERE n >= 3 AND high >= 2""",
    "text_lines": f"""WITH RECURSIVE {_BOX}, m AS MATERIALIZED (SELECT *, (x1-x0)*(y1-y0)//2 AS area, CASE WHEN id%13 = 5 THEN 2 ELSE 8+id*11%9+CASE WHEN id%17 = 3 THEN 30 ELSE 0 END END AS stroke FROM b WHERE id%9 <> 4), f AS MATERIALIZED (SELECT * FROM m WHERE h BETWEEN 8 AND 300 AND x1-x0 BETWEEN 2.5 AND 300 AND area >= 25 AND h*1e0/(x1-x0) BETWEEN 0.35e0 AND 9),
 p AS (SELECT a.id AS a, c.id AS b FROM f a JOIN f c ON a.page = c.page AND a.color = c.color AND (a.x0 < c.x0 OR a.x0 = c.x0 AND a.id < c.id) AND 100*greatest(a.h, c.h) < 135*least(a.h, c.h) AND 10*abs(a.y1-c.y1) <= 2*greatest(a.h, c.h) AND 100*abs(a.y0-c.y0) <= 25*greatest(a.h, c.h) AND 100*(c.x0-a.x1) BETWEEN -15*greatest(a.h, c.h) AND 120*greatest(a.h, c.h)),
 e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(o, n) AS (SELECT a, a FROM e UNION SELECT o, b FROM r JOIN e ON e.a = r.n), c AS (SELECT n AS id, min(o) AS line FROM r GROUP BY n), g AS (SELECT f.*, line, count(*) OVER (PARTITION BY line) AS n FROM f JOIN c USING (id)),
 s AS (SELECT *, count(*) OVER (PARTITION BY line) AS n2, median(stroke) OVER (PARTITION BY line) AS ms FROM g WHERE n >= 3 AND 100*stroke >= 7*h AND stroke >= 2.5), t AS MATERIALIZED (SELECT * FROM s WHERE n2 >= 3 AND stroke BETWEEN 0.5e0*ms AND 2*ms QUALIFY count(*) OVER (PARTITION BY line) >= 3),
 l AS MATERIALIZED (SELECT page, color, line, min(x0) AS x0, max(x1) AS x1, list(h) AS hs, list(y1) AS ys, row_number() OVER (PARTITION BY page, color ORDER BY min(x0), line) AS k FROM t GROUP BY page, color, line),
 w(page, color, line, k, hs, ys, x1, number) AS (SELECT page, color, line, k, hs, ys, x1, CAST(0 AS BIGINT) FROM l WHERE k = 1 UNION ALL SELECT page, color, line, k, CASE WHEN j THEN list_concat(ph, hs) ELSE hs END, CASE WHEN j THEN list_concat(py, ys) ELSE ys END, CASE WHEN j THEN greatest(px, x1) ELSE x1 END, CASE WHEN j THEN pn ELSE pn+1 END FROM (SELECT l.*, w.hs AS ph, w.ys AS py, w.x1 AS px, w.number AS pn, greatest(list_median(w.hs), list_median(l.hs))/greatest(1, least(list_median(w.hs), list_median(l.hs))) < 1.35e0 AND abs(list_median(w.ys)-list_median(l.ys)) < 0.2e0*greatest(list_median(w.hs), list_median(l.hs)) AND l.x0-w.x1 BETWEEN -0.15e0*list_median(w.hs) AND 2.5e0*greatest(list_median(w.hs), list_median(l.hs)) AS j FROM w JOIN l ON l.page = w.page AND l.color = w.color AND l.k = w.k+1)),
 o AS (SELECT t.page, t.color, number, count(*) AS glyphs, median(h)/10e0 AS tall, median(stroke)/10e0 AS wide, min(x0) AS x0, min(y0) AS y0, max(t.x1) AS x1, max(y1) AS y1 FROM t JOIN w USING (line) GROUP BY ALL)
 SELECT page, color, number, glyphs, {", ".join(f"CAST(floor({c}/10e0/25.4e0*1000+0.5e0) AS BIGINT) AS {c}" for c in ("x0", "y0", "x1", "y1"))}, CAST(floor(tall*1000+0.5e0) AS BIGINT) AS height, CAST(floor(wide*1000+0.5e0) AS BIGINT) AS stroke, tall < 5 AS small, wide < 1.2e0 AS thin, CAST(ceil(4*greatest(5/tall, 1.2e0/wide)/0.25e0-1e-9) AS BIGINT) AS width FROM o""",
}

"""Art operations, neighbourhoods and grids of keyed images.

Neighbours are taken inside an image's row, so that pixels meet in no join; sums by image are combined in the task
that holds its row.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchyard.functions import color
from stitchyard.functions.steps import thousandths
from stitchyard.operators.images import _IMG, clamped, pictures, pixels, square

NINE = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def shots(spark: SparkSession, d: str) -> DataFrame:
    """Pictures with alpha as ``a``: 255 in the mask, else 0."""
    return pictures(spark, d).withColumn("a", F.transform("inside", lambda v: v * 255))


def beside(name: str, places: list[tuple[int, int]], outside: str = "null") -> Column:
    """For each pixel the values at places (dx, dy) around it; beyond an edge ``outside``."""
    at = lambda dx, dy: f"if(i % w + {dx} between 0 and w - 1 and i div w + {dy} between 0 and h - 1, {name}[cast(i + {dx} + {dy} * w as int)], {outside})"
    return F.expr(f"transform(sequence(0, w * h - 1), i -> array({', '.join(at(*p) for p in places)}))")


def votes(v: Column, value: int, n: int = 9) -> Column:
    return sum((F.coalesce((v[k] == value).cast("int"), F.lit(0)) for k in range(1, n)), F.coalesce((v[0] == value).cast("int"), F.lit(0)))


def box_downsample(spark: SparkSession, d: str) -> DataFrame:
    """Means of 4 x 4 boxes."""
    img = pixels(pictures(spark, d), "r", "g", "b")
    return img.groupBy("id", F.expr("cast(x div 4 as int)").alias("bx"), F.expr("cast(y div 4 as int)").alias("by")).agg(*[F.floor(F.avg(c) + 0.5).cast("long").alias(c) for c in "rgb"])


def majority_3x3(spark: SparkSession, d: str) -> DataFrame:
    """The commonest of the labels around a pixel if it has five votes, the lowest on ties."""
    p = pictures(spark, d).withColumn("tone", F.transform("r", lambda v: F.floor(v / 64).cast("int")))
    v = pixels(p.withColumn("v", beside("tone", NINE)), "tone", "v")
    best = F.greatest(*[F.struct(votes(F.col("v"), k).alias("n"), F.lit(-k).alias("l")) for k in range(4)])
    return v.withColumn("m", best).select("id", "x", "y", F.when(F.col("m.n") >= 5, -F.col("m.l")).otherwise(F.col("tone")).alias("label"))


def local_range_3x3(spark: SparkSession, d: str) -> DataFrame:
    """The widest channel range around a pixel."""
    p = clamped(pictures(spark, d).select("id", "w", "h", "r", "g", "b"), 1)  # an edge's pixel beyond it widens no range
    span = lambda c: f"greatest({', '.join(square(c, 1))}) - least({', '.join(square(c, 1))})"
    return p.select("id", "x", "y", *[F.expr(span(c)).alias(f"s{c}") for c in "rgb"]).select("id", "x", "y", F.greatest("sr", "sg", "sb").alias("span"))


def erode_dilate(spark: SparkSession, d: str) -> DataFrame:
    """The mask's pixels after a 3 x 3 erosion and dilation, by image."""
    v = pixels(pictures(spark, d).withColumn("v", beside("inside", NINE, "0")), "v")
    return v.groupBy("id").agg(F.count_if(F.array_min("v") > 0).alias("eroded"), F.count_if(F.array_max("v") > 0).alias("dilated"))


def moments(spark: SparkSession, d: str) -> DataFrame:
    """Area, centroid and axis of each mask, in thousandths."""
    m = pixels(pictures(spark, d), "inside").filter("inside = 1").groupBy("id").agg(F.count("*").alias("n"), *[F.sum(F.col(p) * F.col(q)).alias(f"s{p}{q}") for p, q in ("xx", "xy", "yy")], F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    cov = lambda p, q: F.col(f"s{p}{q}") / F.col("n") - F.col(f"s{p}") * F.col(f"s{q}") / (F.col("n") * F.col("n"))
    return m.select("id", F.col("n").alias("area"), thousandths(F.col("sx") / F.col("n")).alias("cx"), thousandths(F.col("sy") / F.col("n")).alias("cy"), thousandths(0.5 * F.atan2(2 * cov("x", "y"), cov("x", "x") - cov("y", "y") + 1e-6)).alias("axis"))


def border_mode_color(spark: SparkSession, d: str) -> DataFrame:
    """Each border's commonest 16-level bin, the lowest on ties, with its mean colour."""
    edge = pixels(pictures(spark, d), "r", "g", "b").filter("x in (0, w - 1) or y in (0, h - 1)")
    bins = edge.groupBy("id", F.expr("cast((r div 16) * 256 + (g div 16) * 16 + b div 16 as int)").alias("bin")).agg(F.count("*").alias("n"), *[F.floor(F.avg(c) + 0.5).cast("long").alias(c) for c in "rgb"])
    best = bins.groupBy("id").agg(F.max(F.struct("n", (-F.col("bin")).alias("o"), "r", "g", "b")).alias("m"))
    return best.select("id", (-F.col("m.o")).alias("bin"), "m.n", "m.r", "m.g", "m.b")


def iou_mae(spark: SparkSession, d: str) -> DataFrame:
    """Overlap and mean error of each image against itself moved by two pixels, in thousandths."""
    p = shots(spark, d).withColumns({f"{c}2": beside(c, [(-2, 0)]) for c in "rgba"})
    j = pixels(p, *"rgba", *[f"{c}2" for c in "rgba"]).filter("x >= 2")
    mae = sum((F.abs(F.col(c) - F.col(f"{c}2")[0]) for c in "gb"), F.abs(F.col("r") - F.col("r2")[0]))
    both, either = F.count_if((F.col("a") > 0) & (F.col("a2")[0] > 0)), F.count_if((F.col("a") > 0) | (F.col("a2")[0] > 0))
    return j.groupBy("id").agg(F.floor(both * 1000 / either).cast("long").alias("iou"), F.floor(F.sum(mae) * 1000 / (3 * F.count("*"))).cast("long").alias("mae"))


def knockout_swap(spark: SparkSession, d: str) -> DataFrame:
    """Pixels near one colour lose their opacity, those near another are recoloured."""
    img = pixels(shots(spark, d), *"rgba")
    near = lambda r, g, b, t: (F.abs(F.col("r") - r) <= t) & (F.abs(F.col("g") - g) <= t) & (F.abs(F.col("b") - b) <= t)
    swap = near(200, 60, 60, 60)
    return img.select("id", "x", "y", *[F.when(swap, v).otherwise(F.col(c)).cast("int").alias(c) for c, v in (("r", 10), ("g", 20), ("b", 30))], F.when(near(60, 60, 60, 50), 0).otherwise(F.col("a")).cast("int").alias("a"))


def invert(spark: SparkSession, d: str) -> DataFrame:
    """Channels from 255, alpha kept."""
    return pixels(shots(spark, d), *"rgba").select("id", "x", "y", *[(255 - F.col(c)).cast("int").alias(c) for c in "rgb"], "a")


def greyscale(spark: SparkSession, d: str) -> DataFrame:
    """Luma by .299/.587/.114, at twice the size by nearest pixels."""
    img = pixels(pictures(spark, d), "r", "g", "b").select("id", "x", "y", F.floor(color.luma(F.col("r"), F.col("g"), F.col("b")) + 0.5).cast("int").alias("v"))
    four = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    return img.withColumn("s", four).select("id", (F.col("x") * 2 + F.col("s.i")).alias("x"), (F.col("y") * 2 + F.col("s.j")).alias("y"), "v")


def region_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of an image's labels that share an edge, with its length."""
    v = pixels(pictures(spark, d).withColumn("v", beside("label", [(1, 0), (0, 1)])), "label", "v")
    j = v.select("id", F.col("label").alias("p"), F.explode("v").alias("q")).filter("p <> q")
    return j.groupBy("id", F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).agg(F.count("*").alias("n"))


SHOT = f"{_IMG.replace('img AS (SELECT', 'im0 AS (SELECT')}, img AS (SELECT *, CASE WHEN inside THEN 255 ELSE 0 END AS a FROM im0)"
_NEAR = "o AS (SELECT i, j FROM (VALUES (-1),(0),(1)) a(i), (VALUES (-1),(0),(1)) b(j)), nb AS (SELECT c.id, c.x, c.y, n.r, n.g, n.b, n.a FROM img c, o JOIN img n ON n.id = c.id AND n.x = c.x + i AND n.y = c.y + j)"
_L = "(0.299e0*r+0.587e0*g+0.114e0*b)"
_W = f"WITH {SHOT}"
QUERIES = [box_downsample, majority_3x3, local_range_3x3, erode_dilate, moments, border_mode_color, iou_mae, knockout_swap, invert, greyscale, region_adjacency]
_AVG = ", ".join(f"CAST(floor(avg({c})+0.5) AS BIGINT) AS {c}" for c in "rgb")
SQL = {
    "box_downsample": f"{_W} SELECT id, CAST(x//4 AS INT) AS bx, CAST(y//4 AS INT) AS \"by\", {_AVG} FROM img GROUP BY 1, 2, 3",
    "majority_3x3": f"{_W}, {_NEAR}, v AS (SELECT id, x, y, r//64 AS l, count(*) AS n FROM nb GROUP BY ALL), m AS (SELECT id, x, y, max(n) AS n, arg_max(l, n*10-l) AS l FROM v GROUP BY ALL) SELECT id, x, y, CAST(CASE WHEN n >= 5 THEN l ELSE r//64 END AS INT) AS label FROM img JOIN m USING (id, x, y)",
    "local_range_3x3": f"{_W}, {_NEAR} SELECT id, x, y, CAST(greatest(max(r)-min(r), max(g)-min(g), max(b)-min(b)) AS INT) AS span FROM nb GROUP BY ALL",
    "erode_dilate": f"{_W}, {_NEAR}, m AS (SELECT id, x, y, min(a) AS lo, max(a) AS hi, count(*) AS n FROM nb GROUP BY ALL) SELECT id, count(*) FILTER (lo > 0 AND n = 9) AS eroded, count(*) FILTER (hi > 0) AS dilated FROM m GROUP BY id",
    "moments": f"{_W}, m AS (SELECT id, count(*) AS n, sum(x*x)*1e0 AS xx, sum(x*y)*1e0 AS xy, sum(y*y)*1e0 AS yy, sum(x)*1e0 AS sx, sum(y)*1e0 AS sy FROM img WHERE a > 0 GROUP BY id) SELECT id, n AS area, CAST(floor(sx/n*1000+0.5) AS BIGINT) AS cx, CAST(floor(sy/n*1000+0.5) AS BIGINT) AS cy, CAST(floor(0.5e0*atan2(2*(xy/n-sx*sy/(n*n)), (xx/n-sx*sx/(n*n))-(yy/n-sy*sy/(n*n))+1e-6)*1000+0.5) AS BIGINT) AS axis FROM m",
    "border_mode_color": f"{_W} SELECT id, CAST((r//16)*256+(g//16)*16+b//16 AS INT) AS bin, count(*) AS n, {_AVG} FROM img WHERE x IN (0, w-1) OR y IN (0, h-1) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, bin) = 1",
    "iou_mae": f"{_W} SELECT p.id, CAST(floor(count(*) FILTER (p.a > 0 AND q.a > 0)*1000e0/count(*) FILTER (p.a > 0 OR q.a > 0)) AS BIGINT) AS iou, CAST(floor(sum(abs(p.r-q.r)+abs(p.g-q.g)+abs(p.b-q.b))*1000e0/(3*count(*))) AS BIGINT) AS mae FROM img p JOIN img q ON p.id = q.id AND p.x = q.x + 2 AND p.y = q.y GROUP BY p.id",
    "knockout_swap": f"{_W}, m AS (SELECT *, abs(r-200)<=60 AND abs(g-60)<=60 AND abs(b-60)<=60 AS s, abs(r-60)<=50 AND abs(g-60)<=50 AND abs(b-60)<=50 AS k FROM img) SELECT id, x, y, CAST(CASE WHEN s THEN 10 ELSE r END AS INT) AS r, CAST(CASE WHEN s THEN 20 ELSE g END AS INT) AS g, CAST(CASE WHEN s THEN 30 ELSE b END AS INT) AS b, CAST(CASE WHEN k THEN 0 ELSE a END AS INT) AS a FROM m",
    "invert": f"{_W} SELECT id, x, y, CAST(255-r AS INT) AS r, CAST(255-g AS INT) AS g, CAST(255-b AS INT) AS b, CAST(a AS INT) AS a FROM img",
    "greyscale": f"{_W} SELECT id, CAST(x*2+i AS INT) AS x, CAST(y*2+j AS INT) AS y, CAST(floor({_L}+0.5) AS INT) AS v FROM img, (VALUES (0),(1)) a(i), (VALUES (0),(1)) b(j)",
    "region_adjacency": f"{_W} SELECT s.id, least(s.label, t.label) AS u, greatest(s.label, t.label) AS v, count(*) AS n FROM img s JOIN img t ON s.id = t.id AND ((t.x = s.x+1 AND t.y = s.y) OR (t.x = s.x AND t.y = s.y+1)) AND s.label <> t.label GROUP BY 1, 2, 3",
}

"""Fits, runs and orders: quadratic backgrounds, coverage and joining of runs, sewing order, distance fields."""

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stitchyard.functions.steps import dropped, thousandths, written
from stitchyard.operators.folds import folded
from stitchyard.operators.images import _IMG, pictures, pixels
from stitchyard.operators.machine import _B, _boxes, visit_precedence
from stitchyard.sources.tables import table

#: Terms of the background: x2, y2, xy, x, y, 1.
TERMS = 6


def solved(rows: Column, n: int) -> Column:
    """The solution of n normal equations, each an array of n coefficients and the right side; a term without weight of its own is 0."""

    def pivot(m: Column, k: Column) -> Column:
        top = F.transform(m[k], lambda v: F.when(F.abs(m[k][k]) < 1e-9, F.lit(0.0)).otherwise(v / m[k][k]))
        return F.transform(F.array(top), lambda t: F.transform(m, lambda row, i: F.when(i == k, t).otherwise(F.zip_with(row, t, lambda v, p: v - row[k] * p))))[0]

    return F.transform(F.aggregate(F.array(*[F.lit(k) for k in range(n)]), rows, pivot), lambda row: row[n])


def _equations(use: Column) -> Column:
    total = lambda a, b: F.sum(F.when(use, a * b).otherwise(F.lit(0.0)))
    t = [F.col("t")[k] for k in range(TERMS)]
    return F.array(*[F.array(*[total(t[min(i, j)], t[max(i, j)]) for j in range(TERMS)], total(t[i], F.col("z"))) for i in range(TERMS)])


def background_fit(band: DataFrame) -> DataFrame:
    """(id, channel, kept, c): the quadratic of least squares over (id, channel, t, z), fitted again without far residues.

    Sums of products are the only thing that leaves a task; the six equations are solved in columns. A residue is far
    beyond 14 and beyond the median plus four scaled median deviations; the second fit needs over 30 of them near.
    """
    key, own = ["id", "channel"], Window.partitionBy("id", "channel")
    first = band.groupBy(*key).agg(_equations(F.lit(True)).alias("m")).select(*key, solved(F.col("m"), TERMS).alias("c"))
    rest = F.abs(F.aggregate(F.zip_with("t", "c", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) - F.col("z"))
    r = band.join(first, key).withColumn("rest", rest).withColumn("med", F.expr("percentile(rest, 0.5D)").over(own))
    r = r.withColumn("mad", F.expr("percentile(abs(rest - med), 0.5D)").over(own) + 1e-6)
    near = F.col("rest") < F.greatest(F.lit(14.0), F.col("med") + 4 * 1.4826 * F.col("mad"))
    r = r.withColumn("near", near).withColumns({"count": F.count_if("near").over(own), "n": F.count("*").over(own)})
    again = (F.col("count") > 30) & (F.col("count") < F.col("n"))
    g = r.groupBy(*key).agg(_equations(F.col("near") | ~again).alias("m"), F.count_if(F.col("near") | ~again).alias("kept"))
    return g.select(*key, "kept", solved(F.col("m"), TERMS).alias("c"))


def quadratic_background(spark: SparkSession, d: str) -> DataFrame:
    """A34 over the border band of every picture and channel, where alpha is 16 or more; under twelve pixels the median stands for all."""
    p = pictures(spark, d).withColumn("a", F.expr("transform(sequence(0, w * h - 1), i -> (i * 37 + id) % 256)"))
    x = pixels(p, "r", "g", "b", "a").withColumn("bw", F.expr("greatest(2, least(8, least(w, h) div 16))")).filter("a >= 16 and (x < bw or y < bw or x >= w - bw or y >= h - bw)")
    x = x.withColumns({"u": F.expr("x / cast(greatest(w - 1, 1) as double) * 2 - 1"), "v": F.expr("y / cast(greatest(h - 1, 1) as double) * 2 - 1")})
    terms = F.array(F.col("u") * F.col("u"), F.col("v") * F.col("v"), F.col("u") * F.col("v"), F.col("u"), F.col("v"), F.lit(1.0))
    band = x.select("id", terms.alias("t"), F.posexplode(F.array(*[F.col(c).cast("double") for c in "rgb"])).alias("channel", "z"))
    few = band.groupBy("id", "channel").agg(F.count("*").alias("n"), F.expr("percentile(z, 0.5D)").alias("mid"))
    fit = background_fit(band).join(few, ["id", "channel"])
    c = F.when(F.col("n") < 12, F.array(*[F.lit(0.0)] * (TERMS - 1), F.col("mid"))).otherwise(F.col("c"))
    return fit.select("id", "channel", "kept", *[thousandths(c[k]).alias(f"c{k}") for k in range(TERMS)])


#: Pixels a millimetre; samples of a quarter pixel; gaps under half a millimetre are bridged, pieces under 3 mm go.
PPM, STEP, GAP, PIECE = 4, 0.25, 8, 3.0


def uncovered(samples: DataFrame) -> DataFrame:
    """(id, run, k, covered, length) to the pieces (id, run, t0, t1) that later layers leave: islands by counting changes,
    short covered ones inside a line bridged, then islands again."""
    run = Window.partitionBy("id", "run").orderBy("k")

    def islands(df: DataFrame, on: str) -> DataFrame:
        turn = df.withColumn("turn", F.coalesce((F.col(on) != F.lag(on).over(run)).cast("int"), F.lit(0)))
        return turn.withColumn("island", F.sum("turn").over(run))

    island, line = Window.partitionBy("id", "run", "island"), Window.partitionBy("id", "run")
    first = islands(samples, "covered").withColumns({"size": F.count("*").over(island), "last": F.max("island").over(line)})
    bridged = first.withColumn("covered", F.col("covered") & ~((F.col("island") > 0) & (F.col("island") < F.col("last")) & (F.col("size") < GAP)))
    g = islands(bridged, "covered").filter("not covered").groupBy("id", "run", "island").agg(F.min("k").alias("a"), F.max("k").alias("z"), F.first("length").alias("length"))
    piece = g.select("id", "run", (F.col("a") * STEP).alias("t0"), F.least(F.col("z") * STEP, F.col("length")).alias("t1"))
    return piece.filter((F.col("t1") - F.col("t0")) / PPM >= PIECE)


def run_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Six straight runs over each picture; a sample is covered where the label under it belongs to a later layer."""
    p = pictures(spark, d).select("id", "w", "h", "label", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("run"))
    p = p.withColumns({"y0": F.expr("2 + 3 * run"), "y1": F.expr("2 + run * 7 % (h - 4)"), "dx": F.expr("w - 3")}).withColumn("length", F.expr("sqrt(cast(dx * dx + (y1 - y0) * (y1 - y0) as double))"))
    s = p.withColumn("k", F.explode(F.expr(f"sequence(0, cast(floor(length / {STEP}D) as int))"))).withColumn("t", F.expr(f"k * {STEP}D / length"))
    at = "label[cast(floor(y0 + (y1 - y0) * t + 0.5D) * w + floor(1 + dx * t + 0.5D) as int)]"
    out = uncovered(s.select("id", "run", "k", F.expr(f"{at} >= 1 + run % 4").alias("covered"), "length"))
    return out.select("id", "run", thousandths(F.col("t0")).alias("t0"), thousandths(F.col("t1")).alias("t1"))


#: The cosine of the sharpest turn at a joint.
TURN = math.cos(math.radians(45))


def joiner() -> Callable[[dict], tuple | None]:
    """Takes a page's possible joints from the best: both ends must be free, and of different lines. One page's ends are its state."""
    above: dict = {}
    used: set = set()

    def top(a: int) -> int:
        while above.get(a, a) != a:
            a = above[a]
        return a

    def step(r: dict) -> tuple | None:
        ends = (r["a"], r["ea"]), (r["b"], r["eb"])
        if used.intersection(ends) or top(r["a"]) == top(r["b"]):
            return None
        used.update(ends)
        above[top(r["a"])] = top(r["b"])
        return r["page"], r["a"], r["ea"], r["b"], r["eb"]

    return step


def joints(lines: DataFrame) -> DataFrame:
    """(page, a, ea, b, eb): joints of straight lines (page, line, x0, y0, x1, y1), the best first; ``ea`` and ``eb`` say that it is the start.

    Ends within a millimetre meet in cells; a joint turns by under 45 degrees, and so does the way over a gap of more
    than 0.3 mm. The score is the gap less twice the cosine of the turn. Lines are longer than the millimetre over
    which their directions are taken, so that a joint changes no other end's direction.
    """
    ends = lines.withColumn("e", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("n", F.expr("sqrt(cast((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) as double))"))
    ends = ends.select("page", "line", F.expr("e = 1").alias("start"), F.expr("if(e = 1, x0, x1)").alias("x"), F.expr("if(e = 1, y0, y1)").alias("y"), F.expr("if(e = 1, x0 - x1, x1 - x0) / n").alias("u"), F.expr("if(e = 1, y0 - y1, y1 - y0) / n").alias("v"))
    ends = ends.withColumns({"cx": F.expr(f"cast(floor(x / {PPM}D) as bigint)"), "cy": F.expr(f"cast(floor(y / {PPM}D) as bigint)")})
    near = ends.withColumn("cx", F.explode(F.expr("sequence(cx - 1, cx + 1)"))).withColumn("cy", F.explode(F.expr("sequence(cy - 1, cy + 1)")))
    met = near.alias("a").join(ends.alias("b"), F.expr("a.page = b.page and a.cx = b.cx and a.cy = b.cy and a.line <> b.line"))
    met = met.selectExpr("a.page", "a.line as a", "a.start as ea", "b.line as b", "b.start as eb", "sqrt(cast((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) as double)) as dist", "-(a.u * b.u + a.v * b.v) as along", "(b.x - a.x) * a.u + (b.y - a.y) * a.v as ahead")
    good = met.filter(f"dist <= {PPM} and along >= {TURN!r}D and (dist <= 0.3D * {PPM} or ahead / dist >= {TURN!r}D)").withColumns({"score": F.expr("dist - 2 * along"), "late": ~F.col("eb")})
    return folded(good.select("page", "score", "a", "ea", "b", "late", "eb"), "page", ["score", "a", "ea", "b", "late"], "page long, a long, ea boolean, b long, eb boolean", joiner)


def run_joins(spark: SparkSession, d: str) -> DataFrame:
    """J27 over the lines of parts, forty a page, in five rows."""
    k = table(spark, d, "part").select(F.expr("p_partkey div 40").alias("page"), F.col("p_partkey").alias("line"))
    k = k.withColumns({"x0": F.expr("(line % 40 div 5) * 40 + line * 7 % 5"), "y0": F.expr("(line % 5) * 60 + line * 11 % 5 - 2")})
    return joints(k.hint("merge").select("page", "line", "x0", "y0", F.expr("x0 + 36 + line % 3").alias("x1"), F.expr("y0 + line * 13 % 7 - 3").alias("y1")))


def sewing_order(visits: DataFrame, before: DataFrame) -> DataFrame:
    """(page, place, i, k): visits (page, i, k) so that those ``before`` (i, j) come first, staying on a colour while one of it is free, else the lowest key.

    Visits of one colour keep their order. A page's visits are one array; each turn takes the best of those whose predecessors are done.
    """
    chain = visits.select("page", "i", "k", F.lag("i").over(Window.partitionBy("page", "k").orderBy("i")).alias("own"))
    pred = before.groupBy(F.col("j").alias("i")).agg(F.collect_list("i").alias("pred"))
    all_ = chain.join(pred, "i", "left").select("page", "i", "k", F.expr("concat(coalesce(pred, cast(array() as array<bigint>)), if(own is null, cast(array() as array<bigint>), array(own)))").alias("pred"))
    page = all_.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("i", "k", "pred"))).alias("v"))
    free = "filter(transform(v, z -> if(not array_contains(s.out, z.i) and size(array_except(z.pred, s.out)) = 0, struct(z.k <> s.cur as other, z.i as i, z.k as k), null)), z -> z is not null)"
    step = f"transform(array(array_min({free})), b -> named_struct('cur', b.k, 'out', concat(s.out, array(b.i))))[0]"
    order = page.select("page", "v", F.expr(f"aggregate(v, named_struct('cur', cast(-1 as bigint), 'out', cast(array() as array<bigint>)), (s, q) -> {step}).out").alias("order"))
    return order.select("page", "v", F.posexplode("order").alias("place", "i")).select("page", "place", "i", F.expr("filter(v, z -> z.i = i)[0].k").alias("k"))


def visit_order(spark: SparkSession, d: str) -> DataFrame:
    """F15 over the boxes of parts: of two colours' visits that share a cell, the lower key comes first."""
    return sewing_order(_boxes(spark, d).select("page", "i", F.col("k").cast("long")), visit_precedence(spark, d).select("i", "j"))


def object_sequence(objects: DataFrame) -> DataFrame:
    """(page, place, i) of objects (page, i, fill, thread, layer, area, cx, cy): fills first, then the others, by thread.

    Threads come by their lowest layer, then by first object; of the others the thread of the last fill that both have
    comes first. Inside a thread the largest object begins, and the nearest unused one follows, the larger of equals.
    """
    thread = objects.groupBy("page", "fill", "thread").agg(F.min("layer").alias("low"), F.min("i").alias("first"), F.sort_array(F.collect_list(F.struct((-F.col("area")).alias("o"), "i", "cx", "cy"))).alias("g"))
    used = "not array_contains(s.out, z.i)"
    near = f"array_min(transform(filter(g, z -> {used}), z -> struct(if(s.cx is null, 0L, (z.cx - s.cx) * (z.cx - s.cx) + (z.cy - s.cy) * (z.cy - s.cy)) as d, z.o as o, z.i as i, z.cx as cx, z.cy as cy)))"
    chain = F.expr(f"aggregate(g, named_struct('cx', cast(null as bigint), 'cy', cast(null as bigint), 'out', cast(array() as array<bigint>)), (s, q) -> transform(array({near}), b -> named_struct('cx', b.cx, 'cy', b.cy, 'out', concat(s.out, array(b.i))))[0]).out")
    thread = thread.select("page", "fill", "thread", "low", "first", chain.alias("chain"))
    both = Window.partitionBy("page", "thread")
    thread = thread.withColumn("shared", F.count("*").over(both) == 2)
    fills = thread.filter("fill and shared").groupBy("page").agg(F.max_by("thread", F.struct("low", "first")).alias("prefer"))
    thread = thread.join(fills, "page", "left").withColumn("head", ~F.col("fill") & F.coalesce(F.col("thread") == F.col("prefer"), F.lit(False)))
    rank = F.struct((~F.col("fill")).alias("a"), (~F.col("head")).alias("b"), "low", "first")
    rows = thread.select("page", rank.alias("rank"), F.posexplode("chain").alias("k", "i"))
    return rows.select("page", (F.row_number().over(Window.partitionBy("page").orderBy("rank", "k")) - 1).alias("place"), "i")


def sequence_objects(spark: SparkSession, d: str) -> DataFrame:
    """T08 over the boxes of parts: large ones are fills."""
    b = _boxes(spark, d)
    o = b.select("page", "i", F.expr("w * h > 300").alias("fill"), F.col("k").alias("thread"), F.expr("i * 7 % 11").alias("layer"), F.expr("w * h").alias("area"), F.expr("2 * x + w").alias("cx"), F.expr("2 * y + h").alias("cy"))
    return object_sequence(o)


#: Rounds of a distance field in one job, and pixels of a cell.
AT_ONCE, COARSE = 5, 2


def distance_fields(cells: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, cx, cy, d) in thousandths: the ways from each start (id, cx, cy) over its mask's ``cells``, straight steps 1, slanting ones 1.414.

    All masks advance together, a round each from the cells that the last one brought nearer, until none does.
    """
    eight = [(dx, dy, 1414 if dx and dy else 1000) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(c).alias("c")) for x, y, c in eight]))
    all_ = cells.unionByName(starts).distinct()
    field = written(all_.join(starts.withColumn("d", F.lit(0).cast("long")), ["id", "cx", "cy"], "left").withColumn("fresh", F.col("d").isNotNull()), "field")
    while True:
        new = field
        for _ in range(AT_ONCE):
            ahead = new.filter("fresh").withColumn("s", step).groupBy("id", (F.col("cx") + F.col("s.x")).alias("cx"), (F.col("cy") + F.col("s.y")).alias("cy")).agg(F.min(F.col("d") + F.col("s.c")).alias("to"))
            new = new.join(ahead, ["id", "cx", "cy"], "left").select("id", "cx", "cy", F.least("d", "to").alias("d"), F.coalesce(F.col("to") < F.coalesce("d", F.lit(2**62)), F.lit(False)).alias("fresh"))
        new = written(new, "field")
        dropped(field)
        field = new
        if not field.filter("fresh").limit(1).count():
            return field.filter("d is not null").select("id", "cx", "cy", "d")


def mask_fields(spark: SparkSession, d: str) -> DataFrame:
    """F18 over cells of two pixels of every picture's mask, without its stripes, from its middle."""
    p = pictures(spark, d)
    cells = pixels(p, "inside", "label").filter("inside = 1 and label <> id % 5").select("id", F.expr(f"x div {COARSE}").alias("cx"), F.expr(f"y div {COARSE}").alias("cy")).distinct()
    starts = p.select("id", F.expr(f"(w div 2 + {COARSE // 2}) div {COARSE}").alias("cx"), F.expr(f"(h div 2 + {COARSE // 2}) div {COARSE}").alias("cy"))
    return distance_fields(cells, starts)


def _normal(t: str) -> str:
    """SQL: the normal equations over ``t`` as a list of lists."""
    e = [f"t{k}" for k in range(TERMS)]
    return "[" + ", ".join("[" + ", ".join([*[f"sum({e[min(i, j)]}*{e[max(i, j)]})" for j in range(TERMS)], f"sum({e[i]}*z)"]) + "]" for i in range(TERMS)) + f"] FROM {t}"


def _solve_sql(source: str, name: str) -> str:
    """SQL: Gauss-Jordan steps over the lists m of ``source``."""
    out, at = [], source
    for k in range(1, TERMS + 1):
        to = f"{name}{k}"
        out.append(f"{to} AS (SELECT * REPLACE (list_transform(m, lambda q, i: CASE WHEN i = {k} THEN list_transform(q, lambda v: v/m[{k}][{k}]) ELSE list_transform(q, lambda v, j: v - q[{k}]*m[{k}][j]/m[{k}][{k}]) END) AS m) FROM {at})")
        at = to
    return ", ".join(out)


_EST = "+".join(f"t{k}*s.m[{k + 1}][{TERMS + 1}]" for k in range(TERMS))
QUERIES = [quadratic_background, run_coverage, run_joins, visit_order, sequence_objects, mask_fields]
SQL = {
    "quadratic_background": f"""WITH {_IMG}, bd AS (SELECT id, r, g, b, x*1e0/greatest(w-1, 1)*2-1 AS u, y*1e0/greatest(h-1, 1)*2-1 AS v FROM (SELECT *, greatest(2, least(8, least(w, h)//16)) AS bw FROM img WHERE ((y*w+x)*37+id)%256 >= 16) WHERE x < bw OR y < bw OR x >= w-bw OR y >= h-bw), tz AS MATERIALIZED (SELECT id, c AS channel, CASE c WHEN 0 THEN r WHEN 1 THEN g ELSE b END*1e0 AS z, u*u AS t0, v*v AS t1, u*v AS t2, u AS t3, v AS t4, 1e0 AS t5 FROM bd, (VALUES (0),(1),(2)) q(c)),
 e0 AS (SELECT id, channel, m FROM (SELECT id, channel, {_normal('tz')} GROUP BY id, channel) q(id, channel, m)), {_solve_sql('e0', 'a')}, rs AS (SELECT tz.*, abs({_EST}-z) AS rest FROM tz JOIN a{TERMS} s USING (id, channel)), md AS (SELECT *, median(rest) OVER (PARTITION BY id, channel) AS med FROM rs), mm AS (SELECT *, median(abs(rest-med)) OVER (PARTITION BY id, channel)+1e-6 AS mad FROM md),
 nr AS (SELECT *, rest < greatest(14, med+4*1.4826e0*mad) AS near FROM mm), cn AS (SELECT *, count(*) FILTER (near) OVER (PARTITION BY id, channel) AS c, count(*) OVER (PARTITION BY id, channel) AS n FROM nr), us AS MATERIALIZED (SELECT * FROM cn WHERE near OR NOT (c > 30 AND c < n)), kp AS (SELECT id, channel, count(*) AS kept FROM us GROUP BY ALL),
 e1 AS (SELECT id, channel, m FROM (SELECT id, channel, {_normal('us')} GROUP BY id, channel) q(id, channel, m)), {_solve_sql('e1', 'z')} SELECT id, CAST(channel AS INT) AS channel, kept, {', '.join(f'CAST(floor(m[{k + 1}][{TERMS + 1}]*1000+0.5e0) AS BIGINT) AS c{k}' for k in range(TERMS))} FROM z{TERMS} JOIN kp USING (id, channel)""",
    "run_coverage": f"""WITH {_IMG}, rn AS (SELECT id, w, h, CAST(k AS INT) AS run, 2+3*k AS y0, 2+k*7%(h-4) AS y1, w-3 AS dx FROM im, range(6) t(k)), le AS (SELECT *, sqrt(CAST(dx*dx+(y1-y0)*(y1-y0) AS DOUBLE)) AS length FROM rn), sa AS (SELECT *, unnest(range(CAST(floor(length/{STEP}) AS BIGINT)+1)) AS k FROM le), sp AS (SELECT *, CAST(floor(1+dx*(k*{STEP}e0/length)+0.5e0) AS INT) AS px, CAST(floor(y0+(y1-y0)*(k*{STEP}e0/length)+0.5e0) AS INT) AS py FROM sa),
 cv AS (SELECT sp.id, run, k, length, label >= 1+run%4 AS covered FROM sp JOIN img ON img.id = sp.id AND img.x = px AND img.y = py), i1 AS (SELECT *, k - row_number() OVER (PARTITION BY id, run, covered ORDER BY k) AS g FROM cv), s1 AS (SELECT *, count(*) OVER (PARTITION BY id, run, covered, g) AS size, min(k) OVER (PARTITION BY id, run, covered, g) AS a, max(k) OVER (PARTITION BY id, run, covered, g) AS z, max(k) OVER (PARTITION BY id, run) AS last FROM i1),
 b1 AS (SELECT id, run, k, length, covered AND NOT (a > 0 AND z < last AND size < {GAP}) AS covered FROM s1), i2 AS (SELECT *, k - row_number() OVER (PARTITION BY id, run, covered ORDER BY k) AS g FROM b1), pc AS (SELECT id, run, min(k)*{STEP}e0 AS t0, least(max(k)*{STEP}e0, any_value(length)) AS t1 FROM i2 WHERE NOT covered GROUP BY id, run, g) SELECT id, run, CAST(floor(t0*1000+0.5e0) AS BIGINT) AS t0, CAST(floor(t1*1000+0.5e0) AS BIGINT) AS t1 FROM pc WHERE (t1-t0)/{PPM} >= {PIECE}""",
    "run_joins": f"""WITH RECURSIVE k AS (SELECT p_partkey//40 AS page, p_partkey AS line, (p_partkey%40//5)*40+p_partkey*7%5 AS x0, (p_partkey%5)*60+p_partkey*11%5-2 AS y0 FROM part), l AS (SELECT *, x0+36+line%3 AS x1, y0+line*13%7-3 AS y1 FROM k), e AS (SELECT page, line, s AS start, CASE WHEN s THEN x0 ELSE x1 END AS x, CASE WHEN s THEN y0 ELSE y1 END AS y, CASE WHEN s THEN x0-x1 ELSE x1-x0 END/sqrt(CAST((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0) AS DOUBLE)) AS u, CASE WHEN s THEN y0-y1 ELSE y1-y0 END/sqrt(CAST((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0) AS DOUBLE)) AS v FROM l, (VALUES (true),(false)) t(s)),
 m AS (SELECT a.page, a.line AS a, a.start AS ea, b.line AS b, b.start AS eb, sqrt(CAST((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y) AS DOUBLE)) AS dist, -(a.u*b.u+a.v*b.v) AS along, (b.x-a.x)*a.u+(b.y-a.y)*a.v AS ahead FROM e a JOIN e b ON a.page = b.page AND a.line <> b.line), g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page ORDER BY dist-2*along, a, ea, b, NOT eb) AS rk FROM m WHERE dist <= {PPM} AND along >= {TURN!r} AND (dist <= 0.3e0*{PPM} OR ahead/dist >= {TURN!r})),
 w(page, rk, a, ea, b, eb, ok, comp, used) AS (SELECT DISTINCT page, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, CAST(0 AS BIGINT), false, false, range(40), CAST([] AS BIGINT[]) FROM g UNION ALL SELECT page, rk, a, ea, b, eb, ok, CASE WHEN ok THEN list_transform(comp, lambda c: CASE WHEN c = ca THEN cb ELSE c END) ELSE comp END, CASE WHEN ok THEN list_concat(used, [a*2+CAST(ea AS INT), b*2+CAST(eb AS INT)]) ELSE used END FROM (SELECT g.*, comp, used, comp[g.a%40+1] AS ca, comp[g.b%40+1] AS cb, comp[g.a%40+1] <> comp[g.b%40+1] AND NOT list_contains(used, g.a*2+CAST(g.ea AS INT)) AND NOT list_contains(used, g.b*2+CAST(g.eb AS INT)) AS ok FROM w JOIN g ON g.page = w.page AND g.rk = w.rk+1)) SELECT page, a, ea, b, eb FROM w WHERE ok""",
    "visit_order": f"""WITH RECURSIVE {_B}, c AS (SELECT page, i, k, cx, cy FROM b, range(20) u(cx), range(20) v(cy) WHERE cx BETWEEN x//10 AND (x+w)//10 AND cy BETWEEN y//10 AND (y+h)//10), pr AS (SELECT DISTINCT p.i, q.i AS j FROM c p JOIN c q USING (page, cx, cy) WHERE p.i < q.i AND p.k <> q.k UNION SELECT p.i, q.i FROM b p JOIN b q ON p.page = q.page AND p.k = q.k AND p.i < q.i), vs AS MATERIALIZED (SELECT b.page, b.i, b.k, coalesce(list(pr.i) FILTER (pr.i IS NOT NULL), []) AS pred FROM b LEFT JOIN pr ON pr.j = b.i GROUP BY ALL),
 o(page, place, cur, done) AS (SELECT DISTINCT page, -1, CAST(-1 AS BIGINT), CAST([] AS BIGINT[]) FROM vs UNION ALL SELECT page, place, z.k, list_append(done, z.i) FROM (SELECT o.page, o.place+1 AS place, any_value(done) AS done, min({{'o': vs.k <> cur, 'i': vs.i, 'k': vs.k}}) AS z FROM o JOIN vs ON vs.page = o.page WHERE NOT list_contains(done, vs.i) AND list_has_all(done, pred) GROUP BY o.page, o.place)) SELECT page, place, done[-1] AS i, cur AS k FROM o WHERE place >= 0""",
    "sequence_objects": f"""WITH RECURSIVE {_B}, o AS MATERIALIZED (SELECT page, i, w*h > 300 AS fill, k AS thread, i*7%11 AS layer, w*h AS area, 2*x+w AS cx, 2*y+h AS cy FROM b), g AS MATERIALIZED (SELECT page, fill, thread, min(layer) AS low, min(i) AS first FROM o GROUP BY ALL), pf AS (SELECT f.page, arg_max(f.thread, {{'l': f.low, 'f': f.first}}) AS prefer FROM g f JOIN g r ON r.page = f.page AND r.thread = f.thread AND NOT r.fill WHERE f.fill GROUP BY f.page),
 c(page, fill, thread, n, done, cx, cy) AS (SELECT page, fill, thread, 0, CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM g UNION ALL SELECT page, fill, thread, n, list_append(done, z.i), z.cx, z.cy FROM (SELECT c.page, c.fill, c.thread, c.n+1 AS n, any_value(done) AS done, min({{'d': CASE WHEN c.cx IS NULL THEN 0 ELSE (o.cx-c.cx)*(o.cx-c.cx)+(o.cy-c.cy)*(o.cy-c.cy) END, 'a': -area, 'i': o.i, 'cx': o.cx, 'cy': o.cy}}) AS z FROM c JOIN o ON o.page = c.page AND o.fill = c.fill AND o.thread = c.thread WHERE NOT list_contains(done, o.i) GROUP BY c.page, c.fill, c.thread, c.n)),
 r AS (SELECT c.page, done[-1] AS i, row_number() OVER (PARTITION BY c.page ORDER BY CASE WHEN c.fill THEN 0 WHEN c.thread = prefer THEN 1 ELSE 2 END, low, first, n) - 1 AS place FROM c JOIN g ON g.page = c.page AND g.fill = c.fill AND g.thread = c.thread LEFT JOIN pf ON pf.page = c.page WHERE n > 0) SELECT page, CAST(place AS INT) AS place, i FROM r""",
    "mask_fields": f"""WITH RECURSIVE {_IMG}, st AS (SELECT id, CAST((w//2+1)//2 AS INT) AS cx, CAST((h//2+1)//2 AS INT) AS cy FROM im), ce AS MATERIALIZED (SELECT DISTINCT id, CAST(x//2 AS INT) AS cx, CAST(y//2 AS INT) AS cy FROM img WHERE inside AND label <> id%5 UNION SELECT * FROM st), f(id, cx, cy, d) AS (SELECT id, cx, cy, 0 FROM st UNION SELECT c.id, c.cx, c.cy, min(f.d + CASE WHEN c.cx <> f.cx AND c.cy <> f.cy THEN 1414 ELSE 1000 END) FROM f JOIN ce c ON c.id = f.id AND abs(c.cx-f.cx) <= 1 AND abs(c.cy-f.cy) <= 1 AND (c.cx <> f.cx OR c.cy <> f.cy) WHERE f.d < 40000 GROUP BY c.id, c.cx, c.cy) SELECT id, cx, cy, CAST(min(d) AS BIGINT) AS d FROM f GROUP BY ALL""",
}

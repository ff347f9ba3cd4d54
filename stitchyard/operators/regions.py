"""Regions of labelled images: components, despeckling, tiny colours, resampling and halftone lines.

Components are found inside bands of an image's rows, each a group of Spark's; what bands share is joined in rounds, so
that no task holds more than a band, and images of one band need no round.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stitchyard.functions import color, steps
from stitchyard.operators.folds import folded
from stitchyard.operators.images import picture_pixels, pictures, pixels
from stitchyard.operators.raster import NINE, SHOT, beside


def striped(spark: SparkSession, d: str) -> DataFrame:
    """Pictures in stripes and, over them, a sprinkle of single pixels, as ``stripe``."""
    return pictures(spark, d).withColumn("stripe", F.expr("transform(r, (v, i) -> if((i % w * 7 + i div w * 11) % 53 = 0, 9, v div 64))"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    """(id, w, h, x, y, label): the pixels of ``striped``."""
    return picture_pixels(spark, d, "r").select("id", "w", "h", "x", "y", F.expr("if((x * 7 + y * 11) % 53 = 0, 9, r div 64)").alias("label"))


def row_runs(px: DataFrame, *own: str) -> DataFrame:
    """(id, y, label, first, last): the runs of neighbouring pixels of one label in each row of (id, x, y, label); ``own``: an image's own columns."""
    run = F.col("x") - F.row_number().over(Window.partitionBy("id", "y", "label").orderBy("x"))
    return px.withColumn("g", run).groupBy("id", "y", "label", "g").agg(F.min("x").alias("first"), F.max("x").alias("last"), *[F.first(c).alias(c) for c in own]).drop("g")


#: Rows of an image that are one group.
BAND = 128


def band_labelled(corners: bool) -> Callable[[pa.Table], pa.Table]:
    """Adds ``comp``, the smallest y * w + x that a pixel of the band reaches inside it, to the pixels of one band."""

    def label(band: pa.Table) -> pa.Table:
        w, x, y, own = (band.column(c).to_numpy().astype(np.int64) for c in ("w", "x", "y", "label"))
        at, w = y * w + x, w[0]
        order = np.argsort(at)
        key, col, own = at[order], x[order], own[order]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step, ok in ((1, col + 1 < w), (w, True), *(((w + 1, col + 1 < w), (w - 1, col > 0)) if corners else ())):
            to = np.searchsorted(key, key + step)
            there = np.minimum(to, len(key) - 1)
            met = np.flatnonzero((key[there] == key + step) & (own[there] == own) & ok)
            a.append(met)
            b.append(to[met])
        comp = np.empty(len(key), np.int64)
        comp[order] = key[steps.least_reached(len(key), np.concatenate(a), np.concatenate(b))]
        return band.append_column("comp", pa.array(comp))

    return label


def components(px: DataFrame, tag: str, corners: bool = False) -> DataFrame:
    """(id, w, h, x, y, label) with ``comp``, the smallest y * w + x of the pixel's component of its label; with ``corners``, pixels meet across corners, too.

    Pixels are dealt by image and band. Where an image has several bands, components that touch across their border are
    joined by ``steps.components``. The result is written.
    """
    px = px.select("id", "w", "h", "x", "y", "label")
    schema = T.StructType([*px.schema.fields, T.StructField("comp", T.LongType())])
    found = steps.written(px.groupBy("id", F.expr(f"y div {BAND}")).applyInArrow(band_labelled(corners), schema), f"{tag}_found")
    if not found.filter(f"y >= {BAND}").limit(1).count():
        return found
    upper = found.filter(f"y % {BAND} = {BAND - 1}").select("id", "y", "label", "x", F.col("comp").alias("a"))
    near = F.explode(F.expr("sequence(x - 1, x + 1)" if corners else "array(x)"))
    lower = found.filter(f"y % {BAND} = 0 and y > 0").select("id", (F.col("y") - 1).alias("y"), "label", near.alias("x"), F.col("comp").alias("b"))
    edges = upper.join(lower, ["id", "y", "label", "x"]).select("id", "a", "b").distinct()
    joined = steps.components(edges, "id", tag).select("id", F.col("node").alias("comp"), F.col("comp").alias("top"))
    whole = found.join(joined, ["id", "comp"], "left").select("id", "w", "h", "x", "y", "label", F.coalesce("top", "comp").alias("comp"))
    return steps.written(whole, f"{tag}_found")


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Components with area, bounding box, centroid in thousandths and the number of pixels on the image's border."""
    edge = F.expr("cast(x in (0, w - 1) or y in (0, h - 1) as bigint)")
    box = [f(c).alias(f"{n}{c}") for c in "xy" for f, n in ((F.min, "min_"), (F.max, "max_"))]
    mid = [steps.thousandths(F.avg(c)).alias(f"mid_{c}") for c in "xy"]
    return components(labels(spark, d), "stripes").groupBy("id", "comp", "label").agg(F.count("*").alias("area"), *box, *mid, F.sum(edge).alias("border"))


def despeckle(spark: SparkSession, d: str) -> DataFrame:
    """Components under four pixels take the label most of their neighbours have, the lowest on ties."""
    found = components(labels(spark, d), "specks")
    small = found.groupBy("id", "comp").agg(F.count("*").alias("n")).filter("n < 4").select("id", "comp")
    four = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    near = found.withColumn("s", four).select("id", (F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"), F.col("label").alias("other"), F.col("comp").alias("oc"))
    votes = found.join(small, ["id", "comp"]).join(near, ["id", "x", "y"]).filter("oc <> comp").groupBy("id", "comp", "other").agg(F.count("*").alias("n"))
    best = votes.groupBy("id", "comp").agg(F.max(F.struct("n", (-F.col("other")).alias("l"))).alias("m"))
    return found.join(best, ["id", "comp"], "left").select("id", "x", "y", F.coalesce(-F.col("m.l"), F.col("label")).cast("int").alias("label"))


def merger() -> Callable[[dict], tuple | None]:
    """Goes over an image's small regions, the smallest first; its state is the labels that regions have taken so far.

    A region takes the label with the longest contact at its turn. One that another has just joined has grown, and waits.
    """
    now: dict[int, int] = {}
    grown: set[int] = set()

    def step(r: dict) -> tuple | None:
        if r["comp"] in grown:
            return None
        length: dict[int, int] = {}
        for z in r["near"]:
            label = now.get(z["comp"], z["label"])
            if label != r["label"]:
                length[label] = length.get(label, 0) + z["n"]
        if not length:
            return None
        to = min(length, key=lambda v: (-length[v], v))
        now[r["comp"]] = to
        grown.update(z["comp"] for z in r["near"] if now.get(z["comp"], z["label"]) == to)
        return r["id"], r["comp"], to

    return step


def small_merged(px: DataFrame, least: int, passes: int = 8) -> DataFrame:
    """(id, w, h, x, y, label) with each region under ``least`` pixels given to the neighbour with the longest contact, in passes
    over the regions as they are then, until none is merged; paper (label 0) at the border stays.

    Regions meet across corners. Contacts are counted once a pass as pixels of the ring around a region; they add
    up when regions join, so that a pass needs no pixels, only an image's small regions in order.
    """
    eight = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in NINE if (i, j) != (0, 0)]))
    for _ in range(passes):
        found = components(px, "small", corners=True)
        size = found.groupBy("id", "comp", "label").agg(F.count("*").alias("area"), F.max(F.expr("x in (0, w - 1) or y in (0, h - 1)")).alias("rim"))
        small = size.filter((F.col("area") < least) & ~((F.col("label") == 0) & F.col("rim"))).select("id", "comp", "label", "area")
        ring = found.join(small.select("id", "comp"), ["id", "comp"]).withColumn("s", eight).select("id", F.col("comp").alias("of"), (F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y")).distinct()
        touch = ring.join(found, ["id", "x", "y"]).filter("comp <> of").groupBy("id", "of", "comp", "label").agg(F.count("*").alias("n"))
        near = touch.groupBy("id", F.col("of").alias("comp")).agg(F.collect_list(F.struct("comp", "label", "n")).alias("near"))
        merged = steps.written(folded(small.join(near, ["id", "comp"]), "id", ["area", "label", "comp"], "id long, comp long, to int", merger), "merged")
        px = found.join(merged, ["id", "comp"], "left").select("id", "w", "h", "x", "y", F.coalesce("to", "label").alias("label"))
        if not merged.limit(1).count():
            break
    return px


#: Pixels of a region that stays, and passes.
LEAST, PASSES = 8, 2


def merge_small_regions(spark: SparkSession, d: str) -> DataFrame:
    """A22 by area, two passes over the labels of every picture."""
    px = picture_pixels(spark, d, "label").withColumn("label", F.col("label") + 1)
    return small_merged(px, LEAST, PASSES).select("id", "x", "y", "label")


def tiny_colors(spark: SparkSession, d: str) -> DataFrame:
    """Labels by share of the pixels, with those under half a percent marked."""
    n = labels(spark, d).groupBy("id", "label").agg(F.count("*").alias("n"), F.first(F.col("w") * F.col("h")).alias("total"))
    return n.select("id", "label", "n", (F.col("n") * 200 < F.col("total")).alias("tiny"))


def resample_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Every image at 30 x 25 by nearest pixels."""
    at = pictures(spark, d).withColumn("i", F.expr("transform(sequence(0, 749), t -> cast(floor((t div 30 + 0.5D) * h / 25) * w + floor((t % 30 + 0.5D) * w / 30) as int))"))
    new = at.select("id", *[F.expr(f"transform(i, k -> {c}[k])").alias(c) for c in "rgb"])
    p = new.select("id", F.posexplode(F.arrays_zip("r", "g", "b")).alias("t", "q"))
    return p.select("id", F.expr("t % 30").alias("tx"), F.expr("cast(t div 30 as int)").alias("ty"), "q.r", "q.g", "q.b")


def halftone_lines(spark: SparkSession, d: str) -> DataFrame:
    """For each row of whole cells of 4, the runs of neighbouring cells darker than 450 thousandths: first and last cell, mean darkness in thousandths."""
    dark = pixels(pictures(spark, d), "r", "g", "b").filter("x < w - w % 4 and y < h - h % 4")
    dark = dark.select("id", F.expr("cast(x div 4 as int)").alias("cx"), F.expr("cast(y div 4 as int)").alias("cy"), (1000 - F.floor(color.luma(F.col("r"), F.col("g"), F.col("b")) * 1000 / 255)).cast("long").alias("t"))
    cells = dark.groupBy("id", "cx", "cy").agg(F.floor(F.sum("t") / 16).cast("long").alias("t")).filter("t > 450")
    run = F.expr("cx - row_number() over (partition by id, cy order by cx)")
    return cells.withColumn("k", run).groupBy("id", "cy", "k").agg(F.min("cx").alias("first"), F.max("cx").alias("last"), F.floor(F.avg("t")).cast("long").alias("t")).drop("k")


def smooth_labels(spark: SparkSession, d: str) -> DataFrame:
    """W04 on the stripes: how many different labels meet around a pixel."""
    v = pixels(striped(spark, d).withColumn("v", beside("stripe", NINE)), "v")
    return v.select("id", "x", "y", F.size(F.array_distinct(F.array_compact("v"))).cast("long").alias("kinds"))


_LAB = f"{SHOT}, lab AS MATERIALIZED (SELECT id, w, h, x, y, CAST(CASE WHEN (x*7+y*11)%53 = 0 THEN 9 ELSE r//64 END AS INT) AS label FROM img)"


def reach_sql(source: str) -> str:
    """SQL: ``found``, the pixels (id, w, h, x, y, label) of ``source`` with their components."""
    return f"""e AS MATERIALIZED (SELECT a.id, a.y*a.w+a.x AS p, b.y*b.w+b.x AS q FROM {source} a JOIN {source} b ON a.id = b.id AND a.label = b.label AND abs(a.x-b.x)+abs(a.y-b.y) = 1), reach(id, o, p) AS (SELECT id, y*w+x, y*w+x FROM {source} UNION SELECT r.id, r.o, e.q FROM reach r JOIN e ON e.id = r.id AND e.p = r.p AND e.q > r.o),
 comp AS (SELECT id, p, min(o) AS comp FROM reach GROUP BY ALL), found AS MATERIALIZED (SELECT s.*, CAST(comp AS BIGINT) AS comp FROM {source} s JOIN comp ON comp.id = s.id AND comp.p = y*w+x)"""


def _pass_sql(t: int) -> str:
    """SQL: ``l{t + 1}``, the labels after a pass over those of ``l{t}``."""
    vote = "[" + ", ".join(f"{{'s': coalesce(list_sum(list_transform(list_filter(nb, lambda z: z.l = {k}), lambda z: z.n)), 0), 'o': {-k}}}" for k in range(6)) + "]"
    return f"""e{t} AS MATERIALIZED (SELECT a.id, a.y*a.w+a.x AS p, b.y*b.w+b.x AS q FROM l{t} a JOIN l{t} b ON a.id = b.id AND a.label = b.label AND greatest(abs(a.x-b.x), abs(a.y-b.y)) = 1), q{t}(id, o, p) AS (SELECT id, y*w+x, y*w+x FROM l{t} UNION SELECT r.id, r.o, e.q FROM q{t} r JOIN e{t} e ON e.id = r.id AND e.p = r.p AND e.q > r.o), c{t} AS (SELECT id, p, min(o) AS comp FROM q{t} GROUP BY ALL), f{t} AS MATERIALIZED (SELECT s.*, CAST(comp AS BIGINT) AS comp FROM l{t} s JOIN c{t} c ON c.id = s.id AND c.p = y*w+x),
 s{t} AS MATERIALIZED (SELECT id, comp, label, count(*) AS area FROM f{t} GROUP BY ALL HAVING count(*) < {LEAST} AND NOT (label = 0 AND bool_or(x IN (0, w-1) OR y IN (0, h-1)))), g{t} AS (SELECT DISTINCT a.id, a.comp AS of_, b.comp, b.label, b.x, b.y FROM f{t} a JOIN s{t} s ON s.id = a.id AND s.comp = a.comp JOIN f{t} b ON b.id = a.id AND greatest(abs(a.x-b.x), abs(a.y-b.y)) = 1 AND b.comp <> a.comp), n{t} AS (SELECT id, of_, comp, label, count(*) AS n FROM g{t} GROUP BY ALL),
 k{t} AS MATERIALIZED (SELECT s.id, s.comp, s.label, list({{'c': n.comp, 'l': n.label, 'n': n.n}}) AS near, row_number() OVER (PARTITION BY s.id ORDER BY area, s.label, s.comp) AS k FROM s{t} s JOIN n{t} n ON n.id = s.id AND n.of_ = s.comp GROUP BY s.id, s.comp, s.label, area),
 w{t}(id, k, comp, dest, was, grown) AS (SELECT DISTINCT id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), -1, CAST([] AS STRUCT(c BIGINT, l INT)[]), CAST([] AS BIGINT[]) FROM k{t} UNION ALL SELECT id, k, comp, CASE WHEN ok THEN to_ ELSE -1 END, CASE WHEN ok THEN list_append(was, {{'c': comp, 'l': to_}}) ELSE was END, CASE WHEN ok THEN list_concat(grown, list_transform(list_filter(nb, lambda z: z.l = to_), lambda z: z.c)) ELSE grown END FROM (SELECT *, -list_max({vote}).o AS to_, len(nb) > 0 AND NOT list_contains(grown, comp) AS ok FROM
  (SELECT k.id, k.k, k.comp, was, grown, list_filter(list_transform(near, lambda z: {{'c': z.c, 'l': coalesce(list_filter(was, lambda v: v.c = z.c)[1].l, z.l), 'n': z.n}}), lambda z: z.l <> k.label) AS nb FROM w{t} w JOIN k{t} k ON k.id = w.id AND k.k = w.k+1))), l{t + 1} AS MATERIALIZED (SELECT f.id, f.w, f.h, f.x, f.y, CAST(coalesce(w.dest, f.label) AS INT) AS label FROM f{t} f LEFT JOIN w{t} w ON w.id = f.id AND w.comp = f.comp AND w.dest >= 0)"""


QUERIES = [merge_small_regions, connected_components, despeckle, tiny_colors, resample_nearest, halftone_lines, smooth_labels]
SQL = {
    "merge_small_regions": f"WITH RECURSIVE {SHOT}, l0 AS MATERIALIZED (SELECT id, w, h, x, y, CAST(label+1 AS INT) AS label FROM img), {', '.join(map(_pass_sql, range(PASSES)))} SELECT id, x, y, label FROM l{PASSES}",
    "connected_components": f"WITH RECURSIVE {_LAB}, {reach_sql('lab')} SELECT id, comp, label, count(*) AS area, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, CAST(floor(avg(x)*1000+0.5e0) AS BIGINT) AS mid_x, CAST(floor(avg(y)*1000+0.5e0) AS BIGINT) AS mid_y, count(*) FILTER (x IN (0, w-1) OR y IN (0, h-1)) AS border FROM found GROUP BY id, comp, label",
    "despeckle": f"WITH RECURSIVE {_LAB}, {reach_sql('lab')}, s AS (SELECT id, comp FROM found GROUP BY ALL HAVING count(*) < 4), v AS (SELECT a.id, a.comp, b.label, count(*) AS n FROM found a JOIN s USING (id, comp) JOIN found b ON a.id = b.id AND abs(a.x-b.x)+abs(a.y-b.y) = 1 AND a.comp <> b.comp GROUP BY ALL), m AS (SELECT id, comp, arg_max(label, n*100-label) AS l FROM v GROUP BY ALL) SELECT id, x, y, CAST(coalesce(l, label) AS INT) AS label FROM found LEFT JOIN m USING (id, comp)",
    "tiny_colors": f"WITH {_LAB} SELECT id, label, count(*) AS n, count(*)*200 < any_value(w*h) AS tiny FROM lab GROUP BY 1, 2",
    "resample_nearest": f"WITH {SHOT} SELECT id, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b FROM range(30) a(tx), range(25) c(ty), img WHERE x = CAST(floor((tx+0.5e0)*w/30) AS INT) AND y = CAST(floor((ty+0.5e0)*h/25) AS INT)",
    "halftone_lines": f"WITH {SHOT}, c AS (SELECT id, CAST(x//4 AS INT) AS cx, CAST(y//4 AS INT) AS cy, CAST(floor(sum(1000-floor((0.299e0*r+0.587e0*g+0.114e0*b)*1000/255))/16) AS BIGINT) AS t FROM img WHERE x < w-w%4 AND y < h-h%4 GROUP BY ALL), k AS (SELECT *, cx - row_number() OVER (PARTITION BY id, cy ORDER BY cx) AS k FROM c WHERE t > 450) SELECT id, cy, min(cx) AS first, max(cx) AS last, CAST(floor(avg(t)) AS BIGINT) AS t FROM k GROUP BY id, cy, k",
    "smooth_labels": f"WITH {_LAB} SELECT a.id, a.x, a.y, count(DISTINCT b.label) AS kinds FROM lab a JOIN lab b ON a.id = b.id AND abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1 GROUP BY ALL",
}

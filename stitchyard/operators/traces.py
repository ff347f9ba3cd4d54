"""Settings, placing, grants and colour rules around a trace (P13, L53, F09, L18, L24, J31, and the decisions of A29, L30 and L34 from given measures)."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchyard.operators.images import _DE, _IMG, _PAL, _de, _lab, _lab_sql, _near, _palette, pictures, pixels
from stitchyard.sources.tables import table

#: Print areas as shares of a drawing's width and height, by kind and place.
AREAS = [
    ("tee", "chest", 0.34, 0.30, 0.32, 0.28), ("tee", "left_chest", 0.52, 0.28, 0.16, 0.14), ("tee", "full", 0.28, 0.26, 0.44, 0.50), ("tee", "back", 0.30, 0.24, 0.40, 0.46),
    ("hoodie", "chest", 0.36, 0.36, 0.28, 0.24), ("hoodie", "full", 0.30, 0.32, 0.40, 0.42), ("hoodie", "left_chest", 0.54, 0.34, 0.14, 0.12),
    ("hat", "front", 0.38, 0.30, 0.24, 0.16), ("hat", "center", 0.38, 0.30, 0.24, 0.16), ("tumbler", "wrap", 0.36, 0.32, 0.28, 0.38), ("tumbler", "center", 0.38, 0.36, 0.24, 0.28),
    ("plaque", "center", 0.28, 0.36, 0.44, 0.22), ("sticker", "center", 0.28, 0.28, 0.44, 0.44), ("sign", "center", 0.22, 0.30, 0.56, 0.36), ("hoop", "center", 0.34, 0.34, 0.32, 0.32),
]
#: Print areas on photographs.
PHOTO_AREAS = [
    ("chest", 0.31, 0.24, 0.38, 0.32), ("center", 0.31, 0.24, 0.38, 0.32), ("left_chest", 0.54, 0.22, 0.18, 0.16), ("full", 0.26, 0.22, 0.48, 0.52), ("front", 0.26, 0.22, 0.48, 0.52),
    ("back", 0.28, 0.22, 0.44, 0.50), ("youth", 0.34, 0.20, 0.32, 0.28), ("youth_chest", 0.34, 0.20, 0.32, 0.28), ("wrap", 0.26, 0.22, 0.48, 0.52),
]
#: Credits that a product brings where the payment names no number of 1 to 500.
PRODUCT_CREDITS = {"single": 1, "pack": 10}
DETAILS = ["", "low", "fine", "130", "42.5", "Balanced", "-5", "what"]
SMOOTHINGS = ["", "HIGH", "low", "33", "250", "sharp"]
CORNERS = ["sharp", "", "70", "smooth", "balanced", "-3", "huge"]
KINDS = ["tee", "hoodie", "hat", "tumbler", "mug", "sign"]
PLACES = ["chest", "full", "center", "back", "sleeve", "Left_Chest"]


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _clip(v: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def _round(v: Column) -> Column:
    return F.floor(v + 0.5).cast("double")


def _between(low: float, high: float, t: Column) -> Column:
    return low + (high - low) * t


def _milli(v: Column, name: str) -> Column:
    return F.floor(v * 1000 + 0.5).cast("long").alias(name)


def _percent(raw: Column, names: dict[str, int]) -> Column:
    """A slider of 0 to 100, as a number or a name; names that are not known stand in the middle."""
    number = F.when(F.trim(raw).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(raw).cast("double"))
    named = F.lit(50.0)
    for name, value in names.items():
        named = F.when(F.lower(raw) == name, F.lit(float(value))).otherwise(named)
    return F.when(number.isNotNull(), _clip(number, 0.0, 100.0)).otherwise(named)


def vectorize_options(spark: SparkSession, d: str) -> DataFrame:
    """Sliders by name or number become the settings of a trace; a number of colours moves an unnumbered detail slider."""
    k = F.col("id")
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("id")).select("id", _pick(DETAILS, k).alias("detail"), F.when(k % 3 == 0, (k % 40).cast("double")).alias("colors"), _pick(SMOOTHINGS, k).alias("smooth"), _pick(CORNERS, k).alias("corner"), F.when(k % 5 == 0, (k % 11) / 2.0).alias("epsilon"))
    many = F.col("colors")
    by_colors = F.when(many <= 5, "low").when(many >= 11, "high").otherwise("medium")
    asked = asked.withColumn("detail", F.when((F.col("detail") == "") & many.isNotNull(), by_colors).otherwise(F.col("detail")))
    names = {"simple": 15, "low": 15, "fine": 85, "high": 85}
    p = asked.select("*", _percent(F.col("detail"), names).alias("dp"), F.col("detail").rlike(r"^[+-]?\d").alias("numbered"), (_percent(F.col("smooth"), {"low": 15, "high": 85}) / 100).alias("s"), (_percent(F.col("corner"), {"sharp": 10, "smooth": 90}) / 100).alias("c"))
    colors = F.when(many.isNotNull(), _clip(many, 2.0, 24.0)).otherwise(_clip(_round(_between(3.0, 24.0, F.col("dp") / 100)), 2.0, 24.0))
    detail = F.when(many.isNotNull() & ~F.col("numbered"), _round(_clip((many - 3) / 21 * 100, 0.0, 100.0))).otherwise(F.col("dp"))
    s, c = F.col("s"), F.col("c")
    out = {"colors": colors, "detail": _round(detail), "smoothing": _round(s * 100), "corner": _round(c * 100), "epsilon": _clip(F.coalesce("epsilon", _between(0.4, 1.6, s)), 0.2, 3.0), "fit_error": _clip(_between(0.4, 2.0, c), 0.2, 4.0), "corner_cos": _clip(_between(-0.55, 0.15, c), -1.0, 1.0), "corner_threshold": _round(_between(40.0, 90.0, c)), "speckle": _round(_between(2.0, 10.0, s)), "segment": _between(3.0, 6.0, s)}
    return p.select("id", *[_milli(v, name) for name, v in out.items()])


def _asked_places(spark: SparkSession, d: str) -> DataFrame:
    w, h = (400 + F.col("l_quantity").cast("long") * 10).alias("w"), (300 + F.col("l_linenumber") * 50).cast("long").alias("h")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _pick(KINDS, F.col("l_partkey")).alias("kind"), _pick(PLACES, F.col("l_suppkey")).alias("place"), w, h, (F.col("l_partkey") % 300).alias("scale"), (F.col("l_suppkey") % 41 - 20).alias("off"))


def _areas(rows: list[tuple]) -> Column:
    """A map from a name to its shares x, y, w and h."""
    return F.create_map(*[v for *key, x, y, w, h in rows for v in (F.lit("/".join(key)), F.array(*map(F.lit, (x, y, w, h))))])


def art_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The box of an artwork on a drawing; kinds without a table take the tee's, places without an area the kind's centre, then its chest (each kind has one of them)."""
    known = F.when(F.col("kind").isin(*{a[0] for a in AREAS}), F.col("kind")).otherwise("tee")
    every, at = _areas(AREAS), lambda place: F.concat_ws("/", "known", place)
    boxes = _asked_places(spark, d).withColumn("known", known).withColumn("a", F.coalesce(*[F.try_element_at(every, at(p)) for p in (F.col("place"), F.lit("center"), F.lit("chest"))]))
    return boxes.select("l_orderkey", "l_linenumber", *[F.floor(F.col(side) * F.col("a")[k] + 0.5).cast("long").alias(name) for k, (name, side) in enumerate((("x", "w"), ("y", "h"), ("bw", "w"), ("bh", "h")))])


def photo_boxes(spark: SparkSession, d: str) -> DataFrame:
    """L53 on a photograph: an area scaled by 25 to 250 % around its middle and moved by shares of the photograph."""
    a = F.coalesce(F.try_element_at(_areas(PHOTO_AREAS), F.lower("place")), F.array(*map(F.lit, PHOTO_AREAS[0][1:])))
    p = _asked_places(spark, d).withColumn("a", a).withColumn("s", _clip(F.col("scale") / 100.0, 0.25, 2.5))
    size = {side: _round(F.col(side) * F.col("a")[k] * F.col("s")) for side, k in (("w", 2), ("h", 3))}
    mid = {side: F.col(side) * (F.col("a")[k] + F.col("a")[k + 2] / 2) + F.col("off") / 100.0 * F.col(side) for side, k in (("w", 0), ("h", 1))}
    return p.select("l_orderkey", "l_linenumber", *[F.floor(mid[s] - size[s] / 2 + 0.5).cast("long").alias(n) for n, s in (("x", "w"), ("y", "h"))], *[size[s].cast("long").alias(f"b{s}") for s in "wh"])


def checkout_grants(spark: SparkSession, d: str) -> DataFrame:
    """credits for a paid checkout, once for each session, at its first event that can be granted; events without a session are each their own.

    A session is never forgotten, however many follow it. The first events are found by a partial
    aggregate and joined by their own ids, so that events without a session meet in no task.
    """
    k = F.col("event_id")
    status = _pick(["paid", "unpaid", "", "no_payment_required"], F.floor(k / 3))
    asked = F.when(k % 4 == 0, k % 700)
    e = table(spark, d, "events").select("event_id", "ts", F.when(k % 9 != 0, F.concat(F.lit("cs_"), (k % 900).cast("string"))).otherwise("").alias("session"), status.alias("status"), (F.col("user_id") % 13 != 0).alias("known"), _pick(list(PRODUCT_CREDITS), k).alias("product"), asked.alias("asked"))
    n = F.when(F.col("asked").between(1, 500), F.col("asked")).otherwise(F.try_element_at(F.create_map(*[F.lit(v) for p in PRODUCT_CREDITS.items() for v in p]), F.col("product")).cast("long"))
    able = e.select("event_id", "ts", "session", (F.col("known") & (F.col("status") != "unpaid")).alias("able"), n.alias("n"))
    first = able.filter("able and session <> ''").groupBy("session").agg(F.min(F.struct("ts", "event_id")).alias("f")).select(F.col("f.event_id").alias("event_id"), F.lit(True).alias("first"))
    granted = F.col("able") & (F.coalesce("first", F.lit(False)) | (F.col("session") == ""))
    return able.join(first, "event_id", "left").select("event_id", F.when(granted, F.col("n")).otherwise(0).cast("long").alias("granted"))


def fill_snap(spark: SparkSession, d: str) -> DataFrame:
    """A fill takes the median colour of its inner pixels, if they are half of it and three at least; -1 where it stays."""
    p = pictures(spark, d)
    p = p.withColumn("label", F.expr("transform(label, (v, i) -> if(v < 0, -1, cast(((i % w) div 8 + i div w div 7 + id) % 5 as int)))"))  # fills with an inside
    same = _near("label", [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)])
    p = p.withColumn("inner", F.transform(same, lambda a: (F.array_min(a) == F.array_max(a)).cast("int")))
    x = pixels(p, "label", "inner", "r", "g", "b").filter("label >= 0")
    g = x.groupBy("id", "label").agg(F.count("*").alias("n"), F.sum("inner").alias("inner"), *[F.expr(f"percentile({c}, 0.5D) filter (where inner = 1)").alias(c) for c in "rgb"])
    snaps = (F.col("inner") >= 3) & (F.col("inner") * 2 >= F.col("n"))
    return g.select("id", "label", "n", "inner", *[F.when(snaps, F.bround(c)).otherwise(-1).cast("long").alias(c) for c in "rgb"])


def core_recolor(spark: SparkSession, d: str) -> DataFrame:
    """An ink's Lab colour is the median of its pixels within 8 of it, of all of them if it has little chroma; with under eight such pixels it stays."""
    p = pictures(spark, d)
    x = pixels(p, "label", "r", "g", "b").filter("label >= 0").withColumn("inks", _palette())
    own = F.element_at("inks", F.col("label") + 1)
    # noise around an ink that differs between images, so that inks with and without a core exist
    near = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), own[f"p{c}"] + (F.col(c) % 16 - 8) * (F.col("id") % 5)))
    v = x.select("id", "label", _lab(own.pr, own.pg, own.pb).alias("ink"), _lab(*[near(c) for c in "rgb"]).alias("v"))
    v = v.withColumn("use", (F.sqrt(F.col("ink")[1] * F.col("ink")[1] + F.col("ink")[2] * F.col("ink")[2]) < 22) | (_de(F.col("v"), F.col("ink")) <= 8))
    g = v.groupBy("id", "label").agg(F.count_if("use").alias("used"), F.count("*").alias("n"), F.first("ink").alias("ink"), *[F.expr(f"percentile(v[{k}], 0.5D) filter (where use)").alias(f"m{k}") for k in range(3)])
    return g.select("id", "label", "n", "used", *[_milli(F.when(F.col("used") >= 8, F.col(f"m{k}")).otherwise(F.col("ink")[k]), c) for k, c in enumerate(("lab_l", "lab_a", "lab_b"))])


def fill_unlabelled(spark: SparkSession, d: str) -> DataFrame:
    """Pixels without a label take the nearest one's, the first in reading order of equals; without any label all stay without one.

    First the nearest of each column, then the nearest of these of a row: the sides of an image, not its area, for each pixel.
    """
    p = pictures(spark, d)
    column = "array_min(transform(filter(sequence(0, h - 1), k -> label[k * w + i % w] >= 0), k -> struct(abs(k - i div w) as d, cast(k * w + i % w as int) as j)))"
    p = p.withColumn("up", F.expr(f"transform(sequence(0, w * h - 1), i -> {column})"))
    row = "array_min(transform(filter(sequence(0, w - 1), m -> up[cast(i div w * w + m as int)] is not null), m -> struct((m - i % w) * (m - i % w) + up[cast(i div w * w + m as int)].d * up[cast(i div w * w + m as int)].d as d, up[cast(i div w * w + m as int)].j as j)))"
    p = p.withColumn("filled", F.expr(f"transform(sequence(0, w * h - 1), i -> if(label[i] >= 0, label[i], coalesce(label[{row}.j], -1)))"))
    return pixels(p, "label", "filled").filter("label < 0").select("id", "x", "y", "filled")


def trace_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether given measures of a trace pass all gates."""
    measured = table(spark, d, "part").selectExpr("p_partkey as id", "p_partkey % 600 as seams", "p_partkey % 23 as stair_pct", "p_partkey % 11 / 11.0D as stair_ratio", "p_partkey % 53 as fringe", "p_partkey % 7 - 5 as specks", "p_partkey % 50 / 10.0D as de", "p_partkey % 22 as de95")
    return measured.select("id", F.expr("seams <= 500 and stair_pct <= 20 and stair_ratio <= 0.9D and fringe <= 50 and specks <= 0 and de <= 4.65D and de95 <= 20").alias("ok"))


def keylines(spark: SparkSession, d: str) -> DataFrame:
    """Whether a thin piece of given measures is drawn on purpose: no seam of the source (under 3.5 of its pixels wide and under 6 mm long; without the source's scale every piece may be one), four times its area in its colour, and a solid core."""
    piece = table(spark, d, "part").selectExpr("p_partkey as id", "p_partkey % 40 / 20.0D as width", "p_partkey % 17 as length", "case when p_partkey % 6 <> 0 then p_partkey % 9 end as source_ppm", "p_partkey % 50 as area", "p_partkey % 50 * (p_partkey % 7) as in_colour", "p_partkey % 13 / 2.0D as core")
    seam = F.coalesce((F.col("source_ppm") == 0) | ((F.col("width") * F.col("source_ppm") < 3.5) & (F.col("length") < 6)), F.lit(True))
    ppm = 10.0
    return piece.select("id", (~seam & (F.col("area") >= 0.3 * ppm) & (F.col("width") >= 0.1) & (F.col("in_colour") >= 4 * F.col("area")) & (F.col("core") <= 6)).alias("keyline"))


def spine_choice(spark: SparkSession, d: str) -> DataFrame:
    """Of a shape's two plans, the loop if it scores more: what is covered, less what is covered twice and crossed pairs."""
    cells = table(spark, d, "lineitem").selectExpr("l_orderkey as shape", "l_linenumber % 2 = 0 as loop", "l_partkey % 5 > 0 as mask", "l_suppkey % 4 as laid", "l_partkey % 7 = 0 as crosses")
    plans = cells.groupBy("shape", "loop").agg(F.count_if("mask").alias("on"), F.count_if(F.expr("mask and laid > 0")).alias("cov"), F.sum("laid").alias("tot"), F.count_if(F.expr("laid > 0")).alias("covered"), F.count_if("crosses").alias("cross"), F.count("*").alias("pairs"))
    score = F.expr("if(on > 0, cov / on, 0.0D) - greatest(0.0D, if(covered > 0, tot / covered, 9.0D) - 1) * 0.8D - cross / pairs")
    s = plans.select("shape", "loop", score.alias("s")).groupBy("shape").agg(F.max(F.expr("if(loop, s, null)")).alias("b"), F.max(F.expr("if(loop, null, s)")).alias("a"))
    return s.select("shape", F.coalesce(F.col("b") > F.col("a"), F.lit(False)).alias("loop"))


QUERIES = [vectorize_options, art_boxes, photo_boxes, checkout_grants, fill_snap, core_recolor, fill_unlabelled, trace_gate, keylines, spine_choice]
_Q = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_V = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}e0" for v in r) + ")" for r in rows)
_ASKED = f"q AS (SELECT l_orderkey, l_linenumber, {_Q(KINDS)}[l_partkey % 6 + 1] AS kind, {_Q(PLACES)}[l_suppkey % 6 + 1] AS place, 400 + CAST(l_quantity AS BIGINT) * 10 AS w, 300 + l_linenumber * 50 AS h, greatest(0.25e0, least(2.5e0, l_partkey % 300 / 100e0)) AS s, l_suppkey % 41 - 20 AS off FROM lineitem)"
_R0 = lambda e, name: f"CAST(floor({e} + 0.5e0) AS BIGINT) AS {name}"
_R3 = lambda e, name: _R0(f"({e}) * 1000", name)
_NOISY = ", ".join(f"greatest(0, least(255, p{c} + ({c} % 16 - 8) * (img.id % 5))) AS v{c}" for c in "rgb")
SQL = {
    "vectorize_options": f"""WITH q AS (SELECT p_partkey AS id, {_Q(DETAILS)}[p_partkey % 8 + 1] AS de, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 40 AS DOUBLE) END AS n, lower({_Q(SMOOTHINGS)}[p_partkey % 6 + 1]) AS sm, {_Q(CORNERS)}[p_partkey % 7 + 1] AS co, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 11 / 2e0 END AS ep FROM part),
 p AS (SELECT *, TRY_CAST(de AS DOUBLE) AS dn, CASE WHEN de IN ('low', 'simple') OR (de = '' AND n <= 5) THEN 15e0 WHEN de IN ('fine', 'high') OR (de = '' AND n >= 11) THEN 85e0 ELSE 50e0 END AS dk, greatest(0e0, least(100e0, coalesce(TRY_CAST(sm AS DOUBLE), CASE sm WHEN 'low' THEN 15e0 WHEN 'high' THEN 85e0 ELSE 50e0 END))) / 100 AS s, greatest(0e0, least(100e0, coalesce(TRY_CAST(co AS DOUBLE), CASE co WHEN 'sharp' THEN 10e0 WHEN 'smooth' THEN 90e0 ELSE 50e0 END))) / 100 AS c FROM q),
 r AS (SELECT *, CASE WHEN dn IS NULL THEN dk ELSE greatest(0e0, least(100e0, dn)) END AS dp FROM p)
 SELECT id, {_R3("CASE WHEN n IS NOT NULL THEN greatest(2e0, least(24e0, n)) ELSE greatest(2e0, least(24e0, floor(3e0 + 21e0 * (dp / 100) + 0.5e0))) END", "colors")}, {_R3("floor(CASE WHEN n IS NOT NULL AND dn IS NULL THEN floor(greatest(0e0, least(100e0, (n - 3) / 21e0 * 100)) + 0.5e0) ELSE dp END + 0.5e0)", "detail")}, {_R3("floor(s * 100 + 0.5e0)", "smoothing")}, {_R3("floor(c * 100 + 0.5e0)", "corner")}, {_R3("greatest(0.2e0, least(3e0, coalesce(ep, 0.4e0 + (1.6e0 - 0.4e0) * s)))", "epsilon")}, {_R3("0.4e0 + (2e0 - 0.4e0) * c", "fit_error")}, {_R3("-0.55e0 + (0.15e0 + 0.55e0) * c", "corner_cos")}, {_R3("floor(40 + 50 * c + 0.5e0)", "corner_threshold")}, {_R3("floor(2 + 8 * s + 0.5e0)", "speckle")}, {_R3("3 + 3 * s", "segment")} FROM r""",
    "art_boxes": f"WITH {_ASKED}, b(kind, place, x, y, w, h) AS (VALUES {_V(AREAS)}), k AS (SELECT *, CASE WHEN kind = 'mug' THEN 'tee' ELSE kind END AS known FROM q) SELECT l_orderkey, l_linenumber, " + ", ".join(_R0(f"k.{side} * coalesce(p.{c}, m.{c}, t.{c})", name) for name, side, c in (("x", "w", "x"), ("y", "h", "y"), ("bw", "w", "w"), ("bh", "h", "h"))) + " FROM k LEFT JOIN b p ON p.kind = known AND p.place = k.place LEFT JOIN b m ON m.kind = known AND m.place = 'center' LEFT JOIN b t ON t.kind = known AND t.place = 'chest'",
    "photo_boxes": f"WITH {_ASKED}, b(place, x, y, w, h) AS (VALUES {_V(PHOTO_AREAS)}), j AS (SELECT q.*, b.x AS ax, b.y AS ay, b.w AS aw, b.h AS ah, floor(q.w * b.w * s + 0.5e0) AS fw, floor(q.h * b.h * s + 0.5e0) AS fh FROM q JOIN b ON b.place = CASE WHEN lower(q.place) IN (SELECT place FROM b) THEN lower(q.place) ELSE 'chest' END) SELECT l_orderkey, l_linenumber, {_R0('w * (ax + aw / 2) + off / 100e0 * w - fw / 2', 'x')}, {_R0('h * (ay + ah / 2) + off / 100e0 * h - fh / 2', 'y')}, CAST(fw AS BIGINT) AS bw, CAST(fh AS BIGINT) AS bh FROM j",
    "checkout_grants": "WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 9 <> 0 THEN event_id % 900 ELSE -1 END AS s, user_id % 13 <> 0 AND event_id // 3 % 4 <> 1 AS able, CASE WHEN event_id % 4 = 0 AND event_id % 700 BETWEEN 1 AND 500 THEN event_id % 700 WHEN event_id % 2 = 0 THEN 1 ELSE 10 END AS n FROM events) SELECT event_id, CASE WHEN able AND (s = -1 OR row_number() OVER (PARTITION BY s, able ORDER BY ts, event_id) = 1) THEN n ELSE 0 END AS granted FROM e",
    "fill_snap": f"WITH {_IMG}, f AS (SELECT * REPLACE (CAST(CASE WHEN label < 0 THEN -1 ELSE (x // 8 + y // 7 + id) % 5 END AS INT) AS label) FROM img), z AS (SELECT a.id, a.label, a.r, a.g, a.b, NOT EXISTS (SELECT 1 FROM f n WHERE n.id = a.id AND abs(n.x - a.x) + abs(n.y - a.y) = 1 AND n.label <> a.label) AS inn FROM f a WHERE a.label >= 0), g AS (SELECT id, label, count(*) AS n, count(*) FILTER (inn) AS inner_, " + ", ".join(f"quantile_cont({c}, 0.5) FILTER (inn) AS {c}" for c in "rgb") + ' FROM z GROUP BY ALL) SELECT id, label, n, inner_ AS "inner", ' + ", ".join(f"CAST(CASE WHEN inner_ >= 3 AND inner_ * 2 >= n THEN round_even({c}, 0) ELSE -1 END AS BIGINT) AS {c}" for c in "rgb") + " FROM g",
    "core_recolor": f"WITH {_IMG}, {_PAL}, px2 AS (SELECT img.id, x, y, label, {_NOISY} FROM img JOIN pal ON pal.id = img.id AND ink = label), {_lab_sql('pal', 'pr', 'pg', 'pb', 'id, ink', 'lab')}, {_lab_sql('px2', 'vr', 'vg', 'vb', 'id, x, y, label', 'v')}, u AS (SELECT v.*, sqrt(lab.\"A\"*lab.\"A\"+lab.\"B\"*lab.\"B\") < 22 OR {_DE.format('v', 'lab')} <= 8 AS use, lab.\"L\" AS l0, lab.\"A\" AS a0, lab.\"B\" AS b0 FROM v JOIN lab ON lab.id = v.id AND ink = label), g AS (SELECT id, label, count(*) AS n, count(*) FILTER (use) AS used, " + ", ".join(f'quantile_cont("{c}", 0.5) FILTER (use) AS m{c}, any_value({c.lower()}0) AS o{c}' for c in "LAB") + " FROM u GROUP BY ALL) SELECT id, label, n, used, " + ", ".join(_R3(f"CASE WHEN used >= 8 THEN m{c} ELSE o{c} END", f"lab_{c.lower()}") for c in "LAB") + " FROM g",
    "fill_unlabelled": f"WITH {_IMG}, c AS (SELECT a.id, a.x, a.y, b.label, {{'d': (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), 'j': b.y*b.w+b.x}} AS k FROM img a LEFT JOIN img b ON b.id = a.id AND b.label >= 0 WHERE a.label < 0) SELECT id, x, y, coalesce(arg_min(label, k), -1) AS filled FROM c GROUP BY ALL",
    "trace_gate": "SELECT p_partkey AS id, p_partkey % 600 <= 500 AND p_partkey % 23 <= 20 AND p_partkey % 11 < 10 AND p_partkey % 53 <= 50 AND p_partkey % 7 <= 5 AND p_partkey % 50 <= 46 AND p_partkey % 22 <= 20 AS ok FROM part",
    "keylines": "WITH q AS (SELECT p_partkey AS id, p_partkey % 40 / 20e0 AS wd, p_partkey % 17 AS ln, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 9 ELSE 0 END AS ppm, p_partkey % 50 AS ar, p_partkey % 7 AS times, p_partkey % 13 AS core2 FROM part) SELECT id, ppm > 0 AND NOT (wd * ppm < 3.5e0 AND ln < 6) AND ar >= 3 AND wd >= 0.1e0 AND times >= 4 AND core2 <= 12 AS keyline FROM q",
    "spine_choice": "WITH p AS (SELECT l_orderkey AS shape, l_linenumber % 2 = 0 AS loop_, coalesce(count(*) FILTER (l_partkey % 5 > 0 AND l_suppkey % 4 > 0) / nullif(CAST(count(*) FILTER (l_partkey % 5 > 0) AS DOUBLE), 0), 0) - greatest(0e0, coalesce(sum(l_suppkey % 4) / nullif(CAST(count(*) FILTER (l_suppkey % 4 > 0) AS DOUBLE), 0), 9e0) - 1) * 0.8e0 - count(*) FILTER (l_partkey % 7 = 0) / CAST(count(*) AS DOUBLE) AS s FROM lineitem GROUP BY ALL) SELECT shape, coalesce(max(s) FILTER (loop_) > max(s) FILTER (NOT loop_), false) AS loop FROM p GROUP BY 1",
}

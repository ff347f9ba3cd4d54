"""Colour, print and thread rules as column expressions and small joins."""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stitchyard.functions import color
from stitchyard.operators.palette import NAMED, named
from stitchyard.operators.stitch import stream
from stitchyard.sources.tables import table

#: Pull of satin and fill, spacing of fills, fill stitch (hundredths of a mm) and underlay by fabric, and other names of fabrics.
FABRICS = [("tee", 35, 22, 42, 360, 1), ("polo", 30, 30, 42, 360, 1), ("fleece", 40, 40, 40, 360, 1), ("towel", 40, 40, 40, 360, 1), ("cap", 25, 25, 42, 350, 0), ("woven", 20, 20, 45, 380, 0)]
ALIASES = {"jersey": "tee", "knit": "tee", "tshirt": "tee", "shirt": "tee", "pique": "polo", "sweat": "fleece", "sweatshirt": "fleece", "hoodie": "fleece", "terry": "towel", "twill": "woven", "poplin": "woven", "denim": "woven", "canvas": "woven"}
ASKED = ["T-Shirt", "Denim!", " hoodie ", "CAP", "", "silk", "Terry", "polo"]
#: Millimetres of a stone size, and marks that a job may have.
STONES = {"SS6": 2.0, "SS8": 2.3, "SS10": 2.8, "SS12": 3.0}
MARKS = 600_000


def _parts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), "p_size", "p_brand", "p_name", *[((k * m) % 256).cast("int").alias(c) for c, m in (("r", 37), ("g", 91), ("b", 151))])


def chroma_luma(a: list[Column], b: list[Column]) -> Column:
    """Distance of two colours by luma and by what the channels differ beside it."""
    dy = color.luma(*a) - color.luma(*b)
    rest = [p - q - dy for p, q in zip(a, b, strict=True)]
    return F.sqrt(0.6 * dy * dy + 0.4 * (rest[0] * rest[0] + rest[1] * rest[1] + rest[2] * rest[2]) / 3)


def chroma_luma_to_paper(spark: SparkSession, d: str) -> DataFrame:
    """C07 of each part's colour and the paper."""
    dist = chroma_luma([F.col(c) for c in "rgb"], [F.lit(244), F.lit(244), F.lit(241)])
    return _parts(spark, d).select("id", F.floor(dist * 1000 + 0.5).cast("long").alias("d"))


def contrast_curve(spark: SparkSession, d: str) -> DataFrame:
    """Darkness spread around the middle, contrast between 0.25 and 2.5."""
    c = F.greatest(F.lit(0.25), F.least(F.lit(2.5), F.when(F.col("p_size") == 0, 1.0).otherwise(F.col("p_size") / 10.0)))
    t = F.col("r") / 200.0
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return _parts(spark, d).select("id", F.floor(F.when(c == 1, clip(t)).otherwise(clip((clip(t) - 0.5) * c + 0.5)) * 10_000 + 0.5).cast("long").alias("t"))


def hash01(x: Column, y: Column, salt: Column) -> Column:
    """A number of 0 to 9999 from whole numbers, by 32-bit steps; a product is rounded as a double before it is cut."""
    wrap = lambda v: (v.bitwiseAND(F.lit(0xFFFFFFFF)) - F.when(v.bitwiseAND(F.lit(0x80000000)) != 0, F.lit(1 << 32)).otherwise(F.lit(0))).cast("long")
    n = wrap((x.cast("double") * 374761393 + y.cast("double") * 668265263 + salt.cast("double") * 1274126177).cast("long"))
    shifted = F.shiftrightunsigned(n.bitwiseAND(F.lit(0xFFFFFFFF)), 13)
    n = wrap((wrap(n.bitwiseXOR(shifted)).cast("double") * 1274126177).cast("long"))
    n = n.bitwiseXOR(F.shiftrightunsigned(n.bitwiseAND(F.lit(0xFFFFFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))
    return n % 10_000


def grain_hash(spark: SparkSession, d: str) -> DataFrame:
    """C09 of places."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", hash01(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")).alias("h"))


def fabric_preset(spark: SparkSession, d: str) -> DataFrame:
    """C20: the preset of a fabric by its name or another of its names, in any spelling; else the tee's."""
    names = [(n, n) for n, *_ in FABRICS] + list(ALIASES.items())
    known = F.broadcast(spark.createDataFrame(names, "key string, fabric string"))
    preset = F.broadcast(spark.createDataFrame(FABRICS, "fabric string, pull_satin int, pull_fill int, spacing int, stitch int, underlay int"))
    asked = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("id") % len(ASKED) + 1).cast("int"))
    p = _parts(spark, d).select("id", F.regexp_replace(F.lower(asked), "[^a-z]", "").alias("key")).join(known, "key", "left")
    return p.select("id", F.coalesce("fabric", F.lit("tee")).alias("fabric")).join(preset, "fabric").select("id", "fabric", "pull_satin", "pull_fill", "spacing", "stitch", "underlay")


def upscale_size(spark: SparkSession, d: str) -> DataFrame:
    """Pixels at 300 to the inch of art of a width in inches: at most 16 inches, 4800 an edge and 4800 x 4800 in all."""
    p = _parts(spark, d).select("id", (100 + F.col("r") * 7).alias("sw"), (80 + F.col("g") * 9).alias("sh"), (F.col("b") / 12.0).alias("asked"))
    aspect = F.col("sh") / F.col("sw")
    wide = F.least(F.lit(16.0), F.greatest(F.lit(1.0), F.when(F.col("asked") == 0, 10.0).otherwise(F.col("asked"))))
    q = p.select("id", aspect.alias("a"), wide.alias("w")).select("id", F.when(F.col("w") * F.col("a") > 16, 16 / F.col("a")).otherwise(F.col("w")).alias("w"), F.least(F.lit(16.0), F.col("w") * F.col("a")).alias("h"))
    edge = lambda c: F.least(F.lit(4800), F.greatest(F.lit(1), F.rint(F.col(c) * 300).cast("int")))
    return q.select("id", edge("w").alias("tw"), edge("h").alias("th"))


def print_fit(spark: SparkSession, d: str) -> DataFrame:
    """A box whose aspect is within 1 % of the art's is used, else the art is fitted into it; one side alone gives the other."""
    p = _parts(spark, d).select("id", ((20 + F.col("r")) / (20 + F.col("g"))).alias("a"), F.when(F.col("id") % 5 != 0, F.col("b") % 20 + 1.0).alias("bw"), F.when(F.col("id") % 7 != 0, F.col("b") % 15 + 1.0).alias("bh"))
    fits = F.abs(F.col("bw") / F.col("bh") - F.col("a")) / F.col("a") <= 0.01
    width = F.when(F.col("bw").isNull() & F.col("bh").isNull(), 10.0).when(F.col("bw").isNull(), F.col("bh") * F.col("a")).when(F.col("bh").isNull() | fits, F.col("bw")).otherwise(F.least(F.col("bw"), F.col("bh") * F.col("a")))
    height = F.when(F.col("bh").isNotNull() & F.coalesce(fits, F.lit(False)), F.col("bh")).otherwise(F.col("w") / F.col("a"))
    milli = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(c)
    return p.withColumn("w", width).withColumn("h", height).select("id", milli("w"), milli("h"))


def mark_budget(spark: SparkSession, d: str) -> DataFrame:
    """Marks that a screen needs, before any is made, and the error where they are too many."""
    p = _parts(spark, d).select("id", (200 + F.col("r") * 12).alias("w"), (150 + F.col("g") * 10).alias("h"), (0.5 + F.col("b") % 40 / 8.0).alias("cell"), F.element_at(F.array(*map(F.lit, ("dot", "line", "crosshatch", "mesh", "fm", "grain"))), (F.col("id") % 6 + 1).cast("int")).alias("kind"))

    def grid(angle: float) -> Column:
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        at = [(x * c + y * s, -x * s + y * c) for x, y in ((F.lit(0), F.lit(0)), (F.col("w"), F.lit(0)), (F.col("w"), F.col("h")), (F.lit(0), F.col("h")))]
        steps = lambda i: F.floor((F.greatest(*[q[i] for q in at]) - F.least(*[q[i] for q in at]) + 2 * F.col("cell")) / F.col("cell") + 1e-9) + 1
        return steps(0) * steps(1)

    micro = lambda share, step: F.greatest(F.lit(1.2), F.col("cell") * share) * step
    scatter = lambda pitch: F.greatest(F.lit(1), F.ceil(F.col("w") / pitch)) * F.greatest(F.lit(1), F.ceil(F.col("h") / pitch))
    n = F.when(F.col("kind") == "fm", scatter(micro(0.42, 1.85))).when(F.col("kind") == "grain", scatter(micro(0.35, 1.6))).when(F.col("kind") == "crosshatch", grid(30) + grid(120)).when(F.col("kind") == "mesh", grid(0) + grid(90)).otherwise(grid(30)).cast("long")
    error = F.when(n > MARKS, F.concat(F.lit("That size and LPI would need "), n.cast("string"), F.lit(f" dots (limit {MARKS}). Lower the LPI or print size.")))
    return p.select("id", "kind", n.alias("marks"), error.alias("error"))


def warm_fill(spark: SparkSession, d: str) -> DataFrame:
    """The nearest named colour in Lab; a warm fill takes the nearest that isn't blue, if there is one."""
    p = _parts(spark, d).select("id", "r", "g", "b", F.array(*color.lab(F.col("r"), F.col("g"), F.col("b"))).alias("p"))
    dist = lambda q: sum(((F.col("p")[k] - q[k]) * (F.col("p")[k] - q[k]) for k in (1, 2)), (F.col("p")[0] - q[0]) * (F.col("p")[0] - q[0])).alias("d")
    nearest = lambda those: F.least(*those)["name"]
    blue = [int(h[5:], 16) > int(h[1:3], 16) + 20 and int(h[5:], 16) > int(h[3:5], 16) + 10 for _, h in NAMED]
    all_ = [F.struct(dist(q), i, n) for i, n, q in named(color.lab)]
    near, other = nearest(all_), nearest([c for c, b in zip(all_, blue, strict=True) if not b])
    return p.select("id", F.when(F.expr("r > g and r > b and r > 80"), F.coalesce(other, near)).otherwise(near).alias("name"))


def thread_swap(spark: SparkSession, d: str) -> DataFrame:
    """A colour stop takes the first request that names its layer or its position; as two joins, not one on OR."""
    asked = F.broadcast(spark.createDataFrame([(0, 3, None, "#111111"), (1, None, 2, "#222222"), (2, 5, 1, "#333333"), (3, 2, 0, "#444444")], "ord int, layer int, place int, hex string"))
    stops = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("place"), F.when(F.col("l_partkey") % 5 != 0, (F.col("l_partkey") % 7).cast("int")).otherwise(F.col("l_linenumber")).alias("layer"), "l_partkey")
    stops = stops.join(asked.select("layer", F.struct("ord", "hex").alias("a")), "layer", "left").join(asked.filter("place is not null").select("place", F.struct("ord", "hex").alias("b")), "place", "left")
    return stops.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min(F.least("a", "b")).alias("hit")).select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("hit.hex", F.lit("#000000")).alias("hex"))


def thread_consolidate(spark: SparkSession, d: str) -> DataFrame:
    """Layers of one spool, or of one colour where there is none, become one, named by its largest."""
    layers = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("area"), F.when(F.col("l_suppkey") % 4 != 0, (F.col("l_suppkey") % 3).cast("string")).alias("code"), F.concat(F.lit("#"), (F.col("l_partkey") % 3).cast("string")).alias("hex"))
    g = layers.groupBy("l_orderkey", F.coalesce("code", "hex").alias("spool")).agg(F.sum("area").alias("area"), F.count("*").alias("layers"), F.max(F.struct("area", (-F.col("l_linenumber")).alias("o"))).alias("m"))
    return g.select("l_orderkey", "spool", "area", "layers", (-F.col("m.o")).cast("int").alias("first"))


def palettes(spark: SparkSession, d: str) -> DataFrame:
    """The codes of two palettes as one listing, each once by palette."""
    p = table(spark, d, "part").select(F.lit("parts").alias("palette"), F.upper("p_brand").alias("code"))
    s = table(spark, d, "supplier").select(F.lit("makers").alias("palette"), F.concat(F.lit("BRAND#"), (F.col("s_nationkey") % 9).cast("string")).alias("code"))
    return p.unionByName(s).distinct()


def paint_order(spark: SparkSession, d: str) -> DataFrame:
    """Layers of a job by area, the largest first."""
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", place.cast("long").alias("place"))


def preview_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first 36 rows of a listing; the limit is the feature."""
    return table(spark, d, "part").orderBy("p_name", "p_partkey").limit(36).select("p_partkey", "p_name")


def split_satin(spark: SparkSession, d: str) -> DataFrame:
    """A stitch over 30 is cut into equal parts, the cuts moved by a twelfth by turns."""
    last = W.partitionBy("design").orderBy("seq")
    s = stream(spark, d).select("design", "seq", "x", "y", F.lag("x").over(last).alias("px"), F.lag("y").over(last).alias("py")).filter("px is not null")
    length = F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))
    cut = s.withColumn("n", F.when(length > 30, F.ceil(length / 30.0)).otherwise(1).cast("long")).withColumn("k", F.explode(F.expr("sequence(1L, n)")))
    t = F.when(F.col("k") == F.col("n"), 1.0).otherwise(F.col("k") / F.col("n") + ((F.col("seq") - 1) % 3 - 1) * 0.12 / F.col("n"))
    at = lambda p, q: F.floor((F.col(p) + (F.col(q) - F.col(p)) * t) * 100 + 0.5).cast("long")
    return cut.select("design", "seq", "k", at("px", "x").alias("x"), at("py", "y").alias("y"))


def _stones(spark: SparkSession, d: str) -> DataFrame:
    """Stones of a sheet by maker: place in ten-thousandths of an inch, size, colour and its name."""
    k = F.col("p_partkey")
    size = F.element_at(F.array(*map(F.lit, STONES)), (k % 4 + 1).cast("int"))
    mm = F.element_at(F.array(*map(F.lit, STONES.values())), (k % 4 + 1).cast("int"))
    return table(spark, d, "part").select((k % 97).alias("sheet"), k.alias("id"), (k * 37 % 80_000).alias("x"), (k * 53 % 60_000).alias("y"), size.alias("ss"), mm.alias("mm"), F.concat("p_name", F.when(k % 5 == 0, ', "big"').otherwise("")).alias("name"), F.lower(F.concat(F.lit("#"), F.lpad(F.hex(k * 4099 % 16_777_216), 6, "0"))).alias("hex"))


def _inches(c: str) -> Column:
    return F.regexp_replace(F.format_string("%.4f", F.col(c) / 10_000), r"\.?0+$", "")


def _sheet(rows: DataFrame, line: Column, name: str, head: str, tail: str) -> DataFrame:
    """A file for each sheet: its lines in order of the stones."""
    g = rows.select("sheet", "id", line.alias("line")).groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("a"))
    return g.select("sheet", F.concat(F.lit(head), F.array_join("a.line", ""), F.lit(tail)).alias(name))


def stones_csv(spark: SparkSession, d: str) -> DataFrame:
    """Stones as CSV; names with a comma or a quote are quoted."""
    name = F.when(F.col("name").rlike('[",\n]'), F.concat(F.lit('"'), F.replace("name", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("name"))
    mm = F.regexp_replace(F.col("mm").cast("string"), r"\.0$", "")
    line = F.concat(F.concat_ws(",", _inches("x"), _inches("y"), "ss", mm, name, "hex"), F.lit("\n"))
    return _sheet(_stones(spark, d), line, "csv", "x_in,y_in,ss,mm,color_name,hex\n", "")


def stones_plt(spark: SparkSession, d: str) -> DataFrame:
    """Stones as plotter marks, 1016 to the inch, y upwards on a sheet of 6 inches."""
    at = F.concat(F.floor(F.col("x") / 10_000 * 1016 + 0.5).cast("string"), F.lit(","), F.floor((6 - F.col("y") / 10_000) * 1016 + 0.5).cast("string"))
    return _sheet(_stones(spark, d), F.concat(F.lit("PU"), at, F.lit(";\nPD"), at, F.lit(";\n")), "plt", "IN;\nSP1;\n", "PU;\nSP0;\n")


def stones_svg(spark: SparkSession, d: str) -> DataFrame:
    """Stones as circles on a sheet of 8 by 6 inches."""
    r = F.regexp_replace(F.format_string("%.4f", F.floor(F.col("mm") / 2 / 25.4 * 10_000 + 0.5) / 10_000), r"\.?0+$", "")
    line = F.concat(F.lit('\n  <circle cx="'), _inches("x"), F.lit('" cy="'), _inches("y"), F.lit('" r="'), r, F.lit('" fill="'), "hex", F.lit('" stroke="#222" stroke-width="0.005"/>'))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<svg xmlns="http://www.w3.org/2000/svg" width="8in" height="6in" viewBox="0 0 8 6">\n  <rect width="8" height="6" fill="#f4f4f1"/>'
    return _sheet(_stones(spark, d), line, "svg", head, "\n</svg>\n")


def suggested_width(spark: SparkSession, d: str) -> DataFrame:
    """The width that the lettering needs, else the one of the art, up to the next quarter of an inch."""
    need = F.when(F.col("id") % 3 == 0, F.col("r") / 37.0)
    quarter = lambda c: F.ceil(c / 0.25 - 1e-9) * 25
    return _parts(spark, d).select("id", quarter(F.coalesce(need, F.col("g") / 29.0)).cast("long").alias("hundredths"), need.isNotNull().alias("by_lettering"))


def complexity_level(spark: SparkSession, d: str) -> DataFrame:
    """The weighted score of an image's measures, to a tenth, and its level."""
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(10.0), v))
    colours, shade, edge, tiny, text = F.col("r"), F.col("g") / 1000.0, F.col("b") / 1500.0, F.col("r") / 2000.0, F.col("g") / 3000.0
    words = clip(F.when(F.col("id") % 2 == 0, text / 0.03 * 6.0 + 3.0).otherwise(text / 0.08 * 4.0))
    score = 0.22 * clip((colours - 45) / 5.0) + 0.50 * clip((shade - 0.10) / 0.012) + 0.10 * clip((edge - 0.045) / 0.012) + 0.12 * clip((tiny - 0.035) / 0.008) + 0.06 * words
    tenths = F.rint(F.round(score * 10, 6))
    return _parts(spark, d).select("id", tenths.cast("long").alias("tenths"), F.when(tenths >= 75, "too_busy").when(tenths >= 40, "busy").otherwise("ok").alias("level"))


QUERIES = [chroma_luma_to_paper, contrast_curve, grain_hash, fabric_preset, upscale_size, print_fit, mark_budget, warm_fill, thread_swap, thread_consolidate, palettes, paint_order, preview_rows, split_satin, stones_csv, stones_plt, stones_svg, suggested_width, complexity_level]
_P = "p AS (SELECT p_partkey AS id, p_size, CAST(p_partkey*37%256 AS INT) AS r, CAST(p_partkey*91%256 AS INT) AS g, CAST(p_partkey*151%256 AS INT) AS b FROM part)"
_Y = "(0.299e0*r+0.587e0*g+0.114e0*b-(0.299e0*244+0.587e0*244+0.114e0*241))"
_LIN = "CASE WHEN {0}/255e0 <= 0.04045e0 THEN {0}/255e0/12.92e0 ELSE pow(({0}/255e0+0.055e0)/1.055e0, 2.4e0) END"
_F = "CASE WHEN {0} > 0.008856e0 THEN cbrt({0}) ELSE 7.787e0*({0})+16e0/116 END"
_S = "s AS (SELECT user_id AS design, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(floor(coalesce(value, 0)) AS BIGINT) AS x, event_id % 97 AS y FROM events), q AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM s WINDOW w AS (PARTITION BY design ORDER BY seq))"
_ST = "st AS (SELECT p_partkey%97 AS sheet, p_partkey AS id, p_partkey*37%80000 AS x, p_partkey*53%60000 AS y, ['SS6','SS8','SS10','SS12'][p_partkey%4+1] AS ss, [2.0e0,2.3e0,2.8e0,3.0e0][p_partkey%4+1] AS mm, p_name || CASE WHEN p_partkey%5 = 0 THEN ', \"big\"' ELSE '' END AS name, '#' || lower(format('{:06X}', p_partkey*4099%16777216)) AS hex FROM part)"
_IN = "regexp_replace(format('{{:.4f}}', {0}/1e4), '\\.?0+$', '')"
_WRAP = "(({0}) & 4294967295) - CASE WHEN (({0}) & 2147483648) <> 0 THEN 4294967296 ELSE 0 END"
_GRID = "(floor((w*cos({0})+h*sin({0})+2*cell)/cell+1e-9)+1)*(floor((w*sin({0})+h*cos({0})+2*cell)/cell+1e-9)+1)"
SQL = {
    "chroma_luma_to_paper": f"WITH {_P} SELECT id, CAST(floor(sqrt(0.6e0*{_Y}*{_Y}+0.4e0*((r-244-{_Y})*(r-244-{_Y})+(g-244-{_Y})*(g-244-{_Y})+(b-241-{_Y})*(b-241-{_Y}))/3)*1000+0.5) AS BIGINT) AS d FROM p",
    "contrast_curve": f"WITH {_P}, c AS (SELECT id, greatest(0.25e0, least(2.5e0, CASE WHEN p_size = 0 THEN 1e0 ELSE p_size/10e0 END)) AS c, greatest(0e0, least(1e0, r/200e0)) AS t FROM p) SELECT id, CAST(floor(CASE WHEN c = 1 THEN t ELSE greatest(0e0, least(1e0, (t-0.5e0)*c+0.5e0)) END*10000+0.5) AS BIGINT) AS t FROM c",
    "grain_hash": "WITH a AS (SELECT l_orderkey, l_linenumber, " + _WRAP.format("CAST(l_partkey*374761393e0+l_suppkey*668265263e0+l_linenumber*1274126177e0 AS BIGINT)") + " AS n FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, xor(n, (n & 4294967295) >> 13) AS n FROM a), c AS (SELECT l_orderkey, l_linenumber, CAST((" + _WRAP.format("n") + ")*1274126177e0 AS BIGINT) AS n FROM b), e AS (SELECT l_orderkey, l_linenumber, " + _WRAP.format("n") + " AS n FROM c) SELECT l_orderkey, l_linenumber, (xor(n, (n & 4294967295) >> 16) & 4294967295) % 10000 AS h FROM e",
    "fabric_preset": f"WITH {_P}, n(fabric, pull_satin, pull_fill, spacing, stitch, underlay) AS (VALUES {', '.join(map(str, FABRICS))}), a AS (SELECT id, CASE id % 8 WHEN 1 THEN 'woven' WHEN 2 THEN 'fleece' WHEN 3 THEN 'cap' WHEN 6 THEN 'towel' WHEN 7 THEN 'polo' ELSE 'tee' END AS fabric FROM p) SELECT id, fabric, pull_satin, pull_fill, spacing, stitch, underlay FROM a JOIN n USING (fabric)",
    "upscale_size": f"WITH {_P}, a AS (SELECT id, (80+g*9)/CAST(100+r*7 AS DOUBLE) AS a, least(16e0, greatest(1e0, CASE WHEN b = 0 THEN 10e0 ELSE b/12e0 END)) AS w FROM p), c AS (SELECT id, CASE WHEN w*a > 16 THEN 16/a ELSE w END AS w, least(16e0, w*a) AS h FROM a) SELECT id, CAST(least(4800, greatest(1, round_even(w*300, 0))) AS INT) AS tw, CAST(least(4800, greatest(1, round_even(h*300, 0))) AS INT) AS th FROM c",
    "print_fit": f"WITH {_P}, a AS (SELECT id, (20+r)/CAST(20+g AS DOUBLE) AS a, CASE WHEN id%5 <> 0 THEN b%20+1e0 END AS bw, CASE WHEN id%7 <> 0 THEN b%15+1e0 END AS bh FROM p), c AS (SELECT *, coalesce(abs(bw/bh-a)/a <= 0.01e0, false) AS fits FROM a), e AS (SELECT id, CASE WHEN fits THEN bw WHEN bw IS NULL AND bh IS NULL THEN 10e0 WHEN bw IS NULL THEN bh*a WHEN bh IS NULL THEN bw ELSE least(bw, bh*a) END AS w, a, CASE WHEN fits THEN bh END AS own FROM c) SELECT id, CAST(floor(w*1000+0.5) AS BIGINT) AS w, CAST(floor(coalesce(own, w/a)*1000+0.5) AS BIGINT) AS h FROM e",
    "mark_budget": f"WITH {_P}, a AS (SELECT id, 200+r*12 AS w, 150+g*10 AS h, 0.5e0+(b%40)/8e0 AS cell, ['dot','line','crosshatch','mesh','fm','grain'][id%6+1] AS kind FROM p), n AS (SELECT id, kind, CAST(CASE kind WHEN 'fm' THEN ceil(w/(greatest(1.2e0, cell*0.42e0)*1.85e0))*ceil(h/(greatest(1.2e0, cell*0.42e0)*1.85e0)) WHEN 'grain' THEN ceil(w/(greatest(1.2e0, cell*0.35e0)*1.6e0))*ceil(h/(greatest(1.2e0, cell*0.35e0)*1.6e0)) WHEN 'mesh' THEN 2*(floor((w+2*cell)/cell+1e-9)+1)*(floor((h+2*cell)/cell+1e-9)+1) WHEN 'crosshatch' THEN 2*{_GRID.format('radians(30)')} ELSE {_GRID.format('radians(30)')} END AS BIGINT) AS marks FROM a) SELECT id, kind, marks, CASE WHEN marks > 600000 THEN 'That size and LPI would need ' || marks || ' dots (limit 600000). Lower the LPI or print size.' END AS error FROM n",
    "warm_fill": f"WITH {_P}, n(ord, name, pr, pg, pb) AS (VALUES {', '.join(str((i, n, int(h[1:3], 16), int(h[3:5], 16), int(h[5:], 16))) for i, (n, h) in enumerate(NAMED))}), u AS (SELECT id AS key, r, g, b FROM p UNION ALL SELECT -1-ord, pr, pg, pb FROM n), l AS (SELECT key, {_LIN.format('r')} AS lr, {_LIN.format('g')} AS lg, {_LIN.format('b')} AS lb FROM u), t AS (SELECT key, (lr*0.4124564e0+lg*0.3575761e0+lb*0.1804375e0)/0.95047e0 AS tx, (lr*0.2126729e0+lg*0.7151522e0+lb*0.0721750e0)/1e0 AS ty, (lr*0.0193339e0+lg*0.1191920e0+lb*0.9503041e0)/1.08883e0 AS tz FROM l), f AS (SELECT key, {_F.format('tx')} AS fx, {_F.format('ty')} AS fy, {_F.format('tz')} AS fz FROM t), m AS (SELECT key, 116*fy-16 AS l1, 500*(fx-fy) AS a1, 200*(fy-fz) AS b1 FROM f), d AS (SELECT p.id, n.name, n.ord, r > g AND r > b AND r > 80 AS warm, pb > pr+20 AND pb > pg+10 AS blue, (x.l1-y.l1)*(x.l1-y.l1)+(x.a1-y.a1)*(x.a1-y.a1)+(x.b1-y.b1)*(x.b1-y.b1) AS d FROM p JOIN m x ON x.key = p.id, n JOIN m y ON y.key = -1-n.ord) SELECT id, CASE WHEN any_value(warm) THEN arg_min(name, {{'d': d, 'o': ord}}) FILTER (NOT blue) ELSE arg_min(name, {{'d': d, 'o': ord}}) END AS name FROM d GROUP BY id",
    "thread_swap": "WITH a(ord, layer, place, hex) AS (VALUES (0, 3, NULL, '#111111'), (1, NULL, 2, '#222222'), (2, 5, 1, '#333333'), (3, 2, 0, '#444444')), s AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 <> 0 THEN l_partkey % 7 ELSE l_linenumber END AS layer FROM lineitem) SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, coalesce((SELECT arg_min(hex, ord) FROM a WHERE a.layer = s.layer OR a.place = s.l_linenumber), '#000000') AS hex FROM s",
    "thread_consolidate": "WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS area, coalesce(CASE WHEN l_suppkey % 4 <> 0 THEN CAST(l_suppkey % 3 AS VARCHAR) END, '#' || l_partkey % 3) AS spool FROM lineitem) SELECT l_orderkey, spool, CAST(sum(area) AS BIGINT) AS area, count(*) AS layers, arg_max(l_linenumber, area*1000-l_linenumber) AS first FROM l GROUP BY 1, 2",
    "palettes": "SELECT 'parts' AS palette, upper(p_brand) AS code FROM part UNION SELECT 'makers', 'BRAND#' || s_nationkey % 9 FROM supplier",
    "paint_order": "SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place FROM lineitem",
    "preview_rows": "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 36",
    "split_satin": f"WITH {_S}, n AS (SELECT *, CAST(CASE WHEN sqrt((x-px)*(x-px)+(y-py)*(y-py)) > 30 THEN ceil(sqrt((x-px)*(x-px)+(y-py)*(y-py))/30e0) ELSE 1 END AS BIGINT) AS n FROM q WHERE px IS NOT NULL), k AS (SELECT *, unnest(range(1, n+1)) AS k FROM n), t AS (SELECT *, CASE WHEN k = n THEN 1e0 ELSE k/CAST(n AS DOUBLE)+((seq-1)%3-1)*0.12e0/n END AS t FROM k) SELECT design, seq, k, CAST(floor((px+(x-px)*t)*100+0.5) AS BIGINT) AS x, CAST(floor((py+(y-py)*t)*100+0.5) AS BIGINT) AS y FROM t",
    "stones_csv": f"WITH {_ST} SELECT sheet, 'x_in,y_in,ss,mm,color_name,hex' || chr(10) || string_agg({_IN.format('x')} || ',' || {_IN.format('y')} || ',' || ss || ',' || regexp_replace(CAST(mm AS VARCHAR), '\\.0$', '') || ',' || CASE WHEN contains(name, ',') THEN '\"' || replace(name, '\"', '\"\"') || '\"' ELSE name END || ',' || hex || chr(10), '' ORDER BY id) AS csv FROM st GROUP BY sheet",
    "stones_plt": f"WITH {_ST}, c AS (SELECT sheet, id, CAST(floor(x/1e4*1016+0.5) AS BIGINT) || ',' || CAST(floor((6-y/1e4)*1016+0.5) AS BIGINT) AS spot FROM st) SELECT sheet, 'IN;' || chr(10) || 'SP1;' || chr(10) || string_agg('PU' || spot || ';' || chr(10) || 'PD' || spot || ';' || chr(10), '' ORDER BY id) || 'PU;' || chr(10) || 'SP0;' || chr(10) AS plt FROM c GROUP BY sheet",
    "stones_svg": f"WITH {_ST} SELECT sheet, '<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"8in\" height=\"6in\" viewBox=\"0 0 8 6\">' || chr(10) || '  <rect width=\"8\" height=\"6\" fill=\"#f4f4f1\"/>' || string_agg(chr(10) || '  <circle cx=\"' || {_IN.format('x')} || '\" cy=\"' || {_IN.format('y')} || '\" r=\"' || {_IN.format('floor(mm/2/25.4e0*10000+0.5)')} || '\" fill=\"' || hex || '\" stroke=\"#222\" stroke-width=\"0.005\"/>', '' ORDER BY id) || chr(10) || '</svg>' || chr(10) AS svg FROM st GROUP BY sheet",
    "suggested_width": f"WITH {_P} SELECT id, CAST(ceil(CASE WHEN id%3 = 0 THEN r/37e0 ELSE g/29e0 END/0.25e0-1e-9)*25 AS BIGINT) AS hundredths, id%3 = 0 AS by_lettering FROM p",
    "complexity_level": f"WITH {_P}, s AS (SELECT id, round_even(round((0.22e0*greatest(0e0, least(10e0, (r-45)/5e0))+0.50e0*greatest(0e0, least(10e0, (g/1000e0-0.10e0)/0.012e0))+0.10e0*greatest(0e0, least(10e0, (b/1500e0-0.045e0)/0.012e0))+0.12e0*greatest(0e0, least(10e0, (r/2000e0-0.035e0)/0.008e0))+0.06e0*greatest(0e0, least(10e0, CASE WHEN id%2 = 0 THEN g/3000e0/0.03e0*6+3 ELSE g/3000e0/0.08e0*4 END)))*10, 6), 0) AS tenths FROM p) SELECT id, CAST(tenths AS BIGINT) AS tenths, CASE WHEN tenths >= 75 THEN 'too_busy' WHEN tenths >= 40 THEN 'busy' ELSE 'ok' END AS level FROM s",
}

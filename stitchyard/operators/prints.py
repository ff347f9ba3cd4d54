"""Print preparation: names, labels, file heads, masks, previews and caches (A38, C04, C10, C11, C12 hash, C13, C17, C23, F04, K16, L37, L50, P19, P20, S08, S09, W08)."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stitchyard.functions import color, money
from stitchyard.operators import images
from stitchyard.operators.folds import folded
from stitchyard.operators.stitch import order, stream
from stitchyard.sources.tables import kind_of, png_dims, table

#: The properties of a drawing that hold a paint.
PAINTED = ["fill", "stroke", "stop-color", "flood-color", "lighting-color", "color"]
#: A paint is a hex colour of six or three digits or three numbers of rgb; it follows its property as an attribute or in a style.
_HEX = "#(?:" + "|".join(f"[0-9a-f]{{{n}}}" for n in (6, 3)) + ")"
_RGB = r"rgb\(" + ",".join([r"\s*\d+\s*"] * 3) + r"\)"
PAINT = rf"(?i)((?:{'|'.join(PAINTED)})\s*[:=]\s*[\"']?)({_HEX}|{_RGB})"


def inverted_paint(c: Column) -> Column:
    """The opposite of ``#rrggbb``, ``#rgb`` or ``rgb(r, g, b)``."""
    h = F.when(F.length(c) == 4, F.concat(F.lit("#"), *[F.repeat(F.substring(c, i, 1), 2) for i in (2, 3, 4)])).otherwise(c)
    number = lambda i: (255 - F.get(F.split(F.regexp_replace(c, r"[^\d,]", ""), ","), F.lit(i)).cast("int")).cast("string")
    return F.when(c.startswith("#"), color.to_hex(*[255 - color.channel(h, i) for i in range(3)])).otherwise(F.concat(F.lit("rgb("), F.concat_ws(",", *[number(i) for i in range(3)]), F.lit(")")))


def svg_invert(spark: SparkSession, d: str) -> DataFrame:
    """C17: every paint of a drawing by its opposite, the rest untouched."""
    k = F.col("p_partkey")
    hexed = F.lower(F.lpad(F.hex(k * 4099 % 16_777_216), 6, "0"))
    svg = F.concat(F.lit('<path fill="#'), hexed, F.lit('" stroke = \'#a0F\' d="M0 0"/><g style="color:rgb( '), (k % 256).cast("string"), F.lit(' , 20,255 );fill:none"><text>#ffffff</text></g>'))
    parts, paints, heads = F.split("svg", PAINT, -1), F.regexp_extract_all("svg", F.lit(PAINT), F.lit(2)), F.regexp_extract_all("svg", F.lit(PAINT), F.lit(1))
    new = F.array_join(F.transform(F.arrays_zip(parts.alias("a"), heads.alias("h"), paints.alias("c")), lambda q: F.concat(q.a, F.coalesce(q.h, F.lit("")), F.when(q.c.isNull(), "").otherwise(inverted_paint(q.c)))), "")
    return table(spark, d, "part").select("p_partkey", svg.alias("svg")).select("p_partkey", new.alias("svg"))


def lab_opencv(r: Column, g: Column, b: Column) -> list[Column]:
    """Float Lab with the matrix and white point of the image library."""
    lin = [F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))) for c in (r, g, b)]
    x, y, z = ((lin[0] * p + lin[1] * q + lin[2] * s) / white for p, q, s, white in ((0.412453, 0.357580, 0.180423, 0.950456), (0.212671, 0.715160, 0.072169, 1.0), (0.019334, 0.119193, 0.950227, 1.088754)))
    f = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116)
    return [F.when(y > 0.008856, 116 * F.cbrt(y) - 16).otherwise(903.3 * y), 500 * (f(x) - f(y)), 200 * (f(y) - f(z))]


def lab_8bit(spark: SparkSession, d: str) -> DataFrame:
    """Lab in bytes: lightness up to 255, the others around 128."""
    k = F.col("p_partkey")
    one = lab_opencv(*[(k * m % 256).cast("double") for m in (37, 91, 151)])
    byte = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), c)) + 0.5).cast("int")
    return table(spark, d, "part").select("p_partkey", byte(one[0] * 2.55).alias("l"), byte(one[1] + 128).alias("a"), byte(one[2] + 128).alias("b"))


def slider_values(spark: SparkSession, d: str) -> DataFrame:
    """C11: a slider of 0 to 100, clamped, between two ends."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("p_size") * 3 - 20) / 100.0))
    return table(spark, d, "part").select("p_partkey", F.floor((2.0 + (14.0 - 2.0) * t) * 1000 + 0.5).cast("long").alias("colours"), F.floor((3.0 + (0.4 - 3.0) * t) * 1000 + 0.5).cast("long").alias("tolerance"))


def claim_hash(spark: SparkSession, d: str) -> DataFrame:
    """The hash under which a device's or an address's claim is kept."""
    return table(spark, d, "customer").select("c_custkey", F.sha2(F.concat(F.lit("dcp-free1:"), "c_name"), 256).alias("device"))


def design_names(spark: SparkSession, d: str) -> DataFrame:
    """The slug of a code, and a machine's name of at most 16 characters."""
    title = F.concat(F.lit("Été/"), "p_name", F.lit(": "), "p_type")
    clean = F.substring(F.regexp_replace(title, r"[^A-Za-z0-9_\- ]+", ""), 1, 16)
    bare = F.when(F.col("p_size") % 10 == 0, F.lit("DESIGN")).otherwise(clean)
    return table(spark, d, "part").select("p_partkey", F.upper(F.regexp_replace("p_name", "[^A-Za-z0-9]+", "")).alias("slug"), bare.alias("design"))


def props_json(spark: SparkSession, d: str) -> DataFrame:
    """A value read from JSON text, and the text written again with another."""
    k = F.from_json("props", "k long").getField("k")
    return table(spark, d, "events").select("event_id", F.coalesce(k, F.lit(-1)).alias("k"), F.to_json(F.struct((k + 1).alias("k"), "event_type")).alias("json"))


def price_labels(spark: SparkSession, d: str) -> DataFrame:
    """Cents as a label, without decimals where they are none; a price that is unset or 0 has the default."""
    cents = F.when(F.col("p_size") % 3 == 0, F.col("p_size") * 100).when(F.col("p_size") % 3 == 1, F.col("p_size") * 7).otherwise(F.when(F.col("p_size") % 2 == 0, 0)).cast("double")
    return table(spark, d, "part").select("p_partkey", money.dollars(money.truthy_or(cents, F.lit(7900.0))).alias("label"))


def _heads(spark: SparkSession, d: str) -> DataFrame:
    """The first bytes of files of five kinds; PNG heads have a size."""
    k = F.col("p_partkey")
    big = lambda c: F.lpad(F.hex(c), 8, "0")
    head = F.when(k % 5 == 0, F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(k * 13 % 5000 + 1), big(k * 7 % 4500 + 1), F.lit("0806000000"))).when(k % 5 == 1, "FFD8FFE000104A464946").when(k % 5 == 2, "52494646AABBCCDD57454250").when(k % 5 == 3, F.hex(F.lit('<?xml version="1.0"?> <SVG width="1">'))).otherwise(F.hex(F.lit("plain words of a text")))
    return table(spark, d, "part").select("p_partkey", F.unhex(head).alias("content"))


def file_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of files by their first bytes."""
    return _heads(spark, d).select("p_partkey", F.coalesce(kind_of(F.col("content")), F.lit("none")).alias("kind"))


def size_guard(spark: SparkSession, d: str) -> DataFrame:
    """Sizes from the heads of PNG files alone, and what is done with large ones: scaled down over 4000 an edge or 12 MB, refused over 16 megapixels in the query."""
    p = _heads(spark, d).filter(kind_of(F.col("content")) == "png")
    w, h = png_dims(F.col("content"))
    size = (F.col("p_partkey") * 9973 % (16 << 20)).alias("bytes")
    q = p.select("p_partkey", w.alias("w"), h.alias("h"), size)
    route = F.when(F.col("w").cast("long") * F.col("h") > 16_000_000, "refused").when((F.greatest("w", "h") > 4000) | (F.col("bytes") > 12 * 1024 * 1024), "scaled").otherwise("as it is")
    return q.select("p_partkey", "w", "h", route.alias("route"))


def mask_select(spark: SparkSession, d: str) -> DataFrame:
    """The mask of an image: its alpha if some of it is clear, else its dark pixels if they are some and not nearly all, else the light ones."""
    p = images.pictures(spark, d).withColumn("a", F.expr("transform(inside, v -> if(id % 3 = 0, v * 255, 255))")).withColumn("lum", F.expr("transform(arrays_zip(r, g, b), q -> 0.299D * (q.r / if(id % 3 = 1, 1, 4) + if(id % 3 = 1, 0, 190)) + 0.587D * q.g / if(id % 3 = 1, 1, 4) + 0.114D * q.b / if(id % 3 = 1, 1, 4))"))
    x = images.pixels(p, "a", "lum")
    seen = F.col("a") > 12
    n = x.groupBy("id").agg(F.count_if(seen).alias("opaque"), F.count_if(seen & (F.col("lum") < 200)).alias("dark"), F.count_if(seen & (F.col("lum") > 80)).alias("light"), F.count("*").alias("n"))
    by_alpha, by_dark = (F.col("opaque") / F.col("n") < 0.97) & (F.col("opaque") > 20), (F.col("dark") > 20) & (F.col("dark") < F.col("opaque") * 0.95)
    return n.select("id", F.when(by_alpha, "alpha").when(by_dark, "dark").otherwise("light").alias("mask"), F.when(by_alpha, F.col("opaque")).when(by_dark, F.col("dark")).otherwise(F.col("light")).alias("pixels"))


def background_rule(spark: SparkSession, d: str) -> DataFrame:
    """Background by the flood, or by a sure guess near the paper, but not where the guess is surely the subject and the colour isn't very near."""
    k = F.col("p_partkey")
    flood, prob, ds, db = k % 3 == 0, k * 37 % 100 / 100.0, k * 13 % 40, k * 7 % 30
    bg = (flood | ((prob < 0.15) & (ds <= 22) & (db <= 18))) & ~((prob > 0.6) & (ds > 18))
    return table(spark, d, "part").select("p_partkey", bg.alias("background"))


def color_stops(spark: SparkSession, d: str) -> DataFrame:
    """The stops of threads: layer or else position, and the source colour or else the thread's."""
    line = F.col("l_linenumber")
    code = F.concat(F.lit("#"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 6, "0"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.when(F.col("l_suppkey") % 3 != 0, (F.col("l_suppkey") % 9).cast("int")).otherwise(line).alias("index"), F.coalesce(F.when(F.col("l_suppkey") % 2 == 0, F.lit("#123456")), code).alias("source"))


def preview_points(spark: SparkSession, d: str, cap: int = 20) -> DataFrame:
    """The points of a preview; of a design over the cap only every n-th stitch, but all jumps and trims, each with its colour's number."""
    w = W.partitionBy("design")
    s = stream(spark, d).withColumn("n", F.count("*").over(w)).withColumn("color", F.sum(F.when(F.col("kind") == "color", 1).otherwise(0)).over(order()))
    stride = F.when(F.col("n") > cap, F.ceil(F.col("n") / cap)).otherwise(1)
    return s.filter("kind <> 'color'").filter((F.col("kind") != "stitch") | ((F.col("seq") - 1) % stride == 0)).select("design", "seq", "x", "y", "kind", F.col("color").cast("long").alias("color"))


def square_fit(spark: SparkSession, d: str) -> DataFrame:
    """A design centred in a square of its longer side and scaled to 4 inches."""
    b = stream(spark, d).groupBy("design").agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    s = b.select("design", *[(F.col(f"lo{c}") - 1).alias(f"lo{c}") for c in "xy"], *[(F.col(f"hi{c}") - F.col(f"lo{c}") + 2).alias(f"w{c}") for c in "xy"]).withColumn("side", F.greatest("wx", "wy"))
    at = lambda c: F.floor((F.col(c) - (F.col(f"lo{c}") - (F.col("side") - F.col(f"w{c}")) / 2.0)) * (4.0 / F.col("side")) * 10_000 + 0.5).cast("long").alias(c)
    return stream(spark, d).join(s, "design").select("design", "seq", at("x"), at("y"))


class Cache:
    """entries live for ``ttl`` from when they were put; together they hold at most ``most`` bytes, and the one used longest ago makes room."""

    def __init__(self, ttl: float, most: int):
        self.ttl, self.most = ttl, most
        self.held: dict = {}  # key -> (bytes, when put, turn of the last use)
        self.turn = 0

    @property
    def used(self) -> int:
        return sum(size for size, _, _ in self.held.values())

    def _expire(self, now: float) -> None:
        self.held = {k: e for k, e in self.held.items() if now - e[1] <= self.ttl}

    def get(self, key, now: float) -> bool:
        self._expire(now)
        self.turn += 1
        if hit := key in self.held:
            size, since, _ = self.held[key]
            self.held[key] = size, since, self.turn
        return hit

    def put(self, key, size: int, now: float) -> None:
        self._expire(now)
        self.turn += 1
        if 0 < size <= self.most:
            self.held.pop(key, None)
            while self.used + size > self.most:
                del self.held[min(self.held, key=lambda k: self.held[k][2])]
            self.held[key] = size, now, self.turn


def preview_cache(spark: SparkSession, d: str) -> DataFrame:
    """F04 for each user: whether a request finds its preview; one that doesn't puts it there."""

    def begin():
        cache = Cache(200_000, 40)

        def step(r: dict) -> tuple:
            now = r["us"] / 1e6
            hit = cache.get(r["key"], now)
            if not hit:
                cache.put(r["key"], r["size"], now)
            return r["event_id"], hit

        return step

    rows = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_id") % 5).alias("key"), (F.col("event_id") % 5 * 6 + 3).alias("size"))
    return folded(rows, "user_id", ["us", "event_id"], "event_id long, hit boolean", begin)


def chamfer(mask: np.ndarray) -> np.ndarray:
    """Steps of 1 and 1.414 to the nearest pixel outside of the mask, in two passes over the rows."""
    out = np.where(mask, 1e9, 0.0)
    w = np.arange(mask.shape[1])
    for a in (out, out[::-1, ::-1]):  # the second pass is the first, turned around
        before = np.full(len(w), 1e9)
        for row, inside in zip(a, mask if a is out else mask[::-1, ::-1], strict=True):
            near = np.minimum(row, before + 1)
            near[1:] = np.minimum(near[1:], before[:-1] + 1.414)
            near[:-1] = np.minimum(near[:-1], before[1:] + 1.414)
            row[:] = np.where(inside, np.minimum.accumulate(np.where(inside, near, 0.0) - w) + w, 0.0)
            before = row
    return out


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, w, h, inside in zip(*(b.column(c).to_pylist() for c in ("id", "w", "h", "inside")), strict=True):
            mask = np.array(inside, bool).reshape(h, w)
            y, x = np.nonzero(mask)
            far = np.floor(chamfer(mask)[y, x] * 1000 + 0.5).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(far)], names=["id", "x", "y", "distance"])


def distance_transform(spark: SparkSession, d: str) -> DataFrame:
    """W08 of the masks of all images, an image at a time."""
    return images.pictures(spark, d).select("id", "w", "h", "inside").mapInArrow(_distances, "id long, x int, y int, distance long")


QUERIES = [svg_invert, lab_8bit, slider_values, claim_hash, design_names, props_json, price_labels, file_kinds, size_guard, mask_select, background_rule, color_stops, preview_points, square_fit, preview_cache, distance_transform]
_LIN = "CASE WHEN {0}/255e0 <= 0.04045e0 THEN {0}/255e0/12.92e0 ELSE pow(({0}/255e0+0.055e0)/1.055e0, 2.4e0) END"
_F = "CASE WHEN {0} > 0.008856e0 THEN cbrt({0}) ELSE 7.787e0*({0})+16e0/116 END"
_S = "s AS (SELECT user_id AS design, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, CASE event_type WHEN 'signup' THEN 'color' WHEN 'error' THEN 'trim' WHEN 'view' THEN 'jump' ELSE 'stitch' END AS kind, CAST(floor(coalesce(value, 0)) AS BIGINT) AS x, event_id % 97 AS y FROM events)"
_BYTE = "CAST(floor(greatest(0e0, least(255e0, {0}))+0.5) AS INT)"
_LUM = "CASE WHEN id%3 = 1 THEN 0.299e0*r+0.587e0*g+0.114e0*b ELSE 0.299e0*(r/4e0+190)+0.587e0*g/4e0+0.114e0*b/4e0 END"
SQL = {
    "svg_invert": "SELECT p_partkey, '<path fill=\"#' || lower(format('{:06X}', 16777215 - p_partkey*4099%16777216)) || '\" stroke = ''#55ff00'' d=\"M0 0\"/><g style=\"color:rgb(' || (255 - p_partkey%256) || ',235,0);fill:none\"><text>#ffffff</text></g>' AS svg FROM part",
    "lab_8bit": f"WITH p AS (SELECT p_partkey, p_partkey*37%256 AS r, p_partkey*91%256 AS g, p_partkey*151%256 AS b FROM part), l AS (SELECT p_partkey, {_LIN.format('r')} AS lr, {_LIN.format('g')} AS lg, {_LIN.format('b')} AS lb FROM p), t AS (SELECT p_partkey, (lr*0.412453e0+lg*0.357580e0+lb*0.180423e0)/0.950456e0 AS tx, (lr*0.212671e0+lg*0.715160e0+lb*0.072169e0)/1e0 AS ty, (lr*0.019334e0+lg*0.119193e0+lb*0.950227e0)/1.088754e0 AS tz FROM l), f AS (SELECT p_partkey, ty, {_F.format('tx')} AS fx, {_F.format('ty')} AS fy, {_F.format('tz')} AS fz FROM t) SELECT p_partkey, {_BYTE.format('(CASE WHEN ty > 0.008856e0 THEN 116*cbrt(ty)-16 ELSE 903.3e0*ty END)*2.55e0')} AS l, {_BYTE.format('500*(fx-fy)+128')} AS a, {_BYTE.format('200*(fy-fz)+128')} AS b FROM f",
    "slider_values": "WITH t AS (SELECT p_partkey, greatest(0e0, least(1e0, (p_size*3-20)/100e0)) AS t FROM part) SELECT p_partkey, CAST(floor((2e0+(14e0-2e0)*t)*1000+0.5) AS BIGINT) AS colours, CAST(floor((3e0+(0.4e0-3e0)*t)*1000+0.5) AS BIGINT) AS tolerance FROM t",
    "claim_hash": "SELECT c_custkey, sha256('dcp-free1:' || c_name) AS device FROM customer",
    "design_names": "SELECT p_partkey, upper(replace(p_name, ' ', '')) AS slug, CASE WHEN p_size % 10 = 0 THEN 'DESIGN' ELSE left('t' || p_name || ' ' || p_type, 16) END AS design FROM part",
    "props_json": "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k, '{' || coalesce('\"k\":' || (CAST(json_extract(props, '$.k') AS BIGINT)+1) || ',', '') || '\"event_type\":\"' || event_type || '\"}' AS json FROM events",
    "price_labels": "WITH c AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size*100 WHEN p_size % 3 = 1 THEN p_size*7 ELSE 0 END AS n FROM part), d AS (SELECT p_partkey, CASE WHEN n = 0 THEN 7900 ELSE n END AS n FROM c) SELECT p_partkey, '$' || CASE WHEN n % 100 = 0 THEN CAST(n//100 AS VARCHAR) ELSE format('{:.2f}', n/1e2) END AS label FROM d",
    "file_kinds": "SELECT p_partkey, ['png', 'jpeg', 'webp', 'svg', 'none'][p_partkey % 5 + 1] AS kind FROM part",
    "size_guard": "WITH p AS (SELECT p_partkey, CAST(p_partkey*13%5000+1 AS INT) AS w, CAST(p_partkey*7%4500+1 AS INT) AS h, p_partkey*9973%16777216 AS n FROM part WHERE p_partkey % 5 = 0) SELECT p_partkey, w, h, CASE WHEN w::BIGINT*h > 16000000 THEN 'refused' WHEN greatest(w, h) > 4000 OR n > 12582912 THEN 'scaled' ELSE 'as it is' END AS route FROM p",
    "mask_select": f"WITH {images._IMG}, z AS (SELECT id, id%3 <> 0 OR inside AS seen, {_LUM} AS lum FROM img), n AS (SELECT id, count(*) FILTER (seen) AS o, count(*) FILTER (seen AND lum < 200) AS k, count(*) FILTER (seen AND lum > 80) AS l, count(*) AS n FROM z GROUP BY id), m AS (SELECT *, CASE WHEN o/CAST(n AS DOUBLE) < 0.97e0 AND o > 20 THEN 'alpha' WHEN k > 20 AND k < o*0.95e0 THEN 'dark' ELSE 'light' END AS mask FROM n) SELECT id, mask, CASE mask WHEN 'alpha' THEN o WHEN 'dark' THEN k ELSE l END AS pixels FROM m",
    "background_rule": "WITH p AS (SELECT p_partkey, p_partkey%3 = 0 AS flood, p_partkey*37%100/100e0 AS prob, p_partkey*13%40 AS ds, p_partkey*7%30 AS db FROM part) SELECT p_partkey, CASE WHEN prob > 0.6e0 AND ds > 18 THEN false ELSE flood OR (prob < 0.15e0 AND ds <= 22 AND db <= 18) END AS background FROM p",
    "color_stops": "SELECT l_orderkey, l_partkey, CAST(CASE WHEN l_suppkey%3 <> 0 THEN l_suppkey%9 ELSE l_linenumber END AS INT) AS \"index\", CASE WHEN l_suppkey%2 = 0 THEN '#123456' ELSE '#' || lpad(CAST(l_partkey%1000 AS VARCHAR), 6, '0') END AS source FROM lineitem",
    "preview_points": f"WITH {_S}, n AS (SELECT *, count(*) OVER (PARTITION BY design) AS n, CAST(sum(CASE WHEN kind = 'color' THEN 1 ELSE 0 END) OVER (PARTITION BY design ORDER BY seq) AS BIGINT) AS color FROM s) SELECT design, seq, x, y, kind, color FROM n WHERE kind <> 'color' AND (kind <> 'stitch' OR (seq-1) % CASE WHEN n > 20 THEN (n+19)//20 ELSE 1 END = 0)",
    "square_fit": f"WITH {_S}, b AS (SELECT design, min(x)-1 AS lx, min(y)-1 AS ly, max(x)-min(x)+2 AS wx, max(y)-min(y)+2 AS wy FROM s GROUP BY 1), c AS (SELECT design, lx, ly, wx, wy, greatest(wx, wy) AS side FROM b) SELECT design, seq, CAST(floor((x-(lx-(side-wx)/2e0))*(4e0/side)*10000+0.5) AS BIGINT) AS x, CAST(floor((y-(ly-(side-wy)/2e0))*(4e0/side)*10000+0.5) AS BIGINT) AS y FROM s JOIN c USING (design)",
    "distance_transform": f"WITH {images._IMG}, d AS (SELECT a.id, a.x, a.y, abs(a.x-b.x) AS dx, abs(a.y-b.y) AS dy FROM img a JOIN img b ON a.id = b.id AND a.inside AND NOT b.inside) SELECT id, x, y, CAST(floor(min(greatest(dx, dy)-least(dx, dy)+1.414e0*least(dx, dy))*1000+0.5) AS BIGINT) AS distance FROM d GROUP BY ALL",
}

"""Flat tones of hue families over keyed images.

Families are told by histograms of a channel's 256 values, so that what decides tones is bounded, however large images are; medians,
spreads and peaks come from whole numbers.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchyard.operators.images import _IMG, pictures, pixels

# Fixed values of the rule: saturation under which a pixel is neutral, families and their least pixels, tones of value and saturation, the least
# gap of two tones, the spread from which there are several, and the share of a further one in hundredths.
NEUTRAL, FAMILIES, LEAST, TONES, GAP, SPREAD, SHARE = 28, 12, 40, {"v": 3, "s": 2}, 22, 10, 5
_WIDE = 180 // FAMILIES


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """8-bit hue of 180 steps, saturation and value, with quotients in 4096ths as image libraries round them."""
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    d = v - low
    s = F.expr("0").cast("int") + F.when(v == 0, 0).otherwise(F.floor((d * F.floor((2 * 1044480 + v) / (2 * F.greatest(v, F.lit(1)))) + 2048) / 4096))
    turn = F.when(v == r, g - b).when(v == g, b - r + 2 * d).otherwise(r - g + 4 * d)
    h = F.when(d == 0, 0).otherwise(F.floor((turn * F.floor((245760 + F.greatest(d, F.lit(1))) / (2 * F.greatest(d, F.lit(1)))) + 2048) / 4096))
    return F.when(h < 0, h + 180).otherwise(h).cast("int"), s.cast("int"), v.cast("int")


def rgb(h: Column, s: Column, v: Column) -> list[Column]:
    """Back to r, g, b, rounded in whole numbers."""
    f = h % 30
    p, q, t = [F.floor((2 * v * (7650 - s * part) + 7650) / 15300).cast("int") for part in (30, f, 30 - f)]
    sector = F.floor(h / 30) % 6
    pick = lambda *six: F.element_at(F.array(*six), (sector + 1).cast("int"))
    return [pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)]


def _centres(channel: Column) -> Column:
    """The tones of a family's channel: its median if it hardly varies, else peaks of 16 bins that keep their distance, the highest first, the upper of equals."""
    bins = F.transform(F.filter(F.transform("bins", lambda n, k: F.struct(n.alias("n"), k.alias("k"))), lambda z: z["n"] > 0), lambda z: z)
    peaks = F.reverse(F.array_sort(bins))

    def step(got: Column, z: Column) -> Column:
        c = (16 * z["k"] + 8).cast("double")
        free = (F.size(got) == 0) | ((F.size(got) < F.when(channel == "v", TONES["v"]).otherwise(TONES["s"])) & (z["n"] * 100 >= F.col("n") * SHARE) & ~F.exists(got, lambda o: F.abs(o - c) < GAP))
        return F.when(free, F.array_append(got, c)).otherwise(got)

    even = F.col("n") * F.col("s2") - F.col("s1") * F.col("s1") < SPREAD * SPREAD * F.col("n") * F.col("n")
    return F.when(even, F.array("median")).otherwise(F.aggregate(peaks, F.expr("cast(array() as array<double>)"), step))


def posterized(px: DataFrame) -> DataFrame:
    """(id, x, y, r, g, b) flattened: each hue family of forty pixels or more takes its mean hue and few tones, neutrals take grey tones; smaller families stay."""
    h, s, v = hsv(F.col("r"), F.col("g"), F.col("b"))
    p = px.withColumns({"h": h, "s": s, "v": v}).withColumn("family", F.when(F.col("s") < NEUTRAL, -1).otherwise(F.floor(F.col("h") / _WIDE)).cast("int"))
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in "hsv"]))
    values = p.select("id", "family", both.alias("q")).groupBy("id", "family", "q.channel", "q.value").agg(F.count("*").alias("c"))
    of = lambda e: F.sum(e).cast("long")
    bins = F.array(*[of(F.when(F.floor(F.col("value") / 16) == k, F.col("c")).otherwise(0)) for k in range(16)])
    turn = F.radians(F.col("value") * 2.0)
    stats = values.groupBy("id", "family", "channel").agg(of(F.col("c")).alias("n"), of(F.col("c") * F.col("value")).alias("s1"), of(F.col("c") * F.col("value") * F.col("value")).alias("s2"), F.expr("percentile(value, 0.5D, c)").alias("median"), bins.alias("bins"), F.atan2(F.sum(F.col("c") * F.sin(turn)), F.sum(F.col("c") * F.cos(turn))).alias("mean"))
    rule = stats.filter(f"n >= {LEAST} or family = -1").withColumn("tones", _centres(F.col("channel"))).groupBy("id", "family").agg(
        *[F.max(F.when(F.col("channel") == c, F.col("tones"))).alias(f"{c}_tones") for c in "sv"], F.max(F.when(F.col("channel") == "h", F.pmod(F.rint(F.degrees("mean") / 2), F.lit(180.0)))).cast("int").alias("hue")
    )
    nearest = lambda c: F.rint(F.array_min(F.transform(f"{c}_tones", lambda t, k: F.struct(F.abs(t - F.col(c)).alias("d"), k.alias("k"), t.alias("t"))))["t"]).cast("int")
    grey = F.col("family") == -1
    e = p.join(rule, ["id", "family"], "left")
    new = {"h": F.when(grey, 0).otherwise(F.coalesce("hue", "h")), "s": F.when(grey, 0).otherwise(F.coalesce(nearest("s"), F.col("s"))), "v": F.coalesce(nearest("v"), F.col("v"))}
    flat = e.select("id", "x", "y", *[c.cast("int").alias(k) for k, c in new.items()])
    return flat.select("*", *[c.alias(n) for c, n in zip(rgb(F.col("h"), F.col("s"), F.col("v")), "rgb", strict=True)])


def hue_posters(spark: SparkSession, d: str) -> DataFrame:
    """L42 over the pictures."""
    return posterized(pixels(pictures(spark, d), "r", "g", "b"))


def _peaks_sql(k: int) -> str:
    """SQL: the k-th peak of ``st``, by those before it."""
    before = "".join(f" AND abs(b.k-p{j}.k)*16 >= {GAP}" for j in range(1, k))
    joins = "".join(f" JOIN p{j} USING (id, family, ch)" for j in range(1, k))
    more = f" AND b.n*100 >= st.n*{SHARE} AND (ch = 'v' OR {k} <= {TONES['s']})" if k > 1 else ""
    return f"p{k} AS MATERIALIZED (SELECT id, family, ch, arg_max(b.k, b.n*16+b.k) AS k FROM st JOIN bins b USING (id, family, ch){joins} WHERE b.n > 0{before}{more} GROUP BY ALL)"


_SEC = lambda *six: "CASE h//30%6 " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(six)) + " END"
_HSV = f"""hs AS (SELECT id, x, y, r, g, b, greatest(r, g, b) AS v, greatest(r, g, b)-least(r, g, b) AS d FROM img), hq AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE (d*((2*1044480+v)//(2*v))+2048)//4096 END AS s, CASE WHEN d = 0 THEN 0 ELSE CAST(floor(((CASE WHEN v = r THEN g-b WHEN v = g THEN b-r+2*d ELSE r-g+4*d END)*((245760+d)//(2*d))+2048)/4096) AS INT) END AS h0 FROM hs),
 p AS MATERIALIZED (SELECT id, x, y, CASE WHEN h0 < 0 THEN h0+180 ELSE h0 END AS h, s, v, CASE WHEN s < {NEUTRAL} THEN -1 ELSE (CASE WHEN h0 < 0 THEN h0+180 ELSE h0 END)//{_WIDE} END AS family FROM hq)"""
QUERIES = [hue_posters]
SQL = {
    "hue_posters": f"""WITH {_IMG}, {_HSV}, q AS (SELECT id, family, 's' AS ch, s AS value FROM p UNION ALL SELECT id, family, 'v', v FROM p), st AS MATERIALIZED (SELECT id, family, ch, count(*) AS n, sum(value) AS s1, sum(value*value) AS s2, quantile_cont(value, 0.5) AS med FROM q GROUP BY ALL HAVING count(*) >= {LEAST} OR family = -1), bins AS MATERIALIZED (SELECT id, family, ch, value//16 AS k, count(*) AS n FROM q GROUP BY ALL),
 {', '.join(map(_peaks_sql, (1, 2, 3)))}, pk AS (SELECT *, 1 AS o FROM p1 UNION ALL SELECT *, 2 FROM p2 UNION ALL SELECT *, 3 FROM p3), tones AS MATERIALIZED (SELECT id, family, ch, med AS t, 1 AS o FROM st WHERE n*s2-s1*s1 < {SPREAD * SPREAD}*n*n UNION ALL SELECT id, family, ch, 16*k+8, o FROM pk JOIN st USING (id, family, ch) WHERE n*s2-s1*s1 >= {SPREAD * SPREAD}*n*n),
 near AS MATERIALIZED (SELECT q.id, q.family, q.ch, q.value, arg_min(t, {{'d': abs(t-value), 'o': o}}) AS t FROM (SELECT DISTINCT * FROM q) q JOIN tones USING (id, family, ch) GROUP BY ALL), hue AS (SELECT id, family, round_even(degrees(atan2(sum(sin(radians(h*2e0))), sum(cos(radians(h*2e0)))))/2, 0) AS hue FROM p GROUP BY ALL HAVING count(*) >= {LEAST}),
 f AS (SELECT p.id, x, y, CAST(CASE WHEN p.family = -1 THEN 0 ELSE coalesce((hue+180)%180, h) END AS INT) AS h, CAST(CASE WHEN p.family = -1 THEN 0 ELSE coalesce(round_even(a.t, 0), s) END AS INT) AS s, CAST(coalesce(round_even(b.t, 0), v) AS INT) AS v FROM p LEFT JOIN hue ON hue.id = p.id AND hue.family = p.family LEFT JOIN near a ON a.id = p.id AND a.family = p.family AND a.ch = 's' AND a.value = s LEFT JOIN near b ON b.id = p.id AND b.family = p.family AND b.ch = 'v' AND b.value = v),
 z AS (SELECT *, CAST((2*v*(7650-s*30)+7650)//15300 AS INT) AS p0, CAST((2*v*(7650-s*(h%30))+7650)//15300 AS INT) AS q0, CAST((2*v*(7650-s*(30-h%30))+7650)//15300 AS INT) AS t0 FROM f) SELECT id, x, y, h, s, v, {_SEC('v', 'q0', 'p0', 'p0', 't0', 'v')} AS r, {_SEC('t0', 'v', 'v', 'q0', 'p0', 'p0')} AS g, {_SEC('p0', 'p0', 't0', 'v', 'v', 'q0')} AS b FROM z""",
}

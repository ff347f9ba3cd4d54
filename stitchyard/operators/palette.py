"""Colour matching and palettes (J18-J22, C01-C05, and the first steps of A07 and A09)."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchyard.functions import color
from stitchyard.sources.tables import table

#: Names of colours and their hex codes.
NAMED = [("black", "#000000"), ("white", "#ffffff"), ("red", "#e01020"), ("green", "#20a040"), ("blue", "#1040c0"), ("yellow", "#f0d020"), ("orange", "#f08020"), ("navy", "#102050"), ("grey", "#808080"), ("pink", "#f0a0b0")]


#: Vectors of seeds that are broadcast.
MOST_SEEDS = 4096


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """A colour by part, from its key."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", *[((k * m) % 256).cast("int").alias(c) for c, m in (("r", 37), ("g", 91), ("b", 151))])


def named(part: Callable[..., list[Column]]) -> list[tuple[Column, Column, list[Column]]]:
    """Place, name and ``part`` (of r, g, b) of each named colour, as literals: the list is fixed, so that a colour meets it in its own row."""
    rgb = lambda h: [F.lit(int(h[k : k + 2], 16)) for k in (1, 3, 5)]
    return [(F.lit(i).alias("ord"), F.lit(n).alias("name"), part(*rgb(h))) for i, (n, h) in enumerate(NAMED)]


def nearest_palette_rgb(spark: SparkSession, d: str) -> DataFrame:
    """Least squared RGB distance, the first on ties."""
    dist = lambda q: sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip("gb", q[1:], strict=True)), (F.col("r") - q[0]) * (F.col("r") - q[0])).alias("d")
    best = F.least(*[F.struct(dist(q), i, n) for i, n, q in named(lambda *c: list(c))])
    return _parts(spark, d).withColumn("m", best).select("p_partkey", "m.name", F.col("m.d").cast("long").alias("d"))


def _labs(spark: SparkSession, d: str) -> DataFrame:
    """Each part with its Lab."""
    return _parts(spark, d).select("p_partkey", *[x.alias(f"u{k}") for k, x in zip("lab", color.lab(*map(F.col, "rgb")), strict=True)])


def nearest_lab_de76(spark: SparkSession, d: str) -> DataFrame:
    """Least CIE76 distance; distances are in thousandths."""
    p = [F.col(f"u{k}") for k in "lab"]
    dist = lambda q: F.floor(F.sqrt(color.de76_squared(p, q)) * 1000 + 0.5).cast("long").alias("d")
    best = F.least(*[F.struct(dist(q), i, n) for i, n, q in named(color.lab)])
    return _labs(spark, d).withColumn("m", best).select("p_partkey", "m.name", "m.d")


def nearest_de2000_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    """Of the colours within 0.5 of the least CIEDE2000 distance, the nearest in a*b*, the first on ties."""
    p, q = (tuple(F.col(f"{side}{k}") for k in "lab") for side in "uv")
    ab = (p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2])
    names = F.array(*[F.struct(i, n, *[v.alias(f"v{k}") for k, v in zip("lab", q, strict=True)]) for i, n, q in named(color.lab)])
    cross = _labs(spark, d).select("*", F.inline(names))
    cross = cross.select("p_partkey", F.struct(color.de2000(p, q).alias("d"), ab.alias("ab"), "ord", "name").alias("c"))
    near = cross.groupBy("p_partkey").agg(F.collect_list("c").alias("c")).withColumn("least", F.array_min(F.transform("c", lambda x: x.d)))
    best = F.array_min(F.transform(F.filter("c", lambda x: x.d <= F.col("least") + 0.5), lambda x: F.struct(x.ab, x.ord, x["name"])))
    return near.select("p_partkey", best["name"].alias("name"))


def cmyk_describe(spark: SparkSession, d: str) -> DataFrame:
    """Hex and CMYK of a colour."""
    p = _parts(spark, d)
    return p.select("p_partkey", color.to_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"), *[x.alias(n) for n, x in zip("cmyk", color.cmyk(F.col("r"), F.col("g"), F.col("b")), strict=True)])


def popularity_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A07, first half: five bits a channel, with counts and mean colours."""
    p = _parts(spark, d)
    bin_ = F.shiftright("r", 3) * 1024 + F.shiftright("g", 3) * 32 + F.shiftright("b", 3)
    return p.groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"), *[F.floor(F.avg(c) + 0.5).cast("long").alias(c) for c in "rgb"])


def nearest_embedding(spark: SparkSession, d: str) -> DataFrame:
    """J22 in general: the nearest of the first vectors of each label, by squared distance in integers. Products are single, as the vectors are."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.floor((x * 1000).cast("float")).cast("long")).alias("v"))
    seeds = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("s")).withColumnRenamed("label", "near")
    if e.agg(F.countDistinct("label")).first()[0] <= MOST_SEEDS:
        seeds = F.broadcast(seeds)
    dist = F.aggregate(F.zip_with("v", "s", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    return e.crossJoin(seeds).withColumn("d", dist).groupBy("vec_id").agg(F.min_by("near", F.struct("d", "near")).alias("near"), F.min("d").alias("d"))


def kmeans_assign_step(spark: SparkSession, d: str) -> DataFrame:
    """A09, one step: sizes of the clusters after the assignment."""
    return nearest_embedding(spark, d).groupBy("near").agg(F.count("*").alias("n"))


_VALUES = ", ".join(f"({i}, '{n}', {int(h[1:3], 16)}, {int(h[3:5], 16)}, {int(h[5:], 16)})" for i, (n, h) in enumerate(NAMED))
_CTE = f"WITH p AS (SELECT p_partkey, CAST(p_partkey*37%256 AS INT) AS r, CAST(p_partkey*91%256 AS INT) AS g, CAST(p_partkey*151%256 AS INT) AS b FROM part), n(ord, name, pr, pg, pb) AS (VALUES {_VALUES})"


def _lab_sql(r: str, g: str, b: str, to: str) -> str:
    lin = [f"(CASE WHEN {c}/255.0e0 <= 0.04045e0 THEN {c}/255.0e0/12.92e0 ELSE pow(({c}/255.0e0+0.055e0)/1.055e0, 2.4e0) END)" for c in (r, g, b)]
    rows = ((0.4124564, 0.3575761, 0.1804375, 0.95047), (0.2126729, 0.7151522, 0.0721750, 1.0), (0.0193339, 0.1191920, 0.9503041, 1.08883))
    xyz = [f"(({lin[0]}*{a}e0+{lin[1]}*{m}e0+{lin[2]}*{z}e0)/{w}e0)" for a, m, z, w in rows]
    f = [f"(CASE WHEN {t} > 0.008856e0 THEN cbrt({t}) ELSE 7.787e0*{t}+16.0e0/116 END)" for t in xyz]
    return f"116*{f[1]}-16 AS {to}l, 500*({f[0]}-{f[1]}) AS {to}a, 200*({f[1]}-{f[2]}) AS {to}b"


_EMB = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x*1000 AS FLOAT)) AS BIGINT)) AS v FROM embeddings), s AS (SELECT label AS near, arg_min(v, vec_id) AS s FROM e GROUP BY 1), x AS (SELECT vec_id, near, CAST(list_sum(list_transform(list_zip(v, s), lambda z: (z[1]-z[2])*(z[1]-z[2]))) AS BIGINT) AS d FROM e, s)"
QUERIES = [nearest_palette_rgb, nearest_lab_de76, nearest_de2000_tiebreak, cmyk_describe, popularity_histogram, nearest_embedding, kmeans_assign_step]
SQL = {
    "nearest_palette_rgb": _CTE + ", x AS (SELECT *, (r-pr)*(r-pr)+(g-pg)*(g-pg)+(b-pb)*(b-pb) AS d FROM p, n) SELECT p_partkey, arg_min(name, d*100+ord) AS name, CAST(min(d) AS BIGINT) AS d FROM x GROUP BY 1",
    "nearest_de2000_tiebreak": _CTE + f""", x AS (SELECT *, {_lab_sql('r', 'g', 'b', 'u')}, {_lab_sql('pr', 'pg', 'pb', 'v')} FROM p, n), x1 AS (SELECT *, (sqrt(ua*ua+ub*ub) + sqrt(va*va+vb*vb)) / 2 AS cb FROM x), x2 AS (SELECT *, 1 + 0.5e0 * (1 - sqrt(pow(cb, 7) / (pow(cb, 7) + pow(25e0, 7)))) AS k1 FROM x1), x3 AS (SELECT *, k1*ua AS xu, k1*va AS xv, sqrt(k1*ua*k1*ua+ub*ub) AS cu, sqrt(k1*va*k1*va+vb*vb) AS cv FROM x2),
 x4 AS (SELECT *, CASE WHEN xu = 0 AND ub = 0 THEN 0e0 ELSE degrees(atan2(ub, xu)) + CASE WHEN atan2(ub, xu) < 0 THEN 360 ELSE 0 END END AS hu, CASE WHEN xv = 0 AND vb = 0 THEN 0e0 ELSE degrees(atan2(vb, xv)) + CASE WHEN atan2(vb, xv) < 0 THEN 360 ELSE 0 END END AS hv, (ul+vl)/2 AS lm, (cu+cv)/2 AS cm FROM x3),
 x5 AS (SELECT *, CASE WHEN cu*cv = 0 THEN 0e0 WHEN abs(hv-hu) <= 180 THEN hv-hu WHEN hv > hu THEN hv-hu-360 ELSE hv-hu+360 END AS dh, CASE WHEN cu*cv = 0 THEN hu+hv WHEN abs(hu-hv) <= 180 THEN (hu+hv)/2 WHEN hu+hv < 360 THEN (hu+hv+360)/2 ELSE (hu+hv-360)/2 END AS hm FROM x4),
 x6 AS (SELECT *, (vl-ul) / (1 + 0.015e0*(lm-50)*(lm-50) / sqrt(20+(lm-50)*(lm-50))) AS dl, (cv-cu) / (1 + 0.045e0*cm) AS dc, 2*sqrt(cu*cv)*sin(radians(dh/2)) / (1 + 0.015e0*cm*(1 - 0.17e0*cos(radians(hm-30)) + 0.24e0*cos(radians(2*hm)) + 0.32e0*cos(radians(3*hm+6)) - 0.20e0*cos(radians(4*hm-63)))) AS dd, -sin(radians(60*exp(-((hm-275)/25)*((hm-275)/25)))) * 2 * sqrt(pow(cm, 7) / (pow(cm, 7) + pow(25e0, 7))) AS rt FROM x5),
 y AS (SELECT p_partkey, name, ord, (ua-va)*(ua-va)+(ub-vb)*(ub-vb) AS ab, sqrt(dl*dl + dc*dc + dd*dd + rt*dc*dd) AS d FROM x6), z AS (SELECT *, min(d) OVER (PARTITION BY p_partkey) AS least_d FROM y) SELECT p_partkey, arg_min(name, {{'ab': ab, 'ord': ord}}) AS name FROM z WHERE d <= least_d + 0.5 GROUP BY 1""",
    "nearest_lab_de76": _CTE + f", x AS (SELECT *, {_lab_sql('r', 'g', 'b', 'u')}, {_lab_sql('pr', 'pg', 'pb', 'v')} FROM p, n), y AS (SELECT *, CAST(floor(sqrt((ul-vl)*(ul-vl)+(ua-va)*(ua-va)+(ub-vb)*(ub-vb))*1000+0.5) AS BIGINT) AS d FROM x) SELECT p_partkey, arg_min(name, d*100+ord) AS name, min(d) AS d FROM y GROUP BY 1",
    "cmyk_describe": _CTE + ", k AS (SELECT *, 1-greatest(r,g,b)/255.0e0 AS kk FROM p) SELECT p_partkey, printf('#%02x%02x%02x', r, g, b) AS hex, CASE WHEN kk >= 0.999 THEN 0e0 ELSE floor((1-r/255.0e0-kk)/(1-kk)*100+0.5) END AS c, CASE WHEN kk >= 0.999 THEN 0e0 ELSE floor((1-g/255.0e0-kk)/(1-kk)*100+0.5) END AS m, CASE WHEN kk >= 0.999 THEN 0e0 ELSE floor((1-b/255.0e0-kk)/(1-kk)*100+0.5) END AS y, CASE WHEN kk >= 0.999 THEN 100e0 ELSE floor(kk*100+0.5) END AS k FROM k",
    "popularity_histogram": _CTE + " SELECT CAST((r>>3)*1024+(g>>3)*32+(b>>3) AS INT) AS bin, count(*) AS n, CAST(floor(avg(r)+0.5) AS BIGINT) AS r, CAST(floor(avg(g)+0.5) AS BIGINT) AS g, CAST(floor(avg(b)+0.5) AS BIGINT) AS b FROM p GROUP BY 1",
    "nearest_embedding": _EMB + " SELECT vec_id, CAST(arg_min(near, d*100+near) AS INT) AS near, min(d) AS d FROM x GROUP BY 1",
    "kmeans_assign_step": _EMB + ", y AS (SELECT vec_id, CAST(arg_min(near, d*100+near) AS INT) AS near FROM x GROUP BY 1) SELECT near, count(*) AS n FROM y GROUP BY 1",
}

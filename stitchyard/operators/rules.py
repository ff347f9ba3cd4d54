"""Workshop rules as columns."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stitchyard.functions import color
from stitchyard.operators.images import _IMG, pictures, pixels
from stitchyard.operators.stitch import stream
from stitchyard.sources.tables import table


def trace_jobs(env: Column, quota_text: Column, cores: Column) -> Column:
    """A set number counts, at least 1; else whole CPUs of the quota within 1 to the cores; else 2."""
    set_ = F.trim(env).try_cast("double")
    part = F.split(F.trim(quota_text), r"\s+")
    quota, period = F.try_element_at(part, F.lit(1)).try_cast("double"), F.try_element_at(part, F.lit(2)).try_cast("double")
    whole = F.least(F.greatest(F.lit(1), F.floor(quota / period)), F.greatest(F.lit(1), F.floor(cores)))
    known = (quota >= 0) & (period > 0)
    return F.when(set_.isNotNull(), F.greatest(F.lit(1), F.floor(set_))).when(known, whole).otherwise(2).cast("long")


def trace_job_slots(spark: SparkSession, d: str) -> DataFrame:
    """C27 on made-up settings of each part."""
    k = F.col("p_partkey")
    env = F.element_at(F.array(F.lit(None), F.lit(""), F.lit(" 6 "), F.lit("nope"), F.lit("0")), (k % 5 + 1).cast("int"))
    quota = F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, "max 100000").when(k % 7 == 2, "100 0").otherwise(F.concat((k % 9 * 50000).cast("string"), F.lit(" 100000")))
    return table(spark, d, "part").select("p_partkey", trace_jobs(env, quota, F.col("p_size") % 8 + 1).alias("slots"))


def password_problem(spark: SparkSession, d: str) -> DataFrame:
    """Shorter than 8, or without a letter or a digit."""
    word = F.expr("substr(c_name, 1 + c_custkey % 10, 5 + c_custkey % 9)")
    bad = (F.length("word") < 8) | ~F.col("word").rlike("[A-Za-z]") | ~F.col("word").rlike("[0-9]")
    return table(spark, d, "customer").select("c_custkey", word.alias("word")).select("c_custkey", bad.alias("refused"))


def free_image_status(spark: SparkSession, d: str) -> DataFrame:
    """Why an account has no free image: admin, used, unverified or a device or address that another account used, in this order."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", (k % 31 == 0).alias("admin"), (F.col("c_acctbal") < 0).alias("used"), (k % 3 == 0).alias("open"), F.when(k % 5 != 0, k % 77).alias("device"), F.when(k % 7 != 0, k % 401).alias("address"))
    out, taken = c, F.lit(False)
    for name in ("device", "address"):
        # who claimed: if it is one account alone, it may be the asking one
        claims = c.filter(f"used and {name} is not null").groupBy(name).agg(F.min("c_custkey").alias(f"{name}_low"), F.max("c_custkey").alias(f"{name}_high"))
        out = out.join(claims, name, "left")
        taken = taken | F.coalesce((F.col(f"{name}_low") != k) | (F.col(f"{name}_high") != k), F.lit(False))
    reason = F.when(F.col("admin"), "admin").when(F.col("used"), "used").when(F.col("open"), "unverified").when(taken, "device")
    return out.select("c_custkey", reason.alias("reason"))


def contact_mail(spark: SparkSession, d: str) -> DataFrame:
    """Whether a mail address can be written to: one at sign, a dot after it, no white space, at most 320 characters."""
    k = F.col("c_custkey")
    mail = F.when(k % 6 == 0, F.concat("c_name", F.lit("@shop.example"))).when(k % 6 == 1, F.concat("c_name", F.lit("@shop"))).when(k % 6 == 2, F.concat("c_name", F.lit("@@shop.example"))).when(k % 6 == 3, F.concat("c_name", F.lit(" @shop.example"))).when(k % 6 == 4, F.concat(F.repeat(F.lit("x"), (k % 13 + 295).cast("int")), F.lit("@shop.example"))).otherwise(F.concat("c_name", F.lit(".@"), k.cast("string"), F.lit(".")))
    c = table(spark, d, "customer").select("c_custkey", mail.alias("mail"))
    return c.select("c_custkey", (F.col("mail").rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$") & (F.length("mail") <= 320)).alias("valid"))


def press_risk(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines are layers: none holds, up to 8 go unless the error is over 40, up to 12 are reviewed, more hold."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").select("o_orderkey", (F.floor("o_totalprice") % 80).alias("mae")).join(lines, "o_orderkey", "left")
    level = F.when(F.col("n").isNull(), "hold").when((F.col("n") <= 8) & (F.col("mae") > 40), "review").when(F.col("n") <= 8, "go").when(F.col("n") > 12, "hold").otherwise("review")
    return o.select("o_orderkey", level.alias("level"))


def credit_edit(spark: SparkSession, d: str) -> DataFrame:
    """a balance after an edit by adding or setting, and why an edit is refused, which leaves the balance."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 500).alias("before"), F.when(F.col("o_orderkey") % 3 > 0, F.floor("o_totalprice") % 24001 - 12000).alias("add"), F.when(F.col("o_orderkey") % 3 == 0, F.floor("o_totalprice") % 150001 - 20000).alias("set"), (F.col("o_orderkey") % 11 > 0).alias("reason"))
    error = F.when(~F.col("reason"), "reason").when(F.abs("add") > 10000, "add_range").when(F.col("before") + F.col("add") < 0, "below_zero").when((F.col("set") < 0) | (F.col("set") > 100000), "set_range")
    return o.select("o_orderkey", error.alias("error"), F.when(error.isNull(), F.coalesce(F.col("before") + F.col("add"), "set")).otherwise(F.col("before")).cast("long").alias("after"))


def object_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most 12 objects of a design: the first of each thread, then the others in order."""
    s = stream(spark, d).select("design", "seq", (F.col("y") % 7).alias("thread"))
    first = F.row_number().over(W.partitionBy("design", "thread").orderBy("seq")) == 1
    ranked = s.withColumn("first", first).withColumn("place", F.row_number().over(W.partitionBy("design").orderBy(F.desc("first"), "seq")))
    return ranked.filter("place <= 12").select("design", "seq", "thread", "place")


def sewing_plan(spark: SparkSession, d: str) -> DataFrame:
    """The kind of stitch by width, the underlay by kind, width and fabric, and the number of threads by size."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 4.0).alias("mm"), (F.col("p_partkey") % 2 == 0).alias("knit"), (F.col("p_size") / 8.0).alias("inches"))
    kind = F.when(F.col("mm") < 1.2, "run").when(F.col("mm") <= 10, "satin").otherwise("tatami")
    top = F.when(kind == "satin", "zigzag").otherwise("tatami")
    heavy = F.when(F.col("knit"), F.concat(F.lit("edge-run,"), top, F.lit(","), top)).otherwise(F.concat(F.lit("edge-run,"), top))
    under = F.when(kind == "run", "").when((kind == "satin") & (F.col("mm") < 2), "center-run").when((kind == "satin") & (F.col("mm") <= 4), "edge-run").otherwise(heavy)
    threads = F.greatest(F.lit(3), F.least(F.lit(8), F.floor(2.5 + 1.1 * F.col("inches") + 0.5))).cast("long")
    return p.select("p_partkey", kind.alias("kind"), under.alias("underlay"), threads.alias("threads"))


def plan_expiry(spark: SparkSession, d: str) -> DataFrame:
    """A plan's end after one to three months from an order's date; days past a month's end run over into the next."""
    day = F.to_date("o_orderdate")
    first = F.add_months(F.trunc(day, "month"), (1 + F.col("o_orderkey") % 3).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.date_add(first, F.day(day) - 1).cast("string").alias("ends"))


def newest_version(spark: SparkSession, d: str) -> DataFrame:
    """The newest name of each size by its numbers, not by its letters; the longest name on ties."""
    name = F.concat(F.lit("model-"), F.col("p_partkey") % 3, F.lit("."), F.col("p_partkey") % 13, F.lit("."), F.col("p_partkey") % 101)
    numbers = F.transform(F.split(F.substring_index("name", "-", -1), r"\."), lambda t: t.cast("int"))
    rows = table(spark, d, "part").select("p_size", name.alias("name"))
    return rows.groupBy("p_size").agg(F.max(F.struct(numbers.alias("v"), F.length("name").alias("n"), "name")).alias("m")).select("p_size", "m.name")


def _colors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", *[((k * m) % 256).cast("long").alias(c) for c, m in (("r", 37), ("g", 91), ("b", 151))])


#: Two colours between which blends are looked for.
ENDS = ((20, 40, 60), (220, 180, 140))


def blend_test(spark: SparkSession, d: str) -> DataFrame:
    """A colour between two others: at 0.14 to 0.86 of the way, and under 16 from the line."""
    step = [q - p for p, q in zip(*ENDS, strict=True)]
    n2 = sum(s * s for s in step)
    off = [F.col(c) - p for c, p in zip("rgb", ENDS[0], strict=True)]
    dot = off[0] * step[0] + off[1] * step[1] + off[2] * step[2]
    square = off[0] * off[0] + off[1] * off[1] + off[2] * off[2]
    blend = (dot * 100 >= 14 * n2) & (dot * 100 <= 86 * n2) & (square * n2 - dot * dot < 256 * n2)
    return _colors(spark, d).select("p_partkey", blend.alias("blend"))


def paper_assign(spark: SparkSession, d: str) -> DataFrame:
    """A pixel is paper if paper is no farther than 1.3 times the nearest ink, by squared distances."""
    inks = ((30, 30, 30), (200, 60, 60), (60, 90, 200))
    far = lambda p: sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip("gb", p[1:], strict=True)), (F.col("r") - p[0]) * (F.col("r") - p[0]))
    ink, near = F.least(*[far(p) for p in inks]), F.coalesce(*[F.when(far(p) == F.least(*[far(q) for q in inks]), i) for i, p in enumerate(inks)])
    return pixels(pictures(spark, d), "r", "g", "b").select("id", "x", "y", F.when(far((250, 250, 250)) * 10 <= ink * 13, -1).otherwise(near).cast("int").alias("label"))


def border_spread(spark: SparkSession, d: str) -> DataFrame:
    """The median of each border's luma, its scaled median deviation in thousandths, and whether the sheet is flat."""
    rim = pixels(pictures(spark, d), "r", "g", "b").filter("x < 3 or x >= w - 3 or y < 3 or y >= h - 3")
    luma = rim.select("id", F.floor(color.luma(F.col("r"), F.col("g"), F.col("b")) + 0.5).alias("v"))
    mid = luma.withColumn("mid", F.percentile("v", F.lit(0.5)).over(W.partitionBy("id")))
    out = mid.groupBy("id", "mid").agg(F.percentile(F.abs(F.col("v") - F.col("mid")), F.lit(0.5)).alias("dev"))
    return out.select("id", "mid", F.floor(F.col("dev") * 1482.6 + 0.5).cast("long").alias("mad"), (F.col("dev") * 1.4826 < 12).alias("sheet"))


_N2 = 200 * 200 + 140 * 140 + 80 * 80
_FAR = "(r-{0})*(r-{0})+(g-{1})*(g-{1})+(b-{2})*(b-{2})"
QUERIES = [trace_job_slots, password_problem, free_image_status, contact_mail, press_risk, credit_edit, object_cap, sewing_plan, plan_expiry, newest_version, blend_test, paper_assign, border_spread]
SQL = {
    "trace_job_slots": r"WITH t AS (SELECT p_partkey, p_size % 8 + 1 AS cores, CASE p_partkey % 5 WHEN 2 THEN 6e0 WHEN 4 THEN 0e0 END AS env, CASE WHEN p_partkey % 7 > 2 THEN (p_partkey % 9) * 50000 END AS quota FROM part) SELECT p_partkey, CAST(CASE WHEN env IS NOT NULL THEN greatest(1, floor(env)) WHEN quota IS NOT NULL THEN least(greatest(1, floor(quota/100000)), cores) ELSE 2 END AS BIGINT) AS slots FROM t",
    "password_problem": "WITH w AS (SELECT c_custkey, substr(c_name, 1 + c_custkey % 10, 5 + c_custkey % 9) AS word FROM customer) SELECT c_custkey, length(word) < 8 OR NOT regexp_matches(word, '[A-Za-z]') OR NOT regexp_matches(word, '[0-9]') AS refused FROM w",
    "free_image_status": "WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 77 END AS device, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 401 END AS address, c_acctbal < 0 AS used FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 31 = 0 THEN 'admin' WHEN used THEN 'used' WHEN c_custkey % 3 = 0 THEN 'unverified' WHEN EXISTS (SELECT 1 FROM c o WHERE o.used AND (o.device = c.device OR o.address = c.address) AND o.c_custkey <> c.c_custkey) THEN 'device' END AS reason FROM c",
    "contact_mail": r"WITH m AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN c_name || '@shop.example' WHEN 1 THEN c_name || '@shop' WHEN 2 THEN c_name || '@@shop.example' WHEN 3 THEN c_name || ' @shop.example' WHEN 4 THEN repeat('x', CAST(c_custkey % 13 + 295 AS INT)) || '@shop.example' ELSE c_name || '.@' || c_custkey || '.' END AS mail FROM customer) SELECT c_custkey, length(mail) <= 320 AND mail NOT LIKE '% %' AND length(mail) - length(replace(mail, '@', '')) = 1 AND position('.' IN substr(split_part(mail, '@', 2), 2)) BETWEEN 1 AND length(split_part(mail, '@', 2)) - 2 AS valid FROM m",
    "press_risk": "WITH n AS (SELECT o_orderkey, floor(o_totalprice) % 80 AS mae, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) SELECT o_orderkey, CASE WHEN n = 0 THEN 'hold' WHEN n <= 8 AND mae > 40 THEN 'review' WHEN n <= 8 THEN 'go' WHEN n <= 12 THEN 'review' ELSE 'hold' END AS level FROM n",
    "credit_edit": "WITH o AS (SELECT o_orderkey AS k, o_orderkey % 500 AS b, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders), e AS (SELECT *, CASE WHEN k % 3 > 0 THEN p % 24001 - 12000 END AS a, CASE WHEN k % 3 = 0 THEN p % 150001 - 20000 END AS s FROM o), f AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'reason' WHEN abs(a) > 10000 THEN 'add_range' WHEN b + a < 0 THEN 'below_zero' WHEN s < 0 OR s > 100000 THEN 'set_range' END AS error FROM e) SELECT k AS o_orderkey, error, CASE WHEN error IS NULL THEN coalesce(b + a, s) ELSE b END AS after FROM f",
    "object_cap": "WITH s AS (SELECT user_id AS design, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, CAST(event_id % 97 % 7 AS BIGINT) AS thread FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY design, thread ORDER BY seq) > 1 AS later FROM s), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY design ORDER BY later, seq) AS INT) AS place FROM f) SELECT design, seq, thread, place FROM r WHERE place <= 12",
    "sewing_plan": "WITH p AS (SELECT p_partkey, p_size/4e0 AS mm, p_partkey % 2 = 0 AS knit, p_size/8e0 AS inches, CASE WHEN p_size < 4.8 THEN 'run' WHEN p_size <= 40 THEN 'satin' ELSE 'tatami' END AS kind FROM part), t AS (SELECT *, CASE kind WHEN 'satin' THEN 'zigzag' ELSE 'tatami' END AS top FROM p) SELECT p_partkey, kind, CASE WHEN kind = 'run' THEN '' WHEN kind = 'satin' AND mm < 2 THEN 'center-run' WHEN kind = 'satin' AND mm <= 4 THEN 'edge-run' WHEN knit THEN 'edge-run,' || top || ',' || top ELSE 'edge-run,' || top END AS underlay, CAST(greatest(3, least(8, floor(2.5e0+1.1e0*inches+0.5e0))) AS BIGINT) AS threads FROM t",
    "plan_expiry": "SELECT o_orderkey, CAST(CAST(date_trunc('month', o_orderdate) + to_months(CAST(1 + o_orderkey % 3 AS INT)) + to_days(CAST(day(o_orderdate) - 1 AS INT)) AS DATE) AS VARCHAR) AS ends FROM orders",
    "newest_version": "WITH n AS (SELECT p_size, p_partkey % 3 AS a, p_partkey % 13 AS b, p_partkey % 101 AS c FROM part), r AS (SELECT DISTINCT *, row_number() OVER (PARTITION BY p_size ORDER BY a DESC, b DESC, c DESC) AS k FROM n) SELECT p_size, 'model-' || a || '.' || b || '.' || c AS name FROM r WHERE k = 1",
    "blend_test": f"WITH c AS (SELECT p_partkey, p_partkey*37%256-20 AS r, p_partkey*91%256-40 AS g, p_partkey*151%256-60 AS b FROM part), t AS (SELECT *, r*200+g*140+b*80 AS t FROM c) SELECT p_partkey, t*100 >= 14*{_N2} AND t*100 <= 86*{_N2} AND (r*r+g*g+b*b)*{_N2}-t*t < 256*{_N2} AS blend FROM t",
    "paper_assign": f"WITH {_IMG}, f AS (SELECT id, x, y, {_FAR.format(250, 250, 250)} AS p, {_FAR.format(30, 30, 30)} AS i, {_FAR.format(200, 60, 60)} AS j, {_FAR.format(60, 90, 200)} AS k FROM img) SELECT id, x, y, CAST(CASE WHEN p*10 <= least(i, j, k)*13 THEN -1 WHEN i <= j AND i <= k THEN 0 WHEN j <= k THEN 1 ELSE 2 END AS INT) AS label FROM f",
    "border_spread": f"WITH {_IMG}, v AS (SELECT id, floor(0.299e0*r+0.587e0*g+0.114e0*b+0.5e0) AS v FROM img WHERE x < 3 OR x >= w-3 OR y < 3 OR y >= h-3), m AS (SELECT id, v, median(v) OVER (PARTITION BY id) AS mid FROM v), s AS (SELECT id, mid, median(abs(v-mid)) AS dev FROM m GROUP BY id, mid) SELECT id, mid, CAST(floor(dev*1482.6e0+0.5e0) AS BIGINT) AS mad, dev*1.4826e0 < 12 AS sheet FROM s",
}

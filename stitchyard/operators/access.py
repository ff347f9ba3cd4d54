"""Searches, row shaping, entitlement and lookups over shop records (P04-P09, P11, P12, P14, P17, J01, J02, J06-J08, J15-J17, F10, S02, S14 cookies, S19)."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stitchyard.sources.tables import table

#: The methods of the shop, and its settings where a store has none.
METHODS = ["dtf", "uvdtf", "uv", "vinyl", "laser", "sticker", "screen", "hat", "apparel", "patch", "embroidery", "sublimation", "rhinestone", "sign"]
SETTINGS = {"trial_days": 7, "shop_price_cents": 7900, "studio_price_cents": 14900}
NOW = "1999-06-01 00:00:00"


def contains(text: Column, query: str) -> Column:
    """Case-insensitive search for a literal text."""
    return F.lower(text).contains(query.lower())


def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    """Code, name, colour and kind joined by spaces."""
    p = table(spark, d, "part")
    return p.filter(contains(F.concat_ws(" ", "p_partkey", "p_name", "p_brand", "p_type"), "Ring Brand#2")).select("p_partkey", "p_name")


def blank_search(spark: SparkSession, d: str) -> DataFrame:
    """Null and empty fields are left out before fields are joined, so that neighbours of one still meet."""
    fields = [F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 3 != 0, F.col("p_name")), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).otherwise(""), F.col("p_type")]
    text = F.concat_ws(" ", *[F.nullif(f, F.lit("")) for f in fields])
    return table(spark, d, "part").filter(contains(text, "ring economy") | contains(text, "1 economy")).select("p_partkey", text.alias("hay"))


def admin_user_search(spark: SparkSession, d: str) -> DataFrame:
    """The search reads the computed shop name."""
    u = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = u.select("c_custkey", F.lower("c_name").alias("email"), F.coalesce("n_name", F.lit("")).alias("shop_name"), "c_mktsegment")
    return rows.filter(contains(F.concat_ws(" ", "email", "shop_name", "c_mktsegment"), "nation_1 b"))


def _users(spark: SparkSession, d: str) -> DataFrame:
    """Customers as users: role, plan and its end, unlocks of a job, credits, and whether the mail is verified."""
    k = F.col("c_custkey")
    plan = F.element_at(F.array(*map(F.lit, ("shop", "studio", "trial", "free"))), (k % 4 + 1).cast("int"))
    role = F.when(k % 17 == 0, "admin").when(k % 5 == 0, "shop").otherwise("client")
    ends = F.when(k % 3 != 0, F.expr("cast('1999-01-01 00:00:00' as timestamp_ntz) + make_dt_interval(cast(c_custkey % 300 as int))"))
    cols = [k.alias("id"), "c_name", "c_mktsegment", role.alias("role"), plan.alias("plan"), ends.alias("plan_expires"), F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 2000)).cast("long").alias("credits")]
    flags = [(k % 2 == 0).alias("verified"), (k % 7 == 0).alias("free_used"), (k % 11 == 0).alias("unlocked"), (k % 6 == 0).alias("free_image")]
    return table(spark, d, "customer").select(*cols, *flags)


def public_users(spark: SparkSession, d: str) -> DataFrame:
    """Only listed columns and computed ones leave the store."""
    return _users(spark, d).select("id", F.lower("c_name").alias("email"), "role", (F.col("plan") != "free").alias("member"), F.initcap(F.lower("c_mktsegment")).alias("segment"))


def art_for_entitled(spark: SparkSession, d: str) -> DataFrame:
    """The drawing of a job is there for its producers alone, others see that there is one."""
    o = table(spark, d, "orders")
    able = (F.col("o_orderstatus") == "F") | (F.col("o_totalprice") > 300_000)
    return o.select("o_orderkey", F.when(able, F.concat(F.lit("<svg id='"), F.col("o_orderkey").cast("string"), F.lit("'/>"))).alias("svg"), F.lit(True).alias("has_art"))


def scrubbed(text: Column) -> Column:
    """A text without hidden words; texts without one stay as they are."""
    clean = F.regexp_replace(F.regexp_replace(text, r"(?i)digitiz\w*", ""), r"(?i)embroider\w*", "")
    return F.when(text.rlike("(?i)digitiz|embroider"), F.trim(F.regexp_replace(clean, r"\s{2,}", " "))).otherwise(text)


def scrub_hidden(spark: SparkSession, d: str) -> DataFrame:
    """Hidden keys go, one method is renamed, hidden words leave all texts, emptied entries leave lists."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    method = F.when(k % 2 == 0, "embroidery").otherwise("laser")
    job = F.create_map(F.lit("title"), F.concat(F.lit("Digitized  "), "o_orderpriority"), F.lit("method"), method, F.lit("embroideryHoop"), F.lit("4in"), F.lit("note"), F.concat(F.lit("keep  two spaces of "), k.cast("string")))
    tags = F.array(F.lit("digitize"), F.lit("red"), F.concat(F.lit("Embroidered cap "), k.cast("string")), F.lit(""))
    renamed = lambda v: F.when(v == "embroidery", "apparel").otherwise(v)
    shown = F.transform_values(F.map_filter("job", lambda key, _: ~key.rlike("(?i)digitiz|embroider")), lambda _, v: scrubbed(renamed(v)))
    rows = o.select("o_orderkey", job.alias("job"), tags.alias("tags"))
    entries = F.array_sort(F.transform(F.map_entries(shown), lambda e: F.concat(e.key, F.lit("="), e.value)))
    return rows.select("o_orderkey", F.array_join(entries, "|").alias("job"), F.array_join(F.filter(F.transform("tags", scrubbed), lambda v: v != ""), "|").alias("tags"))


def session_valid(spark: SparkSession, d: str) -> DataFrame:
    """Not past its end, and begun after the cutoff; without a beginning it is none, an unset end is no end."""
    e = table(spark, d, "events")
    now, cutoff = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-03 00:00:00").cast("timestamp_ntz")
    ends = F.when(F.col("event_id") % 4 != 0, F.expr("cast(ts as timestamp_ntz) + make_dt_interval(cast(event_id % 40 as int))"))
    begun = F.when(F.col("event_id") % 7 != 0, F.col("ts").cast("timestamp_ntz"))
    ok = ~F.coalesce(now > ends, F.lit(False)) & F.coalesce(begun >= cutoff, F.lit(False))
    return e.select("event_id", ok.alias("valid"))


def preview_windows(spark: SparkSession, d: str) -> DataFrame:
    """Zoom, window and size of a preview within their limits, or the error of the first bad one."""
    raw = "p_partkey, (p_size - 2) / 4.0D as zoom, case when p_partkey % 5 <> 0 then (p_partkey % 13 - 3) / 10.0D end as x, case when p_partkey % 7 <> 0 then (p_partkey % 11 - 2) / 10.0D end as y, case when p_partkey % 3 = 0 then (p_partkey % 17) / 12.0D end as w, case when p_partkey % 3 = 0 and p_partkey % 31 <> 0 then (p_partkey % 19) / 40.0D end as h, case when p_partkey % 2 = 0 then p_partkey % 3000 - 1 end as pw"
    p = table(spark, d, "part").selectExpr(*raw.split(", "))
    error = F.expr("case when zoom <= 0 then 'Invalid zoom' when w <= 0 or h <= 0 then 'Invalid preview window' when pw <= 0 then 'Invalid preview size' when (w is null) <> (h is null) then 'Preview window needs both w and h' end")
    q = p.withColumn("error", error).withColumn("zoom", F.expr("greatest(0.1D, least(16.0D, zoom))"))
    side = F.expr("1 / zoom")
    q = q.select("p_partkey", "error", "zoom", F.coalesce("x", F.when(F.col("w").isNull(), (1 - side) / 2).otherwise(0.0)).alias("x"), F.coalesce("y", F.when(F.col("w").isNull(), (1 - side) / 2).otherwise(0.0)).alias("y"), F.coalesce("w", side).alias("w"), F.coalesce("h", side).alias("h"), "pw")
    q = q.withColumns({c: F.expr(f"least(1.0D, greatest(1 / 16.0D, {c}))") for c in "wh"})
    inside = lambda c, s: F.expr(f"case when greatest(0.0D, {c}) + {s} > 1 then greatest(0.0D, 1 - {s}) else greatest(0.0D, {c}) end")
    q = q.select("p_partkey", "error", "zoom", inside("x", "w").alias("x"), inside("y", "h").alias("y"), "w", "h", F.expr("case when pw is not null then greatest(8L, least(2048L, pw)) end").alias("pw"))
    milli = lambda c: F.when(F.col("error").isNull(), F.floor(F.col(c) * 1000 + 0.5)).otherwise(-1).cast("long").alias(c)
    return q.select("p_partkey", "error", *[milli(c) for c in ("zoom", "x", "y", "w", "h")], F.when(F.col("error").isNull(), F.coalesce("pw", F.lit(-1))).otherwise(-1).cast("long").alias("pw"))


def entitlements(spark: SparkSession, d: str) -> DataFrame:
    """What a user may do, with membership on (first letter) and off."""
    u = _users(spark, d)
    comped, now = F.col("role") == "admin", F.lit(NOW).cast("timestamp_ntz")
    live = F.coalesce(F.col("plan_expires") > now, F.lit(True))
    paid, trial, studio = F.col("plan").isin("shop", "studio") & live, (F.col("plan") == "trial") & live, (F.col("plan") == "studio") & live
    produce_on, produce_off = comped | paid | trial, F.col("role").isin("admin", "shop")
    vector_on, halftone_on = comped | produce_on, comped | studio
    free = ~comped & ~F.col("free_used") & F.col("verified")
    use = lambda included: included | F.col("unlocked") | (F.col("credits") >= 1) | free
    art = lambda included: comped | (~F.col("free_image") & (included | F.col("unlocked")))
    flags = {"produce_on": produce_on, "produce_off": produce_off, "vector_on": vector_on, "halftone_on": halftone_on, "use_vector_on": use(vector_on), "use_halftone_on": use(halftone_on), "use_off": use(comped), "export_on": comped | vector_on | halftone_on | F.col("unlocked"), "preview_on": art(vector_on | halftone_on), "preview_halftone_on": art(halftone_on)}
    return u.select("id", *[v.alias(k) for k, v in flags.items()])


def methods_for(spark: SparkSession, d: str) -> DataFrame:
    """The list of methods without the one that only admins see."""
    every = F.array(*map(F.lit, METHODS))
    shown = F.filter(every, lambda m: (F.col("role") == "admin") | (m != "embroidery"))
    return _users(spark, d).select("id", F.array_join(shown, ",").alias("methods"))


def session_user(spark: SparkSession, d: str) -> DataFrame:
    """The session of a token, then its user."""
    asked = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 3 % 25_000).alias("token"))
    s = table(spark, d, "events").select(F.col("event_id").alias("token"), "user_id")
    u = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return asked.join(s, "token").join(u, "user_id").select("o_orderkey", "token", "c_name")


def job_shop(spark: SparkSession, d: str) -> DataFrame:
    """The shop of a job, or none."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("shop_id"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("shop_id"), F.col("n_name").alias("shop_name"))
    return o.join(n, "shop_id", "left").select("o_orderkey", "shop_name")


def user_job_counts(spark: SparkSession, d: str) -> DataFrame:
    """Jobs that a user owns or ordered, each once, as a union of pairs instead of a join on OR."""
    o = table(spark, d, "orders")
    pairs = o.select("o_orderkey", F.explode(F.array_distinct(F.array("o_custkey", F.col("o_orderkey") % 700))).alias("c_custkey"))
    n = pairs.groupBy("c_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("jobs"))


def job_events(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the jobs in work, in order."""
    jobs = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return jobs.join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey").select("l_orderkey", "o_orderdate", "l_linenumber", "l_partkey")


def email_taken(spark: SparkSession, d: str) -> DataFrame:
    """Users whose address, in lower case and trimmed, another user has; by counts, not by pairs."""
    mail = F.lower(F.trim(F.concat(F.lit(" "), "c_mktsegment", (F.col("c_custkey") % 900).cast("string"), F.lit("@X.example "))))
    u = table(spark, d, "customer").select("c_custkey", mail.alias("mail"))
    many = u.groupBy("mail").agg(F.count("*").alias("n")).filter("n > 1")
    return u.join(many, "mail", "left_semi").select("c_custkey", "mail")


def file_owner(spark: SparkSession, d: str) -> DataFrame:
    """The first job whose file has the name that is asked for."""
    name = lambda path: F.regexp_extract(path, "[^/]+$", 0)
    files = table(spark, d, "orders").select("o_orderkey", name(F.concat(F.lit("/uploads/"), F.col("o_custkey").cast("string"), F.lit("/"), (F.col("o_orderkey") * 7 % 2000).cast("string"), F.lit(".png"))).alias("file"))
    first = files.groupBy("file").agg(F.min("o_orderkey").alias("job"))
    asked = table(spark, d, "events").select("event_id", name(F.concat(F.lit("/x/"), (F.col("event_id") % 2500).cast("string"), F.lit(".png"))).alias("file"))
    return asked.join(first, "file").select("event_id", "job")


def refund_order(spark: SparkSession, d: str) -> DataFrame:
    """The order of a refund by its order id, or else by its payment."""
    e = table(spark, d, "events")
    paid = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("order_id"), (F.col("event_id") * 2 + 1).alias("payment_id"))
    refunds = e.filter("event_type = 'error'").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_id") - 3).alias("order_id"), ((F.col("event_id") - 5) * 2 + 1).alias("payment_id"))
    by_order = refunds.join(paid.select("order_id", F.col("order_id").alias("a")), "order_id", "left")
    both = by_order.join(paid.select("payment_id", F.col("order_id").alias("b")), "payment_id", "left")
    return both.select("event_id", F.coalesce("a", "b", F.lit(-1)).alias("order_of_refund"))


def sku_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A code in any case finds its item; other codes find none."""
    items = table(spark, d, "part").select(F.upper(F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string"))).alias("code"), "p_partkey")
    asked = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("brand#"), (F.col("l_suppkey") % 5 + 1).cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("asked"))
    return asked.join(items, F.upper("asked") == F.col("code"), "left").groupBy("l_orderkey").agg(F.count("p_partkey").alias("found"), F.count("*").alias("asked"))


def credit_use(spark: SparkSession, d: str) -> DataFrame:
    """included, unlocked, credit, free image or refused, for uses of jobs and services in order, with membership on.

    A service has credits of its own and unlocks a job for itself alone. The first use of a job takes a credit of the
    service; without one the user's free image, which serves either service once. Both are known from how many
    first uses came before, so that windows do it.
    """
    comped, live = F.col("role") == "admin", F.coalesce(F.col("plan_expires") > F.lit(NOW).cast("timestamp_ntz"), F.lit(True))
    trace = comped | (F.col("plan").isin("shop", "studio", "trial") & live)
    print_ = comped | ((F.col("plan") == "studio") & live)
    u = _users(spark, d).select(F.col("id").alias("user_id"), trace.alias("trace"), print_.alias("print"), "credits", (F.col("id") % 3).alias("prints"), (F.col("verified") & ~F.col("free_used") & ~comped).alias("free"))
    uses = table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 6).alias("job"), (F.col("event_id") % 2 == 0).alias("tracing")).join(u, "user_id")
    uses = uses.select("event_id", "user_id", "ts", "job", "tracing", F.when(F.col("tracing"), F.col("trace")).otherwise(F.col("print")).alias("included"), F.when(F.col("tracing"), F.col("credits")).otherwise(F.col("prints")).alias("have"), "free")
    when = ("ts", "event_id")
    first = uses.withColumn("k", F.row_number().over(W.partitionBy("user_id", "job", "tracing").orderBy(*when)))
    new = first.filter("k = 1 and not included").withColumn("n", F.row_number().over(W.partitionBy("user_id", "tracing").orderBy(*when))).withColumn("over", F.col("n") > F.col("have"))
    new = new.withColumn("m", F.count_if("over").over(W.partitionBy("user_id").orderBy(*when)))
    got = F.when(~F.col("over"), "credit").when(F.col("free") & (F.col("m") == 1), "free").otherwise("refused")
    both = first.join(new.select("user_id", "job", "tracing", got.alias("got")), ["user_id", "job", "tracing"], "left")
    return both.select("event_id", F.when(F.col("included"), "included").when((F.col("k") > 1) & (F.col("got") != "refused"), "unlocked").otherwise(F.col("got")).alias("outcome"))


def settings_with_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Settings that a store lacks are filled in."""
    n = table(spark, d, "nation")
    own = {"trial_days": F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")), "shop_price_cents": F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey") * 100), "studio_price_cents": F.lit(None)}
    return n.select("n_nationkey", *[F.coalesce(own[k].cast("long"), F.lit(v).cast("long")).alias(k) for k, v in SETTINGS.items()])


def cookie_token(spark: SparkSession, d: str) -> DataFrame:
    """A cookie of a header line; entries without a sign of equality are none, the last of a name counts."""
    line = F.concat(F.lit(" theme=dark ; broken; sid = s"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(";sid=%20t"), F.col("user_id").cast("string"))).otherwise(""))
    parts = F.filter(F.split("line", ";"), lambda p: F.instr(p, "=") > 0)
    mine = F.filter(parts, lambda p: F.trim(F.substring_index(p, "=", 1)) == "sid")
    value = F.trim(F.regexp_replace(F.element_at(mine, -1), "^[^=]*=", ""))
    return table(spark, d, "events").select("event_id", line.alias("line")).select("event_id", F.regexp_replace(value, "%20", " ").alias("sid"))


def env_lines(spark: SparkSession, d: str) -> DataFrame:
    """Names and values of lines; notes and lines without a value are none, quotes around a value go."""
    k = F.col("p_partkey")
    line = F.when(k % 5 == 0, F.concat(F.lit("# note="), "p_name")).when(k % 5 == 1, F.concat(F.lit("  KEY = '"), "p_name", F.lit("' "))).when(k % 5 == 2, F.concat(F.lit('A="'), "p_name", F.lit('"=b'))).when(k % 5 == 3, F.lit("no value")).otherwise(F.concat(F.lit("B= "), "p_brand"))
    t = F.trim("line")
    v = F.trim(F.regexp_replace(t, "^[^=]*=", ""))
    bare = F.when(F.col("v").rlike("^(\".*\"|'.*')$"), F.expr("substring(v, 2, length(v) - 2)"))
    rows = table(spark, d, "part").select("p_partkey", line.alias("line")).filter((F.instr("line", "=") > 0) & ~t.startswith("#"))
    return rows.select("p_partkey", F.trim(F.substring_index(t, "=", 1)).alias("k"), v.alias("v")).select("p_partkey", F.col("k").alias("name"), F.coalesce(bare, F.col("v")).alias("value"))


QUERIES = [catalog_search, blank_search, admin_user_search, public_users, art_for_entitled, scrub_hidden, session_valid, preview_windows, entitlements, methods_for, session_user, job_shop, user_job_counts, job_events, email_taken, file_owner, refund_order, sku_lookup, credit_use, settings_with_defaults, cookie_token, env_lines]
_U = "u AS (SELECT c_custkey AS id, c_name, c_mktsegment, CASE WHEN c_custkey % 17 = 0 THEN 'admin' WHEN c_custkey % 5 = 0 THEN 'shop' ELSE 'client' END AS role, ['shop', 'studio', 'trial', 'free'][c_custkey % 4 + 1] AS plan, CASE WHEN c_custkey % 3 <> 0 THEN TIMESTAMP '1999-01-01' + to_days(CAST(c_custkey % 300 AS INT)) END AS plan_expires, greatest(0, CAST(floor(c_acctbal/2000) AS BIGINT)) AS credits, c_custkey % 2 = 0 AS verified, c_custkey % 7 = 0 AS free_used, c_custkey % 11 = 0 AS unlocked, c_custkey % 6 = 0 AS free_image FROM customer)"
_SCRUB = "trim(regexp_replace(regexp_replace({0}, '(digitiz|embroider)[0-9A-Za-z_]*', '', 'gi'), '\\s{{2,}}', ' ', 'g'))"
SQL = {
    "catalog_search": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_partkey || ' ' || p_name || ' ' || p_brand || ' ' || p_type), 'ring brand#2')",
    "blank_search": "WITH h AS (SELECT p_partkey, p_partkey || (CASE WHEN p_size % 3 <> 0 THEN ' ' || p_name ELSE '' END) || (CASE WHEN p_size % 5 <> 0 THEN ' ' || p_brand ELSE '' END) || ' ' || p_type AS hay FROM part) SELECT * FROM h WHERE contains(lower(hay), 'ring economy') OR contains(lower(hay), '1 economy')",
    "admin_user_search": "SELECT c_custkey, lower(c_name) AS email, n_name AS shop_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(c_name || ' ' || n_name || ' ' || c_mktsegment), 'nation_1 b')",
    "public_users": f"WITH {_U} SELECT id, lower(c_name) AS email, role, plan <> 'free' AS member, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS segment FROM u",
    "art_for_entitled": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_totalprice > 300000 THEN '<svg id=''' || o_orderkey || '''/>' END AS svg, true AS has_art FROM orders",
    "scrub_hidden": "SELECT o_orderkey, 'method=' || CASE WHEN o_orderkey % 2 = 0 THEN 'apparel' ELSE 'laser' END || '|note=keep  two spaces of ' || o_orderkey || '|title=' || " + _SCRUB.format("'Digitized  ' || o_orderpriority") + " AS job, 'red|' || " + _SCRUB.format("'Embroidered cap ' || o_orderkey") + " AS tags FROM orders",
    "session_valid": "SELECT event_id, NOT (event_id % 4 <> 0 AND TIMESTAMP '2024-01-20' > ts + to_days(CAST(event_id % 40 AS INT))) AND event_id % 7 <> 0 AND ts >= TIMESTAMP '2024-01-03' AS valid FROM events",
    "preview_windows": """WITH a AS (SELECT p_partkey, (p_size - 2) / 4e0 AS zoom, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 13 - 3) / 10e0 END AS x, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 11 - 2) / 10e0 END AS y, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 17) / 12e0 END AS w, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 31 <> 0 THEN (p_partkey % 19) / 40e0 END AS h, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 3000 - 1 END AS pw FROM part),
 b AS (SELECT p_partkey, CASE WHEN zoom <= 0 THEN 'Invalid zoom' WHEN w <= 0 OR h <= 0 THEN 'Invalid preview window' WHEN pw <= 0 THEN 'Invalid preview size' WHEN (w IS NULL) <> (h IS NULL) THEN 'Preview window needs both w and h' END AS error, greatest(0.1e0, least(16e0, zoom)) AS zoom, x, y, w, h, pw, w IS NULL AS auto FROM a),
 c AS (SELECT p_partkey, error, zoom, pw, coalesce(x, CASE WHEN auto THEN (1 - 1/zoom) / 2 ELSE 0e0 END) AS x, coalesce(y, CASE WHEN auto THEN (1 - 1/zoom) / 2 ELSE 0e0 END) AS y, least(1e0, greatest(0.0625e0, coalesce(w, 1/zoom))) AS w, least(1e0, greatest(0.0625e0, coalesce(h, 1/zoom))) AS h FROM b),
 e AS (SELECT * REPLACE (greatest(0e0, x) AS x, greatest(0e0, y) AS y) FROM c), f AS (SELECT * REPLACE (CASE WHEN x + w > 1 THEN greatest(0e0, 1 - w) ELSE x END AS x, CASE WHEN y + h > 1 THEN greatest(0e0, 1 - h) ELSE y END AS y) FROM e)
 SELECT p_partkey, error, CASE WHEN error IS NULL THEN CAST(floor(zoom*1000+0.5) AS BIGINT) ELSE -1 END AS zoom, CASE WHEN error IS NULL THEN CAST(floor(x*1000+0.5) AS BIGINT) ELSE -1 END AS x, CASE WHEN error IS NULL THEN CAST(floor(y*1000+0.5) AS BIGINT) ELSE -1 END AS y, CASE WHEN error IS NULL THEN CAST(floor(w*1000+0.5) AS BIGINT) ELSE -1 END AS w, CASE WHEN error IS NULL THEN CAST(floor(h*1000+0.5) AS BIGINT) ELSE -1 END AS h, CASE WHEN error IS NULL AND pw IS NOT NULL THEN greatest(8, least(2048, pw)) ELSE -1 END AS pw FROM f""",
    "entitlements": f"WITH {_U}, l AS (SELECT *, role = 'admin' AS comped, coalesce(plan_expires > TIMESTAMP '{NOW}', true) AS live, role <> 'admin' AND NOT free_used AND verified AS free FROM u), m AS (SELECT *, comped OR (plan IN ('shop', 'studio', 'trial') AND live) AS p, comped OR (plan = 'studio' AND live) AS h FROM l) SELECT id, p AS produce_on, role IN ('admin', 'shop') AS produce_off, p AS vector_on, h AS halftone_on, p OR unlocked OR credits >= 1 OR free AS use_vector_on, h OR unlocked OR credits >= 1 OR free AS use_halftone_on, comped OR unlocked OR credits >= 1 OR free AS use_off, p OR h OR unlocked AS export_on, comped OR (NOT free_image AND (p OR h OR unlocked)) AS preview_on, comped OR (NOT free_image AND (h OR unlocked)) AS preview_halftone_on FROM m",
    "methods_for": f"WITH {_U} SELECT id, CASE WHEN role = 'admin' THEN '{','.join(METHODS)}' ELSE '{','.join(m for m in METHODS if m != 'embroidery')}' END AS methods FROM u",
    "session_user": "SELECT o_orderkey, event_id AS token, c_name FROM orders JOIN events ON event_id = o_orderkey * 3 % 25000 JOIN customer ON c_custkey = user_id",
    "job_shop": "SELECT o_orderkey, (SELECT n_name FROM nation WHERE n_nationkey = o_custkey % 40) AS shop_name FROM orders",
    "user_job_counts": "SELECT c_custkey, count(o_orderkey) AS jobs FROM customer LEFT JOIN orders ON o_custkey = c_custkey OR o_orderkey % 700 = c_custkey GROUP BY 1",
    "job_events": "SELECT l_orderkey, o_orderdate, l_linenumber, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'",
    "email_taken": "WITH u AS (SELECT c_custkey, lower(c_mktsegment || c_custkey % 900) || '@x.example' AS mail FROM customer) SELECT * FROM u a WHERE EXISTS (SELECT 1 FROM u b WHERE b.mail = a.mail AND b.c_custkey <> a.c_custkey)",
    "file_owner": "SELECT event_id, min(o_orderkey) AS job FROM events JOIN orders ON o_orderkey * 7 % 2000 = event_id % 2500 GROUP BY 1",
    "refund_order": "WITH p AS (SELECT event_id AS o FROM events WHERE event_type = 'purchase') SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN a.o END, b.o, -1) AS order_of_refund FROM events LEFT JOIN p a ON a.o = event_id - 3 LEFT JOIN p b ON b.o = event_id - 5 WHERE event_type = 'error'",
    "sku_lookup": "SELECT l_orderkey, count(p_partkey) AS found, count(*) AS asked FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_brand = 'Brand#' || (l_suppkey % 5 + 1) GROUP BY 1",
    "credit_use": f"""WITH {_U}, v AS (SELECT *, role = 'admin' AS comped, coalesce(plan_expires > TIMESTAMP '{NOW}', true) AS live FROM u), e AS (SELECT event_id, user_id, ts, event_id % 6 AS job, event_id % 2 AS svc, CASE WHEN event_id % 2 = 0 THEN comped OR (plan IN ('shop', 'studio', 'trial') AND live) ELSE comped OR (plan = 'studio' AND live) END AS inc, CASE WHEN event_id % 2 = 0 THEN credits ELSE id % 3 END AS have, verified AND NOT free_used AND NOT comped AS free FROM events JOIN v ON id = user_id),
 f AS (SELECT *, row_number() OVER (PARTITION BY user_id, job, svc ORDER BY ts, event_id) AS k FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, svc ORDER BY ts, event_id) > have AS over_ FROM f WHERE k = 1 AND NOT inc), m AS (SELECT user_id, job, svc, CASE WHEN NOT over_ THEN 'credit' WHEN free AND count(*) FILTER (over_) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'free' ELSE 'refused' END AS got FROM n)
 SELECT event_id, CASE WHEN inc THEN 'included' WHEN k > 1 AND got <> 'refused' THEN 'unlocked' ELSE got END AS outcome FROM f LEFT JOIN m USING (user_id, job, svc)""",
    "settings_with_defaults": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE 7 END::BIGINT AS trial_days, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 100 ELSE 7900 END::BIGINT AS shop_price_cents, 14900::BIGINT AS studio_price_cents FROM nation",
    "cookie_token": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ' t' || user_id ELSE 's' || event_id END AS sid FROM events",
    "env_lines": "SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN 'KEY' WHEN 2 THEN 'A' ELSE 'B' END AS name, CASE p_partkey % 5 WHEN 1 THEN p_name WHEN 2 THEN '\"' || p_name || '\"=b' ELSE p_brand END AS value FROM part WHERE p_partkey % 5 IN (1, 2, 4)",
}

"""Shop records: boards, searches, counts, lookups and cascades (P, J, A, T operators)."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stitchyard.sources.tables import table

STATUSES = ["F", "O", "P", "X"]


def job_board_search(spark: SparkSession, d: str) -> DataFrame:
    """Literal, case-insensitive search over joined fields, newest first."""
    text = F.lower(F.concat_ws(" ", "o_orderpriority", "o_orderstatus", "c_name"))
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).filter(text.contains("1-urgent o")).select("o_orderkey", "c_name", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey")


def board_status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Jobs by status, statuses without jobs kept."""
    every = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    n = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).count()
    return every.join(n, "status", "left").select("status", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def client_job_counts(spark: SparkSession, d: str) -> DataFrame:
    """Clients with their job counts, zero kept."""
    n = table(spark, d, "orders").groupBy("o_custkey").count()
    c = table(spark, d, "customer")
    return c.join(n, c.c_custkey == n.o_custkey, "left").select("c_custkey", F.coalesce("count", F.lit(0)).cast("long").alias("jobs"))


def shop_counts(spark: SparkSession, d: str) -> DataFrame:
    """Two counts per shop, aggregated before the joins, so that neither fans out."""
    users = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("users"))
    staff = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("staff"))
    n = table(spark, d, "nation")
    return n.join(users, n.n_nationkey == users.c_nationkey, "left").join(staff, n.n_nationkey == staff.s_nationkey, "left").select("n_name", F.coalesce("users", F.lit(0)).cast("long").alias("users"), F.coalesce("staff", F.lit(0)).cast("long").alias("staff"))


def admin_overview(spark: SparkSession, d: str) -> DataFrame:
    """Counts and a conditional count in one row."""
    c = table(spark, d, "customer").agg(F.count("*").alias("users"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"))
    return c.crossJoin(table(spark, d, "orders").agg(F.count("*").alias("jobs"))).crossJoin(table(spark, d, "supplier").agg(F.count("*").alias("shops")))


def recent_top8(spark: SparkSession, d: str) -> DataFrame:
    """The eight newest, by a fallback chain of times."""
    when = F.coalesce("o_orderdate", F.lit("1970-01-01").cast("timestamp_ntz"))
    return table(spark, d, "orders").orderBy(when.desc(), "o_orderkey").limit(8).select("o_orderkey", "o_orderdate")


def sort_filter_limit(spark: SparkSession, d: str) -> DataFrame:
    """Sort, filter, then limit."""
    return table(spark, d, "orders").filter("o_orderstatus = 'P'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


def limit_then_filter(spark: SparkSession, d: str) -> DataFrame:
    """The last 200 of a user first, the service afterwards."""
    last = table(spark, d, "events").filter("user_id = 1").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    return last.filter("event_type = 'purchase'").select("event_id", "value")


def status_legacy_map(spark: SparkSession, d: str) -> DataFrame:
    """Old status names read as new ones."""
    new = F.when(F.col("o_orderstatus") == "F", "new").when(F.col("o_orderstatus") == "O", "proof_sent").otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").groupBy(new.alias("status")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_key"))


def first_match_owner(spark: SparkSession, d: str) -> DataFrame:
    """The first user with either key, as two equi-joins instead of one on OR."""
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_name")
    keys = o.select("o_orderkey", F.explode(F.array("o_custkey", (F.col("o_orderkey") % 97).cast("long"))).alias("k"))
    return keys.join(c, keys.k == c.c_custkey).groupBy("o_orderkey").agg(F.min(F.struct("c_custkey", "c_name")).alias("m")).select("o_orderkey", F.col("m.c_custkey").alias("owner"), F.col("m.c_name").alias("owner_name"))


def free_claim_conflict(spark: SparkSession, d: str) -> DataFrame:
    """Users of whom another user has the same device or address, by counts of users per key."""
    e = table(spark, d, "events").select("user_id", (F.col("event_id") % 4001).alias("device"), F.floor("value").cast("long").alias("ip"))

    def shared(key: str) -> DataFrame:
        who = e.select("user_id", key).filter(F.col(key).isNotNull()).distinct()
        many = who.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
        return who.join(many, key, "left_semi").select("user_id")

    return shared("device").union(shared("ip")).distinct()


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """What stays after the jobs of some clients go."""
    gone = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    jobs = table(spark, d, "orders").join(gone, "o_custkey", "left_anti").select(F.col("o_orderkey").alias("l_orderkey"))
    left = table(spark, d, "lineitem").join(jobs, "l_orderkey", "left_semi")
    return left.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("jobs"))


def domain_suffix_match(spark: SparkSession, d: str) -> DataFrame:
    """Every dotted suffix of a host but the bare top-level domain, against a list."""
    host = F.split(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1), "\\.")
    p = table(spark, d, "pages").select("page_id", host.alias("h"))
    tails = p.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("h") - 1, F.lit(1))), lambda i: F.concat_ws(".", F.slice("h", i, F.size("h"))))).alias("tail"))
    listed = spark.createDataFrame([("example.net",), ("example.org",)], "tail string")
    return tails.join(F.broadcast(listed), "tail", "left_semi").select("page_id").distinct()


#: Names of internal steps that messages don't show.
INTERNAL = r"invent-warp(?:-forced-bundled)?|invent/[\w-]+|ecc-multiROI-TPS-bundled|ecc-multiROI-TPS|ecc-multiROI|TPS-bundled|TPS|bundled|vai-trace(?:\s+fallback)?|vtracer|raster-corel|hallucinate(?:-after)?|invent-hallucinate|src-bezier(?:-fallback)?|lab-hier|bezier|Vectorizer\.AI|legacy(?:\s+fallback)?|fallback|path-transfer|corel-import|auto\s+path-transfer|invent-transfer|invent-trace|invent-hybrid|local-trace|local-js"
UNITS = r"(\d+)\s+(layers?|colors?|paths?|stitches)\b"


def public_message(s: Column) -> Column:
    """P10: a message by its kind, with its count and unit, or without internal names."""
    word = r"(?i)\b(?:" + INTERNAL + r")\b"
    n, unit = F.regexp_extract(s, "(?i)" + UNITS, 1), F.lower(F.regexp_extract(s, "(?i)" + UNITS, 2))
    unit = F.when(unit.startswith("color") | unit.startswith("layer"), "layers").when(unit.startswith("path"), "paths").otherwise(unit)
    count = F.concat(n, F.lit(" "), unit)
    label = lambda text: F.when(n != "", F.concat(F.lit(text + " \u00b7 "), count)).otherwise(text)
    left = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, word, ""), r"\s*\u00b7\s*\u00b7+", " \u00b7 "), r"\s{2,}", " ")
    left = F.regexp_replace(F.regexp_replace(F.regexp_replace(left, r"\s*\u00b7\s*$", ""), r"^\s*\u00b7\s*", ""), r"^\s+|\s+$", "")
    bare = F.when(n != "", F.concat(F.lit("Vectorized \u00b7 "), count)).otherwise("Update")
    inner = F.when(left.rlike(r"^[\u00b7\s/-]*$"), bare).when((n != "") & (F.instr(left, n) == 0), F.concat(left, F.lit(" \u00b7 "), count)).otherwise(left)
    hidden = s.rlike(word) | s.rlike("(?i)invent-warp|ecc-multiROI|vai-trace|vtracer|lab-hier|hallucinate|src-bezier")
    made = s.rlike("(?i)^Vectorized") | (s.rlike("(?i)vectoriz") & s.rlike(word))
    return F.when(s.rlike("(?i)^Pro Vectorize") | s.rlike(r"(?i)Vectorizer\.AI"), label("Pro Vectorize")).when(made, label("Vectorized")).when(s.rlike("(?i)Corel import"), label("Art imported")).when(hidden, inner).otherwise(s)


def _messages(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id").cast("string")
    kinds = [F.concat(F.lit("Pro Vectorize: "), k, F.lit(" Colors")), F.lit("vectorized by lab-hier"), F.concat(F.lit("Corel import with "), k, F.lit("  paths")), F.concat(F.lit("vtracer \u00b7  \u00b7 ready \u00b7 "), k, F.lit(" stitches")), F.lit("legacy fallback \u00b7 TPS"), F.concat(F.lit("bezier "), k, F.lit(" layers bezier")), F.concat(F.lit("Order "), k, F.lit(" paid")), F.concat(F.lit("bundled \u00b7 "), k, F.lit(" PATHS removed"))]
    return table(spark, d, "events").select("event_id", F.element_at(F.array(*kinds), (F.col("event_id") % 8 + 1).cast("int")).alias("message"))


def event_message_sanitize(spark: SparkSession, d: str) -> DataFrame:
    """P10 over messages of every kind."""
    return _messages(spark, d).select("event_id", public_message(F.col("message")).alias("message"))


QUERIES = [job_board_search, board_status_counts, client_job_counts, shop_counts, admin_overview, recent_top8, sort_filter_limit, limit_then_filter, status_legacy_map, first_match_owner, free_claim_conflict, cascade_delete, domain_suffix_match, event_message_sanitize]
SQL = {
    "job_board_search": "SELECT o_orderkey, c_name, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(concat_ws(' ', o_orderpriority, o_orderstatus, c_name)), '1-urgent o')",
    "board_status_counts": "SELECT s.status, count(o_orderkey) AS n FROM (VALUES ('F'),('O'),('P'),('X')) s(status) LEFT JOIN orders ON o_orderstatus = s.status GROUP BY 1",
    "client_job_counts": "SELECT c_custkey, count(o_orderkey) AS jobs FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "shop_counts": "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS users, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS staff FROM nation",
    "admin_overview": "SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS in_debt, (SELECT count(*) FROM orders) AS jobs, (SELECT count(*) FROM supplier) AS shops",
    "recent_top8": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 8",
    "sort_filter_limit": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
    "limit_then_filter": "SELECT event_id, value FROM (SELECT * FROM events WHERE user_id = 1 ORDER BY ts DESC, event_id DESC LIMIT 200) WHERE event_type = 'purchase'",
    "status_legacy_map": "SELECT CASE o_orderstatus WHEN 'F' THEN 'new' WHEN 'O' THEN 'proof_sent' ELSE o_orderstatus END AS status, count(*) AS n, max(o_orderkey) AS last_key FROM orders GROUP BY 1",
    "first_match_owner": "SELECT o_orderkey, min(c_custkey) AS owner, arg_min(c_name, c_custkey) AS owner_name FROM orders JOIN customer ON c_custkey = o_custkey OR c_custkey = o_orderkey % 97 GROUP BY 1",
    "free_claim_conflict": "WITH e AS (SELECT DISTINCT user_id, event_id % 4001 AS device, CAST(floor(value) AS BIGINT) AS ip FROM events) SELECT DISTINCT a.user_id FROM e a WHERE EXISTS (SELECT 1 FROM e b WHERE b.user_id <> a.user_id AND b.device = a.device) OR EXISTS (SELECT 1 FROM e b WHERE b.user_id <> a.user_id AND b.ip = a.ip)",
    "cascade_delete": "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS jobs FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) GROUP BY 1",
    "domain_suffix_match": "SELECT DISTINCT page_id FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS h FROM pages) WHERE h IN ('example.net', 'example.org') OR ends_with(h, '.example.net') OR ends_with(h, '.example.org')",
    "event_message_sanitize": "SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'Pro Vectorize \u00b7 ' || event_id || ' layers' WHEN 1 THEN 'Vectorized' WHEN 2 THEN 'Art imported \u00b7 ' || event_id || ' paths' WHEN 3 THEN 'ready \u00b7 ' || event_id || ' stitches' WHEN 4 THEN 'Update' WHEN 5 THEN event_id || ' layers' WHEN 6 THEN 'Order ' || event_id || ' paid' ELSE event_id || ' PATHS removed' END AS message FROM events",
}

"""Files and documents of jobs: PNG round trips, layered SVG, CSV lines, nesting, transitions (S06, K02, K03, K07, K13, K14 marks, S10, S11, C24, J30, F19, T06)."""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stitchyard.sources import png, svg
from stitchyard.operators.images import pixels
from stitchyard.operators.raster import SHOT, shots
from stitchyard.sources.tables import table


#: The ends of the ticks at a sheet's corners.
TICKS = [("-0.25", "0", "-0.04", "0"), ("-0.25", "{h}", "-0.04", "{h}"), ("{w1}", "0", "{w2}", "0"), ("{w1}", "{h}", "{w2}", "{h}"), ("0", "-0.25", "0", "-0.04"), ("{w}", "-0.25", "{w}", "-0.04"), ("0", "{h1}", "0", "{h2}"), ("{w}", "{h1}", "{w}", "{h2}")]
MARKS_SHEET = '<svg width="{W}in" height="{H}in" viewBox="-0.25 -0.25 {W} {H}"><path d="M 0 0 L {w} 0 L {w} {h} L 0 {h} Z" fill="none" stroke="#e106d7"/>' + "".join(f'<line x1="{a}" y1="{b}" x2="{c}" y2="{e}" stroke="#111" stroke-width="0.02"/>' for a, b, c, e in TICKS) + "</svg>"


def png_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every picture written as a PNG and read back."""
    img = pixels(shots(spark, d), *"rgba").select(F.col("id").cast("string").alias("path"), "x", "y", *"rgba")
    return png.pixels(png.files(img)).select(F.col("path").cast("long").alias("id"), "x", "y", *"rgba")


def _rects(spark: SparkSession, d: str) -> DataFrame:
    """A rectangle in one of five fills for each part; its page is its size."""
    p = table(spark, d, "part").select("p_partkey", "p_size", *[F.expr(f"p_partkey * {m} % {n}").alias(c) for c, m, n in (("x", 7, 90), ("y", 11, 80), ("w", 3, 41), ("h", 5, 37), ("k", 1, 5))])
    path = F.format_string("M%d,%dh%dv%dh-%dz", "x", "y", F.col("w") + 1, F.col("h") + 1, F.col("w") + 1)
    return p.select("p_size", "p_partkey", F.concat(F.lit("#00"), F.col("k"), F.lit("0ff")).alias("fill"), path.alias("path"))


def svg_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page's SVG text, a group for each fill in the order of first sight."""
    layers = _rects(spark, d).groupBy("p_size", "fill").agg(F.min("p_partkey").alias("first"), F.array_sort(F.collect_list(F.struct("p_partkey", "path"))).alias("a"))
    body = F.concat(F.lit('<g fill="'), F.col("fill"), F.lit('" fill-rule="evenodd"><path d="'), F.concat_ws(" ", "a.path"), F.lit('"/></g>'))
    pages = layers.groupBy("p_size").agg(F.array_sort(F.collect_list(F.struct("first", body.alias("t")))).alias("a"))
    return pages.select("p_size", F.concat(F.lit("<svg>"), F.concat_ws("", "a.t"), F.lit("</svg>")).alias("svg"))


def svg_layers(spark: SparkSession, d: str) -> DataFrame:
    """The layers of those pages read back from the text: place, fill and number of subpaths."""
    group = r"'<g fill=\"(#[0-9a-f]+)\"[^>]*><path d=\"([^\"]*)\"'"
    parts = svg_pages(spark, d).select("p_size", F.expr(f"arrays_zip(regexp_extract_all(svg, r{group}, 1), regexp_extract_all(svg, r{group}, 2))").alias("z"))
    rows = parts.select("p_size", F.posexplode("z").alias("layer", "p"))
    return rows.select("p_size", "layer", F.col("p.0").alias("fill"), F.expr("regexp_count(p.`1`, 'M')").cast("long").alias("subpaths"))


def drawings(spark: SparkSession, d: str) -> DataFrame:
    """(id, svg): drawings of suppliers as other programs write them: groups in groups, both quotes, short and functional fills, ends too many."""
    text = (
        '<?xml version="1.0"?>\n<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 200 100">\n<g data-name="Paper sheet"><path d="M0 0h200v100h-200z" fill="#ffffff"/></g>\n<rect width="9" height="9" fill="#abcdef"/>'
        '<g fill="#F0a" transform="translate(10, {k})">\n <path d=\'M{m} 2 L3,4\'/>\n <g transform=\'translate(3)\' fill-rule="evenodd" fill="none">\n <path fill="rgb(1,2,{m})" d="m5 5 l10 0 0,{k}z"/><g/><path d="M1 1H{k}V9z"></path>\n </g>'
        '<PATH transform="translate(1 2)" d="M0 0 c1 1 2 2 {k} 3 s1 1 2 2 T9 9"/></g></g>\n<path d="M9 9h1v1z" fill="#123456cc" fill-rule="EvenOdd"/><path d="M{k} 9l1 1" fill="#f0A"/><path d="M1 1" fill="url(#x)"/><path fill="#000"/></svg>'
    )
    parts = re.split(r"(\{[km]\})", text)
    at = {"{k}": (F.col("id") % 7 + 1).cast("string"), "{m}": (F.col("id") % 5).cast("string")}
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")).select("id", F.concat(*[at.get(x, F.lit(x)) for x in parts]).alias("svg"))


def svg_scan(spark: SparkSession, d: str) -> DataFrame:
    """S10 of those drawings, on a sheet of 10 by 5 inches."""
    return svg.layered(drawings(spark, d), F.lit(10 / 200), F.lit(5 / 100))


def traced(spark: SparkSession, d: str) -> DataFrame:
    """(id, svg): traced pictures of suppliers, 120 by 80: a sheet, a nearly white ground, and eight paths in three fills, some moved."""
    k = F.col("id")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
    x, y = (k * 7 + F.col("j") * 11) % 90, (k * 5 + F.col("j") * 13) % 60
    fill = F.element_at(F.array(*map(F.lit, ("#112233", "#aabbcc", "#F00"))), ((k + F.col("j")) % 3 + 1).cast("int"))
    path = F.concat(F.lit('<path d="M '), x, F.lit(" "), y, F.lit(" L "), x + 9, F.lit(","), y + 9, F.lit(' Z" fill="'), fill, F.lit('" transform="translate('), F.col("j"), F.lit(",2)\"/>"))
    body = s.select("id", F.col("j"), path.alias("t")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("j", "t"))).alias("a"))
    head = '<svg width="120" height="80"><path d="M 0 0 L 120 0 L 120 80 L 0 80 Z" fill="#00ff00"/><path d="M 2 2 L 114 2 L 114 78 Z" fill="#fafafa"/><path d="M1 1" fill="none"/>'
    return body.select("id", F.concat(F.lit(head), F.array_join("a.t", ""), F.lit("</svg>")).alias("svg"))


def svg_traced(spark: SparkSession, d: str) -> DataFrame:
    """S11 of those pictures."""
    return svg.traced_layers(traced(spark, d))


def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a list of stones; names with quotes or commas are quoted."""
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))).otherwise(F.col("p_name"))
    safe = F.when(name.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(name)
    return table(spark, d, "part").select("p_partkey", F.concat_ws(",", F.col("p_partkey") % 12, F.col("p_size"), safe).alias("line"))


def ring_nesting(spark: SparkSession, d: str) -> DataFrame:
    """Of the boxes of a page, each one's smallest enclosing box (the lower key on ties) and how deep it lies; a page holds 40 boxes, so that pairs grow with the pages."""
    b = table(spark, d, "part").select(F.expr("p_partkey div 40").alias("page"), "p_partkey", *[F.expr(f"p_partkey * {m} % {n}").alias(c) for c, m, n in (("x", 7, 40), ("y", 11, 30), ("w", 13, 53), ("h", 17, 47))])
    outer = b.select("page", *[F.col(c).alias(f"o{c}") for c in ("p_partkey", *"xywh")])
    inside = F.expr("ox < x and oy < y and ox + ow > x + w and oy + oh > y + h")
    return b.join(outer, (b["page"] == outer["page"]) & inside).groupBy("p_partkey").agg(F.min(F.struct(F.expr("ow * oh"), "op_partkey")).alias("m"), F.count("*").alias("depth")).select("p_partkey", F.col("m.op_partkey").alias("parent"), "depth")


def job_packets(spark: SparkSession, d: str) -> DataFrame:
    """The packet of a job as JSON: its size, numbers and state, and its files by line and name; a job without artwork says null."""
    k = F.col("o_orderkey")
    files = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("art-"), F.col("l_partkey").cast("string"), F.when(F.col("l_suppkey") % 2 == 0, ".svg").otherwise(".eps")).alias("name"))
    assets = files.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "name"))), lambda f: f["name"]).alias("assets"))
    jobs = table(spark, d, "orders").join(assets, "o_orderkey", "left")
    size = F.struct(((k % 40) / 4.0).alias("width"), ((k % 24) / 2.0).alias("height"))
    job = F.struct(k.alias("id"), F.col("o_orderpriority").alias("title"), F.when(k % 2 == 0, "dtf").otherwise("vinyl").alias("method"), size.alias("size_in"), (k % 50 + 1).alias("qty"), F.col("o_orderstatus").alias("status"), F.when(k % 3 != 0, F.concat(F.lit("uploads/"), k.cast("string"), F.lit(".png"))).alias("artwork"))
    packet = F.struct(job.alias("job"), F.coalesce("assets", F.array().cast("array<string>")).alias("assets"), F.when(k % 5 == 0, "rush").otherwise("").alias("notes"))
    return jobs.select("o_orderkey", F.to_json(packet, {"ignoreNullFields": "false"}).alias("packet"))


def _inches(v: Column) -> Column:
    """Inches in hundredths as text, without closing zeros."""
    return F.regexp_replace(v.cast("decimal(12,2)").cast("string"), r"\.?0+$", "")


def cutter_marks(spark: SparkSession, d: str) -> DataFrame:
    """A sheet with a job's outline and two ticks of a quarter inch at each corner, 0.04 inch off; sizes without a value are one inch."""
    part = table(spark, d, "part").select("p_partkey", *[F.when(F.col("p_size") % m != 0, F.col("p_size") / n).otherwise(1).cast("decimal(12,2)").alias(c) for c, m, n in (("w", 7, 4), ("h", 5, 8))])
    at = {k: _inches(F.expr(e)) for k, e in {"w": "w", "h": "h", "W": "w + 0.5", "H": "h + 0.5", "w1": "w + 0.04", "w2": "w + 0.25", "h1": "h + 0.04", "h2": "h + 0.25"}.items()}
    pieces = re.split("[{}]", MARKS_SHEET)
    return part.select("p_partkey", F.concat(*[at[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)]).alias("svg"))


#: The ranks of the states of a job.
RANK = {"view": 0, "click": 1, "signup": 2, "purchase": 3, "error": 4}


def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    """events as states; whether each is forward from the one before it."""
    rank = F.create_map(*[F.lit(v) for kv in RANK.items() for v in kv])[F.col("event_type")]
    before = F.lag("rank").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("rank", rank).select("event_id", F.coalesce(F.col("rank") > before, F.lit(True)).alias("forward"))


def stale_uploads(spark: SparkSession, d: str) -> DataFrame:
    """What was last touched over 14 days before the newest, by kind."""
    e = table(spark, d, "events")
    newest = e.agg(F.max("ts").alias("newest"))
    return e.join(F.broadcast(newest)).groupBy("event_type").agg(F.count_if(F.col("ts") < F.col("newest") - F.expr("interval 14 days")).alias("stale"), F.count("*").alias("n"))


_RECTS = "r AS (SELECT p_size, p_partkey, '#00' || (p_partkey % 5) || '0ff' AS fill, 'M' || (p_partkey*7%90) || ',' || (p_partkey*11%80) || 'h' || (p_partkey*3%41+1) || 'v' || (p_partkey*5%37+1) || 'h-' || (p_partkey*3%41+1) || 'z' AS path FROM part)"
QUERIES = [png_round_trip, svg_pages, svg_layers, svg_scan, svg_traced, csv_lines, ring_nesting, job_packets, cutter_marks, status_transitions, stale_uploads]
_AT = lambda *v: " || ' ' || ".join(x if x.startswith("'") else f"printf('%.4f', ({x})*0.05e0)" for x in v)
_SCAN = [
    (0, "'#ff00aa'", 0, "nonzero", _AT("'M'", "m+10", "2+k", "'L'", "13", "4+k")),
    (1, "'#01020' || m", 0, "evenodd", _AT("'m'", "18", "5+k", "'l'", "28", "5+k", "28", "5+2*k", "'z'")),
    (0, "'#ff00aa'", 1, "evenodd", _AT("'M'", "14", "1+k", "'H'", "k+13", "'V'", "9+k", "'z'")),
    (0, "'#ff00aa'", 2, "nonzero", _AT("'M'", "11", "k+2", "'c'", "12", "k+3", "13", "k+4", "k+11", "k+5", "'s'", "k+12", "k+6", "k+13", "k+7", "'T'", "20", "k+11")),
    (2, "'#123456'", 0, "evenodd", _AT("'M'", "9", "9", "'h'", "10", "'v'", "10", "'z'")),
    (0, "'#ff00aa'", 3, "nonzero", _AT("'M'", "k", "9", "'l'", "k+1", "10")),
]
SQL = {
    "svg_traced": "WITH p AS (SELECT s_suppkey AS id, j, (s_suppkey*7+j*11)%90+j AS x, (s_suppkey*5+j*13)%60+2 AS y, ['#112233', '#aabbcc', '#ff0000'][(s_suppkey+j)%3+1] AS hex FROM supplier, range(8) t(j)), n AS (SELECT id, j, hex, 5 + sum(length(rtrim(rtrim(printf('%.4f', v), '0'), '.')) + 1) AS n FROM (SELECT id, j, hex, unnest([x*10/120e0, y*10/80e0, (x+9)*10/120e0, (y+9)*10/80e0]) AS v FROM p) GROUP BY ALL), g AS (SELECT id, hex, count(*) AS paths, CAST(sum(n) AS BIGINT) AS length, min(j) AS first FROM n GROUP BY id, hex) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY length DESC, first) - 1 AS INT) AS layer, hex, paths, length FROM g",
    "svg_scan": "WITH s AS (SELECT s_suppkey AS id, s_suppkey%7+1 AS k, s_suppkey%5 AS m FROM supplier) " + " UNION ALL ".join(f"SELECT id, {n} AS layer, {h} AS hex, {p} AS place, '{r}' AS rule, {t} AS d FROM s" for n, h, p, r, t in _SCAN),
    "png_round_trip": f"WITH {SHOT} SELECT id, x, y, " + ", ".join(f"CAST({c} AS INT) AS {c}" for c in "rgba") + " FROM img",
    "svg_pages": f"""WITH {_RECTS}, l AS (SELECT p_size, fill, min(p_partkey) AS f, '<g fill="' || fill || '" fill-rule="evenodd"><path d="' || string_agg(path, ' ' ORDER BY p_partkey) || '"/></g>' AS t FROM r GROUP BY p_size, fill) SELECT p_size, '<svg>' || string_agg(t, '' ORDER BY f) || '</svg>' AS svg FROM l GROUP BY p_size""",
    "svg_layers": f"WITH {_RECTS}, l AS (SELECT p_size, fill, min(p_partkey) AS f, count(*) AS subpaths FROM r GROUP BY p_size, fill) SELECT p_size, CAST(row_number() OVER (PARTITION BY p_size ORDER BY f) - 1 AS INT) AS layer, fill, subpaths FROM l",
    "csv_lines": """WITH n AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 3 = 0 THEN p_name || ', "' || p_brand || '"' ELSE p_name END AS name FROM part) SELECT p_partkey, (p_partkey % 12) || ',' || p_size || ',' || CASE WHEN regexp_matches(name, '[",\n]') THEN '"' || replace(name, '"', '""') || '"' ELSE name END AS line FROM n""",
    "ring_nesting": "WITH b AS (SELECT p_partkey // 40 AS page, p_partkey, p_partkey*7%40 AS x, p_partkey*11%30 AS y, p_partkey*13%53 AS w, p_partkey*17%47 AS h FROM part), i AS (SELECT b.p_partkey, o.p_partkey AS parent, count(*) OVER (PARTITION BY b.p_partkey) AS depth, row_number() OVER (PARTITION BY b.p_partkey ORDER BY o.w*o.h, o.p_partkey) AS k FROM b JOIN b o ON o.page = b.page AND o.x < b.x AND o.y < b.y AND o.x+o.w > b.x+b.w AND o.y+o.h > b.y+b.h) SELECT p_partkey, parent, depth FROM i WHERE k = 1",
    "job_packets": """WITH a AS (SELECT l_orderkey, string_agg('"art-' || l_partkey || CASE WHEN l_suppkey % 2 = 0 THEN '.svg"' ELSE '.eps"' END, ',' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR) || CASE WHEN l_suppkey % 2 = 0 THEN '.svg' ELSE '.eps' END) AS t FROM lineitem GROUP BY 1) SELECT o_orderkey, '{"job":{"id":' || o_orderkey || ',"title":"' || o_orderpriority || '","method":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'dtf' ELSE 'vinyl' END || '","size_in":{"width":' || CAST(o_orderkey % 40 / 4e0 AS VARCHAR) || ',"height":' || CAST(o_orderkey % 24 / 2e0 AS VARCHAR) || '},"qty":' || (o_orderkey % 50 + 1) || ',"status":"' || o_orderstatus || '","artwork":' || CASE WHEN o_orderkey % 3 <> 0 THEN '"uploads/' || o_orderkey || '.png"' ELSE 'null' END || '},"assets":[' || coalesce(t, '') || '],"notes":"' || CASE WHEN o_orderkey % 5 = 0 THEN 'rush' ELSE '' END || '"}' AS packet FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""",
    "cutter_marks": "WITH p AS (SELECT p_partkey, CAST(CASE WHEN p_size % 7 <> 0 THEN p_size / 4e0 ELSE 1 END AS DECIMAL(12,2)) AS w, CAST(CASE WHEN p_size % 5 <> 0 THEN p_size / 8e0 ELSE 1 END AS DECIMAL(12,2)) AS h FROM part), t AS (SELECT p_partkey, " + ", ".join(f"regexp_replace(CAST(CAST({e} AS DECIMAL(12,2)) AS VARCHAR), '\\.?0+$', '') AS {n}" for n, e in (("w0", "w"), ("h0", "h"), ("ww", "w + 0.5"), ("hh", "h + 0.5"), ("w1", "w + 0.04"), ("w2", "w + 0.25"), ("h1", "h + 0.04"), ("h2", "h + 0.25"))) + " FROM p) SELECT p_partkey, '" + MARKS_SHEET.format(w="' || w0 || '", h="' || h0 || '", W="' || ww || '", H="' || hh || '", w1="' || w1 || '", w2="' || w2 || '", h1="' || h1 || '", h2="' || h2 || '") + "' AS svg FROM t",
    "status_transitions": "WITH r AS (SELECT *, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END AS rank FROM events) SELECT event_id, coalesce(rank > lag(rank) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS forward FROM r",
    "stale_uploads": "SELECT event_type, count(*) FILTER (ts < newest - INTERVAL 14 DAYS) AS stale, count(*) AS n FROM events, (SELECT max(ts) AS newest FROM events) GROUP BY event_type",
}

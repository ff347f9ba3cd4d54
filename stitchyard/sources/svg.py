"""SVG texts as rows: a stream of tags with what groups hand down, and paths as scaled tokens.

A text becomes one row a tag. How deep a tag lies is a running sum; a group's end takes over from its beginning, the
last one at the same depth; translations add up and are taken away again; the fill that holds is that of the last
group with a fill at the same count of open groups with fills. Nothing is walked with a stack.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many numbers a command takes.
TAKE = {"H": 1, "V": 1, "M": 2, "L": 2, "T": 2, "S": 4, "Q": 4, "C": 6, "A": 7}
TAG = r"<(/?)([a-zA-Z][\w:-]*)([^>]*)>"
TOKEN = r"([MmLlHhVvCcQqTtSsAaZz]|-?\d*\.?\d+(?:e[-+]?\d+)?)"


def attribute(attrs: Column, name: str) -> Column:
    """An attribute's value, null where there is none."""
    found = rf"(?i)\b{name}\s*=\s*[\"']([^\"']*)[\"']"
    return F.when(attrs.rlike(found), F.regexp_extract(attrs, found, 1))


def hex_fill(fill: Column) -> Column:
    """A fill as six digits, or null for none; names stay."""
    s = F.lower(F.trim(fill))
    rgb = r"^rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)"
    two = lambda k: F.lower(F.lpad(F.hex(F.regexp_extract(s, rgb, k).cast("int")), 2, "0"))
    one = lambda k: F.substring(s, k, 1)
    short = F.concat(F.lit("#"), *[one(k) for k in (2, 2, 3, 3, 4, 4)])
    return F.when(s.isNull() | s.isin("", "none", "transparent") | s.contains("url("), None).when(s.rlike(rgb), F.concat(F.lit("#"), two(1), two(2), two(3))).when(~s.startswith("#"), s).when(F.length(s) == 4, short).otherwise(F.substring(s, 1, 7))


def _shift(attrs: Column, k: int) -> Column:
    number = F.regexp_extract(F.coalesce(attribute(attrs, "transform"), F.lit("")), r"translate\(\s*([-+\d.eE]+)(?:[ ,]+([-+\d.eE]+))?\s*\)", k)
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def svg_tags(docs: DataFrame) -> DataFrame:
    """(id, pos, close, name, attrs) of (id, svg), in the order of the text."""
    part = lambda k: F.regexp_extract_all("svg", F.lit(TAG), F.lit(k))
    z = docs.select("id", F.posexplode(F.arrays_zip(part(1).alias("c"), part(2).alias("n"), part(3).alias("a"))).alias("pos", "t"))
    return z.select("id", "pos", (F.col("t.c") == "/").alias("close"), F.lower("t.n").alias("name"), F.col("t.a").alias("attrs"))


def svg_paths(docs: DataFrame) -> DataFrame:
    """(id, pos, fill, rule, tx, ty, d): the filled paths of (id, svg) with what their groups hand down.

    A path in a group named as paper is left out, and so is one without d or any fill. Ends without a beginning are
    ignored; a group that ends in its own tag hands nothing down.
    """
    t = svg_tags(docs).filter("name in ('g', 'path')").withColumn("own", F.col("attrs").rlike(r"/\s*$"))
    a = F.col("attrs")
    t = t.filter("not (name = 'g' and own and not close) and not (name = 'path' and close)")
    group = F.col("name") == "g"
    t = t.select("id", "pos", "name", "close", F.when(group & ~F.col("close"), 1).when(group, -1).otherwise(0).alias("step"), hex_fill(attribute(a, "fill")).alias("fill"), attribute(a, "fill-rule").alias("rule"), F.lower(F.coalesce(attribute(a, "data-name"), F.lit(""))).contains("paper").alias("paper"), _shift(a, 1).alias("tx"), _shift(a, 2).alias("ty"), attribute(a, "d").alias("d"))
    run = Window.partitionBy("id").orderBy("pos")
    t = t.withColumn("sum", F.sum("step").over(run))
    t = t.withColumn("floor", F.least(F.lit(0), F.min("sum").over(run)))
    # an end at the ground has no beginning
    t = t.withColumn("floor0", F.coalesce(F.lag("floor").over(run), F.lit(0))).filter("not (step = -1 and floor < floor0)")
    t = t.withColumn("depth", F.col("sum") - F.col("floor") + F.when(F.col("step") == -1, 1).otherwise(0))
    level = Window.partitionBy("id", "depth").orderBy("pos")
    opened = lambda c: F.last(F.when(F.col("step") == 1, F.struct(F.col(c).alias("v"))), True).over(level)["v"]
    t = t.withColumns({f"o_{c}": opened(c) for c in ("fill", "rule", "paper", "tx", "ty")})
    add = lambda c: F.sum(F.col("step") * F.col(f"o_{c}")).over(run)
    count = lambda c: F.sum(F.when(F.col(f"o_{c}").isNotNull(), F.col("step")).otherwise(0)).over(run)
    t = t.withColumns({"gx": add("tx"), "gy": add("ty"), "fills": count("fill"), "rules": count("rule")})
    held = lambda c, n: F.when(F.col(n) > 0, F.last(F.when((F.col("step") == 1), F.col(c)), True).over(Window.partitionBy("id", n).orderBy("pos")))
    t = t.withColumns({"g_fill": held("fill", "fills"), "g_rule": held("rule", "rules")})
    fill = F.coalesce("fill", "g_fill")
    p = t.filter((F.col("name") == "path") & (F.coalesce("d", F.lit("")) != "") & fill.isNotNull() & ~((F.col("depth") > 0) & F.coalesce("o_paper", F.lit(False))))
    return p.select("id", "pos", fill.alias("fill"), F.lower(F.coalesce("rule", "g_rule", F.lit("nonzero"))).alias("rule"), (F.coalesce("gx", F.lit(0.0)) + F.col("tx")).alias("tx"), (F.coalesce("gy", F.lit(0.0)) + F.col("ty")).alias("ty"), "d")


def scaled_paths(paths: DataFrame, sx: Column, sy: Column, short: bool = False) -> DataFrame:
    """C14: paths (id, pos, tx, ty, d) moved and scaled, numbers with four places (``short``: without zeros at the end); commands keep their letters, points come out absolute.

    The point at which a relative command begins is the last absolute one plus what relative ones have added since: a
    running sum for each axis. Numbers before any command, or too few for one, are left out.
    """
    tokens = F.regexp_extract_all(F.replace("d", F.lit(","), F.lit(" ")), F.lit(TOKEN), F.lit(1))
    t = paths.select("id", "pos", "tx", "ty", sx.alias("sx"), sy.alias("sy"), F.posexplode(tokens).alias("k", "t")).withColumn("cmd", F.when(F.col("t").rlike("^[A-Za-z]$"), F.col("t")))
    run = Window.partitionBy("id", "pos").orderBy("k")
    t = t.withColumns({"n": F.count("cmd").over(run), "op": F.last("cmd", True).over(run)}).filter("op is not null")
    t = t.withColumn("take", F.coalesce(F.create_map(*[F.lit(v) for kv in TAKE.items() for v in kv])[F.upper("op")], F.lit(1)))
    own = Window.partitionBy("id", "pos", "n")
    t = t.withColumns({"arg": F.row_number().over(own.orderBy("k")) - 2, "args": F.count("*").over(own) - 1}).filter("cmd is not null or (upper(op) <> 'Z' and arg < args - args % take)")
    t = t.withColumn("slot", F.col("arg") % F.col("take")).withColumn("up", F.upper("op"))
    axis = F.expr("case when cmd is not null then 'c' when up = 'H' then 'x' when up = 'V' then 'y' when up = 'A' then case slot when 5 then 'x' when 6 then 'y' when 0 then 'rx' when 1 then 'ry' else 'as' end when slot % 2 = 0 then 'x' else 'y' end")
    t = t.withColumns({"axis": axis, "v": F.when(F.col("cmd").isNull(), F.col("t").cast("double"))})
    anchor = F.expr("axis in ('x', 'y') and (take = 1 or slot >= take - 2)")
    t = t.withColumns({"anchor": anchor, "rel": F.col("op") != F.col("up")})
    line = Window.partitionBy("id", "pos", "axis").orderBy("k")
    t = t.withColumn("since", F.sum(F.when(F.col("anchor") & ~F.col("rel"), 1).otherwise(0)).over(line))
    t = t.withColumn("after", F.sum(F.when(F.col("anchor"), F.col("v")).otherwise(0.0)).over(Window.partitionBy("id", "pos", "axis", "since").orderBy("k")))
    at = F.col("v") + F.when(F.col("rel"), F.coalesce(F.lag("after").over(line), F.lit(0.0))).otherwise(0.0)
    t = t.withColumn("at", at)
    plain = lambda c: F.format_string("%.4f", c)
    four = (lambda c: F.regexp_replace(plain(c), r"\.?0+$", "")) if short else plain
    text = F.when(F.col("axis") == "c", F.col("t")).when(F.col("axis") == "x", four((F.col("at") + F.col("tx")) * F.col("sx"))).when(F.col("axis") == "y", four((F.col("at") + F.col("ty")) * F.col("sy"))).when(F.col("axis") == "rx", four(F.col("v") * F.col("sx"))).when(F.col("axis") == "ry", four(F.col("v") * F.col("sy"))).otherwise(F.col("t"))
    return t.groupBy("id", "pos").agg(F.sort_array(F.collect_list(F.struct("k", text.alias("s")))).alias("q")).select("id", "pos", F.array_join("q.s", " ").alias("d"))


def layered(docs: DataFrame, sx: Column, sy: Column) -> DataFrame:
    """(id, layer, hex, place, rule, d): paths by fill, layers in the order of their first paths."""
    p = svg_paths(docs)
    both = p.drop("d", "tx", "ty").join(scaled_paths(p, sx, sy), ["id", "pos"])
    first = both.withColumn("first", F.min("pos").over(Window.partitionBy("id", "fill")))
    layer, place = F.dense_rank().over(Window.partitionBy("id").orderBy("first")) - 1, F.row_number().over(Window.partitionBy("id", "fill").orderBy("pos")) - 1
    return first.select("id", layer.alias("layer"), F.col("fill").alias("hex"), place.alias("place"), "rule", "d")


def traced_layers(docs: DataFrame, inches: float = 10.0) -> DataFrame:
    """(id, layer, hex, paths, length) of traced pictures (id, svg) of so many inches: fills by the total length of their scaled paths, the longest first.

    Paths that cover 98 % of the sheet both ways go, and so do nearly white ones that cover 90 %. A path is an empty
    element with d and fill; a translation is added to its points. Bounds take numbers by pairs, as traced paths have.
    """
    sheet = lambda side: F.coalesce(F.regexp_extract("svg", rf'\b{side}="([\d.]+)"', 1).try_cast("double"), F.lit(1.0))
    tags = F.regexp_extract_all("svg", F.lit(r"<path\s+([^>]+?)\s*/>"), F.lit(1))
    p = docs.select("id", sheet("width").alias("w"), sheet("height").alias("h"), F.posexplode(tags).alias("pos", "a"))
    p = p.select("id", "w", "h", "pos", attribute(F.col("a"), "d").alias("d"), hex_fill(attribute(F.col("a"), "fill")).alias("fill"), _shift(F.col("a"), 1).alias("tx"), _shift(F.col("a"), 2).alias("ty")).filter("d is not null and fill is not null")
    number = F.regexp_extract_all("d", F.lit(r"(-?\d*\.?\d+(?:e[-+]?\d+)?)"), F.lit(1))
    box = lambda side: F.expr(f"aggregate(filter(transform(n, (v, i) -> if(i % 2 = {side}, v, null)), v -> v is not null), named_struct('a', 1e308D, 'z', -1e308D), (s, v) -> named_struct('a', least(s.a, v), 'z', greatest(s.z, v)), s -> s.z - s.a)")
    p = p.withColumn("n", F.transform(number, lambda v: v.cast("double"))).withColumns({"bw": box(0), "bh": box(1)})
    light = F.least(*[F.conv(F.substring("fill", k, 2), 16, 10).cast("int") for k in (2, 4, 6)]) >= 245
    covers = lambda share: (F.col("bw") >= F.col("w") * share) & (F.col("bh") >= F.col("h") * share)
    kept = p.filter(~covers(0.98) & ~(light & covers(0.9)))
    text = scaled_paths(kept, inches / F.col("w"), inches / F.col("h"), short=True)
    g = kept.select("id", "pos", "fill").join(text, ["id", "pos"]).groupBy("id", "fill").agg(F.count("*").alias("paths"), F.sum(F.length("d")).alias("length"), F.min("pos").alias("first"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("length"), "first")) - 1
    return g.select("id", place.alias("layer"), F.col("fill").alias("hex"), "paths", "length")

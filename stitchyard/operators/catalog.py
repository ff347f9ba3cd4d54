"""The catalogs of shops: made from styles, colours and product lines, and loaded if whole.

A shop's grid of styles and colours is cut before it is made: codes of a grid differ if styles and colours do, so that a cap on its rows
is one on its styles, and a shop with millions of parts ranks its styles once.
"""

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stitchyard.functions.steps import written
from stitchyard.sources.tables import table

# Rows of a catalog, rows of its grid, and the fillers that are tried.
WHOLE, GRID, FILLERS = 1000, 700, 500
#: The colours of blanks.
COLORS = [
    ("Black", "#1a1a1a"), ("White", "#f4f4f0"), ("Navy", "#1b2a4a"), ("Royal", "#2a4db3"), ("Red", "#b91c1c"), ("Athletic Heather", "#9aa0a6"), ("Dark Heather Grey", "#4b4f54"),
    ("Charcoal", "#3a3d40"), ("Forest Green", "#1f4a32"), ("Maroon", "#6b1c2a"), ("Gold", "#c9a227"), ("Orange", "#d45a12"), ("Purple", "#4b2d73"), ("Safety Green", "#b6e000"),
    ("Safety Orange", "#ff6a00"), ("Sand", "#cbb79a"), ("Light Blue", "#7eb6d4"), ("Cardinal", "#8b1e3f"), ("Kelly", "#2e8b57"), ("Pink", "#e89bb5"), ("Brown", "#5c3a21"), ("Lime", "#8fd14f"),
    ("Turquoise", "#2aa3a3"), ("Natural", "#e8dcc8"), ("Jet Black", "#0d0d0d"), ("Ash", "#d5d2cc"),
]
#: Product lines: code, kind, sizes, and how many of the colours each comes in.
LINES = [("TUMBLER", "tumbler", ["15", "20", "30", "SKINNY20"], 26), ("SIGN", "sign", ["ACM", "CORRUGATED", "ACRYLIC", "PVC", "DIBOND"], 12), ("HOOP", "hoop", ["4IN", "5IN", "6IN"], 16)]
FILLER = ("LASER-TAG", "plaque")


def slug(color: Column) -> Column:
    return F.upper(F.regexp_replace(color, "[^A-Za-z0-9]+", ""))


def _slug(color: str) -> str:
    return "".join(c for c in color if c.isalnum()).upper()


def _extras() -> list[tuple[int, str, str, str, str]]:
    """(at, code, kind, color, hex) of the lines and then the fillers; the same for every shop, bounded by the lists above."""
    rows = [(f"{line}-{size}-{_slug(c)}", kind, c, h) for line, kind, sizes, n in LINES for size in sizes for c, h in COLORS[:n]]
    rows += [(f"{FILLER[0]}-{n:03d}-{_slug(c)}", FILLER[1], c, h) for n in range(1, FILLERS + 1) for c, h in [COLORS[(n - 1) % len(COLORS)]]]
    return [(GRID + k, *r) for k, r in enumerate(rows)]


def _listed(names: tuple[str, ...], rows: list[tuple]) -> Column:
    """A fixed list as one literal: the first field is a number, the others are texts."""
    return F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rows])), f"array<struct<{names[0]}: int, {', '.join(f'{n}: string' for n in names[1:])}>>")


def catalogs(styles: DataFrame) -> DataFrame:
    """(shop, place, code, kind, color, hex) from styles (shop, at, code, kind): the grid in the order of ``at``, then lines and fillers; the first of a code
    wins, and a catalog ends with its thousandth row. A shop without styles has no rows here; styles without a code are left out."""
    of_code = styles.filter("code is not null").groupBy("shop", "code").agg(F.min(F.struct("at", "kind")).alias("s"))
    rank = F.row_number().over(Window.partitionBy("shop").orderBy("s.at", "code"))
    kept = of_code.withColumn("k", rank).filter(f"k <= {-(-GRID // len(COLORS))}")
    colors = _listed(("i", "color", "hex"), [(i, *c) for i, c in enumerate(COLORS)])
    grid = kept.withColumn("c", F.explode(colors)).withColumn("pos", (F.col("k") - 1) * len(COLORS) + F.col("c.i")).filter(f"pos < {GRID}")
    grid = grid.select("shop", "pos", F.concat_ws("-", "code", slug(F.col("c.color"))).alias("code"), F.col("s.kind").alias("kind"), "c.color", "c.hex")
    extras = _listed(("pos", "code", "kind", "color", "hex"), _extras())
    rest = kept.select("shop").distinct().select("shop", F.explode(extras).alias("e")).select("shop", "e.*")
    first = grid.unionByName(rest).groupBy("shop", "code").agg(F.min(F.struct("pos", "kind", "color", "hex")).alias("m"))
    place = F.row_number().over(Window.partitionBy("shop").orderBy("m.pos"))
    return first.withColumn("place", place).filter(f"place <= {WHOLE}").select("shop", "place", "code", "m.kind", "m.color", "m.hex")


def loaded(stored: DataFrame, made: DataFrame) -> DataFrame:
    """A shop's stored catalog if it has exactly a thousand rows, else the made one; rows gain ``rewritten``. Both have the columns of ``catalogs``."""
    whole = stored.groupBy("shop").agg(F.count("*").alias("n")).filter(f"n = {WHOLE}").select("shop")
    kept = stored.join(whole, "shop", "left_semi").withColumn("rewritten", F.lit(False))
    return kept.unionByName(made.join(whole, "shop", "left_anti").withColumn("rewritten", F.lit(True)))


def _styles(spark: SparkSession, d: str) -> DataFrame:
    """Parts as styles of the shop of their brand; codes of one shop repeat."""
    p = table(spark, d, "part")
    kind = F.element_at(F.array(*map(F.lit, ("tee", "hoodie", "hat"))), (F.col("p_size") % 3 + 1).cast("int"))
    return p.select(F.col("p_brand").alias("shop"), F.col("p_partkey").alias("at"), F.concat(F.substring("p_type", 1, 3), F.col("p_size").cast("string")).alias("code"), kind.alias("kind"))


def shop_catalogs(spark: SparkSession, d: str) -> DataFrame:
    """S03 for the shops of all brands."""
    return catalogs(_styles(spark, d))


def catalog_load(spark: SparkSession, d: str) -> DataFrame:
    """By the number in its name, a shop has a stored catalog in capitals that is as made, one that lacks rows, or none."""
    made = written(catalogs(_styles(spark, d)), "catalogs")
    third = F.substring_index("shop", "#", -1).cast("int") % 3
    stored = made.withColumn("kind", F.upper("kind")).filter((third == 0) | ((third == 1) & (F.col("place") % 9 != 0)))
    return loaded(stored, made)


_VALUES = ", ".join(f"({i}, '{c}', '{h}', '{_slug(c)}')" for i, (c, h) in enumerate(COLORS))
_LINE = " UNION ALL ".join(f"SELECT {k} AS l, u.j, i, '{line}-' || s || '-' || slug AS code, '{kind}' AS kind, color, hex FROM (SELECT unnest({sizes}) AS s, generate_subscripts({sizes}, 1) AS j) u, col WHERE i < {n}" for k, (line, kind, sizes, n) in enumerate(LINES))
_MADE = f"""col(i, color, hex, slug) AS (VALUES {_VALUES}), st AS (SELECT p_brand AS shop, p_partkey AS seq, left(p_type, 3) || p_size AS code, ['tee', 'hoodie', 'hat'][p_size%3+1] AS kind FROM part),
 g AS (SELECT shop, seq, i, s.code || '-' || slug AS code, kind, color, hex FROM st s, col), g1 AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY shop, code ORDER BY seq) = 1), g2 AS (SELECT * FROM g1 QUALIFY row_number() OVER (PARTITION BY shop ORDER BY seq, i) <= {GRID}),
 f AS (SELECT 9 AS l, n AS j, i, '{FILLER[0]}-' || lpad(CAST(n AS VARCHAR), 3, '0') || '-' || slug AS code, '{FILLER[1]}' AS kind, color, hex FROM range(1, {FILLERS + 1}) t(n) JOIN col ON i = (n-1)%{len(COLORS)}), r AS ({_LINE} UNION ALL SELECT * FROM f),
 u AS (SELECT shop, -1 AS l, seq AS j, i, code, kind, color, hex FROM g2 UNION ALL SELECT shop, r.* FROM (SELECT DISTINCT shop FROM st) CROSS JOIN r), u1 AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY shop, code ORDER BY l, j, i) = 1),
 made AS (SELECT shop, CAST(row_number() OVER (PARTITION BY shop ORDER BY l, j, i) AS INT) AS place, code, kind, color, hex FROM u1 QUALIFY row_number() OVER (PARTITION BY shop ORDER BY l, j, i) <= {WHOLE})"""

QUERIES = [shop_catalogs, catalog_load]
SQL = {
    "shop_catalogs": f"WITH {_MADE} SELECT * FROM made",
    "catalog_load": f"WITH {_MADE}, stored AS (SELECT shop, place, code, upper(kind) AS kind, color, hex, count(*) OVER (PARTITION BY shop) AS n FROM made WHERE CAST(split_part(shop, '#', 2) AS INT)%3 = 0 OR CAST(split_part(shop, '#', 2) AS INT)%3 = 1 AND place%9 <> 0) SELECT shop, place, code, kind, color, hex, false AS rewritten FROM stored WHERE n = {WHOLE} UNION ALL SELECT *, true FROM made WHERE shop NOT IN (SELECT shop FROM stored WHERE n = {WHOLE})",
}

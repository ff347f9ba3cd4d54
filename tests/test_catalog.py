"""Closed cases of catalogs, of the tones of hue families and of histogram palettes."""

import colorsys

import duckdb
from pyspark.sql import functions as F

from stitchyard.operators import catalog, histogram, hues


def test_catalogs(spark):
    """Caps, first codes and fillers; a code that a line has too is the style's; the order of styles is that of ``at``."""
    many = [("big", 100 - i, f"S{i}", "tee") for i in range(40)]
    rows = [*many, ("big", 500, "S39", "hat"), ("one", 1, "HOOP-4IN", "tee"), ("one", 2, None, "tee")]
    got = {}
    for r in catalog.catalogs(spark.createDataFrame(rows, "shop string, at long, code string, kind string")).orderBy("shop", "place").collect():
        got.setdefault(r.shop, []).append(r)
    big, one = got["big"], got["one"]
    assert [r.place for r in big] == list(range(1, 1001)) and len({r.code for r in big}) == 1000
    assert big[0][2:] == ("S39-BLACK", "tee", "Black", "#1a1a1a") and big[26].code == "S38-BLACK" and big[699].code == "S13-" + catalog._slug(catalog.COLORS[699 % 26][0])
    assert big[700].code == "TUMBLER-15-BLACK" and big[999].kind == "plaque"
    # 26 of the one style, of which 16 are also hoops, 104 tumblers, 60 signs, 48 hoops and 500 fillers
    assert len(one) == 26 + 104 + 60 + 48 + 500 - 16 and one[0].kind == "tee" and one[-1].code == "LASER-TAG-500-" + catalog._slug(catalog.COLORS[499 % 26][0])
    assert catalog.catalogs(spark.createDataFrame([], "shop string, at long, code string, kind string")).count() == 0


def test_loaded(spark):
    made = spark.range(1000).select(F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("shop"), F.col("id").cast("int").alias("place"), F.lit("m").alias("code"), *[F.lit("").alias(c) for c in ("kind", "color", "hex")])
    stored = made.withColumn("code", F.lit("s")).filter("shop = 'a' or shop = 'b' and place > 0")
    got = {(r.shop, r.code, r.rewritten): r["count"] for r in catalog.loaded(stored, made).groupBy("shop", "code", "rewritten").count().collect()}
    assert got == {("a", "s", False): 1000, ("b", "m", True): 1000, ("c", "m", True): 1000}
    assert catalog.loaded(stored.limit(0), made).filter("rewritten").count() == 3000


def test_hsv(spark):
    """Colours and back: hues within a step of the standard ones, and primary colours exactly."""
    rows = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (0, 0, 0), (255, 255, 255), (12, 200, 77), (250, 3, 60), (9, 8, 200), (128, 128, 127)]
    df = spark.createDataFrame(rows, "r int, g int, b int")
    df = df.withColumns(dict(zip("hsv", hues.hsv(*map(F.col, "rgb")), strict=True)))
    for r in df.select("*", F.array(*hues.rgb(*map(F.col, "hsv"))).alias("back")).collect():
        h, s, v = colorsys.rgb_to_hsv(r.r / 255, r.g / 255, r.b / 255)
        assert abs(r.h - h * 180) % 180 <= 0.51 and abs(r.s - s * 255) <= 0.51 and r.v == round(v * 255)
        assert max(abs(a - b) for a, b in zip(r.back, (r.r, r.g, r.b), strict=True)) <= (0 if r.h % 30 == 0 and s in (0, 1) else 5)


def test_posters(spark):
    """Two tones of red, a small family that stays, greys that hardly vary; a peak too near or too small is none."""
    px = [(1, i, 0, 200 + i % 3, 0, 0) for i in range(60)] + [(1, i, 1, 90, 0, 0) for i in range(20)] + [(1, 0, 2, 150, 0, 0)]
    px += [(1, i, 3, 0, 0, 255) for i in range(39)] + [(1, i, 4, 100 + i, 100 + i, 100 + i) for i in range(4)]
    got = {}
    for r in hues.posterized(spark.createDataFrame(px, "id long, x int, y int, r int, g int, b int")).collect():
        got.setdefault(r.y, set()).add((r.h, r.s, r.v, r.r, r.g, r.b))
    assert got == {0: {(0, 255, 200, 200, 0, 0)}, 1: {(0, 255, 88, 88, 0, 0)}, 2: {(0, 255, 200, 200, 0, 0)}, 3: {(120, 255, 255, 0, 0, 255)}, 4: {(0, 0, 102, 102, 102, 102)}}


def test_histogram_palette(spark):
    """Near greys merge into the fuller, a tint into the more saturated ink with a real part; a scattered accent is rescued, and specks are left out."""
    px = [(1, 100, 100, 100)] * 3000 + [(1, 120, 120, 120)] * 2000 + [(1, 200, 20, 20)] * 500 + [(1, 196, 44, 36)] * 900
    # 20 pixels of vivid greens, each bin under its least share of some 8,600 pixels
    px += [(1, 20 + 16 * (i % 2), 180 + 16 * (i % 5), 20 + 16 * (i // 10)) for i in range(20)] + [(1, 0, 0, 250)] * 2
    px += [(1, 250, 250, 250)] * 2200 + [(2, 7, 7, 7)]
    got = {}
    for r in histogram.palette_of(spark.createDataFrame(px, "id long, r int, g int, b int")).collect():
        got[r.id] = [(q.r, q.g, q.b, q.w) for q in r.inks]
    assert got[2] == [(7.0, 7.0, 7.0, 1)]
    assert got[1][:3] == [(100.0, 100.0, 100.0, 5000), (250.0, 250.0, 250.0, 2200), (200.0, 20.0, 20.0, 1400)]
    assert len(got[1]) == 4 and got[1][3][3] == 22 and got[1][3][1] > 150
    assert histogram.palette_of(spark.createDataFrame([], "id long, r int, g int, b int")).count() == 0


def test_palette_without_full_bins(spark):
    """An image whose 4,096 bins are all under their least share has no ink, as in SQL, and does not stop the others."""
    px = [(1, 16 * r, 16 * g, 16 * b) for r in range(16) for g in range(16) for b in range(16)] + [(2, 9, 9, 9), (2, 12, 9, 9)]
    got = {r.id: [(q.r, q.g, q.b, q.w) for q in r.inks] for r in histogram.palette_of(spark.createDataFrame(px, "id long, r int, g int, b int")).collect()}
    assert got == {1: [], 2: [(10.5, 9.0, 9.0, 2)]}


def test_palettes_of_odd_keys(spark, tmp_path):
    """Keys that are null, under 0 (their channels are as well), or beyond 32 bits give what SQL gives; a key that is there twice has twice the pixels."""
    of = {}
    for name, keys in (("odd", [None, -1, -40, -300, 0, 7, 5_000_000_000]), ("two", [7, 7])):
        spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/{name}/supplier.parquet")
        of[name] = sorted(tuple(r) for r in histogram.histogram_palette(spark, f"{tmp_path}/{name}").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/odd/supplier.parquet/*.parquet'")
    assert of["odd"] == sorted(con.execute(histogram.SQL["histogram_palette"]).fetchall())
    assert of["two"] == [(*r[:5], 2 * r[5]) for r in of["odd"] if r[0] == 7]

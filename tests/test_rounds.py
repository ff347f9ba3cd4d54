"""Closed cases of the operators that work in rounds: components, walks, outlines, lettering, palettes, runs, orders."""

import math
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stitchyard.functions import steps
from stitchyard.operators import cracks, lettering, palettes, regions, runs, stitch
from stitchyard.sources import svg

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402


def test_components(spark):
    """A long chain, a pair, a star and a double edge; another key's nodes of the same names stay apart."""
    chain = [(1, i, i + 1) for i in range(40)]
    e = spark.createDataFrame([*chain, (1, 100, 99), *[(1, 200, 200 + i) for i in range(1, 9)], (2, 5, 7), (2, 7, 5), (2, 8, 8)], "k int, a long, b long")
    got = {(r.k, r.node): r.comp for r in steps.components(e, "k", "t").collect()}
    want = {(1, i): 0 for i in range(41)} | {(1, 99): 99, (1, 100): 99} | {(1, 200 + i): 200 for i in range(9)} | {(2, 5): 5, (2, 7): 5}
    assert got == want
    assert steps.components(e.limit(0), "k", "t").count() == 0


def test_walks(spark):
    """A line of nine, a lone node and a ring of five."""
    line = [(1, 10 * i, 10 * (i + 1)) for i in range(8)] + [(1, 80, None)]
    ring = [(1, 3, 17), (1, 17, 5), (1, 5, 11), (1, 11, 2), (1, 2, 3)]
    got = {(r.k, r.node): (r.first, r.at, r.closed) for r in steps.walks(spark.createDataFrame([*line, *ring, (2, 3, None)], "k int, node long, next long"), "k", "t").collect()}
    want = {(1, 10 * i): (0, i, False) for i in range(9)} | {(1, n): (2, i, True) for i, n in enumerate((2, 3, 17, 5, 11))} | {(2, 3): (3, 0, False)}
    assert got == want


def test_cracks(spark):
    """A map of three labels: one line ends at the border, three meet at a junction, and one pixel has a ring of its own."""
    rows = ["aaab", "aaab", "acab", "aaab", "cccc"]
    label = ["abc".index(c) for r in rows for c in r]
    images = spark.createDataFrame([(7, 4, 5, label)], "id long, w int, h int, label array<int>")
    lines = {}
    for r in cracks.crack_lines(cracks.picture_edges(images)).collect():
        lines.setdefault(r.crack, {})[r.at] = r
    found = {tuple((p[i].x, p[i].y) for i in sorted(p)): (p[0].left, p[0].right, p[0].closed) for p in lines.values()}
    assert found == {
        ((3, 0), (3, 1), (3, 2), (3, 3), (3, 4)): (1, 0, False),
        ((0, 4), (1, 4), (2, 4), (3, 4)): (0, 2, False),
        ((3, 4), (4, 4)): (1, 2, False),
        ((1, 2), (2, 2), (2, 3), (1, 3), (1, 2)): (0, 2, True),
    }


def test_rings(spark):
    box = lambda ring, x, y, s: [(1, ring, k, x + dx * s, y + dy * s) for k, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]
    points = [*box(1, 0, 0, 100), *box(2, 10, 10, 60), *box(3, 20, 20, 20), *box(4, 80, 80, 10), *box(5, 200, 0, 30), *[(2, *p[1:]) for p in box(9, 1, 1, 5)]]
    got = {r.ring: (r.parent, r.depth, r.area2) for r in cracks.ring_parents(spark.createDataFrame(points, "page long, ring long, seq int, x long, y long")).collect()}
    assert got == {1: (-1, 0, 20000), 2: (1, 1, 7200), 3: (2, 2, 800), 4: (1, 1, 200), 5: (-1, 0, 1800), 9: (-1, 0, 50)}


def test_letter_rows(spark):
    """Three letters and a dot in their band; a pair is no row; two low marks beside one letter are none; colours and pages stay apart."""
    row = [(1, 0, i, x, 0, x + 30, 50) for i, x in enumerate((0, 40, 85))] + [(1, 0, 9, 120, 40, 126, 50)]
    far = [(1, 0, 20, 400, 0, 430, 50), (1, 0, 21, 440, 0, 470, 50), (1, 1, 22, 130, 0, 160, 50), (2, 0, 23, 0, 0, 30, 50), (2, 0, 24, 40, 40, 46, 50), (2, 0, 25, 50, 40, 56, 50)]
    boxes = spark.createDataFrame([*row, *far], "page long, color int, id long, x0 long, y0 long, x1 long, y1 long")
    assert sorted((r.page, r.color, r.line, r.place, r.id) for r in lettering.rows_of_letters(boxes).collect()) == [(1, 0, 0, i, n) for i, n in enumerate((0, 1, 2, 9))]


def test_line_merger():
    step, row = lettering.merger(), lambda n, x0, x1, h, y: {"page": 1, "color": 0, "line": n, "x0": x0, "x1": x1, "hs": [h] * 3, "ys": [y] * 3}
    assert [step(row(*r))[3] for r in ((0, 0, 100, 40, 50), (1, 180, 300, 42, 52), (2, 420, 500, 40, 50), (3, 510, 600, 70, 50), (4, 605, 700, 70, 90))] == [0, 0, 1, 2, 3]


def test_text_line(spark):
    """Four glyphs 4 mm high with strokes of 1 mm: small and thin at 4 inches, sewn well from 5 on; an outlier of a stroke is left out."""
    marks = [(1, 0, i, 40 * i, 0, 40 * i + 30, 40, 40, 700, 10 if i < 4 else 25) for i in range(5)]
    r = lettering.lines_of_text(spark.createDataFrame(marks, "page long, color int, id long, x0 long, y0 long, x1 long, y1 long, h long, area long, stroke long")).collect()
    assert [(x.glyphs, x.height, x.stroke, x.small, x.thin, x.width) for x in r] == [(4, 4000, 1000, True, True, 20)]


@pytest.mark.parametrize("i", [1, 4])
def test_kmeans(spark, i):
    """Seeding, rounds and merging of one picture against the plain form."""
    p = brute.picture(i)
    px = spark.createDataFrame([(i, k, *map(int, c), *map(float, v)) for k, (c, v) in enumerate(zip(p, brute.lab(p)))], "id long, i long, r int, g int, b int, l double, m double, s double")
    state = palettes.settled(px, palettes.seeded(px, 8).withColumn("done", F.lit(False)), 12, 0.35)
    merged = palettes.near_merged(F.transform("c", lambda z: F.struct(z["r"], z["g"], z["b"], F.lit(1.0).alias("n"))), 36.0)
    got = np.array([(z.r, z.g, z.b) for z in state.select(merged.alias("c")).first().c])
    assert np.allclose(got, brute.kmeans(p, 8, 12), atol=1e-6)


def test_near_merged(spark):
    """Chains merge by the pass order: the first pair's mean decides over the third; weights count."""
    colors = [(10, 10, 10), (12, 10, 10), (200, 0, 0), (11, 11, 10), (202, 3, 0), (0, 0, 255)]
    df = spark.createDataFrame([([(*c, 1.0) for c in colors],)], "c array<struct<r:int,g:int,b:int,n:double>>")
    got = [(z.r, z.g, z.b) for z in df.select(palettes.near_merged(F.col("c"), 16.0).alias("c")).first().c]
    assert np.allclose(got, brute.merge_near(colors, 16.0)) and len(got) == 3


def test_few_colors(spark):
    """An image of three colours keeps them, by first place, and nothing merges."""
    rows = [(1, i, *c, 0.0, 0.0, 0.0) for i, c in enumerate([(5, 0, 0), (6, 0, 0), (5, 0, 0), (0, 9, 0)])]
    px = spark.createDataFrame(rows, "id long, i long, r int, g int, b int, l double, m double, s double")
    tree = palettes.split_tree(px, 4, lambda w: F.max("r").over(w), lambda w: F.col("r"))
    assert [[(z.r, z.g) for z in r.c] for r in palettes._boxes(tree, 4).collect()] == [[(5, 0), (6, 0), (0, 9)]]


def test_solved(spark):
    a = np.random.default_rng(3).normal(0, 1, (9, 4))
    n, want = a.T @ a, np.array([1.0, -2.0, 3.0, 0.5])
    rows = [[*map(float, r), float(r @ want)] for r in n]
    got = spark.createDataFrame([(rows,)], "m array<array<double>>").select(runs.solved(F.col("m"), 4)).first()[0]
    assert np.allclose(got, want)


def test_background(spark):
    """A true quadratic under a few far pixels is found again; they are clipped."""
    rows = []
    for k in range(60):
        u, v = math.sin(k), math.cos(3 * k)
        z = 100 + 20 * u * u - 10 * v * v + 5 * u * v + 7 * u - 3 * v + (200 if k % 20 == 0 else 0)
        rows.append((1, 0, [u * u, v * v, u * v, u, v, 1.0], z))
    r = runs.background_fit(spark.createDataFrame(rows, "id long, channel int, t array<double>, z double")).first()
    assert r.kept == 57 and np.allclose(r.c, [20, -10, 5, 7, -3, 100])


def test_coverage(spark):
    """A gap of seven samples inside is bridged, one of eight is not; ends are clipped, and a short piece goes."""
    text = "1" * 5 + "0" * 60 + "1" * 7 + "0" * 20 + "1" * 8 + "0" * 47 + "1" * 9 + "0" * 49
    s = spark.createDataFrame([(1, 1, k, c == "1", (len(text) - 1) * 0.25) for k, c in enumerate(text)], "id long, run int, k int, covered boolean, length double")
    assert sorted((r.t0, r.t1) for r in runs.uncovered(s).collect()) == [(1.25, 22.75), (39.0, 51.0)]


def test_joints(spark):
    """The straight joint wins over a bent one, a sharp turn is none, and a ring isn't closed."""
    lines = [(1, 0, 0, 0, 40, 0), (1, 1, 41, 0, 80, 0), (1, 2, 41, 1, 70, 20), (1, 3, 80, 3, 80, 40), (2, 0, 0, 0, 20, 0), (2, 1, 23, 0, 0, 0)]
    df = spark.createDataFrame(lines, "page long, line long, x0 long, y0 long, x1 long, y1 long")
    assert sorted((r.page, r.a, r.ea, r.b, r.eb) for r in runs.joints(df).collect()) == [(1, 0, False, 1, True)]


def test_sewing_order(spark):
    """One stays on a colour while it can; a predecessor of another colour comes first."""
    visits = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 0), (1, 3, 1), (1, 4, 0)], "page long, i long, k long")
    before = spark.createDataFrame([(3, 4)], "i long, j long")
    assert [r.i for r in runs.sewing_order(visits, before).orderBy("place").collect()] == [0, 2, 1, 3, 4]


def test_fields(spark):
    """Ways go around a wall; a cell that is cut off has none."""
    cells = [(1, x, y) for x in range(5) for y in range(5) if x != 2 or y == 4] + [(1, 9, 9)]
    df = spark.createDataFrame(cells, "id long, cx int, cy int")
    got = {(r.cx, r.cy): r.d for r in runs.distance_fields(df, spark.createDataFrame([(1, 0, 0)], "id long, cx int, cy int")).collect()}
    assert got[(2, 4)] == 2 * 1414 + 2 * 1000 and got[(4, 0)] == got[(2, 4)] + 2 * 1414 + 2 * 1000 and (9, 9) not in got and len(got) == 21


def test_svg(spark):
    """Arcs, relative and absolute commands in one path, numbers too few or before any command, ends without a beginning, a fill by name."""
    text = "</g><g fill='red' transform='translate(1)'><g fill='url(#p)' fill-rule='EVENODD'></g><path d='7 M1 1 l1 1 2 0 C0 0 1 1 5 5 c1 1 1 1 1 1 A2 3 0 1 0 9 9 a1 1 0 0 1 1 1 H3 h2 V1 q1 1 2 2 L4'/></g></g><path d='M0 0' fill=''/><g data-name='my paper'><g><path d='M1 1' fill='#111'/></g><path d='M2 2' fill='#222'/></g>"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, svg string")
    got = [(r.id, r.layer, r.hex, r.place, r.rule, r.d) for r in svg.layered(docs, F.lit(1.0), F.lit(2.0)).collect()]
    numbers = "M 2 2 l 3 4 5 4 C 1 0 2 2 6 10 c 7 12 7 12 7 12 A 2 6 0 1 0 10 18 a 1 2 0 0 1 11 20 H 4 h 6 V 2 q 7 4 8 6 L"
    four = " ".join(t if t.isalpha() else f"{float(t):.4f}" for t in numbers.split())
    d = four.replace("2.0000 6.0000 0.0000 1.0000 0.0000 10", "2.0000 6.0000 0 1 0 10").replace("1.0000 2.0000 0.0000 0.0000 1.0000 11", "1.0000 2.0000 0 0 1 11")
    assert sorted(got) == [(1, 0, "red", 0, "nonzero", d), (1, 1, "#111111", 0, "nonzero", "M 1.0000 2.0000")]


def test_small_regions(spark):
    """A speck goes to its longest contact; two specks that touch wait for each other's pass; paper at the border stays; a corner joins."""
    rows = ["0111111", "1111211", "1111311", "1111111", "2222222", "2411222", "2214222", "2222222"]
    px = [(1, 7, 8, x, y, int(c)) for y, r in enumerate(rows) for x, c in enumerate(r)]
    df = spark.createDataFrame(px, "id long, w int, h int, x int, y int, label int")
    for passes, want in ((1, ["0111111", "1111111", "1111111", "1111111", "2222222", "2222222", "2222222", "2222222"]), (8, None)):
        got = {(r.x, r.y): r.label for r in regions.small_merged(df, 4, passes).collect()}
        text = ["".join(str(got[x, y]) for x in range(7)) for y in range(8)]
        assert want is None or text == want
    assert text == ["0111111", *["1111111"] * 3, *["2222222"] * 4]


def test_pile_up(spark):
    """Fourteen places of a cell stay, two of a satin go together, travel is dropped sooner; what may not go without a thread too long stays."""
    place = lambda i, role, kind="stitch", x=5: (1, i, kind, role, x, 5)
    rows = [place(i, "fill") for i in range(13)] + [place(13, "satin"), place(14, "satin"), place(15, "fill"), place(16, "travel"), place(17, "underlay"), place(18, "fill", "jump"), place(19, "satin"), place(20, "fill", x=900)]
    far = [(2, i, "stitch", "travel", 5 + 100 * (i % 2 == 1 and i > 8), 5) for i in range(8)] + [(2, 8, "stitch", "travel", 5, 5), (2, 9, "stitch", "fill", 900, 5)]
    df = spark.createDataFrame([*rows, *far], "design long, seq long, kind string, role string, x long, y long")
    got = {}
    for r in stitch.unpiled(df).collect():
        got.setdefault(r.design, set()).add(r.seq)
    assert got[1] == set(range(13)) | {15, 18, 19, 20} and got[2] == set(range(7)) | {8, 9}

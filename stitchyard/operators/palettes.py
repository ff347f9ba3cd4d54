"""Palettes of images, all images at a time: split trees, k-means, tone bands and ordered merging.

Pixels are written once, dealt into buckets by image. Rounds join them with one row of centres an image, so that no
pixel is shuffled again. Merging that depends on order folds an image's few colours as an array.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stitchyard.functions import color
from stitchyard.functions.steps import dropped, thousandths, written
from stitchyard.operators.images import _F, _IMG, _LIN, INKS, _palette, clamped, picture_pixels, pictures, square
from stitchyard.sources.tables import table

#: Colours of a palette, rounds of k-means, and squared Lab distances under which their results merge.
COLORS, ROUNDS = 8, 12
#: Rounds of k-means in one job; images that no longer move stay as they are.
AT_ONCE = 4


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def _near2(p: Column, q: Column) -> Column:
    return sum(((p[c] - q[c]) * (p[c] - q[c]) for c in ("m", "s")), (p["l"] - q["l"]) * (p["l"] - q["l"]))


def _with_lab(z: Column, *more: Column) -> Column:
    """A colour r, g, b with its Lab as l, m, s."""
    return F.struct(*[z[c].cast("double").alias(c) for c in "rgb"], *[v.alias(n) for n, v in zip("lms", color.lab(z["r"], z["g"], z["b"]), strict=True)], *more)


def _nearest(p: DataFrame, most: int, far: Callable[[Column], Column], *keep: str) -> DataFrame:
    """``keep`` of ``p`` with ``k``, the place of the nearest of the at most ``most`` centres c of its row, the first of equals, and ``d``, its distance.

    Each place has a column of its own, as the lambda of an array would be interpreted for every pixel.
    """
    each = p.select("*", *[far(F.get("c", F.lit(k))).alias(f"d{k}") for k in range(most)]).withColumn("d", F.least(*[f"d{k}" for k in range(most)], F.lit(None).cast("double")))
    first = F.coalesce(*[F.when(F.col(f"d{k}") == F.col("d"), k) for k in range(most)])
    return each.select(*keep, "d", first.alias("k"))


def colored(spark: SparkSession, d: str) -> DataFrame:
    """(id, i, r, g, b, l, m, s): the pixels of all pictures with their Lab, in buckets by picture."""
    p = picture_pixels(spark, d, "r", "g", "b").withColumn("i", F.expr("y * w + x"))
    return written(p.select("id", "i", "r", "g", "b", *[v.alias(n) for n, v in zip("lms", color.lab(F.col("r"), F.col("g"), F.col("b")), strict=True)]), "colored", "id")


def near_merged(colors: Column, limit: float, lab: bool = True) -> Column:
    """Colours (r, g, b, n) merged into the mean by n, in the order of pairs, until no two are within ``limit`` (squared).

    One step takes the next pair in the order of passes over all pairs; it comes after the last one, or in the next pass.
    """
    full = F.transform(colors, lambda z: _with_lab(z, z["n"].cast("double").alias("n")))
    near = _near2 if lab else lambda p, q: sum(((p[c] - q[c]) * (p[c] - q[c]) for c in "gb"), (p["r"] - q["r"]) * (p["r"] - q["r"]))

    def next_pair(s: Column) -> Column:
        row = lambda p, i: F.filter(F.transform(s["c"], lambda q, j: F.when((i < j) & (p["n"] > 0) & (q["n"] > 0) & (near(p, q) <= limit), F.struct(((i < s["i"]) | ((i == s["i"]) & (j <= s["j"]))).cast("int").alias("again"), i.alias("i"), j.alias("j")))), lambda z: z.isNotNull())
        return F.array_min(F.flatten(F.transform(s["c"], row)))

    def merged(p: Column, q: Column) -> Column:
        return _with_lab(F.struct(*[((p[c] * p["n"] + q[c] * q["n"]) / (p["n"] + q["n"])).alias(c) for c in "rgb"]), (p["n"] + q["n"]).alias("n"))

    def step(s: Column, _: Column) -> Column:
        one = lambda best: F.when(best.isNull(), s).otherwise(F.struct(F.transform(s["c"], lambda z, m: F.when(m == best["i"], merged(s["c"][best["i"]], s["c"][best["j"]])).when(m == best["j"], z.withField("n", F.lit(0.0))).otherwise(z)).alias("c"), best["i"].alias("i"), best["j"].alias("j")))
        return let(next_pair(s), one)

    start = F.struct(full.alias("c"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))
    return F.filter(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(colors), F.lit(1))), start, step)["c"], lambda z: z["n"] > 0)


def _listed(palette: DataFrame) -> DataFrame:
    """A row for each colour of (id, c), in thousandths."""
    out = palette.select("id", F.posexplode("c").alias("place", "z"))
    return out.select("id", "place", *[thousandths(F.col(f"z.{c}")).alias(c) for c in "rgb"])


def split_tree(px: DataFrame, colors: int, score: Callable, axis: Callable) -> DataFrame:
    """``px`` with its box: each round the box of the highest score of every image is cut at the middle of its axis.

    ``score(w)`` and ``axis(w)`` are columns over a box's window; ``axis`` gives the value that orders it. Pixels of
    equal value keep their order. An image of no more distinct colours than boxes has a box for each, by first place.
    """
    own, box = Window.partitionBy("id"), Window.partitionBy("id", "box")
    same = Window.partitionBy("id", "r", "g", "b")
    p = px.withColumn("first", F.min("i").over(same)).withColumn("kinds", F.count_if(F.col("i") == F.col("first")).over(own))
    p = p.withColumns({"box": F.when(F.col("kinds") <= colors, F.col("first")).otherwise(0), "pos": F.col("i")})
    for turn in range(colors - 1):
        p = p.withColumns({"n": F.count("*").over(box), "score": score(box), "value": axis(box)})
        eligible = F.when((F.col("n") > 1) & (F.col("kinds") > colors), F.struct(F.col("score"), (-F.col("box")).alias("box")))
        p = p.withColumn("pick", -F.max(eligible).over(own)["box"]).withColumn("to", F.row_number().over(box.orderBy("value", "pos")))
        cut = F.col("to") <= F.greatest(F.lit(1), F.expr("n div 2"))
        at = F.coalesce(F.col("box") == F.col("pick"), F.lit(False))
        p = p.withColumns({"box": F.when(at, F.when(cut, 2 * turn + 1).otherwise(2 * turn + 2)).otherwise(F.col("box")), "pos": F.when(at, F.col("to")).otherwise(F.col("pos"))})
    return p


def _boxes(p: DataFrame, colors: int) -> DataFrame:
    """(id, kinds, c): the mean colours of the boxes in their order."""
    g = p.groupBy("id", "kinds", "box").agg(*[F.avg(c).alias(c) for c in "rgb"])
    return g.groupBy("id", "kinds").agg(F.sort_array(F.collect_list(F.struct("box", "r", "g", "b", F.lit(1.0).alias("n")))).alias("c"))


def _span(c: str, w: Window) -> Column:
    return F.max(c).over(w) - F.min(c).over(w)


def median_cut(spark: SparkSession, d: str) -> DataFrame:
    """The box of the widest channel is cut at its median, until there are eight; near colours merge."""
    px = colored(spark, d)
    r, g, b = (lambda w, c=c: _span(c, w) for c in "rgb")
    axis = lambda w: F.when((b(w) > r(w)) & (b(w) > g(w)), F.col("b")).when(g(w) > r(w), F.col("g")).otherwise(F.col("r"))
    c = _boxes(split_tree(px, COLORS, lambda w: F.greatest(r(w), g(w), b(w)), axis), COLORS)
    return _listed(c.select("id", F.when(F.col("kinds") <= COLORS, F.transform("c", lambda z: _with_lab(z, z["n"]))).otherwise(near_merged(F.col("c"), 64.0)).alias("c")))


def _centers(colors: Column) -> Column:
    return F.transform(colors, lambda z: _with_lab(z))


def _to_own(z: Column) -> Column:
    """Squared distance of a centre to the pixel of the row."""
    return _near2(z, {c: F.col(c) for c in "lms"})


def lloyd_round(px: DataFrame, state: DataFrame, still: float) -> DataFrame:
    """One round for every image of ``state`` (id, c, done): pixels to the nearest centre in Lab, the first of equals; centres to their means."""
    near = _nearest(px.join(state.hint("shuffle_hash"), "id"), COLORS, _to_own, "id", "r", "g", "b", "c", "done")
    g = near.groupBy("id", "k").agg(*[F.avg(c).alias(c) for c in "rgb"], F.first("c").alias("c"), F.first("done").alias("done"))
    one = g.groupBy("id").agg(F.first("c").alias("c"), F.first("done").alias("done"), F.map_from_entries(F.collect_list(F.struct("k", F.struct("r", "g", "b")))).alias("new"))
    moved = _centers(F.transform("c", lambda z, k: F.coalesce(F.col("new")[k], F.struct(z["r"], z["g"], z["b"]))))
    one = one.withColumn("to", moved)
    far = F.exists(F.zip_with("c", "to", lambda p, q: sum((F.abs(p[c] - q[c]) for c in "gb"), F.abs(p["r"] - q["r"])) > still), lambda v: v)
    return one.select("id", F.when(F.col("done"), F.col("c")).otherwise(F.col("to")).alias("c"), (F.col("done") | ~far).alias("done"))


def settled(px: DataFrame, state: DataFrame, rounds: int, still: float) -> DataFrame:
    """Rounds until no image's centres move, or ``rounds`` are over."""
    state = written(state, "centers")
    for begin in range(0, rounds, AT_ONCE):
        new = state
        for _ in range(min(AT_ONCE, rounds - begin)):
            new = lloyd_round(px, new, still)
        new = written(new, "centers")
        dropped(state)
        state = new
        if not state.filter("not done").limit(1).count():
            break
    return state


def seeded(px: DataFrame, k: int) -> DataFrame:
    """(id, c): the first pixel, then for each further centre the pixel at which the running sum of squared distances to the
    nearest centre passes a fixed share of the whole; an image without distances left gets no more."""
    one = F.struct(*[F.col(c).cast("double").alias(c) for c in "rgb"], "l", "m", "s")
    state = px.groupBy("id").agg(F.array(F.min_by(one, "i")).alias("c"))
    for turn in range(1, k):
        far = _nearest(px.join(state.hint("shuffle_hash"), "id"), turn, _to_own, "id", "i", "r", "g", "b", "l", "m", "s", "c")
        run = Window.partitionBy("id").orderBy("i")
        far = far.withColumns({"sum": F.sum("d").over(run), "whole": F.sum("d").over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
        passed = F.col("sum") >= F.col("whole") * (turn * 9973 % 10000 / 10000)
        g = far.groupBy("id").agg(F.first("c").alias("c"), F.first("whole").alias("whole"), F.min_by(F.when(passed, one), F.when(passed, F.col("i"))).alias("hit"), F.max_by(one, "i").alias("last"))
        state = g.select("id", F.when(F.col("whole") > 0, F.concat("c", F.array(F.coalesce("hit", "last")))).otherwise(F.col("c")).alias("c"))
    return state


def kmeans_palette(spark: SparkSession, d: str) -> DataFrame:
    """K-means++ in Lab with fixed seeding for every picture, to its end; near centres merge."""
    px = colored(spark, d)
    state = settled(px, seeded(px, COLORS).withColumn("done", F.lit(False)), ROUNDS, 0.35)
    return _listed(state.select("id", near_merged(F.transform("c", lambda z: F.struct(z["r"], z["g"], z["b"], F.lit(1.0).alias("n"))), 36.0).alias("c")))


def hierarchical_palette(spark: SparkSession, d: str) -> DataFrame:
    """A10: the box with the most squared deviation in Lab is cut at the median of its widest axis; eight rounds of k-means refine, near colours merge."""
    px = colored(spark, d)
    spread = lambda c, w: F.var_pop(c).over(w)
    score = lambda w: (spread("l", w) + spread("m", w) + spread("s", w)) * F.count("*").over(w)
    axis = lambda w: F.when((spread("m", w) >= spread("l", w)) & (spread("m", w) >= spread("s", w)), F.col("m")).when(spread("s", w) >= spread("l", w), F.col("s")).otherwise(F.col("l"))
    boxes = written(_boxes(split_tree(px, COLORS, score, axis), COLORS), "boxes")
    state = settled(px, boxes.select("id", _centers(F.col("c")).alias("c"), (F.col("kinds") <= COLORS).alias("done")), 8, 0.3)
    plain = lambda c: F.transform(c, lambda z: F.struct(z["r"], z["g"], z["b"], F.lit(1.0).alias("n")))
    both = state.join(boxes.select("id", "kinds"), "id")
    return _listed(both.select("id", F.when(F.col("kinds") <= COLORS, F.transform("c", lambda z: _with_lab(z, F.lit(1.0).alias("n")))).otherwise(near_merged(plain("c"), 6.25)).alias("c")))


def popularity_palette(spark: SparkSession, d: str) -> DataFrame:
    """Bins of five bits a channel over flat pixels (all pixels, if they give fewer than three), the fullest first, at least 4 apart in Lab."""
    span = lambda c: f"greatest({', '.join(square(c, 1))}) - least({', '.join(square(c, 1))})"
    p = clamped(pictures(spark, d).select("id", "w", "h", "r", "g", "b"), 1).select("id", "i", *[F.expr(span(c)).alias(f"s{c}") for c in "rgb"], *[F.col(c)[F.col("i")].alias(c) for c in "rgb"])
    x = p.withColumns({"bin": F.expr("(r div 8) * 1024 + (g div 8) * 32 + b div 8"), "flat": F.greatest("sr", "sg", "sb") <= 48})
    sums = lambda use: [F.count_if(use).alias("n"), F.min(F.when(use, F.col("i"))).alias("first"), *[F.avg(F.when(use, F.col(c))).alias(c) for c in "rgb"]]
    n = x.groupBy("id", "bin").agg(*[c.alias(f"{half}_{k}") for half, use in (("all", F.lit(True)), ("few", F.col("flat"))) for c, k in zip(sums(use), ("n", "first", *"rgb"), strict=True)])
    one = lambda half: F.collect_list(F.when(F.col(f"{half}_n") > 0, F.struct((-F.col(f"{half}_n")).alias("o"), *[F.col(f"{half}_{k}").alias(k) for k in ("first", *"rgblms")]))).alias(half)
    both = n.select("*", *[v.alias(f"{half}_{c}") for half in ("all", "few") for c, v in zip("lms", color.lab(*[F.col(f"{half}_{c}") for c in "rgb"]), strict=True)]).groupBy("id").agg(one("all"), one("few"))
    bins = F.sort_array(F.when(F.coalesce(F.size("few"), F.lit(0)) >= 3, F.col("few")).otherwise(F.col("all")))
    take = lambda s, z: F.when((F.size(s) < COLORS) & ~F.exists(s, lambda o: _near2(o, z) < 16), F.concat(s, F.array(z))).otherwise(s)
    none = F.slice(bins, 1, 0)
    return _listed(both.select("id", F.aggregate(bins, none, take).alias("c")))


#: Bands of tone, rounds of medians, and the least gap between their centres.
BANDS, TURNS, APART = 6, 10, 9.0


def tone_bands(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of each band of tone: centres begin at percentiles of L, become the medians of their pixels ten times, and merge within 9."""
    px = colored(spark, d)
    shares = ", ".join(f"{0.08 + 0.84 * k / (BANDS - 1)!r}D" for k in range(BANDS))
    few = px.groupBy("id").agg(F.count("*").alias("n"), F.expr(f"percentile(l, array({shares}))").alias("c"), F.expr("percentile(l, 0.5D)").alias("mid"))
    state = few.select("id", F.when(F.col("n") < 32, F.array("mid")).otherwise(F.col("c")).alias("c"))
    which = lambda s: _nearest(px.join(s.hint("shuffle_hash"), "id"), BANDS, lambda z: F.abs(F.col("l") - z), "id", "l", "c")
    for _ in range(TURNS):
        g = which(state).groupBy("id", "k").agg(F.expr("percentile(l, 0.5D)").alias("mid"), F.first("c").alias("c"))
        one = g.groupBy("id").agg(F.first("c").alias("c"), F.map_from_entries(F.collect_list(F.struct("k", "mid"))).alias("new"))
        state = one.select("id", F.transform("c", lambda z, k: F.coalesce(F.col("new")[k], z)).alias("c"))
    state = written(state, "bands")
    last = lambda s: F.element_at(s, -1)
    fold = lambda s, z: F.when(z - last(s) < APART, F.concat(F.slice(s, 1, F.size(s) - 1), F.array((last(s) + z) / 2))).otherwise(F.concat(s, F.array(z)))
    sorted_ = F.sort_array("c")
    bands = state.select("id", F.aggregate(F.slice(sorted_, 2, 1000), F.slice(sorted_, 1, 1), fold).alias("c"))
    out = which(bands).withColumnRenamed("k", "band").groupBy("id", "band").agg(F.count("*").alias("n"), F.first(F.col("c")[F.col("band")]).alias("center"))
    return out.select("id", "band", "n", thousandths(F.col("center")).alias("center"))


def fills(spark: SparkSession, d: str) -> DataFrame:
    """(id, k, r, g, b, length): the thirty fills of a traced picture in page order; each is near one of its inks."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("k"))
    s = s.withColumn("q", _palette()[F.col("k") % INKS]).withColumn("e", F.expr("k * 7 % 13 - 6 + id % 3 * (k % 4)"))
    one = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.col(f"q.p{c}") + F.col("e") * {"r": 1, "g": -1, "b": 2}[c])).cast("int").alias(c)
    return s.select("id", "k", *map(one, "rgb"), F.expr("100 + k * 37 % 91 + id % 7").alias("length"))


def _hex(z: Column) -> Column:
    return color.to_hex(*[F.floor(z[c] + 0.5).cast("int") for c in "rgb"])


def fill_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Fills of one hex are one colour; the closest two in Lab merge, the heavier keeping its place's end, until there are eight."""
    f = fills(spark, d).groupBy("id", "r", "g", "b").agg(F.count("*").alias("w"), F.min("k").alias("first"))
    start = f.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("first", "r", "g", "b", "w"))).alias("f"))
    full = lambda z, w, members: F.struct(_with_lab(z).alias("z"), w.cast("double").alias("w"), members.alias("members"))
    start = start.select("id", F.transform("f", lambda z: full(z, z["w"], F.array(_hex(z)))).alias("c"))

    def step(s: Column, _: Column) -> Column:
        pairs = F.flatten(F.transform(s, lambda p, i: F.filter(F.transform(s, lambda q, j: F.when(i < j, F.struct(_near2(p["z"], q["z"]).alias("d"), i.alias("i"), j.alias("j")))), lambda v: v.isNotNull())))

        def merged(best: Column) -> Column:
            p, q = s[best["i"]], s[best["j"]]
            mean = F.struct(*[((p["z"][c] * p["w"] + q["z"][c] * q["w"]) / (p["w"] + q["w"])).alias(c) for c in "rgb"])
            return F.concat(F.filter(s, lambda _, m: (m != best["i"]) & (m != best["j"])), F.array(full(mean, p["w"] + q["w"], F.concat(p["members"], q["members"]))))

        return let(F.array_min(pairs), merged)

    turns = F.when(F.size("c") > COLORS, F.sequence(F.lit(1), F.greatest(F.size("c") - COLORS, F.lit(1)))).otherwise(F.expr("cast(array() as array<int>)"))
    out = start.select("id", F.explode(F.aggregate(turns, F.col("c"), step)).alias("q"))
    return out.select("id", F.explode("q.members").alias("hex"), _hex(F.col("q.z")).alias("to_hex"), F.col("q.w").cast("long").alias("weight"))


def fill_merge(spark: SparkSession, d: str) -> DataFrame:
    """Fills by total length; one within 6 of the nearest colour that stands for others goes to it, else stands for itself."""
    f = fills(spark, d).groupBy("id", "r", "g", "b").agg(F.sum("length").alias("n"), F.min("k").alias("first"))
    start = f.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "first", "r", "g", "b"))).alias("f"))
    kind = "struct<reps:array<struct<r:double,g:double,b:double,l:double,m:double,s:double>>,to:array<struct<hex:string,rep:string>>>"
    empty = F.struct(F.expr("array()").alias("reps"), F.expr("array()").alias("to")).cast(kind)

    def step(s: Column, z: Column) -> Column:
        def place(q: Column) -> Column:
            best = F.array_min(F.transform(s["reps"], lambda o, k: F.struct(_near2(o, q).alias("d"), k.alias("k"))))
            pair = lambda rep: F.concat(s["to"], F.array(F.struct(_hex(q).alias("hex"), _hex(rep).alias("rep"))))
            return let(best, lambda v: F.when(v["d"] <= 36, F.struct(s["reps"].alias("reps"), pair(s["reps"][v["k"]]).alias("to"))).otherwise(F.struct(F.concat(s["reps"], F.array(q)).alias("reps"), pair(q).alias("to"))))

        return let(_with_lab(z), place)

    return start.select("id", F.explode(F.aggregate("f", empty, step)["to"]).alias("q")).select("id", "q.hex", "q.rep")


#: Layers within this join; tiny and small close clusters fold, and so do more than so many.
JOIN, MOST = 11.0, 4


def layer_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Layers by area join the nearest cluster within 11, or begin one; then tiny, small close and surplus clusters fold into their nearest, the cheapest first."""
    start = fills(spark, d).groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("o"), "k", "r", "g", "b", F.col("length").cast("double").alias("area")))).alias("f"), F.sum("length").cast("double").alias("whole"))
    lab = "struct<r:double,g:double,b:double,l:double,m:double,s:double>"
    empty = F.expr("array()").cast(f"array<struct<seed:{lab},z:{lab},area:double,members:array<int>>>")

    def join(s: Column, f: Column) -> Column:
        def place(q: Column) -> Column:
            best = F.array_min(F.transform(s, lambda o, k: F.struct(F.sqrt(_near2(o["seed"], q)).alias("d"), k.alias("k"))))
            new = F.struct(q.alias("seed"), q.alias("z"), f["area"].alias("area"), F.array(f["k"]).alias("members"))
            # sums of colour by area stand in z until all have joined
            grown = lambda o: F.struct(o["seed"].alias("seed"), F.struct(*[((o["z"][c] * o["area"] + f[c] * f["area"]) / (o["area"] + f["area"])).alias(c) for c in "rgb"], *[o["z"][c].alias(c) for c in "lms"]).alias("z"), (o["area"] + f["area"]).alias("area"), F.concat(o["members"], F.array(f["k"])).alias("members"))
            return let(best, lambda v: F.when(v["d"] < JOIN, F.transform(s, lambda o, k: F.when(k == v["k"], grown(o)).otherwise(o))).otherwise(F.concat(s, F.array(new))))

        return let(_with_lab(f), place)

    joined = start.select("id", "whole", F.aggregate("f", empty, join).alias("c"))
    alive = joined.select("id", "whole", F.transform("c", lambda o: F.struct(_with_lab(o["z"]).alias("z"), o["area"].alias("area"), o["members"].alias("members"), F.lit(True).alias("on"))).alias("c"))

    def fold(s: Column, _: Column) -> Column:
        count = F.size(F.filter(s, lambda o: o["on"]))

        def candidate(o: Column, k: Column) -> Column:
            target = F.array_min(F.filter(F.transform(s, lambda p, j: F.when(p["on"] & (j != k), F.struct(F.sqrt(_near2(p["z"], o["z"])).alias("d"), j.alias("j")))), lambda v: v.isNotNull()))
            share = o["area"] / F.col("whole")
            go = lambda t: ((share < 0.004) & ((t["d"] < 14) | (share < 0.001))) | ((share < 0.015) & (t["d"] < 15)) | (count > MOST)
            return F.when(o["on"], let(target, lambda t: F.when(t.isNotNull() & go(t), F.struct((share * t["d"]).alias("cost"), k.alias("k"), t["j"].alias("j")))))

        best = F.array_min(F.filter(F.transform(s, candidate), lambda v: v.isNotNull()))

        def merged(v: Column) -> Column:
            p, q = s[v["j"]], s[v["k"]]
            heavy = p["area"] + q["area"] * 0.25
            z = F.struct(*[((p["z"][c] * p["area"] + q["z"][c] * q["area"] * 0.25) / heavy).alias(c) for c in "rgb"])
            into = F.struct(_with_lab(z).alias("z"), (p["area"] + q["area"]).alias("area"), F.concat(p["members"], q["members"]).alias("members"), F.lit(True).alias("on"))
            return F.when(v.isNull(), s).otherwise(F.transform(s, lambda o, k: F.when(k == v["j"], into).when(k == v["k"], o.withField("on", F.lit(False))).otherwise(o)))

        return let(best, merged)

    done = alive.select("id", F.posexplode(F.filter(F.aggregate(F.sequence(F.lit(1), F.size("c")), F.col("c"), fold), lambda o: o["on"])).alias("cluster", "q"))
    return done.select("id", F.explode("q.members").alias("layer"), "cluster", *[thousandths(F.col(f"q.z.{c}")).alias(c) for c in "rgb"])


QUERIES = [median_cut, kmeans_palette, hierarchical_palette, popularity_palette, tone_bands, fill_clusters, fill_merge, layer_clusters]


def _lab_of(r: str, g: str, b: str) -> dict[str, str]:
    """SQL: Lab of a colour as expressions."""
    lin = [f"({_LIN.format(c)})" for c in (r, g, b)]
    f = [f"({_F.format('(' + '+'.join(f'{v}*{m}e0' for v, m in zip(lin, row, strict=True)) + f')/{w}e0')})" for row, w in (((0.4124564, 0.3575761, 0.1804375), 0.95047), ((0.2126729, 0.7151522, 0.0721750), 1.0), ((0.0193339, 0.1191920, 0.9503041), 1.08883))]
    return {"l": f"116*{f[1]}-16", "m": f"500*({f[0]}-{f[1]})", "s": f"200*({f[1]}-{f[2]})"}


_N3 = "({0}.l-{1}.l)*({0}.l-{1}.l)+({0}.m-{1}.m)*({0}.m-{1}.m)+({0}.s-{1}.s)*({0}.s-{1}.s)"
_PX = f"{_IMG}, pix AS MATERIALIZED (SELECT id, CAST(y*w+x AS BIGINT) AS i, r, g, b, {', '.join(f'{v} AS {c}' for c, v in _lab_of('r', 'g', 'b').items())} FROM img)"
_OUT3 = ", ".join(f"CAST(floor({c}*1000+0.5e0) AS BIGINT) AS {c}" for c in "rgb")


def _merge_sql(source: str, limit: float) -> str:
    """SQL: ``mg`` of the colours (id, k, r, g, b) of ``source``, merged in the order of pairs. A row of the recursion is a colour."""
    lab = _lab_of("r", "g", "b")
    return f"""m0 AS MATERIALIZED (SELECT id, k, r, g, b, {', '.join(f'{v} AS {c}' for c, v in lab.items())} FROM {source}), mr(id, k, r, g, b, n, l, m, s, pi, pj, step) AS (SELECT id, k, r, g, b, 1e0, l, m, s, -1, -1, 0 FROM m0 UNION ALL
 SELECT id, k, r, g, b, n, {', '.join(f'{v} AS {c}' for c, v in lab.items())}, pi, pj, step FROM (SELECT a.id, a.k, {', '.join(f'CASE WHEN a.k = t.i THEN (a.{c}*a.n+o.{c}*o.n)/(a.n+o.n) ELSE a.{c} END AS {c}' for c in 'rgb')}, CASE WHEN a.k = t.i THEN a.n+o.n ELSE a.n END AS n, t.i AS pi, t.j AS pj, a.step+1 AS step
  FROM mr a JOIN (SELECT id, z.i AS i, z.j AS j FROM (SELECT p.id, min({{'w': CASE WHEN p.k < p.pi OR p.k = p.pi AND q.k <= p.pj THEN 1 ELSE 0 END, 'i': p.k, 'j': q.k}}) AS z FROM mr p JOIN mr q ON p.id = q.id AND p.k < q.k WHERE {_N3.format('p', 'q')} <= {limit}e0 GROUP BY p.id)) t ON t.id = a.id JOIN mr o ON o.id = a.id AND o.k = t.j WHERE a.k <> t.j)),
 ml AS (SELECT * FROM mr QUALIFY step = max(step) OVER (PARTITION BY id)), mg AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS place FROM ml)"""


def _tree_sql(score: str, axis: str) -> str:
    """SQL: ``b{COLORS - 1}``, the pixels with their boxes after all cuts; no picture has so few colours that it is not cut."""
    at, out = "b0 AS MATERIALIZED (SELECT *, 0 AS box, i AS pos FROM pix)", []
    for t in range(COLORS - 1):
        out.append(f"s{t} AS MATERIALIZED (SELECT id, box, count(*) AS n, {score} AS score, {axis} AS axis FROM b{t} GROUP BY id, box), k{t} AS (SELECT id, n, axis, box AS pick FROM s{t} WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, box) = 1), o{t} AS (SELECT b.*, n, box = pick AS hit, row_number() OVER (PARTITION BY b.id, box ORDER BY CASE axis WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END, pos) AS rk FROM (SELECT *, {{}} FROM b{t}) b JOIN k{t} ON k{t}.id = b.id), b{t + 1} AS MATERIALIZED (SELECT id, i, r, g, b, l, m, s, CASE WHEN NOT hit THEN box WHEN rk <= greatest(1, n//2) THEN {2 * t + 1} ELSE {2 * t + 2} END AS box, CASE WHEN hit THEN rk ELSE pos END AS pos FROM o{t})")
    return ", ".join([at, *out])


_RANGE = "max({0})-min({0})"
_CUT = _tree_sql(f"greatest({_RANGE.format('r')}, {_RANGE.format('g')}, {_RANGE.format('b')})", f"CASE WHEN {_RANGE.format('b')} > {_RANGE.format('r')} AND {_RANGE.format('b')} > {_RANGE.format('g')} THEN 2 WHEN {_RANGE.format('g')} > {_RANGE.format('r')} THEN 1 ELSE 0 END").replace("{}", "r AS v0, g AS v1, b AS v2")
_TREE = _tree_sql("(var_pop(l)+var_pop(m)+var_pop(s))*count(*)", "CASE WHEN var_pop(m) >= var_pop(l) AND var_pop(m) >= var_pop(s) THEN 1 WHEN var_pop(s) >= var_pop(l) THEN 2 ELSE 0 END").replace("{}", "l AS v0, m AS v1, s AS v2")


def _rounds_sql(begin: str, rounds: int, still: float) -> str:
    """SQL: centres c0 (id, k, r, g, b, done) from ``begin``, and those after each round."""
    lab, out = _lab_of("r", "g", "b"), [f"c0 AS MATERIALIZED ({begin})"]
    for t in range(rounds):
        out.append(f"e{t} AS MATERIALIZED (SELECT *, {', '.join(f'{v} AS {c}' for c, v in lab.items())} FROM c{t}), a{t} AS (SELECT pix.id, pix.i, arg_min(e.k, {{'d': {_N3.format('pix', 'e')}, 'k': e.k}}) AS k FROM pix JOIN e{t} e USING (id) WHERE NOT e.done GROUP BY ALL), n{t} AS (SELECT pix.id, k, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM a{t} JOIN pix USING (id, i) GROUP BY ALL), z{t} AS (SELECT c.id, c.k, c.done, coalesce(n.r, c.r) AS r, coalesce(n.g, c.g) AS g, coalesce(n.b, c.b) AS b, abs(c.r-coalesce(n.r, c.r))+abs(c.g-coalesce(n.g, c.g))+abs(c.b-coalesce(n.b, c.b)) > {still}e0 AS far FROM c{t} c LEFT JOIN n{t} n USING (id, k)), c{t + 1} AS MATERIALIZED (SELECT id, k, r, g, b, done OR NOT bool_or(far) OVER (PARTITION BY id) AS done FROM z{t})")
    return ", ".join(out)


def _seeds_sql() -> str:
    out = ["g1 AS MATERIALIZED (SELECT id, 0 AS k, r, g, b, l, m, s FROM pix WHERE i = 0)"]
    for t in range(1, COLORS):
        out.append(f"f{t} AS MATERIALIZED (SELECT pix.id, pix.i, min({_N3.format('pix', 'o')}) AS d FROM pix JOIN g{t} o USING (id) GROUP BY ALL), h{t} AS (SELECT id, i, sum(d) OVER (PARTITION BY id ORDER BY i) AS run, sum(d) OVER (PARTITION BY id) AS whole FROM f{t}), j{t} AS (SELECT id, coalesce(min(i) FILTER (run >= whole*{t * 9973 % 10000 / 10000}e0), max(i)) AS i FROM h{t} WHERE whole > 0 GROUP BY id), g{t + 1} AS MATERIALIZED (SELECT * FROM g{t} UNION ALL SELECT id, {t}, r, g, b, l, m, s FROM j{t} JOIN pix USING (id, i))")
    return ", ".join(out)


_FILL = "pl AS (SELECT s_suppkey AS id, CAST(k AS INT) AS k, (k%5*61+s_suppkey*7)%256 AS pr, (k%5*97+s_suppkey*3)%256 AS pg, (k%5*29+s_suppkey*11)%256 AS pb, k*7%13-6+s_suppkey%3*(k%4) AS e, 100+k*37%91+s_suppkey%7 AS length FROM supplier, range(30) t(k)), f0 AS (SELECT id, k, greatest(0, least(255, pr+e)) AS r, greatest(0, least(255, pg-e)) AS g, greatest(0, least(255, pb+2*e)) AS b, length FROM pl), fl AS MATERIALIZED (SELECT *, " + ", ".join(f"{v} AS {c}" for c, v in _lab_of("r", "g", "b").items()) + ", printf('#%02x%02x%02x', CAST(r AS INT), CAST(g AS INT), CAST(b AS INT)) AS hex FROM f0)"
_HEX = "printf('#%02x%02x%02x', " + ", ".join(f"CAST(floor({{0}}{c}+0.5e0) AS INT)" for c in "rgb") + ")"
_LABS = _lab_of("r", "g", "b")
_LAB3 = ", ".join(f"{v} AS {c}" for c, v in _LABS.items())
_BANDS = ["p1 AS (SELECT id, quantile_cont(l, [" + ", ".join(repr(0.08 + 0.84 * k / (BANDS - 1)) for k in range(BANDS)) + "]) AS q FROM pix GROUP BY id)", "t0 AS MATERIALIZED (SELECT id, unnest(range(6)) AS k, unnest(q) AS c FROM p1)"]
for _t in range(TURNS):
    _BANDS.append(f"u{_t} AS (SELECT pix.id, pix.i, pix.l, arg_min(k, {{'d': abs(l-c), 'k': k}}) AS k FROM pix JOIN t{_t} USING (id) GROUP BY ALL), t{_t + 1} AS MATERIALIZED (SELECT t.id, t.k, coalesce(n.c, t.c) AS c FROM t{_t} t LEFT JOIN (SELECT id, k, median(l) AS c FROM u{_t} GROUP BY ALL) n USING (id, k))")
SQL = {
    "median_cut": f"WITH RECURSIVE {_PX}, {_CUT}, av AS MATERIALIZED (SELECT id, CAST(box AS INT) AS k, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM b{COLORS - 1} GROUP BY ALL), {_merge_sql('av', 64.0)} SELECT id, CAST(place AS INT) AS place, {_OUT3} FROM mg",
    "kmeans_palette": f"WITH RECURSIVE {_PX}, {_seeds_sql()}, {_rounds_sql(f'SELECT id, k, r*1e0 AS r, g*1e0 AS g, b*1e0 AS b, false AS done FROM g{COLORS}', ROUNDS, 0.35)}, {_merge_sql(f'c{ROUNDS}', 36.0)} SELECT id, CAST(place AS INT) AS place, {_OUT3} FROM mg",
    "hierarchical_palette": f"WITH RECURSIVE {_PX}, {_TREE}, {_rounds_sql(f'SELECT id, CAST(box AS INT) AS k, avg(r) AS r, avg(g) AS g, avg(b) AS b, false AS done FROM b{COLORS - 1} GROUP BY id, box', 8, 0.3)}, {_merge_sql('c8', 6.25)} SELECT id, CAST(place AS INT) AS place, {_OUT3} FROM mg",
    "popularity_palette": f"""WITH RECURSIVE {_IMG}, nb AS (SELECT c.id, c.x, c.y, {', '.join(f'max(n.{c})-min(n.{c}) AS d{c}' for c in 'rgb')} FROM img c, (VALUES (-1),(0),(1)) a(i), (VALUES (-1),(0),(1)) e(j) JOIN img n ON n.id = c.id AND n.x = c.x+i AND n.y = c.y+j GROUP BY ALL), pix AS (SELECT img.*, y*w+x AS i, (r//8)*1024+(g//8)*32+b//8 AS bin, greatest(dr, dg, db) <= 48 AS flat FROM img JOIN nb USING (id, x, y)),
 h AS (SELECT id, flat, bin, count(*) AS n, min(i) AS first, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM pix WHERE flat GROUP BY ALL UNION ALL SELECT id, false, bin, count(*), min(i), avg(r), avg(g), avg(b) FROM pix GROUP BY id, bin), u AS (SELECT * FROM h QUALIFY flat = (count(*) FILTER (flat) OVER (PARTITION BY id) >= 3)), o AS MATERIALIZED (SELECT *, {_LAB3}, row_number() OVER (PARTITION BY id ORDER BY n DESC, first) AS k FROM u),
 t(id, k, c) AS (SELECT id, k, [{{'r': r, 'g': g, 'b': b, 'l': l, 'm': m, 's': s}}] FROM o WHERE k = 1 UNION ALL SELECT o.id, o.k, CASE WHEN len(c) < {COLORS} AND list_min(list_transform(c, lambda z: (z.l-o.l)*(z.l-o.l)+(z.m-o.m)*(z.m-o.m)+(z.s-o.s)*(z.s-o.s))) >= 16 THEN list_append(c, {{'r': r, 'g': g, 'b': b, 'l': l, 'm': m, 's': s}}) ELSE c END FROM t JOIN o ON o.id = t.id AND o.k = t.k+1),
 z AS (SELECT id, c FROM t QUALIFY k = max(k) OVER (PARTITION BY id)), v AS (SELECT id, unnest(range(len(c))) AS place, unnest(c, recursive := true) FROM z) SELECT id, CAST(place AS INT) AS place, {_OUT3} FROM v""",
    "tone_bands": f"""WITH RECURSIVE {_PX}, {', '.join(_BANDS)}, so AS MATERIALIZED (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY c) AS k FROM t{TURNS}), fo(id, k, v) AS (SELECT id, k, [c] FROM so WHERE k = 1 UNION ALL SELECT so.id, so.k, CASE WHEN c-v[-1] < {APART} THEN list_append(v[:-2], (v[-1]+c)/2) ELSE list_append(v, c) END FROM fo JOIN so ON so.id = fo.id AND so.k = fo.k+1),
 ce AS (SELECT id, unnest(range(len(v))) AS k, unnest(v) AS c FROM fo WHERE k = {BANDS}), w AS (SELECT pix.id, pix.i, arg_min({{'k': k, 'c': c}}, {{'d': abs(l-c), 'k': k}}) AS z FROM pix JOIN ce USING (id) GROUP BY ALL) SELECT id, CAST(z.k AS INT) AS band, count(*) AS n, CAST(floor(z.c*1000+0.5e0) AS BIGINT) AS center FROM w GROUP BY id, z""",
    "fill_clusters": f"""WITH RECURSIVE {_FILL}, st AS (SELECT id, hex, r*1e0 AS r, g*1e0 AS g, b*1e0 AS b, l, m, s, count(*)*1e0 AS w, min(k) AS k FROM fl GROUP BY ALL), cl(id, k, r, g, b, l, m, s, w, members, step) AS (SELECT id, k, r, g, b, l, m, s, w, [hex], 0 FROM st UNION ALL
 SELECT id, k, r, g, b, {_LAB3}, w, members, step FROM (SELECT a.id, CASE WHEN a.k = t.i THEN 1000+a.step ELSE a.k END AS k, {', '.join(f'CASE WHEN a.k = t.i THEN (a.{c}*a.w+o.{c}*o.w)/(a.w+o.w) ELSE a.{c} END AS {c}' for c in 'rgb')}, CASE WHEN a.k = t.i THEN a.w+o.w ELSE a.w END AS w, CASE WHEN a.k = t.i THEN list_concat(a.members, o.members) ELSE a.members END AS members, a.step+1 AS step
  FROM cl a JOIN (SELECT id, z.i AS i, z.j AS j FROM (SELECT p.id, min({{'d': {_N3.format('p', 'q')}, 'i': p.k, 'j': q.k}}) AS z FROM cl p JOIN cl q ON p.id = q.id AND p.k < q.k GROUP BY p.id HAVING count(*) > {COLORS * (COLORS - 1) // 2})) t ON t.id = a.id JOIN cl o ON o.id = a.id AND o.k = t.j WHERE a.k <> t.j)),
 z AS (SELECT * FROM cl QUALIFY step = max(step) OVER (PARTITION BY id)) SELECT id, unnest(members) AS hex, {_HEX.format('')} AS to_hex, CAST(w AS BIGINT) AS weight FROM z""",
    "fill_merge": f"""WITH RECURSIVE {_FILL}, st AS (SELECT id, hex, l, m, s, sum(length) AS n, min(k) AS k FROM fl GROUP BY ALL), o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, k) AS rk FROM st),
 t(id, rk, hex, reps, rep) AS (SELECT id, rk, hex, [{{'h': hex, 'l': l, 'm': m, 's': s}}], hex FROM o WHERE rk = 1 UNION ALL SELECT id, rk, hex, CASE WHEN near.d <= 36 THEN reps ELSE list_append(reps, {{'h': hex, 'l': l, 'm': m, 's': s}}) END, CASE WHEN near.d <= 36 THEN reps[near.k].h ELSE hex END FROM (SELECT o.*, reps, list_min(list_transform(reps, lambda z, i: {{'d': (z.l-o.l)*(z.l-o.l)+(z.m-o.m)*(z.m-o.m)+(z.s-o.s)*(z.s-o.s), 'k': i}})) AS near FROM t JOIN o ON o.id = t.id AND o.rk = t.rk+1)) SELECT id, hex, rep FROM t""",
    "layer_clusters": f"""WITH RECURSIVE {_FILL}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length DESC, k) AS rk, sum(length) OVER (PARTITION BY id)*1e0 AS whole FROM fl), t(id, rk, k, seeds, c) AS (SELECT id, rk, k, [{{'l': l, 'm': m, 's': s}}], CAST(1 AS BIGINT) FROM o WHERE rk = 1 UNION ALL SELECT id, rk, k, CASE WHEN near.d < {JOIN} THEN seeds ELSE list_append(seeds, {{'l': l, 'm': m, 's': s}}) END, CASE WHEN near.d < {JOIN} THEN near.k ELSE len(seeds)+1 END FROM (SELECT o.*, seeds, list_min(list_transform(seeds, lambda z, i: {{'d': sqrt((z.l-o.l)*(z.l-o.l)+(z.m-o.m)*(z.m-o.m)+(z.s-o.s)*(z.s-o.s)), 'k': i}})) AS near FROM t JOIN o ON o.id = t.id AND o.rk = t.rk+1)),
 j AS (SELECT o.id, c AS k, sum(r*length)/sum(length)*1e0 AS r, sum(g*length)/sum(length)*1e0 AS g, sum(b*length)/sum(length)*1e0 AS b, sum(length)*1e0 AS area, any_value(whole) AS whole, list(o.k) AS members FROM t JOIN o USING (id, rk) GROUP BY o.id, c), cl(id, k, r, g, b, l, m, s, area, whole, members, step) AS (SELECT id, k, r, g, b, {_LAB3}, area, whole, members, 0 FROM j UNION ALL
 SELECT id, k, r, g, b, {_LAB3}, area, whole, members, step FROM (SELECT a.id, a.k, {', '.join(f'CASE WHEN a.k = v.t THEN (a.{c}*a.area+o.{c}*o.area*0.25e0)/(a.area+o.area*0.25e0) ELSE a.{c} END AS {c}' for c in 'rgb')}, CASE WHEN a.k = v.t THEN a.area+o.area ELSE a.area END AS area, a.whole, CASE WHEN a.k = v.t THEN list_concat(a.members, o.members) ELSE a.members END AS members, a.step+1 AS step
  FROM cl a JOIN (SELECT id, u.k AS k, u.t AS t FROM (SELECT id, min({{'c': area/whole*z.d, 'k': k, 't': z.t}}) AS u FROM (SELECT p.id, p.k, p.area, p.whole, count(*) OVER (PARTITION BY p.id) AS n, min({{'d': sqrt({_N3.format('p', 'q')}), 't': q.k}}) AS z FROM cl p JOIN cl q ON p.id = q.id AND p.k <> q.k GROUP BY p.id, p.k, p.area, p.whole) WHERE (area/whole < 0.004e0 AND (z.d < 14 OR area/whole < 0.001e0)) OR (area/whole < 0.015e0 AND z.d < 15) OR n > {MOST} GROUP BY id)) v ON v.id = a.id JOIN cl o ON o.id = a.id AND o.k = v.k WHERE a.k <> v.k)),
 y AS (SELECT * FROM cl QUALIFY step = max(step) OVER (PARTITION BY id)), z AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS cluster FROM y) SELECT id, unnest(members) AS layer, CAST(cluster AS INT) AS cluster, {_OUT3} FROM z""",
}

"""Palettes from 4-bit histograms: medians of the fullest bins, merged by perception, and one rescued accent.

An image is one row, and some images are worked out together in arrays: their pixels, their bins, the merges of up to 28 inks each, and the
search of all pixels for an accent. Nothing is joined, and no pixel becomes a row.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stitchyard.functions.steps import thousandths
from stitchyard.operators.images import _DE, _IMG, _lab_sql, _sizes, channels

# Fixed values of the rule: bins of a palette and their least share; the chroma and distance of a pixel that no ink covers, the share of
# such pixels that makes an accent, how far it must be from all inks, and the inks from which there is none.
BINS, LEAST, FAR_CHROMA, FAR, ACCENT, APART, FULL = 28, 0.00035, 40, 18, 0.0015, 30, 12
#: Which pair may merge, for its distance d, chromas c1 and c2, smaller share n and hue difference t in degrees; ``merged`` has it in arrays.
MAY = """d < 8 or c1 < 12 and c2 < 12 and d < 24 or c1 < 18 and c2 < 18 and d < 16 or n < 0.006{0} and d < 32
 or c1 > 18 and c2 > 18 and t < 16 and d < 14 or c1 > 25 and c2 > 25 and t < 14 and d < 26 and n < 0.02{0} or c1 < 8 and c2 < 8 and n < 0.02{0} and d < 48"""
#: Images that are worked out together, and pixels of them at a time.
IMAGES, PIXELS = 128, 1 << 17
#: The pairs of a palette's places, the earlier first.
_I, _J = np.triu_indices(BINS, 1)
#: The linear value of a channel from -255 on (the pictures of keys under 0 have such), by twice its value, as a median may be a half.
_LINEAR = np.array([v / 255.0 / 12.92 if v / 255.0 <= 0.04045 else math.pow((v / 255.0 + 0.055) / 1.055, 2.4) for v in np.arange(-510, 511) / 2])


def _lab(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lab of colours given as twice their channels (``color.lab``)."""
    r, g, b = _LINEAR[r + 510], _LINEAR[g + 510], _LINEAR[b + 510]
    f = []
    for m, n, k, white in ((0.4124564, 0.3575761, 0.1804375, 0.95047), (0.2126729, 0.7151522, 0.0721750, 1.0), (0.0193339, 0.1191920, 0.9503041, 1.08883)):
        t = (r * m + g * n + b * k) / white
        f.append(np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16.0 / 116))
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def _distance(p: tuple, q: tuple) -> np.ndarray:
    d = [a - b for a, b in zip(p, q, strict=True)]
    return np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def _twice_median(counts: np.ndarray) -> np.ndarray:
    """Twice the median value of each histogram of the last axis; 0 of an empty one."""
    upto = counts.cumsum(-1)
    n = upto[..., -1:]
    return (upto > (n - 1) // 2).argmax(-1) + (upto > n // 2).argmax(-1)


def merged(lab: tuple, c: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All merges of images' inks (Lab, chroma, pixels; none at a place without pixels): which stay, and their pixels.

    The nearest pair that may merge goes first. The more saturated ink of a pair stays if it is a real part of both, else the one with
    more pixels, the earlier of equals. An ink that stays keeps its colour, so that only the share under which a pair may merge meets the new pixels.
    """
    w, total = w.copy(), w.sum(1)
    d = _distance(tuple(v[:, _I] for v in lab), tuple(v[:, _J] for v in lab))
    c1, c2, hue = c[:, _I], c[:, _J], np.degrees(np.arctan2(lab[2], lab[1]))
    t = np.abs(hue[:, _I] - hue[:, _J])
    t = np.minimum(t, 360 - t)
    least, most = np.minimum(c1, c2), np.maximum(c1, c2)
    always = (d < 8) | (most < 12) & (d < 24) | (most < 18) & (d < 16) | (least > 18) & (t < 16) & (d < 14)
    small = (least > 25) & (t < 14) & (d < 26) | (most < 8) & (d < 48)
    under = np.where(always, np.inf, np.where(small, 0.02, np.where(d < 32, 0.006, -np.inf)))
    d[(w[:, _I] == 0) | (w[:, _J] == 0)] = np.inf
    left = np.arange(len(w))
    while len(left):
        share = np.minimum(w[left][:, _I], w[left][:, _J]) / total[left, None]
        open_ = np.where(share < under[left], d[left], np.inf)
        best = open_.argmin(1)
        go = open_[np.arange(len(left)), best] < np.inf
        left, best = left[go], best[go]
        i, j = _I[best], _J[best]
        ci, cj, wi, wj = c[left, i], c[left, j], w[left, i], w[left, j]
        swap = (cj > ci + 6) & (wj >= 0.08 * (wi + wj)) & (cj > 20) | (wj > wi)
        keep, gone = np.where(swap, j, i), np.where(swap, i, j)
        w[left, keep], w[left, gone] = wi + wj, 0
        at, pair = np.nonzero((_I == gone[:, None]) | (_J == gone[:, None]))
        d[left[at], pair] = np.inf
    return w > 0, w


def _palettes(ids: pa.Array, ends: np.ndarray, rgb: list[np.ndarray], times: np.ndarray | int = 1) -> pa.RecordBatch:
    """(id, inks) of some images; ``ends``: where each one's pixels end in the channels, ``times``: how often an image is there."""
    n, size = len(ids), np.diff(ends, prepend=0)
    # a bin's values differ in their low four bits; the lowest value, the lowest bin, all bins, and the values of one
    low, first, bins, deep = (-255, -4095, 8191, 511) if any((c < 0).any() for c in rgb) else (0, 0, 4096, 16)
    parts = [slice(k, k + PIXELS) for k in range(0, len(rgb[0]), PIXELS)]
    image = lambda part: np.searchsorted(ends, np.arange(part.start, min(part.stop, len(rgb[0]))), "right")
    div = lambda c: c + 15 * (c < 0) >> 4
    bin_ = lambda part: image(part) * bins + div(rgb[0][part]) * 256 + div(rgb[1][part]) * 16 + div(rgb[2][part]) - first
    count = np.zeros(n * bins, np.int64)
    for part in parts:
        count += np.bincount(bin_(part), minlength=n * bins)
    # the fullest first, of equals the lower bin
    full = np.sort(np.partition(count.reshape(n, bins) * bins + bins - 1 - np.arange(bins), bins - BINS, axis=1)[:, bins - BINS :], axis=1)[:, ::-1]
    w, at = full // bins, bins - 1 - full % bins
    w = np.where(w / np.maximum(size, 1)[:, None] >= LEAST, w, 0)
    place = np.full(n * bins, -1, np.int32)
    place[(np.arange(n)[:, None] * bins + at)[w > 0]] = np.flatnonzero(w > 0)
    base = (low, low, low) if low else (at // 256 * 16, at // 16 % 16 * 16, at % 16 * 16)
    values = [np.zeros(n * BINS * deep, np.int64) for _ in rgb]
    for part in parts:
        of = place[bin_(part)]
        for c, counts in zip(rgb, values, strict=True):
            counts += np.bincount((of * deep + (c[part] - low) % deep)[of >= 0], minlength=n * BINS * deep)
    twice = [2 * k + _twice_median(v.reshape(n, BINS, deep)) for k, v in zip(base, values, strict=True)]
    lab = _lab(*twice)
    stays, w = merged(lab, np.sqrt(lab[1] * lab[1] + lab[2] * lab[2]), w)
    # the inks that stay move to the front
    order = np.argsort(~stays, axis=1, kind="stable")
    twice, lab, w = [np.take_along_axis(v, order, 1) for v in twice], [np.take_along_axis(v, order, 1) for v in lab], np.take_along_axis(w, order, 1)
    k = stays.sum(1)
    lab = [np.where(w > 0, v, np.inf) for v in lab]
    searched = (k > 0) & (k < FULL)
    off, values = np.zeros(n, np.int64), [np.zeros(n * (256 - low), np.int64) for _ in rgb]
    for part in parts if searched.any() else []:
        of = image(part)
        own = np.flatnonzero(searched[of])
        of, seen = of[own], [c[part][own] for c in rgb]
        own = _lab(*[2 * c for c in seen])
        far = np.sqrt(own[1] * own[1] + own[2] * own[2]) > FAR_CHROMA
        for ink in range(k[searched].max()):
            of, seen, own = of[far], [c[far] for c in seen], [v[far] for v in own]
            far = _distance(own, [v[of, ink] for v in lab]) > FAR
        of, seen = of[far], [c[far] for c in seen]
        off += np.bincount(of, minlength=n)
        for c, counts in zip(seen, values, strict=True):
            counts += np.bincount(of * (256 - low) + c - low, minlength=n * (256 - low))
    accent = [2 * low + _twice_median(v.reshape(n, 256 - low)) for v in values]
    apart = (_distance([v[:, None] for v in _lab(*accent)], lab) > APART).all(1)
    new = np.flatnonzero((off / np.maximum(size, 1) > ACCENT) & apart)
    for v, a in zip([*twice, w], [*accent, off], strict=True):
        v[new, k[new]] = a[new]
    k[new] += 1
    there, w = np.arange(BINS) < k[:, None], w * np.reshape(times, (-1, 1))
    inks = pa.StructArray.from_arrays([*[pa.array(v[there] / 2) for v in twice], pa.array(w[there])], names=["r", "g", "b", "w"])
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], k.cumsum())), pa.int32()), inks)], names=["id", "inks"])


def _of_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, IMAGES):
            rows = batch.slice(at, IMAGES)
            ends = rows.column("r").offsets.to_numpy()
            yield _palettes(rows.column("id"), ends[1:] - ends[0], [rows.column(c).flatten().to_numpy() for c in "rgb"])


def _of_pictures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, IMAGES):
            rows = batch.slice(at, IMAGES)
            yield _palettes(rows.column("id"), *channels(rows), rows.column("times").to_numpy())


def _schema(images: DataFrame) -> T.StructType:
    ink = T.StructType([*[T.StructField(c, T.DoubleType()) for c in "rgb"], T.StructField("w", T.LongType())])
    return T.StructType([images.schema["id"], T.StructField("inks", T.ArrayType(ink))])


def palette_of(px: DataFrame) -> DataFrame:
    """(id, inks) from (id, r, g, b). All pixels are searched for the accent; its colour is the median of all that no ink covers.

    An image whose bins all lack their least share has no inks, and no accent either.
    """
    rows = px.groupBy("id").agg(F.collect_list(F.struct(*"rgb")).alias("p"))
    return rows.select("id", *[F.col(f"p.{c}").alias(c) for c in "rgb"]).mapInArrow(_of_arrays, _schema(rows))


def histogram_palette(spark: SparkSession, d: str) -> DataFrame:
    """A14 over the pictures: inks by place, in thousandths, with their pixels."""
    images = _sizes(spark, d).groupBy("id", "w", "h").agg(F.count("*").alias("times"))
    p = images.mapInArrow(_of_pictures, _schema(images)).select("id", F.posexplode("inks").alias("place", "q"))
    return p.select("id", "place", *[thousandths(F.col(f"q.{c}")).alias(c) for c in "rgb"], F.col("q.w").alias("n"))


_TURN = 'abs(degrees(atan2(a[i]."B", a[i]."A"))-degrees(atan2(a[j]."B", a[j]."A")))'
_PAIR = f"{{'d': {_DE.format('a[i]', 'a[j]')}, 'i': i, 'j': j, 'c1': a[i].c, 'c2': a[j].c, 'n': least(a[i].w, a[j].w)/total, 't': least({_TURN}, 360-{_TURN})}}"
_MAY = MAY.format("e0").replace("d <", "z.d <").replace("c1", "z.c1").replace("c2", "z.c2").replace("n <", "z.n <").replace("t <", "z.t <")
QUERIES = [histogram_palette]
SQL = {
    "histogram_palette": f"""WITH RECURSIVE {_IMG}, bn AS (SELECT id, r//16*256+g//16*16+b//16 AS key, count(*) AS n, median(r) AS pr, median(g) AS pg, median(b) AS pb FROM img GROUP BY ALL), {_lab_sql('bn', 'pr', 'pg', 'pb', 'id, key, n, pr, pg, pb', 'v')}, k AS (SELECT *, sqrt("A"*"A"+"B"*"B") AS c FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, key) <= {BINS} AND n/sum(n) OVER (PARTITION BY id) >= {LEAST}e0),
 s0 AS MATERIALIZED (SELECT id, list({{'pr': pr, 'pg': pg, 'pb': pb, 'L': "L", 'A': "A", 'B': "B", 'c': c, 'w': n}} ORDER BY n DESC, key) AS a, sum(n) AS total FROM k GROUP BY id),
 m(id, t, a, total) AS (SELECT id, 0, a, total FROM s0 UNION ALL SELECT id, t, list_filter(list_transform(a, lambda q, k: CASE WHEN k = keep THEN struct_update(q, w := a[keep].w+a[gone].w) ELSE q END), lambda q, k: k <> gone), total FROM (SELECT *, CASE WHEN swap THEN b.j ELSE b.i END AS keep, CASE WHEN swap THEN b.i ELSE b.j END AS gone FROM (SELECT *, a[b.j].c > a[b.i].c+6 AND a[b.j].w >= 0.08e0*(a[b.i].w+a[b.j].w) AND a[b.j].c > 20 OR a[b.j].w > a[b.i].w AS swap FROM
  (SELECT id, t+1 AS t, a, total, list_sort(list_filter(flatten(list_transform(range(1, len(a)+1), lambda i: list_transform(range(i+1, len(a)+1), lambda j: {_PAIR}))), lambda z: {_MAY}))[1] AS b FROM m) WHERE b IS NOT NULL))),
 e AS MATERIALIZED (SELECT id, arg_max(a, t) AS pal FROM m GROUP BY id), ip AS (SELECT id, r AS pr, g AS pg, b AS pb FROM img), {_lab_sql('ip', 'pr', 'pg', 'pb', 'id, pr, pg, pb', 'x')}, f AS (SELECT x.id, count(*) AS n, median(pr) AS pr, median(pg) AS pg, median(pb) AS pb FROM x JOIN e USING (id) WHERE sqrt("A"*"A"+"B"*"B") > {FAR_CHROMA} AND len(pal) < {FULL} AND len(list_filter(pal, lambda z: {_DE.format('z', 'x')} <= {FAR})) = 0 GROUP BY x.id),
 {_lab_sql('f', 'pr', 'pg', 'pb', 'id, n, pr, pg, pb', 'y')}, o AS (SELECT id, unnest(pal) AS q, generate_subscripts(pal, 1)-1 AS place FROM e), u AS (SELECT id, place, q.pr, q.pg, q.pb, q.w AS n FROM o UNION ALL SELECT y.id, len(pal), pr, pg, pb, n FROM y JOIN e USING (id) JOIN im USING (id) WHERE n/(w*h) > {ACCENT}e0 AND len(list_filter(pal, lambda z: {_DE.format('z', 'y')} <= {APART})) = 0)
 SELECT id, CAST(place AS INT) AS place, {', '.join(f'CAST(floor(p{c}*1000+0.5e0) AS BIGINT) AS {c}' for c in 'rgb')}, CAST(n AS BIGINT) AS n FROM u""",
}

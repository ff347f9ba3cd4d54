"""Clusters, whitening and archives against brute force on small tables with awkward rows."""

import base64
import gzip
import hashlib
import math

import numpy as np
import pytest

pytest.importorskip("stitchyard.llm")
import duckdb  # noqa: E402

from stitchyard.llm import centroids, queries, sharding, warc, whitening  # noqa: E402
from stitchyard.llm import vectors as V  # noqa: E402

KIND = "vec_id long, embedding array<float>, cluster string, `a b.c` int"
D = "/root/testdata/sf0.001"


def rows(n, seed=0, spread=1.0):
    r = np.random.default_rng(seed)
    good = [(i, [float(x) for x in r.normal(0, spread * (1 + i % 5), 64).astype(np.float32)], "x", 1) for i in range(n)]
    nan, inf, short = [*good[0][1][:-1], math.nan], [math.inf, *good[0][1][1:]], good[0][1][:63]
    bad = [(1000, None, "x", 1), (1001, nan, "x", 1), (1002, inf, "x", 1), (1003, short, "x", 1), (1004, [], "x", 1), (1005, [None, *good[0][1][1:]], "x", 1)]
    return [*good, (2000, good[3][1], "y", 2), (2001, good[3][1], "y", 2), (7, good[7][1], "y", 2), (None, good[4][1], "z", None), *bad]


def lloyd(data, k=16, rounds=3):
    x = [(i, [math.floor(64 * float(c)) for c in v]) for i, v, *_ in data if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    at = [v for _, v in sorted(((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in x if i is not None))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(at))
    for _ in range(rounds):
        own = [[] for _ in at]
        for _, v in x:
            own[near(v)[1]].append(v)
        at = [[sum(z) // len(g) for z in zip(*g)] if g else c for g, c in zip(own, at)]
    return [(i, near(v)[1], near(v)[0]) for i, v in x], at


@pytest.mark.parametrize("seed", [0, 1])
def test_clusters(spark, seed):
    data = rows(150, seed, 0.3)
    want, at = lloyd(data)
    out = centroids.query(spark.createDataFrame(data, KIND)).collect()
    key = lambda r: tuple((z is not None, z) for z in r)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in out), key=key) == sorted(want, key=key)
    for r in out:
        assert r.inertia == sum(w[2] for w in want) and r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, at[r.cluster])).encode()).hexdigest()


def test_clusters_few(spark):
    assert centroids.query(spark.createDataFrame([], KIND)).count() == 0
    few = [(1, [0.5] * 64, "x", 1), (2, [0.5] * 64, "x", 1), (3, [3e38] * 64, "x", 1)]
    out = {r.vec_id: r for r in centroids.query(spark.createDataFrame(few, KIND)).collect()}
    assert out[1].cluster == out[2].cluster and out[1].distance == out[2].distance == out[3].distance == 0


def test_annulus_ties():
    """Equal centroids, equal distances and edges of the annulus: the smaller number wins, and fewer are compared than there are."""
    r = np.random.default_rng(5)
    at = [[int(z) for z in r.integers(-40, 40, 8) * (1 + i % 9) * (1 + i % 9)] for i in range(40)]
    at += [at[3], at[11], [-z for z in at[12]], [0] * 8]
    x = np.array([[int(z) for z in r.integers(-40, 40, 8) * 10] for _ in range(300)] + at + [[(a + b) // 2 for a, b in zip(at[1], at[2])]])
    brute = [min((sum((int(a) - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(at)) for v in x]
    search = centroids.Annulus(at)
    first = search.nearest(x)
    again = search.nearest(x, np.random.default_rng(6).integers(0, len(at), len(x)))
    for number, distance, compared in (first, again):
        assert list(zip(distance, number)) == brute
    assert first[2].mean() < 0.6 * len(at)


def test_squares_wrap():
    x = np.array([[2**31, -(2**31)], [2**62, 1], [5, 6]])
    assert list(V.squares(x, 1, np.array([-1, 1]))) == [2 * (2**31 + 1) ** 2 if 2 * (2**31 + 1) ** 2 < 2**63 else V.MOST, V.MOST, 61]


def test_whitening(spark):
    data = rows(200, 3, 0.4)
    ok = [(i, [math.floor(256 * float(c)) for c in v]) for i, v, *_ in data if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in ok}), float)
    n, mean = len(x), x.mean(0)
    values, found = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    total = [int(z) for z in x.sum(0)]
    out = {}
    for r in whitening.query(spark.createDataFrame(data, KIND)).collect():
        out.setdefault((r.vec_id, r.component), []).append(r)
    assert sorted(k[0] is None or k[0] for k in out for _ in out[k]) == sorted(i is None or i for i, _ in ok for _ in range(4))
    for k in range(1, 5):
        e, v = values[-k], found[:, -k]
        seen = np.array([out[i, k][0].whitened for i, _ in ok])
        want = np.array([(np.array(z) - mean) @ v / math.sqrt(e) for _, z in ok])
        assert min(np.abs(seen - want).max(), np.abs(seen + want).max()) < 1e-9
        for i, z in ok:
            r = out[i, k][0]
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(z, total))
            assert abs(r.explained - e / values.sum()) < 1e-12 and r.identity_error < 1e-9


def test_whitening_flat(spark):
    """No variance gives no rows; one direction gives one component; the commonest length counts."""
    make = lambda vs: spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vs)], KIND)
    assert whitening.query(make([])).count() == 0 and whitening.query(make([[1.0] * 3] * 4)).count() == 0
    out = whitening.query(make([[0.0, 0.0], [1.0, 1.0], [1.0, 1.0], [2.0, 2.0], [5.0], []])).orderBy("vec_id").collect()
    assert [(r.vec_id, r.component, r.n) for r in out] == [(i, 1, 3) for i in range(4)] and np.allclose([r.whitened for r in out], np.array([-1, 0, 0, 1]) * math.sqrt(1.5))


def test_moments_merge():
    """Merging keeps figures that sums of raw squares would lose."""
    x = np.random.default_rng(1).normal(0, 1, (1000, 3)) + 1e8
    cut = [V.Moments.of(x[a : a + 77]) for a in range(0, 1000, 77)]
    while len(cut) > 1:
        cut = [a.merge(b) for a, b in zip(cut[::2], cut[1::2])] + cut[len(cut) // 2 * 2 :]
    exact = np.array(x - 1e8)
    assert cut[0].n == 1000 and np.allclose(cut[0].covariance(), np.cov(exact.T, bias=True), rtol=1e-6, atol=1e-7)


PAGES = [
    (1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, "same"), (4, "http://a/4 x\r\ny: z", None), (5, "u", ""), (6, "u", "WARC/1.1\r\nX-Archive-Boundary: 0\r\nWARC-Type: response\r\n\r\nfake\r\n\r\n"),
    (7, "u", "é中\U0001f600" * 400), (8, "u", "x" * 1000), (8, "u", "x" * 1000), (8, "v", "x" * 1000), (None, "u", "none"), (None, "u", "none"), (9, "u", "none"), (10, "u", "y" * 64), (11, "u", "y" * 65), (12, "u", "\n\r\n\r\n"),
]


def archive(spark, path, size=64):
    warc.write(spark.createDataFrame([(*p, "k") for p in PAGES], "page_id long, url string, html string, record string"), f"file://{path}", size)
    return warc.read(spark, f"file://{path}")


def test_warc(spark, tmp_path):
    out = warc.resolved(archive(spark, tmp_path / "w")).collect()
    raw = [(p, (h or "").encode()) for p, _, h in PAGES]
    first = {h: max((p for p, g in raw if g == h), key=lambda p: (p is not None, p or 0)) for _, h in raw}
    seen = sorted(((r.page_id is not None, r.page_id or 0, r.bytes, r.digest, r.kind, r.refers_to or 0) for r in out), key=repr)
    want, given = [], set()
    for p, h in raw:
        kind = "revisit" if p != first[h] or h in given else "response"
        given |= {h} if kind == "response" else set()
        want.append((p is not None, p or 0, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), kind, first[h] or 0 if kind == "revisit" else 0))
    assert seen == sorted(want, key=repr) and all(r.intact for r in out)
    assert {r.segments for r in out if r.page_id == 7} == {-(-len("é中\U0001f600".encode()) * 400 // 64)} and all(r.segments == 1 for r in out if r.page_id in (5, 10, 12))


def test_warc_file(spark, tmp_path):
    """The files are WARC: records of a version line, fields and a block of the stated length, two line ends after each."""
    archive(spark, tmp_path / "w")
    count = 0
    for f in (tmp_path / "w").glob("*.gz"):
        raw, at = gzip.decompress(f.read_bytes()), 0
        while at < len(raw):
            end = raw.index(b"\r\n\r\n", at)
            lines = raw[at:end].decode().split("\r\n")
            length = int(dict(x.split(": ", 1) for x in lines[1:])["Content-Length"])
            assert lines[0] == "WARC/1.1" and raw[end + 4 + length : end + 8 + length] == b"\r\n\r\n"
            at, count = end + 8 + length, count + 1
    assert count == sum(max(1, -(-len((h or "").encode()) // 64)) for h in {h or "" for _, _, h in PAGES}) + len(PAGES) - len({h or "" for _, _, h in PAGES})


def test_warc_damage(spark, tmp_path):
    """A changed byte, a lost segment and a revisit of nothing are told."""
    archive(spark, tmp_path / "w")
    for i, f in enumerate(sorted((tmp_path / "w").glob("*.gz"))):
        raw = gzip.decompress(f.read_bytes())
        records = raw.split(b"WARC/1.1\r\nX-Archive")[1:]
        kept = [r.replace(b"none\r\n\r\n", b"nine\r\n\r\n") for r in records if b"WARC-Segment-Number: 2\r" not in r and b"\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: 4\r\n\r\nsame" not in r]
        (tmp_path / "v").mkdir(exist_ok=True)
        (tmp_path / "v" / f"{i}.txt").write_bytes(b"".join(b"WARC/1.1\r\nX-Archive" + r for r in kept))
    out = warc.resolved(warc.read(spark, f"file://{tmp_path}/v")).collect()
    bad = {r.page_id for r in out if not r.intact}
    assert bad >= {1, 2, 7, 8, 9, 11} and not bad & {5, 6, 10, 12} and len(out) == len(PAGES) - 1
    assert all(r.bytes is None for r in out if r.page_id in (1, 2))


def test_warc_empty(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.query(none).count() == 0


@pytest.mark.parametrize("name", ["op11_annulus_clusters", "op12_chunked_warc", "op9_event_chat"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    a, b = queries.queries()[name](spark, D).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    text = lambda x: sorted(map(repr, x[sorted(x.columns)].astype(object).where(x.notna(), None).values.tolist()))
    assert text(a) == text(b)


@pytest.mark.parametrize("n", [20, 3000])
def test_shard_codes(spark, n):
    """Values that share a long beginning keep their order as codes; many values keep it in steps; null comes first."""
    names = [None, *sorted(f"common_crawl/segment-{i:05d}" for i in range(n))]
    d = spark.createDataFrame([(i, "x", "en", s, 0) for i, s in enumerate(names)], "doc_id long, text string, lang string, source string, n_chars long")
    codes = [r.source_dim for r in sharding.described(d).orderBy("doc_id").collect()]
    assert codes == sorted(codes) and codes[0] == 0 and len(set(codes)) == min(n + 1, max(codes) + 1) and max(codes) >= min(n, sharding.STEPS - 2)

"""The training-data operators against brute force on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("stitchyard.llm")
import public_tokenizers  # noqa: E402

from stitchyard.llm import chat_format, decontaminate, html_extract, language_id, lm_scoring, near_dedup, packing, quality_rules, sharding, substring_dedup  # noqa: E402

VOCAB = str(public_tokenizers.path("word_bpe_49k.json"))
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))
KIND = "doc_id long, text string, lang string, source string, n_chars long, n_words long"


def words(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefghij"), 5)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    a, b = words(1, 120), words(2, 90)
    texts = [a, b, a, None, "", " \n\t", a + " more words here now", "é ü 中文 " + b[:300] + " ñ", "x", "a b c " * 60, words(3, 4000), "l one\nl one\n" * 30, None, b[100:400] + words(4, 60)]
    rows = [(i, t, "en" if i % 2 else None, "s", 0, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KIND)


def got(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_rules(docs):
    out = got(quality_rules.query(docs))
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        c = Counter(zip(w, w[1:], w[2:]))
        hit = [any(0 <= k <= len(w) - 3 and c[w[k], w[k + 1], w[k + 2]] > 1 for k in (i - 2, i - 1, i)) for i in range(len(w))]
        lines = [x for x in (r.text or "").split("\n") if x.split()]
        o = out[r.doc_id]
        assert (o.n_words, o.word_chars, o.n_dup_lines, o.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), sum(hit))
    assert set(quality_rules.filtered(docs).columns) == set(docs.columns)
    assert sum(r.rejected for r in quality_rules.ablate(quality_rules.ledger(docs), "base-1").collect()) >= 5


def test_substrings(docs):
    out, seen = got(substring_dedup.query(docs)), set()
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        raw = (r.text or "").encode()
        mark = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                mark[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        rest = bytes(x for x, m in zip(raw, mark) if not m)
        o = out[r.doc_id]
        assert (o.n_bytes, o.n_removed, o.n_spans, o.kept_sha256) == (len(raw), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(rest).hexdigest())
    assert substring_dedup.cleaned(docs).columns == docs.columns


def test_substrings_hot_anchor(monkeypatch):
    """Windows around one anchor whose second ranks differ in the high bits alone are no repeats of each other."""
    text, window = words(60, 20).encode()[:100], np.arange(1, 101, dtype=np.uint64) << np.uint64(40)
    batch = pa.RecordBatch.from_arrays([pa.array([text.decode()] * 100), pa.array(range(100)), pa.array([[0]] * 100, pa.list_(pa.int32()))], names=["text", "id", "anchors"])

    def each(batches, want):
        offsets = np.arange(101) * 100
        span, at = np.zeros(10000, np.uint64), np.full(10000, -1)
        at[offsets[:-1]], span[offsets[:-1] + substring_dedup.SPAN] = offsets[:-1], window
        for b in batches:
            yield b, np.frombuffer(text * 100, np.uint8), offsets, (span,), at

    monkeypatch.setattr(substring_dedup, "_each", each)
    rows = list(substring_dedup._window_rows([batch]))
    assert sum(r.num_rows for r in rows) == 100
    assert sum(r.num_rows for r in substring_dedup._later(iter(rows))) == 0
    assert sum(r.num_rows for r in substring_dedup._later(iter([*rows, *rows]))) == 100


def brute_spans(rows):
    """(doc_id, bytes, removed bytes, runs, digest) by marking every repeated window, in order of doc_id."""
    seen = set()
    for i, t in rows:
        raw = (t or "").encode()
        mark = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                mark[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        yield i, len(raw), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(bytes(x for x, m in zip(raw, mark) if not m)).hexdigest()


def test_substrings_hot_passage(spark):
    """A passage in most texts, in the same slice and in others, and texts that repeat themselves."""
    hot, rng, rows = words(61, 60), np.random.default_rng(62), []
    for i in range(300):
        own = words(1000 + i, 30)
        at = int(rng.integers(0, 80))
        rows.append((i, own[:at] + (hot[int(rng.integers(0, 9)) :] if i % 3 else "") + own[at:] + (hot if i % 7 == 0 else "")))
    rows += [(300, "ab" * 400), (301, "ab" * 90), (302, None), (303, "é" * 300), (304, hot * 3)]
    d = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(7)
    got_ = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.query(d).collect()}
    assert got_ == set(brute_spans(rows))


def test_packing(docs):
    from tokenizers import Tokenizer

    t, rows = Tokenizer.from_file(VOCAB), packing.query(docs, VOCAB).collect()
    for r in docs.collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for p in sorted((p for p in rows if p.doc_id == r.doc_id), key=lambda p: p.start):
            assert p.start == at and p.length & (p.length - 1) == 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert sorted(p.sequence_id for p in rows) == list(range(len(rows)))


def test_near(docs):
    out = got(near_dedup.query(docs))
    assert [out[i].class_id for i in (0, 2, 6)] == [0, 0, 0] and out[1].class_id == 1
    assert [out[i].class_id for i in (3, 4, 12)] == [3, 3, 3] and out[5].class_id == 5
    again = docs.union(docs)
    assert near_dedup.query(again).count() == 2 * docs.count() and near_dedup.deduplicated(again).columns == docs.columns


def test_near_masses(spark):
    """The bitmap's bound is never under the exact one, and close to it."""
    texts = [words(300 + i % 7, 60) + " " + words(400 + i, 10 + i % 9) for i in range(90)]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    model = near_dedup.idf(d)
    exact = got(near_dedup.counted_masses(d, 1, model), "id")
    for i, r in got(near_dedup.masses(d, model), "id").items():
        assert abs(r.w - exact[i].w) < 1e-3
        mine, own = (sum(x[f"m{k}"] for k in range(near_dedup.SLOTS)) for x in (r, exact[i]))
        assert own - 1e-3 <= mine <= own + 0.05 * r.w


@pytest.mark.parametrize("bits", [near_dedup.BITS, 0])
def test_near_large_bucket(spark, monkeypatch, bits):
    """Classes of many copies with edits, most of them below the threshold with each other, against all pairs,
    with both bounds of masses."""
    monkeypatch.setattr(near_dedup, "BITS", bits)
    base, rng, texts = words(70, 150).split(), np.random.default_rng(71), []
    for i in range(150):
        w = list(base)
        for at in rng.choice(len(w), i % 6, replace=False):
            w[at] = "new" + str(rng.integers(1 << 40))
        texts.append(" ".join(w))
    texts = list(dict.fromkeys(texts))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = near_dedup.idf(d)
    row, gram, count, n = near_dedup.shingles(pa.array(texts))
    bags = [dict(zip(gram[row == i].tolist(), model.weights(gram[row == i], count[row == i]).tolist(), strict=True)) for i in range(n)]
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            both = sum(min(v, bags[j].get(k, 0)) for k, v in bags[i].items())
            if both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                label = [label[j] if x == label[i] else x for x in label]
    want = {i: min(j for j in range(n) if label[j] == label[i]) for i in range(n)}
    assert {r.doc_id: r.class_id for r in near_dedup.query(d).collect()} == want and 1 < len(set(want.values())) < n


def lattice_sum(word, pieces, p):
    """The probability of a word by the plain recursion over all its segmentations."""
    table, w = dict(zip(pieces, p, strict=True)), lm_scoring.START + word
    ways = [1.0]
    for j in range(1, len(w) + 1):
        ways.append(sum(ways[i] * table.get(w[i:j], 0) for i in range(max(0, j - 60), j)))
    return ways[-1]


def test_lm(docs):
    rows = got(lm_scoring.query(docs, PIECES))
    train = [t for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for t in [*(r.text or "").encode().lower().split(), b"\0end"]]
    c, n = Counter(train), len(train)
    held = docs.select("doc_id", lm_scoring.F.expr("pmod(crc32(cast(cast(doc_id as string) as binary)), 7) = 2").alias("held_out"), "text")
    model = lm_scoring.Model(held, PIECES)
    pieces, log_p = model.shared.value
    p, known = np.exp(log_p), {}
    assert abs(p.sum() + 10**model.log_end - 1) < 1e-9
    for r in docs.collect():
        t = [*(r.text or "").encode().lower().split(), b"\0end"]
        o = rows[r.doc_id]
        assert (o.n_tokens, o.n_known, o.train_tokens) == (len(t), sum(c[x] > 0 for x in t), n)
        assert abs(o.base_score - sum(np.log10((c[x] + 1) / (n + len(c) + 1)) for x in t)) < 1e-6
        for w in t[:-1]:
            known.setdefault(w, lattice_sum(w, pieces, p))
        assert abs(o.score - sum(np.log10(known[w]) for w in t[:-1]) - model.log_end) < 1e-6


def test_lm_temperature(docs):
    """Each round makes the training words more likely."""
    held = docs.selectExpr("doc_id", "false as held_out", "text")
    words_ = [w for r in docs.collect() for w in (r.text or "").encode().lower().split()]
    found = []
    for t in lm_scoring.Model(held, PIECES, 3).temperatures:
        pieces, rank = lm_scoring.scored_pieces(PIECES)
        found.append(lm_scoring.log_words(lm_scoring.Lattice(pieces, lm_scoring.log_pieces(rank, t, 0.0)), words_).sum())
    assert len(found) == 4 and all(a < b + 1e-9 for a, b in zip(found, found[1:]))


def test_lattice():
    pieces, rank = lm_scoring.scored_pieces(PIECES)
    log_p = lm_scoring.log_pieces(rank, 1.3, 0.1)
    some = [b"the", b"hello,", b"x", "é".encode(), b"abcdefgh" * 9, b"\x00", "中文".encode()]
    assert np.allclose(lm_scoring.log_words(lm_scoring.Lattice(pieces, log_p), some), [np.log(lattice_sum(w, pieces, np.exp(log_p))) for w in some])


def test_long_words_are_learnt(monkeypatch):
    """Pieces learn from words over LONG bytes as the form over blocks of one length does."""
    pieces, rank = lm_scoring.scored_pieces(PIECES)
    model = lm_scoring.Lattice(pieces, lm_scoring.log_pieces(rank, 1.0, 0.1))
    monkeypatch.setattr(lm_scoring, "PART", 7)
    long = ("https://example.org/" + "theinternational" * 6 + "中文句子没有空格").encode()
    block = model.expected(np.frombuffer(lm_scoring.START + long, np.uint8)[None].astype(np.uint64), np.ones(1))
    assert len(long) > lm_scoring.LONG and np.allclose(lm_scoring.expected_words(model, [long], np.array([3.0])), 3 * block)


def test_shards(docs):
    out = sharding.query(docs).collect()
    assert len(out) == docs.count() and all(0 <= r.shard < 16 for r in out)
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_shards_of_copies(spark):
    """Equal texts share a shard unless they outweigh it, and shards are near equal by brute force."""
    rng, rows = np.random.default_rng(90), []
    for i in range(900):
        rows.append((i, words(i % 300 if i % 3 else i, int(rng.integers(20, 60))), f"l{i % 3}", f"s{i % 11}"))
    rows += [(900 + i, words(7, 400), None, "s") for i in range(6)] + [(2000 + i, "same text " * 20, "l", "t") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out, text = sharding.query(d).collect(), {r[0]: r[1] for r in rows}
    size = Counter()
    for r in out:
        size[r.shard] += r.size
        assert (r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id].encode()))
    mean = sum(size.values()) / 16
    assert sorted(size) == list(range(16)) and max(size.values()) < 1.15 * mean and min(size.values()) > 0.85 * mean
    shards, held = {}, Counter()
    for r in out:
        shards.setdefault(r.text_crc32, set()).add(r.shard)
        held[r.text_crc32] += r.size
    assert all(len(s) == 1 for k, s in shards.items() if held[k] <= 0.05 * mean) and any(len(s) > 1 for s in shards.values())


def test_shards_end_at_the_target(spark):
    d = spark.createDataFrame([(i, words(i, 30), "l", "s") for i in range(64)], "doc_id long, text string, lang string, source string")
    total = sum(r.size for r in sharding.query(d).collect())
    assert len({r.shard for r in sharding.sharded(d, total).collect()}) == 1
    assert len({r.shard for r in sharding.sharded(d, int(0.6 * total)).collect()}) == 2


def test_language(spark):
    rows = [(i, words(i, 30).translate(str.maketrans("abcdefghij", "klmnopqrst")) if i % 2 else words(i, 30), "uv"[i % 2]) for i in range(80)] + [(80, None, "u"), (81, "12 !", None)]
    out = got(language_id.query(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(out[i].lang_pred == "uv"[i % 2] for i in range(80)) and out[80].lang_pred == out[81].lang_pred == "und"


def test_language_parts(spark, monkeypatch):
    """A filter met in parts gives the same result; every learnt gram is in the filter; a null doc_id is learnt from."""
    other = str.maketrans("abcdefghij", "klmnopqrst")
    rows = [(i or None, words(i, 40).translate(other) if i % 2 else words(i, 40), "uv"[i % 2], "x") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out string")
    monkeypatch.setattr(language_id, "ROOM", 256)
    whole = sorted(map(str, language_id.query(d).collect()))
    model = language_id.learn(d)
    h = language_id.grams([t for _, t, lang, _ in rows if lang == "u"])[0]
    assert model.blocks > 4 and language_id._hits(h, np.array([0, len(h)]), 2, model.blocks, model.part(0))[0, 0] == len(h)
    monkeypatch.setattr(language_id, "PART_BYTES", 1 << 19)
    assert sorted(map(str, language_id.query(d).collect())) == whole and len(whole) == 60
    assert [r.held_out for r in language_id.query(d).collect() if r.doc_id is None] == [False]


def test_language_of_mixed_training(spark):
    """Some words of the other language in its training texts don't put their grams into a filter."""
    other = str.maketrans("abcdefghij", "klmnopqrst")
    plain = lambda i: words(i, 40).translate(other) if i % 2 else words(i, 40)
    rows = [(i, plain(i) + (" " + " ".join(plain(i + 1).split()[:2]) if i % 5 == 0 else ""), "uv"[i % 2]) for i in range(300)]
    out = got(language_id.query(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(out[i].lang_pred == "uv"[i % 2] and out[i].score > 0.8 for i in range(300))


def test_leaks(spark):
    item = words(50, 30)
    changed = item.split()
    changed[7], changed[21] = "other", "words"
    texts = [words(51, 100) + " " + item + " " + words(52, 50), words(53, 200), None, " ".join(changed), ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.query(d, b).collect()) == [(0, 1), (3, 1)]


def test_leaks_of_rows_without_own_id(spark):
    item, clean = words(50, 30), words(53, 200)
    rows = [(None, item, "a"), (None, clean, "b"), (7, clean + " " + item, "c"), (7, clean, "d"), (8, None, "e")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = decontaminate.decontaminated(d, b)
    assert out.columns == d.columns and sorted(r.lang for r in out.collect()) == ["b", "d", "e"]


def test_leaks_edited(spark):
    """Items with words replaced, left out and put in, inside longer texts, against the LCS of all pairs and windows."""
    rng, vocabulary = np.random.default_rng(80), words(81, 400).split()
    # a few words are very common, as in prose
    some = lambda n: [vocabulary[i] for i in (400 * rng.random(n) ** 3).astype(int)]
    items, texts, planted = [some(n) for n in rng.integers(15, 60, 40)], [], []
    for rate in (0.0, 0.1, 0.2, 0.3, 0.35):
        for k, item in enumerate(items):
            w = []
            for x in item:
                kind = rng.choice(["keep", "replace", "drop", "add"], p=[1 - rate, rate / 2, rate / 4, rate / 4])
                w += {"keep": [x], "replace": some(1), "drop": [], "add": [x, *some(1)]}[kind]
            texts.append(" ".join([*some(rng.integers(80, 200)), *w, *some(rng.integers(80, 200))]))
            planted.append((rate, k))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.lcs for r in decontaminate.query(docs, benchmark).collect()}
    idf, vectors = np.ones(decontaminate.TERMS), np.zeros((decontaminate.TERMS, 4), np.float32)
    checker = decontaminate.Items(list(range(len(items))), [" ".join(x) for x in items], idf, vectors)
    w, want = decontaminate._words(pa.array(texts)), {}
    for row, first, _ in zip(*decontaminate.windows(w.at, decontaminate.STEP), strict=True):
        for k, item in enumerate(items):
            lcs, answer = checker.check(k, w.hash[max(w.at[row], first - len(item)) : min(w.at[row + 1], first + decontaminate.WIDTH + len(item))])
            if lcs >= decontaminate.LCS and answer >= decontaminate.ANSWER:
                want[row, k] = max(lcs, want.get((row, k), 0))
    for rate in (0.0, 0.1, 0.2, 0.3, 0.35):
        of = [(i, k) for i, (x, k) in enumerate(planted) if x == rate and (i, k) in want]
        found = sum(pair in got for pair in of)
        assert len(of) >= 10 and found >= 0.9 * len(of)
    assert got == want


def test_leaks_without_basis():
    """The basis decides no result: with vectors of zero the counts find the edited item alone."""
    item = words(50, 30)
    text = words(51, 100) + " " + " ".join("new" if i % 4 == 1 else x for i, x in enumerate(item.split())) + " " + words(52, 50)
    items = decontaminate.Items([1], [item], np.ones(decontaminate.TERMS), np.zeros((decontaminate.TERMS, 4), np.float32))
    assert list(decontaminate.found_in(items, decontaminate._words(pa.array([text, words(53, 200)])))) == [(0, 0)]


def test_html():
    page = '<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>One\n two<br><p>Three</p><script>x("</p>")</script><aside>no</aside><div class="comments"><p>me</p></div></article><footer>f</footer>'
    assert html_extract.extract(page) == "A & B\n\nOne two\n\nThree"
    assert html_extract.extract("") == "" and html_extract.extract("<nav>x</nav>") == ""


def test_html_ambiguous_names():
    one, two, price = "Long text one that goes on and on for a while, really.", "More text that is long, too, and closes the piece.", "The price of a share rose by ten percent on that day, as we said."
    assert html_extract.extract("<article><header><h1>Title</h1><nav>x</nav></header><p>" + one + "</p></article>") == "Title\n\n" + one
    assert html_extract.extract(f'<div class="article"><p>{one}</p><div class="share-price">{price}</div><p>{two}</p><div class="share">Share</div></div>') == "\n\n".join((one, price, two))
    assert html_extract.extract(f"<div class='social-science'><article><p>{one}</p></article></div><p>short</p>") == one
    assert html_extract.extract("<div>" * 3000 + one) == one


def test_html_ratios_decide(monkeypatch):
    """Without names and kinds the clusters choose the container; with equal ratios the text is another."""
    links = "".join(f"<div><i></i><b></b><a href='/{i}'><span>Link {i}</span></a></div>" for i in range(30))
    body = "".join(f"<p>{words(700 + i, 30)}</p>" for i in range(4))
    page, want = f"<body><div>{links}</div><div>{body}</div><div><a>end</a></div></body>", "\n\n".join(words(700 + i, 30) for i in range(4))
    assert html_extract.extract(page) == want
    monkeypatch.setattr(html_extract, "smooth", lambda ratios: [1.0] * len(ratios))
    assert html_extract.extract(page) != want


def test_html_query(spark):
    """Nulls, empty pages, repeated rows, an empty table and further columns, against the kernel."""
    rows = [(1, "u", "<article><p>a&nbsp;b<p>c</article>", 5), (1, "u", "<article><p>a&nbsp;b<p>c</article>", 5), (2, None, None, 6), (None, "v", "", 7)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.query(d).collect()) == [(0, "", 0), (1, "a b\n\nc", 6), (1, "a b\n\nc", 6), (2, "", 0)]
    assert html_extract.query(d.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, 0, "start", "user", None), (1, 1, 0, "delta", None, "a<"), (1, 2, 1, "start", "assistant", None), (1, 3, 1, "delta", None, "draft"), (1, 4, 1, "regenerate", None, None), (1, 5, 1, "delta", None, "</turn>"), (1, 6, 0, "edit", None, "b\\")]
    segments = chat_format.formatted(spark.createDataFrame(rows, "conv_id long, seq long, message long, kind string, role string, text string")).orderBy("message").collect()
    assert [tuple(map(chat_format.unescape, chat_format.TURN.fullmatch(s.segment).groups())) for s in segments] == [("user", "b\\"), ("assistant", "</turn>")]


def test_empty(docs):
    none = docs.limit(0)
    for f in (quality_rules.query, near_dedup.query, substring_dedup.query, sharding.query, language_id.query, lambda d: packing.query(d, VOCAB), lambda d: lm_scoring.query(d, PIECES)):
        assert f(none).count() == 0


def test_empty_others(spark, docs):
    item = spark.createDataFrame([(1, words(50, 30))], "item_id long, text string")
    assert decontaminate.query(docs.limit(0), item).count() == 0 and decontaminate.query(docs, item.limit(0)).count() == 0
    talk = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat_format.query(talk).collect()] == [-7]  # the conversation that the query adds


def test_clashing_names(spark):
    """Columns that operators use themselves, and names that need quotes, stay with their rows."""
    text = words(600, 120)
    rows = [(1, text, "mine", "k", "s", 3), (2, text, "yours", "k", "s", 4), (3, words(601, 120), "theirs", "k", "s", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, `_id` string, `_key` string, spans string, `a b.c` int")
    item = spark.createDataFrame([(1, words(602, 30))], "item_id long, text string")
    for f, left in ((quality_rules.filtered, 3), (near_dedup.deduplicated, 2), (substring_dedup.cleaned, 3), (lambda x: decontaminate.decontaminated(x, item), 3)):
        out = f(d)
        assert out.columns == d.columns and out.count() == left
        assert {(r.doc_id, r["_id"], r["a b.c"]) for r in out.collect()} <= {(1, "mine", 3), (2, "yours", 4), (3, "theirs", 5)}


def test_substrings_windows_go_as_names():
    """A window goes to the sort as eight bytes, the name of its pair of ranks; a copy in the same slice sends none."""
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(150))
    at = np.unique(substring_dedup.anchors(substring_dedup.doubled(np.frombuffer(text.encode(), np.uint8), (substring_dedup.SPAN,))[0]))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, text]), pa.array([at.astype(np.int32)] * 2)], names=["id", "text", "anchors"])
    blobs = [b for r in substring_dedup._window_rows([batch]) for b in r.column("windows").to_pylist()]
    assert sum(map(len, blobs)) == 8 * (150 - substring_dedup.LENGTH + 1)


def test_ranges_of_a_passage_are_joined(spark):
    """A long repeated passage has many anchors, and is one range: ranges are few enough to be broadcast where texts are not."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    passage = " ".join(word() for _ in range(300))
    d = spark.createDataFrame([(1, f"{word()} {passage}"), (2, f"{passage} {word()}"), (3, word())], "doc_id long, text string")
    found = {r.row.doc_id: r.spans for r in substring_dedup.marked(d).collect()}
    assert found[1] is None and found[3] is None and [tuple(r) for r in found[2]] == [(0, len(passage))]

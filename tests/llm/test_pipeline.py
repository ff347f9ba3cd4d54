"""The stages of the pipeline and the whole of it, on a small table with awkward rows, against brute force."""

import hashlib
import re

import pytest

pytest.importorskip("stitchyard.llm")
import corpus_pipeline  # noqa: E402
from stitchyard.llm.common import materialize  # noqa: E402
from test_operators import words  # noqa: E402

KIND = "doc_id long, text string, lang string, source string, n_chars long, `_id` string, `a b` int, `row` string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and benchmark, with null and repeated ids, texts and columns whose names operators use."""
    a, b, item = words(501, 150), words(502, 140), words(503, 40)
    near = a.split()
    near[70] = "changed"
    shared = words(504, 60)
    texts = [
        (0, a), (1, a), (2, " ".join(near)), (3, b), (None, words(505, 130)), (None, words(506, 120)),
        (5, words(507, 100) + " " + shared), (5, words(508, 100) + " " + shared + " tail of this text"),
        (6, words(509, 80) + " " + item + " " + words(510, 60)), (None, words(511, 90) + " " + item),
        (7, None), (8, ""), (9, "too short"), (10, "word " * 200), (11, "### $$$ " * 100 + words(512, 60)), (12, words(513, 5000)),
    ]
    rows = [(i, t, "en", None, None if t is None else len(t), f"own{k}", k, "r") for k, (i, t) in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, KIND).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


@pytest.fixture(scope="module")
def stages(spark, folder):
    """What each stage but the last returns, written and read again."""
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out.append(materialize(stage(spark, out[-1], folder), f"test-{name}"))
    return out


def test_quality(stages):
    out = stages[1]
    assert out.columns == [x.split()[0].strip("`") if "a b" not in x else "a b" for x in KIND.split(", ")]
    assert sorted(r["_id"] for r in out.collect()) == sorted(f"own{k}" for k in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 15))


def test_near_duplicates(stages):
    out = stages[2]
    assert sorted(r["_id"] for r in out.collect()) == sorted(f"own{k}" for k in (0, 3, 4, 5, 6, 7, 8, 9, 15))
    assert {r["row"] for r in out.collect()} == {"r"} and "a b" in out.columns


def test_repeated_passages(stages):
    before = {r["_id"]: r for r in stages[2].collect()}
    after = {r["_id"]: r for r in stages[3].collect()}
    assert set(before) == set(after)
    seen = set()
    # null ids come first, then by id and by the hash of the text
    for r in sorted(before.values(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, hashlib.sha256(r.text.encode()).hexdigest())):
        raw = r.text.encode()
        mark = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                mark[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        rest = bytes(x for x, m in zip(raw, mark) if not m).decode()
        assert after[r["_id"]].text == rest and after[r["_id"]].n_chars == len(rest)
    assert sum(len(before[k].text) > len(after[k].text) for k in before) == 2


def test_benchmark_passages(stages):
    left = {r["_id"]: r.text for r in stages[4].collect()}
    # the item stays in the first of its two documents, which then goes; the other has lost the passage before
    assert len(left) == 8 and {"own0", "own3", "own4", "own5", "own6", "own7", "own15"} <= set(left)
    item = words(503, 40)
    assert not any(item in t for t in left.values())


def test_run(spark, folder, stages):
    kept = stages[4].collect()
    pieces = corpus_pipeline.run(spark, folder).collect()
    ends = {}
    for p in pieces:
        assert p.length & (p.length - 1) == 0 and 0 < p.length <= 4096 and p.offset == 0
        ends[p.doc_id, p.doc_tokens] = ends.get((p.doc_id, p.doc_tokens), 0) + p.length
    assert sorted(i is None for i, _ in ends) == sorted(r.doc_id is None for r in kept)
    assert all(total == n for (_, n), total in ends.items())
    assert sorted(p.sequence_id for p in pieces) == list(range(len(pieces)))


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_names_match_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "benchmark_passages", "packed"]
    assert re.match(r"The training-data pipeline", corpus_pipeline.__doc__)

"""Language ID by language-bitmask n-gram filters.

The filter is one bit-sliced Bloom filter for all languages: each slot holds a mask with a bit per
language, and the AND of a gram's slots is the set of languages that may contain it. A document gets, for
each language, the number of its grams whose set has the language (a popcount by bit), corrected for the
filter's false-positive rate in that language: (hits - f n) / (1 - f). Grams that all languages hold tell
nothing and aren't counted, unless a text has no others. The largest corrected count decides, and its
share of all corrected counts is the score.

Every training gram is in the filter of the language that uses it at the highest rate, and of all that use it at
``CONTAINS`` of that rate or more, however rare it is. Mere occurrence would not do: with some words of other
languages in one text of a thousand, all filters hold all grams once there is enough text. The filter is built on the cluster in blocks of ``BLOCK``
slots, a gram's slots in one block, with ``ROOM`` slots for each gram of the language that has most. A filter
of up to ``PART_BYTES`` is broadcast; a larger one is met part by part, block by block, and the parts' counts are added.

Grams are of four characters over lower-cased text, with every run of other characters than letters as
one space. Defined results: null text, or one without a letter, is ``und`` with score 0, as are all
documents when no labelled row can be learnt from; repeated rows are predicted again each; ties go to the
language first in order; an empty table gives no rows; a row without doc_id is learnt from and not held out;
texts of any length are read whole, in slices of rows; further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrays as A
from .common import drop_table, materialize, partitions

N, HASHES, ROOM, BLOCK, PART_BYTES = 4, 4, 16, 1 << 16, 64 << 20
#: Share of its rate in the language that uses it most, from which a language contains a gram.
CONTAINS = 0.1
_LETTER: list[np.ndarray] = []


def _letter() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each gram, offsets of the grams by row, and whether each row has a letter."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(texts)) + 1)  # the line end after each text
    letter = _letter()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters, the first stands for all
    keep[0] = True
    letter, codes, owner = letter[keep], np.where(letter, points, 32)[keep].astype(np.uint64), np.searchsorted(ends, np.flatnonzero(keep), "left")
    has = np.bincount(owner[letter], minlength=len(texts)) > 0
    k = len(codes) - N + 1
    if k <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), has
    # a space belongs to the texts on both sides; a gram is of one text if its first and last letters are
    first = np.where(letter, owner, np.append(owner[1:], -1))[:k]
    whole = first == np.where(letter, owner, np.append(-2, owner[:-1]))[N - 1 :]
    h = codes[:k] * A.WORD_KEYS[0]
    for i in range(1, N):
        h = h + codes[i : i + k] * A.WORD_KEYS[i]
    return A.mix(h[whole]), np.searchsorted(first[whole], np.arange(len(texts) + 1)), has


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in A.slices(batches, "text", 16 << 20):
        langs = np.array(b.column("lang").to_pylist())
        texts = b.column("text").to_pylist()
        for lang in np.unique(langs):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            h, n = np.unique(grams(own)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.int64) & (blocks - 1)


def _slot(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th slot of each gram in its block."""
    return ((h + np.uint64(k) * (A.mix(h ^ np.uint64(0xA5A5A5A5)) | np.uint64(1))) >> np.uint64(8)).astype(np.int64) & (BLOCK - 1)


class Filter:
    """Languages in order, the number of blocks and parts, each language's false-positive rate, and the blocks as a table."""

    def __init__(self, langs: list[str], blocks: int, parts: int, false: np.ndarray, table: DataFrame):
        self.langs, self.blocks, self.parts, self.false, self.table = langs, blocks, parts, false, table

    def part(self, k: int) -> dict[int, np.ndarray]:
        """The masks of the blocks of a part: (slots, bytes of a mask)."""
        rows = self.table.filter(F.pmod("block", F.lit(self.parts)) == k).collect()
        return {r.block: np.frombuffer(r.masks, np.uint8).reshape(BLOCK, -1) for r in rows}


def _hits(h: np.ndarray, offsets: np.ndarray, n_langs: int, blocks: int, part: dict[int, np.ndarray]) -> np.ndarray:
    """By language and row: grams whose slots in this part's blocks all have the language; last those of all languages."""
    at = _block(h, blocks)
    place = np.full(blocks, -1)
    place[list(part)] = np.arange(len(part))
    masks = np.concatenate([*part.values(), np.zeros((BLOCK, max(1, (n_langs + 7) // 8)), np.uint8)])
    base = place[at]
    base[base < 0] = len(part)  # of another part: no language
    sets = None
    for k in range(HASHES):
        found = masks[base * BLOCK + _slot(h, k)]
        sets = found if sets is None else sets & found
    bits = [(sets[:, i >> 3] >> (i & 7)) & 1 for i in range(n_langs)]
    return np.stack([A.sums(x, offsets) for x in [*bits, functools.reduce(np.bitwise_and, bits)]])


def learn(labelled: DataFrame) -> Filter | None:
    """The filter of the grams of (text, lang) rows."""
    rows = labelled.filter("text is not null and lang is not null").select("text", "lang")
    met = materialize(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    sizes = dict(met.groupBy("lang").agg(F.sum("n")).collect())
    if not sizes:
        return None
    total = F.broadcast(labelled.sparkSession.createDataFrame(list(sizes.items()), "lang string, total long"))
    rate = met.join(total, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate"))
    # a gram has a row for each language at most
    counts = materialize(rate.withColumn("top", F.max("rate").over(W.partitionBy("gram"))).filter(F.col("rate") >= CONTAINS * F.col("top")).select("lang", "gram"), "language-grams")
    drop_table(met)
    totals = dict(counts.groupBy("lang").count().collect())
    langs, blocks = sorted(totals), max(1, 1 << (max(totals.values()) * ROOM // BLOCK).bit_length())
    bytes_, code = (len(langs) + 7) // 8, {lang: i for i, lang in enumerate(langs)}

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by block: the masks of a block whose grams came in order."""
        now, masks = None, None

        def block():
            ones = [int(np.count_nonzero(masks[:, i >> 3] >> (i & 7) & 1)) for i in range(len(langs))]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([masks.tobytes()]), pa.array([ones], pa.list_(pa.int64()))], names=["block", "masks", "ones"])

        for b in batches:
            owner, h = b.column("block").to_numpy(), b.column("gram").to_numpy().view(np.uint64)
            lang = np.array([code[x] for x in b.column("lang").to_pylist()], np.int64)
            for own in np.unique(owner):
                if own != now:
                    if now is not None:
                        yield block()
                    now, masks = int(own), np.zeros((BLOCK, bytes_), np.uint8)
                here = owner == own
                for k in range(HASHES):
                    np.bitwise_or.at(masks, (_slot(h[here], k), lang[here] >> 3), (1 << (lang[here] & 7)).astype(np.uint8))
        if now is not None:
            yield block()

    of = F.shiftrightunsigned("gram", 32).bitwiseAND(F.lit(blocks - 1).cast("long")).alias("block")
    dealt = counts.select("lang", "gram", of).repartition(min(blocks, partitions(labelled.sparkSession)), "block").sortWithinPartitions("block")
    table = materialize(dealt.mapInArrow(fill, "block long, masks binary, ones array<long>"), "language-filter")
    ones = table.select(*[F.sum(F.pow(F.col("ones")[i] / F.lit(float(BLOCK)), F.lit(HASHES))).alias(f"f{i}") for i in range(len(langs))]).first()
    drop_table(counts)
    return Filter(langs, blocks, max(1, -(-blocks * BLOCK * bytes_ // PART_BYTES)), np.array(ones, float) / blocks, table)


def _decided(model: Filter, n: np.ndarray, has: np.ndarray, hits: np.ndarray) -> tuple[list[str], list[float]]:
    f, every = model.false[:, None], hits[-1]
    telling = n > every  # grams of all languages tell nothing, unless there are no others
    n, hits = np.where(telling, n - every, n), np.where(telling, hits[:-1] - every, hits[:-1])
    corrected = np.maximum(0, (hits - f * n) / np.maximum(1 - f, 1e-9))
    best, top = corrected.argmax(0), corrected.max(0)
    score = top / np.maximum(corrected.sum(0), 1e-9)
    return [model.langs[k] if ok else "und" for k, ok in zip(best, has, strict=True)], [float(s) if ok else 0.0 for s, ok in zip(score, has, strict=True)]


def predicted(docs: DataFrame, model: Filter | None) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    names = [x.split()[0] for x in schema.split(", ")]
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    light = Filter(model.langs, model.blocks, model.parts, model.false, None)
    if model.parts == 1:
        shared = docs.sparkSession.sparkContext.broadcast(model.part(0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in A.slices(batches, "text", 1 << 20):
                h, offsets, has = grams([t or "" for t in b.column("text").to_pylist()])
                lang, score = _decided(light, np.diff(offsets), has, _hits(h, offsets, len(light.langs), light.blocks, shared.value))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=names)

        return rows.mapInArrow(run, schema)
    keyed = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "language-rows")
    counts = functools.reduce(DataFrame.unionByName, [keyed.select("row", "text").mapInArrow(_part_hits(light, docs.sparkSession.sparkContext.broadcast(model.part(k))), "row long, n long, has boolean, hits array<double>") for k in range(model.parts)])
    added = counts.groupBy("row").agg(F.first("n").alias("n"), F.first("has").alias("has"), F.array(*[F.sum(F.col("hits")[i]) for i in range(len(model.langs) + 1)]).alias("hits"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = np.array(b.column("hits").to_pylist(), float).reshape(b.num_rows, -1).T
            lang, score = _decided(light, b.column("n").to_numpy(), b.column("has").to_numpy(zero_copy_only=False), hits)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=names)

    return keyed.drop("text").join(added, "row").drop("row").mapInArrow(decide, schema)


def _part_hits(model: Filter, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.slices(batches, "text", 1 << 20):
            h, offsets, has = grams([t or "" for t in b.column("text").to_pylist()])
            hits = _hits(h, offsets, len(model.langs), model.blocks, shared.value).T.astype(float)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.diff(offsets)), pa.array(has), pa.array(hits.tolist(), pa.list_(pa.float64()))], names=["row", "n", "has", "hits"])

    return run


def held_out() -> Column:
    """The documents that are not learnt from; one without doc_id is."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def query(docs: DataFrame) -> DataFrame:
    return predicted(docs, learn(docs.filter(~held_out())))

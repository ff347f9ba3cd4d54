"""Subword lattice likelihood: existing scores of a vocabulary weigh all segmentations.

The pieces and their scores are those of a public tokenizer's vocabulary file, whose scores are ranks of merges
(0, -1, -2, ...). A piece of score s has the probability (1 - s) ** -T / Z: ranks on a log scale, with a
temperature T that is fitted to the training texts by expectation maximisation over all segmentations of all
their words, on the cluster. Pieces with a capital A-Z can't occur and are left out. A byte that is no piece
is one of the least score (the byte fallback of the vocabulary), so every text has a probability.

A rank says little of how often a piece is used, so these are the first guess alone. Words met in training, the ``HOT`` most
frequent, are pieces, too, with their counts less a discount d = n1 / (n1 + 2 n2), n1 and n2 the words met once and
twice. What is discounted is spelled: each such word counts d times, all others as often as they are met, and ``SPELL`` more
rounds of expectation maximisation over the segmentations of all of them give every piece its own mass, of which a
share ``FLOOR`` stays with the ranks. Words that training doesn't know are thus spelled as rare ones are.

A text is a sequence of words, each begun by the vocabulary's mark, and one end token. Its probability is the
sum over all segmentations of the product of the pieces' probabilities, in log space by a forward recursion
over byte positions. No piece crosses words, so a text's log probability is the sum of its words', and each
distinct word is worked out once. ``score`` is that log probability, base 10.

``mixture_score`` is of a second model for which a word met in training is an arc of its own beside its pieces, with
its discounted frequency; the discounted mass goes to the lattice, so that all words sum to one:
(c - d) / N + d V / N x lattice(word), with the same d.
Words over ``LONG`` bytes are learnt from and scored one by one.

Counts of words come from all texts. The ``HOT`` most frequent words are broadcast and scored where the
texts are read; all others meet their scores in a join.

Defined results: a null or empty text has the end token alone; repeated rows are scored again each, and
count again in training; without training rows all words are unknown and T is 1; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .common import drop_table, materialize

ROUNDS, SPELL, HOT, LONG, FLOOR, PART = 2, 2, 1 << 17, 64, 0.01, 1 << 12
#: Stands for the vocabulary's mark of a word's beginning; the byte is in no UTF-8 text.
MARK, START = "\u2581", b"\xff"
LOG10 = math.log(10)
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)


def scored_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """The usable pieces of a vocabulary file as bytes, and ln(1 - score) of each."""
    from sentencepiece import SentencePieceProcessor

    vocab = SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for k in range(vocab.get_piece_size()):
        piece, score = vocab.id_to_piece(k), vocab.get_score(k)
        plain = not (vocab.is_byte(k) or vocab.is_control(k) or vocab.is_unknown(k) or vocab.is_unused(k))
        if plain and score > -1e8 and MARK not in piece[1:] and not re.search("[A-Z]", piece):
            found[piece.encode().replace(MARK.encode(), START)] = score
    least = min(found.values()) - 1
    for k in range(256):
        found.setdefault(bytes([k]), least)
    ordered = sorted(found)
    return ordered, np.log(1 - np.array([found[p] for p in ordered]))


def log_pieces(rank: np.ndarray, temperature: float, end: float) -> np.ndarray:
    """Log probability of each piece, with the mass ``end`` kept for the end token."""
    x = -temperature * rank
    top = x.max()
    return x - (top + math.log(np.exp(x - top).sum())) + math.log1p(-end)


def fitted(rank: np.ndarray, mass: np.ndarray) -> float:
    """The temperature at which the pieces' mean rank is that of the masses: the most likely one."""
    want, low, high = float(mass @ rank / mass.sum()), 0.0, 16.0
    for _ in range(60):
        middle = (low + high) / 2
        p = np.exp(log_pieces(rank, middle, 0.0))
        low, high = (middle, high) if p @ rank > want else (low, middle)
    return (low + high) / 2


POWERS = np.cumprod(np.concatenate(([U(1)], np.full(LONG, BASE))), dtype=np.uint64)


class Lattice:
    """Pieces by hash, and forward and backward recursions over words of one length at a time."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.longest = max(map(len, pieces))
        self.log_p = log_p
        keys = self._key(self._hashes(pieces))
        self.size = len(pieces)
        self.marks = np.zeros(1 << 22, bool)
        self.marks[keys >> U(42)] = True
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    @staticmethod
    def _key(h: np.ndarray) -> np.ndarray:
        key = h * U(0xD6E8FEB86659FD93)
        return key ^ (key >> U(32))

    @staticmethod
    def _hashes(pieces: list[bytes]) -> np.ndarray:
        """The hash of each piece, all of one length at a time."""
        length, out = np.fromiter(map(len, pieces), np.int64, len(pieces)), np.zeros(len(pieces), np.uint64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            block = np.frombuffer(b"".join(pieces[i] for i in at), np.uint8).reshape(len(at), n)
            for k in range(n):
                out[at] = out[at] * BASE + block[:, k] + U(1)
        return out

    def find(self, key: np.ndarray) -> np.ndarray:
        """The piece of each key or -1; most keys aren't pieces and end at the marks."""
        out = np.full(len(key), -1, np.int32)
        maybe = np.flatnonzero(self.marks[key >> U(42)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, key[maybe]), self.size - 1)
            hit = self.keys[at] == key[maybe]
            out[maybe[hit]] = self.order[at[hit]]
        return out

    def edges(self, words: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(from, to, piece of each word or -1) over an array of words of the same length."""
        n, length = words.shape
        h = np.zeros((length + 1, n), np.uint64)
        for i in range(length):
            h[i + 1] = h[i] * BASE + words[:, i] + U(1)
        out = []
        for j in range(1, length + 1):
            for i in range(max(0, j - self.longest), j):
                ids = self.find(self._key(h[j] - h[i] * POWERS[j - i]))
                if (ids >= 0).any():
                    out.append((i, j, ids))
        return out

    def weights(self, edges: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        p = np.append(self.log_p, -np.inf)
        return [(i, j, ids, p[ids]) for i, j, ids in edges]

    @staticmethod
    def _sum(parts: list[np.ndarray], n: int) -> np.ndarray:
        if not parts:
            return np.full(n, -np.inf)
        if len(parts) == 1:
            return parts[0]
        x = np.stack(parts)
        top = x.max(0)
        safe = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            return safe + np.log(np.exp(x - safe).sum(0))

    def forward(self, weights: list, n: int, length: int) -> list[np.ndarray]:
        alpha = [np.zeros(n)]
        for j in range(1, length + 1):
            alpha.append(self._sum([alpha[i] + w for i, to, _, w in weights if to == j], n))
        return alpha

    def expected(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected occurrences of each piece."""
        n, length = words.shape
        out = np.zeros(self.size)
        weights = self.weights(self.edges(words))
        alpha = self.forward(weights, n, length)
        beta = [np.zeros(n)] * (length + 1)
        for i in range(length - 1, -1, -1):
            beta[i] = self._sum([w + beta[j] for at, j, _, w in weights if at == i], n)
        for i, j, ids, w in weights:
            hit = np.flatnonzero(ids >= 0)
            share = np.exp(alpha[i][hit] + w[hit] + beta[j][hit] - alpha[length][hit])
            out += np.bincount(ids[hit], share * counts[hit], self.size)
        return out

    def long_word(self, word: bytes) -> float:
        """The log probability of one long word, with the last ``longest`` positions in memory."""
        data = np.frombuffer(word, np.uint8)
        alpha, h = np.full(self.longest, -np.inf), np.zeros(self.longest, np.uint64)
        alpha[-1] = 0.0  # alpha[-k] is of the position k before the next one
        spans = np.ones(self.longest, np.uint64)
        for k in range(self.longest):
            spans[k] = POWERS[self.longest - k]
        p = np.append(self.log_p, -np.inf)
        top = U(0)
        for at, b in enumerate(data):
            top = U((int(top) * int(BASE) + int(b) + 1) & 0xFFFFFFFFFFFFFFFF)
            ids = self.find(self._key(top - h * spans))
            x = alpha + p[ids]
            best = x.max()
            alpha[:-1], h[:-1] = alpha[1:], h[1:]
            alpha[-1], h[-1] = best + math.log(np.exp(x - best).sum()), top
        return float(alpha[-1])


    def expected_long(self, word: bytes) -> np.ndarray:
        """``expected`` of one long word met once: forward, then backward, in blocks of ``PART`` positions."""
        n, step, out = len(word), self.longest, np.zeros(self.size)
        # padded in front, so that every position has as many before it; those have no mass
        h = np.zeros(step + n + 1, np.uint64)
        top = 0
        for i, b in enumerate(word):
            top = (top * int(BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
            h[step + i + 1] = top
        place = np.arange(-step, 0)
        p = np.append(self.log_p, -np.inf)
        alpha = np.full(step + n + 1, -np.inf)
        alpha[step] = 0.0
        beta = np.full(step + n + 1, -np.inf)
        beta[step + n] = 0.0

        def pieces(low: int, high: int) -> np.ndarray:
            """The pieces that end at the positions low < j <= high, by their start (j - step first) or -1."""
            j = np.arange(low + 1, high + 1)
            key = self._key(h[step + j][:, None] - h[step + j[:, None] + place] * POWERS[-place])
            ids = self.find(key.reshape(-1)).reshape(len(j), step)
            ids[j[:, None] + place < 0] = -1
            return ids

        parts = [(low, min(low + PART, n)) for low in range(0, n, PART)]
        for low, high in parts:
            w = p[pieces(low, high)]
            for j in range(low + 1, high + 1):
                x = alpha[j : j + step] + w[j - low - 1]
                best = x.max()
                alpha[step + j] = best + math.log(np.exp(x - best).sum())
        total = alpha[-1]
        for low, high in reversed(parts):
            ids = pieces(low, high)
            w = p[ids]
            for j in range(high, low, -1):
                x = w[j - low - 1] + beta[step + j]
                beta[j : j + step] = np.logaddexp(beta[j : j + step], x)
                share = np.exp(alpha[j : j + step] + x - total)
                hit = ids[j - low - 1] >= 0
                out[ids[j - low - 1][hit]] += share[hit]
        return out


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and bytes of the words of each length up to LONG, in parts that stay in the cache."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(length):
        if 0 < n <= LONG:
            at = np.flatnonzero(length == n)
            for k in range(0, len(at), 4096):
                part = at[k : k + 4096]
                yield part, np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), n).astype(np.uint64)


def _joined(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches of about ``rows`` rows, so that there are many words of each length."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def log_words(model: Lattice, words: list[bytes]) -> np.ndarray:
    """The log probability of each word, its mark included."""
    out, words = np.zeros(len(words)), [START + w for w in words]
    for at, block in _by_length(words):
        weights = model.weights(model.edges(block))
        out[at] = model.forward(weights, *block.shape)[-1]
    for i, w in enumerate(words):
        if len(w) > LONG:
            out[i] = model.long_word(w)
    return out


def expected_words(model: Lattice, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Expected occurrences of each piece in words of any length, met ``counts`` times each."""
    out, words = np.zeros(model.size), [START + w for w in words]
    for at, block in _by_length(words):
        out += model.expected(block, counts[at])
    for w, n in zip(words, counts, strict=True):
        if len(w) > LONG:
            out += n * model.expected_long(w)
    return out


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    learnt, others = Counter(), Counter()

    def rows():
        words = [*learnt, *(w for w in others if w not in learnt)]
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([learnt.get(w, 0) for w in words], pa.int64()), pa.array([learnt.get(w, 0) + others.get(w, 0) for w in words], pa.int64())], names=["word", "c", "n"])
        learnt.clear()
        others.clear()
        return out

    for b in A.slices(batches, "text", 4 << 20):
        for text, held in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("held_out").to_pylist(), strict=True):
            (others if held else learnt).update(tokens(text))
        if len(learnt) + len(others) > 500_000:
            yield rows()
    yield rows()


class Model:
    """Training totals, the temperature of the pieces, and the table of all words with their scores of both models."""

    def __init__(self, docs: DataFrame, path: str, rounds: int = ROUNDS):
        spark = docs.sparkSession
        self.pieces, self.rank = scored_pieces(path)
        rows = docs.select("held_out", "text")
        counted = materialize(rows.mapInArrow(_counts, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "lm-words")
        texts = docs.filter(~F.col("held_out")).count()
        words, distinct, once, twice = counted.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
        self.total, self.distinct = (words or 0) + texts, (distinct or 0) + (texts > 0)
        self.base = lambda c: math.log10((c + 1) / (self.total + self.distinct + 1))
        self.temperatures, end = [1.0], 0.5
        for _ in range(rounds if words else 0):
            mass = self._expected(counted, log_pieces(self.rank, self.temperatures[-1], end))
            self.temperatures.append(fitted(self.rank, mass))
            end = texts / (texts + mass.sum())
        log_p = log_pieces(self.rank, self.temperatures[-1], end)
        discount = once / (once + 2 * twice) if once else 0.5
        pieces = self.pieces
        if words:
            pieces, log_p, end = self._spelled(counted, log_p - math.log1p(-end), discount, texts)
        self.log_end = math.log10(end)
        if self.total:
            self.log_end_mixed, rest = math.log10(max(texts, FLOOR) / self.total), max(discount * (distinct or 0), FLOOR) / self.total
            self.arc = (self.total, discount, rest)
        else:
            self.log_end_mixed, self.arc = math.log10(0.5), (1, 0.0, 0.5)
        self.shared = spark.sparkContext.broadcast((pieces, log_p))
        scored = counted.mapInArrow(self._scorer(), "word binary, c long, n long, log_p double, log_m double")
        self.words = materialize(scored, "lm-scores")
        drop_table(counted)
        self.end_known, self.end_base = texts > 0, self.base(texts)

    def _spelled(self, counted: DataFrame, log_p: np.ndarray, discount: float, texts: int) -> tuple[list[bytes], np.ndarray, float]:
        """All pieces, whole words among them, their log probabilities, and that of the end token."""
        longest = max(map(len, self.pieces)) - 1
        # whole words go down to a count that at most HOT words reach, the same for words of one count
        able = (F.length("word") <= longest) & (F.col("c") > discount)
        sizes = counted.filter(able).groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(HOT).collect()
        least, n = math.inf, 0
        for row in sizes:
            n += row.n
            if n > HOT:
                break
            least = row.c
        whole = able & (F.col("c") >= F.lit(float(least)))
        weighed = counted.select("word", F.when(whole, F.lit(float(discount))).otherwise(F.col("c").cast("double")).alias("c"))
        guess, first = log_p, np.exp(log_p)
        for _ in range(SPELL):
            mass = self._expected(weighed, guess)
            mass = (1 - FLOOR) * mass + FLOOR * mass.sum() * first
            guess = np.log(mass / mass.sum())
        found = dict(zip(self.pieces, mass, strict=True))
        for row in counted.filter(whole).select("word", "c").toLocalIterator():
            word = START + bytes(row.word)
            found[word] = found.get(word, 0.0) + row.c - discount
        pieces = sorted(found)
        mass = np.array([found[x] for x in pieces])
        total = mass.sum() + texts
        return pieces, np.log(mass / total), texts / total

    def _expected(self, counted: DataFrame, log_p: np.ndarray) -> np.ndarray:
        shared = counted.sparkSession.sparkContext.broadcast((self.pieces, log_p))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Lattice(*shared.value)
            total = np.zeros(model.size)
            for b in _joined(batches):
                total += expected_words(model, b.column("word").to_pylist(), b.column("c").to_numpy())
            ids = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["piece", "mass"])

        rows = counted.filter("c > 0").select("word", "c").mapInArrow(run, "piece long, mass double").groupBy("piece").agg(F.sum("mass").alias("mass")).toPandas()
        out = np.zeros(len(self.pieces))
        out[rows.piece.to_numpy(np.int64)] = rows.mass.to_numpy(float)
        return out

    def _scorer(self):
        shared, (total, discount, rest) = self.shared, self.arc

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Lattice(*shared.value)
            for b in _joined(batches):
                whole = np.maximum(b.column("c").to_numpy() - discount, 0) / total
                lattice = log_words(model, b.column("word").to_pylist())
                with np.errstate(divide="ignore"):
                    mixed = np.logaddexp(np.log(whole), math.log(rest) + lattice) / LOG10
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lattice / LOG10), pa.array(mixed)], names=["word", "c", "n", "log_p", "log_m"])

        return run

    def score(self, docs: DataFrame, hot: int = HOT) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixture_score of each row of ``docs``."""
        top = self.words.orderBy(F.desc("n"), "word").limit(hot).toPandas()
        known = {w: i for i, w in enumerate(top.word.map(bytes))}
        counts, log_p, log_m = top.c.to_numpy(np.int64), top.log_p.to_numpy(float), top.log_m.to_numpy(float)
        base = np.log10((counts + 1) / (self.total + self.distinct + 1)) if len(counts) else np.zeros(0)
        shared = docs.sparkSession.sparkContext.broadcast((known, counts > 0, base, log_p, log_m))
        end = (self.end_known, self.end_base, self.log_end, self.log_end_mixed)
        schema = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base_score double, score double, mixture_score double"
        first = docs.select(F.col("doc_id").cast("long"), "held_out", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(_first_scores(shared, end), schema + ", rest array<binary>")
        parts = first.select("*", F.posexplode_outer("rest").alias("at", "word")).drop("rest")
        one = F.coalesce("at", F.lit(0)) == 0
        # a row without other words has no word to join by; such rows are spread by their number
        key = F.coalesce("word", F.concat(F.lit(b" "), F.col("row").cast("string").cast("binary")))
        joined = parts.withColumn("key", key).join(self.words.select(F.col("word").alias("key"), "c", "log_p", "log_m"), "key", "left")
        rare_base = F.log10((F.col("c") + 1) / F.lit(float(self.total + self.distinct + 1)))
        once = lambda c: F.when(one, F.col(c)).otherwise(0)
        return joined.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("held_out").alias("held_out"),
            F.sum(once("n_tokens")).alias("n_tokens"),
            F.sum(once("n_known") + F.when(F.col("c") > 0, 1).otherwise(0)).alias("n_known"),
            F.lit(self.total).cast("long").alias("train_tokens"),
            F.sum(once("base_score") + F.coalesce(rare_base, F.lit(0.0))).alias("base_score"),
            F.sum(once("score") + F.coalesce("log_p", F.lit(0.0))).alias("score"),
            F.sum(once("mixture_score") + F.coalesce("log_m", F.lit(0.0))).alias("mixture_score"),
        ).drop("row")


def _first_scores(shared, end: tuple[bool, float, float, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, base, log_p, log_m = shared.value
        get = known.get
        for b in A.slices(batches, "text", 2 << 20):
            split = [tokens(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            n = np.fromiter(map(len, split), np.int64, len(split))
            offsets = np.concatenate(([0], np.cumsum(n)))
            words = [w for row in split for w in row]
            ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            hot = ids >= 0
            pick = lambda x: A.sums(np.where(hot, x[ids], 0) if len(x) else np.zeros(len(ids), x.dtype), offsets)  # noqa: B023, E731
            cold = np.flatnonzero(~hot)
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(cold, offsets).astype(np.int32)), pa.array([words[i] for i in cold], pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), b.column("row"), pa.array(n + 1), pa.array(pick(seen.astype(np.int64)) + end[0]), pa.array(pick(base) + end[1]), pa.array(pick(log_p) + end[2]), pa.array(pick(log_m) + end[3]), rest],
                names=["doc_id", "held_out", "row", "n_tokens", "n_known", "base_score", "score", "mixture_score", "rest"],
            )

    return run


def query(docs: DataFrame, path: str) -> DataFrame:
    held = (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2).alias("held_out")
    rows = docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    return Model(rows, path).score(rows)

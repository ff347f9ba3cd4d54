"""Rule bitmask ledger: every rule once per document, then policies and ablations on the bits.

``ledger`` measures each whole text and sets one bit per failed rule; texts are not read again.
A policy is a named, versioned set of rules: it keeps a document when none of its bits is set.
``ablate`` counts, from the bits alone, what each policy loses by each rule.

Defined results: a null or empty text has no words, fails ``few_words`` and so is rejected; repeated
rows give repeated ledger rows; further columns of the input are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .common import packed_rows, unpacked_rows

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True

#: Rule name and the SQL condition under which it fails, by bit. Bits are never renumbered.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words and n_words > 0"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("short_mean_word", "word_chars < 2 * n_words"),
    ("long_mean_word", "word_chars > 15 * n_words"),
    ("capitals", "2 * n_upper > n_letters and n_letters > 0"),
]
BASE = ["few_words", "repeated_words"]
POLICIES = {
    "base-1": BASE,
    "web-1": [*BASE, "symbols", "duplicate_lines", "capitals"],
    "web-2": [name for name, _ in RULES],
}
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long"


def mask(names: list[str]) -> int:
    return sum(1 << i for i, (name, _) in enumerate(RULES) if name in names)


def _seen(key: np.ndarray) -> np.ndarray:
    """The values that occur more than once."""
    s = np.sort(key)
    return np.unique(s[1:][s[1:] == s[:-1]])


def measure(col: pa.Array) -> list[np.ndarray]:
    w = A.Words(col)
    rows = len(w.offsets) - 1
    salt = A.mix(np.arange(1, rows + 1, dtype=np.uint64))
    char = (w.data & 0xC0) != 0x80
    first, gram = w.grams(3)
    key = gram ^ salt[w.row[first]]
    again = first[np.isin(key, _seen(key))]
    covered = np.zeros(len(w.starts) + 2, bool)
    for i in range(3):
        covered[again + i] = True
    covered = covered[: len(w.starts)]
    from_, to = A.runs(w.data != 10, w.offsets)
    worded = np.searchsorted(w.starts, to) > np.searchsorted(w.starts, from_)
    from_, to = from_[worded], to[worded]
    row = np.searchsorted(w.offsets, from_, "right") - 1
    distinct = np.unique(np.stack([row.astype(np.uint64), A.hashes(w.data, from_, to)]), axis=1)[0] if len(row) else row
    lines = np.bincount(row, minlength=rows)
    return [
        np.diff(w.at),
        A.sums(char & w.inside, w.offsets),
        A.sums(IS_SYMBOL[w.data], w.offsets),
        lines - np.bincount(distinct.astype(np.int64), minlength=rows),
        A.sums(covered, w.at),
        lines,
        A.sums(UPPER[w.data], w.offsets),
        A.sums(LETTER[w.data], w.offsets),
    ]


NAMES = [x.split()[0] for x in MEASURES.split(", ")]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in A.slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in measure(b.column("text")))], names=[b.schema.names[0], *NAMES])


def _with_bits(rows: DataFrame) -> DataFrame:
    bits = [F.when(F.expr(sql), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, sql) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return rows.withColumn("failed", failed.cast("long"))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``: bit i is set when rule i fails."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return _with_bits(rows.mapInArrow(_measured, f"doc_id long, {MEASURES}"))


def filtered(docs: DataFrame, policy: str = "web-2") -> DataFrame:
    """The rows and columns of ``docs`` that a policy keeps."""
    rows = packed_rows(docs, "text")
    schema = T.StructType([rows.schema["row"], *[T.StructField(n, T.LongType()) for n in NAMES]])
    return unpacked_rows(judged(_with_bits(rows.mapInArrow(_measured, schema)), policy).filter("kept"))


def judged(rows: DataFrame, policy: str) -> DataFrame:
    """Add ``policy`` and ``kept`` by the bits of a ledger."""
    return rows.withColumn("policy", F.lit(policy)).withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0)


def ablate(rows: DataFrame, policy: str) -> DataFrame:
    """By rule of a policy: documents it rejects, rejects alone, and that would stay without it.

    The ledger is first counted by distinct bit set (at most 2^rules rows), so that only counts of bit
    sets meet the rules.
    """
    used = F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long"))
    sets = rows.groupBy(used.alias("bits")).agg(F.count("*").alias("n"))
    per_rule = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if name in POLICIES[policy]]))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return sets.withColumn("r", per_rule).groupBy("r.rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("rejected_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def query(docs: DataFrame, policy: str = "web-2") -> DataFrame:
    rows = judged(ledger(docs), policy)
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE)).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed", "policy")

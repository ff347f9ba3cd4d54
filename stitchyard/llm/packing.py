"""Power-of-two decomposition: each document's ids are cut into pieces of binary length.

Whole pieces of the full length come first, then one piece for each set bit of the rest, largest first.
Equal lengths are bucketed together: a sequence is one piece, so that none crosses documents and none
has padding. Sequence ids run bucket by bucket, longest first, without gaps.

Defined results: a null or empty text has the end id alone; repeated rows are packed again each; rows
with a null doc_id are packed too; an empty table gives no rows; further columns are ignored. A very long text is
tokenized as a whole, in memory in proportion to it.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .common import materialize, numbered

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


MARK = "\x01"
#: Bytes of text that are tokenized together.
GROUP = 8 << 20
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


class Chunks:
    """The chunks of a text column between white space, in lower case, with their hashes.

    A comma or stop after an ASCII letter and before white space is a chunk of its own: it is a token of its
    own with or without a space before it.
    """

    def __init__(self, col: pa.Array):
        data, offsets = A.flat(col)
        self.data, n = A.LOWER[data], len(data)
        inside = ~A.SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        apart = np.zeros(n + 1, bool)
        if n:
            space_next = edge[1:].copy()
            space_next[:-1] |= ~inside[1:]
            apart[1:n] = ((self.data[1:] == 44) | (self.data[1:] == 46)) & _LETTER[self.data[:-1]] & ~edge[1:n] & space_next[1:]
        starts, ends = A.runs(inside, offsets)
        at = np.flatnonzero(apart)
        self.starts, self.ends = np.sort(np.concatenate((starts, at))), np.sort(np.concatenate((ends, at)))
        self.at = np.searchsorted(self.starts, offsets)
        self.hash = A.hashes(self.data, self.starts, self.ends)


class Ids:
    """Token ids of texts as little-endian unsigned 32-bit numbers.

    Tokens never cross ASCII white space, and the vocabulary is of lower case, so each distinct chunk of a
    group of texts is encoded once. One that is a normalised word of letters goes to the tokenizer's
    model; the others are encoded in one call, with a mark between them that makes a token of its own.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.end = Tokenizer.from_file(path), end_id
        (self.mark,) = self._encode(MARK).tolist()
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        two = {b: level.pre_tokenize_str(chr(b))[0][0] for b in range(32, 2048)}
        # the model's letter of each byte, from characters of one and two bytes
        self.letters = {byte: letter for c, out in two.items() for byte, letter in zip(chr(c).encode(), out, strict=True)}
        self.bytes = bytes(b for b in self.letters if chr(b).isalpha() or b > 127)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def distinct(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks one after the other, and the number of each."""
        tokenize, letters, normalized = self.tokenizer.model.tokenize, self.letters, unicodedata.is_normalized
        flat = array("I")  # the ids in the order in which they are found
        size, start = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        others = []

        def found(i: int, ids) -> None:
            start[i] = len(flat)
            flat.extend(ids)
            size[i] = len(flat) - start[i]

        for i, c in enumerate(chunks):
            if c.isalpha():  # ASCII
                found(i, [x.id for x in tokenize(c.decode("ascii"))])
            elif not c.translate(None, self.bytes) and (t := c.decode("utf-8", "replace")).isalpha() and t.lower() == t and normalized("NFC", t):
                found(i, [x.id for x in tokenize(c.decode("latin-1").translate(letters))])
            else:
                others.append((i, c.decode("utf-8", "replace")))
        marked = [(i, t) for i, t in others if MARK not in t]
        ids = self._encode(f" {MARK} ".join(t for _, t in marked))
        at = np.flatnonzero(ids == self.mark)
        if len(at) + 1 == len(marked):
            for (i, _), part in zip(marked, np.split(ids, at), strict=True):
                found(i, part[part != self.mark].tolist())
        else:
            marked = []
        done = {i for i, _ in marked}
        for i, t in others:
            if i not in done:
                found(i, self._encode(t).tolist())
        place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(flat))
        return np.frombuffer(flat, np.uint32)[place].astype("<u4"), size

    def __call__(self, cols: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows of text columns, each row's end id included, and the offsets by row."""
        parts = [Chunks(c) for c in cols]
        per_row = np.concatenate([np.diff(x.at) for x in parts])
        _, first, inverse = np.unique(np.concatenate([x.hash for x in parts]), return_index=True, return_inverse=True)
        bounds = np.cumsum([0, *(len(x.starts) for x in parts)])
        chunks = []
        part = np.searchsorted(bounds, first, "right") - 1
        raws = [x.data.tobytes() for x in parts]
        for k, i in zip(part.tolist(), (first - bounds[part]).tolist(), strict=True):
            chunks.append(raws[k][parts[k].starts[i] : parts[k].ends[i]])
        ids, length = self.distinct(chunks)
        start = np.cumsum(length) - length
        n = length[inverse]
        row_at = np.concatenate(([0], np.cumsum(per_row)))
        size = A.sums(n, row_at)
        offsets = np.concatenate(([0], np.cumsum(size + 1)))
        out = np.full(offsets[-1], self.end, "<u4")
        place = np.repeat(start[inverse] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        keep = np.ones(len(out), bool)
        keep[offsets[1:] - 1] = False
        out[keep] = ids[place]
        return out, offsets


_IDS: dict[tuple[str, int], Ids] = {}


def ids_of(path: str, end_id: int) -> Ids:
    """The tokenizer of this process."""
    if (path, end_id) not in _IDS:
        _IDS[path, end_id] = Ids(path, end_id)
    return _IDS[path, end_id]


def cuts(n: int, full: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    out = [(i * full, full) for i in range(n // full)]
    at, rest = n // full * full, n % full
    for bit in reversed(range(full.bit_length())):
        if rest >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pieces(docs: DataFrame, path: str, end_id: int = 2, full: int = 4096) -> DataFrame:
    """One row per piece with ``ids`` (little-endian unsigned 32-bit), not yet numbered."""
    return docs.select("doc_id", "text").mapInArrow(_cutter(path, end_id, full, True), SCHEMA + ", ids binary")


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for b in A.slices(batches, "text"):
        held.append(b)
        size += b.column("text").nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _cutter(path: str, end_id: int, full: int, with_ids: bool, group_bytes: int = GROUP):
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path, end_id)
        for group in _groups(batches, group_bytes):
            coded, offsets = ids([b.column("text") for b in group])
            whole, rows, raw = memoryview(coded.tobytes()), [], []
            doc_ids = [i for b in group for i in b.column("doc_id").to_pylist()]
            for doc_id, at, n in zip(doc_ids, offsets[:-1].tolist(), np.diff(offsets).tolist(), strict=True):
                for start, length in cuts(n, full):
                    piece = whole[4 * (at + start) : 4 * (at + start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(piece), n))
                    if with_ids:
                        raw.append(bytes(piece))
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(raw, pa.binary())] if with_ids else [])], names=[*names, *(["ids"] if with_ids else [])])
            del coded, whole, rows, raw, columns
        A.give_back()

    return cut


def bucketed(rows: DataFrame) -> DataFrame:
    """Number the sequences bucket by bucket; each piece is a sequence, at offset 0."""
    order = rows.withColumn("_bucket", -F.col("length"))
    return numbered(order, ["_bucket", "doc_id", "start"], "sequence_id", None, "packing").drop("_bucket").withColumn("offset", F.lit(0).cast("long"))


def query(docs: DataFrame, path: str, group_bytes: int = GROUP) -> DataFrame:
    """``group_bytes`` bounds the memory of a task, and changes no result: about 25 bytes for each byte of a group."""
    return bucketed(materialize(docs.select("doc_id", "text").mapInArrow(_cutter(path, 2, 4096, False, group_bytes), SCHEMA), "packing-pieces"))

"""Repeated-substring removal by prefix doubling.

A position's name at length 2m comes from the pair of names at length m, m bytes apart: names double
from single bytes to ``SPAN`` and to ``LENGTH`` bytes inside each text. Spark then sorts names with
positions twice, and positions whose name is unique leave after the first sort:

1. At offset 0, positions are sorted by the rank (a 64-bit name) of their first ``SPAN`` bytes. Only the smallest
   rank of each window of ``LENGTH`` bytes is sorted (its anchor). Equal windows have the same anchor at the
   same place, so a window whose anchor's rank is unique can't repeat: it leaves.
2. At offset ``SPAN``, the windows that stay are sorted by the names of their pairs of ranks, of the first and of the last
   ``SPAN`` bytes, beside those of the same anchor at the same place. All but the first of equal pairs, in
   order of (doc_id, start), are repeats, and the bytes they cover go. ``LENGTH`` is reached, so the doubling ends.

Sorting every position at every doubling would write eight times 16 bytes per byte of text, so ranks of
up to ``SPAN`` bytes double inside the texts. A pair of ranks has a name of 64 bits, too, and goes as
that; windows are equal if it is, beside the 64-bit rank of their anchor and its place.

What a task can tell by itself isn't gathered: of the positions of one rank in a slice of text, one meets those of
other slices and the others are known to repeat; of equal windows of a slice, the first meets the others'
first. A passage that a third of all texts hold thus costs one row a slice in the task that its rank goes to.

Copies of a whole text need no sort: all but the first go whole if they have ``LENGTH`` bytes.

Defined results: a null text is empty and loses nothing. Rows that repeat a doc_id, or have none (which comes
first), are documents of their own in the order of (doc_id, hash of the text). An empty table gives no
rows. Further columns are ignored by the query and kept by ``cleaned``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .common import BROADCAST_IDS, materialize, partitions, row_ids, semi

LENGTH, SPAN = 100, 50
U = np.uint64
NAME_BYTES = 8


def doubled(data: np.ndarray, want: tuple[int, ...]) -> list[np.ndarray]:
    """Names of all substrings of the wanted (growing) lengths; entry i is the one that starts at i."""
    name, m, out = A.BYTE_KEYS[data], 1, []
    for length in want:
        while m < length:
            step = min(m, length - m)
            n = len(name) - step
            if n <= 0:
                return [*out, *[np.zeros(0, np.uint64)] * (len(want) - len(out))]
            pair = name[:n] * U(0x9E3779B97F4A7C15)
            pair ^= pair >> U(32)
            pair += name[step:]
            pair *= U(0xD6E8FEB86659FD93)
            pair ^= pair >> U(29)
            name, m = pair, m + step
        out.append(name)
    return out


def anchors(span_names: np.ndarray, start: int = 0) -> np.ndarray:
    """For each window of LENGTH bytes, the position of its smallest SPAN-byte name, leftmost on ties."""
    key = (span_names >> U(32) << U(32)) | np.arange(start, start + len(span_names), dtype=np.uint64)
    width, want = 1, LENGTH - SPAN + 1
    while width < want:
        step = min(width, want - width)
        key = np.minimum(key[:-step], key[step:])
        width += step
    return (key & U(0xFFFFFFFF)).astype(np.int64)


def _each(batches: Iterator[pa.RecordBatch], want: tuple[int, ...]) -> Iterator[tuple]:
    """Slices with their bytes, offsets, names at the wanted lengths and the anchor of each window (-1 across rows)."""
    for b in A.slices(batches, "text"):
        data, offsets = A.flat(b.column("text"))
        if len(data) < LENGTH:
            continue
        names = doubled(data, want)
        at = anchors(names[0])
        inside = np.zeros(len(at), bool)
        for s, e in zip(offsets[:-1], offsets[1:], strict=True):
            inside[s : max(s, e - LENGTH + 1)] = True
        yield b, data, offsets, names, np.where(inside, at, -1)


def _order(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of 16-byte keys, and where a new one begins in it."""
    halves = key.view(np.uint64).reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0]))
    new = np.ones(len(key), bool)
    new[1:] = (halves[order][1:] != halves[order][:-1]).any(1)
    return order, new


def _firsts(key: np.ndarray) -> np.ndarray:
    order, new = _order(key)
    return order[new]


def _unique(key: np.ndarray) -> np.ndarray:
    return key[_firsts(key)]


def _among(key: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Which of the keys are in ``seen``, whose own are distinct."""
    order, new = _order(np.concatenate((seen, key)))
    group = np.cumsum(new) - 1
    has = np.zeros(len(new), bool)
    has[group[order < len(seen)]] = True
    out = np.empty(len(order), bool)
    out[order] = has[group]
    return out[len(seen) :]


def _spread(name: np.ndarray, ids: np.ndarray, alone: np.ndarray) -> pa.Array:
    """What rows are dealt by: their name, or their text where they need not meet others of that name."""
    return pa.array(np.where(alone, A.mix(name.view(np.uint64) ^ A.mix(ids.view(np.uint64))).view(np.int64), name))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the anchors; ``again`` where the slice has the name twice, dealt elsewhere but for one of them."""
    for b, _, offsets, (span,), at in _each(batches, (SPAN,)):
        p = np.unique(at[at >= 0])
        row = np.searchsorted(offsets, p, "right") - 1
        name, ids = span[p].view(np.int64), b.column("id").to_numpy()[row]
        order = np.argsort(name, kind="stable")
        same = name[order][1:] == name[order][:-1]
        again, other = np.zeros(len(p), bool), np.zeros(len(p), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        other[order[1:][same]] = True
        yield pa.RecordBatch.from_arrays([_spread(name, ids, other), pa.array(name), pa.array(ids), pa.array((p - offsets[row]).astype(np.int32)), pa.array(again)], names=["deal", "name", "id", "at", "again"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by name, (id, at) of those whose name isn't alone; the last row waits for the next batch."""
    held, held_name, sent = None, 0, True
    for b in batches:
        if not b.num_rows:
            continue
        name = b.column("name").to_numpy()
        keep = b.column("again").to_numpy(zero_copy_only=False).copy()
        same = name[1:] == name[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        if held is not None and name[0] == held_name:
            keep[0] = True
            if not sent:
                yield held.select(["id", "at"])
        yield b.filter(pa.array(keep)).select(["id", "at"])
        held, held_name, sent = b.slice(len(name) - 1), name[-1], bool(keep[-1])
    A.give_back()


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each repeated anchor of a text: its windows' first offset and the names of their rank pairs.

    Only the first of equal windows in a slice goes to the sort; the others are runs of repeats already (``z``
    is their end) and are dealt elsewhere.
    """
    for b, data, offsets, (span,), at in _each(batches, (SPAN,)):
        lists = b.column("anchors").to_numpy(zero_copy_only=False)
        own = np.concatenate([x.astype(np.int64) + o for x, o in zip(lists, offsets[:-1], strict=True)])
        marked = np.zeros(len(data) + 1, bool)
        marked[own] = True
        s = np.flatnonzero(marked[at] & (at >= 0))
        if not len(s):
            continue
        row, ids = np.searchsorted(offsets, s, "right") - 1, b.column("id").to_numpy()
        pair = np.stack([span[s], span[s + LENGTH - SPAN]], axis=1)
        key = A.mix(pair[:, 0] ^ A.mix(pair[:, 1] ^ A.mix((at[s] - s).astype(np.uint64))))
        by_id = np.lexsort((s, ids[row]))  # the first is that of the smallest id
        fresh = np.zeros(len(s), bool)
        fresh[by_id[np.unique(key[by_id], return_index=True)[1]]] = True
        p = at[s]
        head = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1) | (fresh[1:] != fresh[:-1]))))
        size = np.diff(np.append(head, len(s)))
        known = ~fresh[head]
        sent = np.where(known, 0, size)
        bounds = (np.concatenate(([0], np.cumsum(sent))) * NAME_BYTES).astype(np.int32)
        blobs = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(bounds), pa.py_buffer(A.mix(pair[fresh, 0] ^ A.mix(pair[fresh, 1])).view(np.uint8))])
        name, of, start = span[p[head]].view(np.int64), ids[row[head]], s[head] - offsets[row[head]]
        yield pa.RecordBatch.from_arrays(
            [_spread(name, of, known), pa.array(name), pa.array(of), pa.array(start.astype(np.int32)), pa.array((p[head] - s[head]).astype(np.int32)), pa.array(start + size - 1 + LENGTH, pa.int64(), mask=~known), blobs],
            names=["deal", "name", "id", "start", "offset", "z", "windows"],
        )


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of window rows sorted by (name, id, start), the runs of windows that were met before.

    Only the keys of the anchor that a batch ends with are carried to the next batch.
    """
    last, seen = None, np.zeros(0, "V16")
    for b in batches:
        known = b.column("z").is_valid()
        done = b.filter(known)
        if done.num_rows:
            yield pa.RecordBatch.from_arrays([done.column("id"), done.column("start").cast(pa.int64()), done.column("z")], names=["id", "a", "z"])
        b = b.filter(pc.invert(known))
        if not b.num_rows:
            continue
        blobs = b.column("windows")
        bounds = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
        pair = np.frombuffer(blobs.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(np.uint64)
        n = np.diff(bounds) // NAME_BYTES
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - (np.cumsum(n) - n)[row]
        name = b.column("name").to_numpy().view(np.uint64)
        offset = b.column("offset").to_numpy().astype(np.int64)[row] - step
        # names of anchors and offsets beside those of the pairs: 64 bits each
        key = np.empty(len(row), [("first", np.uint64), ("last", np.uint64)])
        key["first"], key["last"] = A.mix(name[row] + offset.astype(np.uint64) * U(0x9E3779B97F4A7C15)), pair
        key = key.view("V16").reshape(-1)
        fresh = np.zeros(len(key), bool)
        fresh[_firsts(key)] = True
        if last is not None:
            now = np.flatnonzero(name[row] == last)
            fresh[now] &= ~_among(key[now], seen)
        tail = _unique(key[name[row] == name[-1]])
        seen = _unique(np.concatenate((seen, tail))) if last is not None and name[-1] == last else tail
        last = name[-1]
        again = np.flatnonzero(~fresh)
        if not len(again):
            continue
        cut = np.concatenate(([True], (np.diff(again) > 1) | (row[again][1:] != row[again][:-1])))
        head = again[cut]
        size = np.diff(np.append(np.flatnonzero(cut), len(again)))
        start = b.column("start").to_numpy().astype(np.int64)[row[head]] + step[head]
        yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row[head])), pa.array(start), pa.array(start + size - 1 + LENGTH)], names=["id", "a", "z"])
    A.give_back()


def _disjoint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, spans) with the sorted ranges of each row joined where they meet; a text has less than 2 ** 40 bytes."""
    for b in batches:
        lists = b.column("spans")
        a, z = (c.to_numpy().astype(np.int64) for c in lists.flatten().flatten())
        row = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy())
        own = row << 40
        top = np.maximum.accumulate(z + own)
        head = np.flatnonzero(np.concatenate(([True], (a + own)[1:] > top[:-1]))) if len(a) else np.zeros(0, np.int64)
        end = np.append(head[1:], len(a))[: len(head)] - 1
        ranges = pa.StructArray.from_arrays([pa.array(a[head]), pa.array(top[end] - own[end])], names=["a", "z"])
        bounds = np.concatenate(([0], np.cumsum(np.bincount(row[head], minlength=b.num_rows)))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(bounds), ranges)], names=["id", "spans"])


def spans(texts: DataFrame) -> DataFrame:
    """(id, spans): the disjoint byte ranges to remove in each of the rows (id, text) of distinct ids and texts."""
    n = partitions(texts.sparkSession)
    named = texts.mapInArrow(_anchor_rows, "deal long, name long, id long, at int, again boolean")
    hits = named.repartition(n, "deal").drop("deal").sortWithinPartitions("name").mapInArrow(_repeated, "id long, at int")
    by_text = materialize(hits.groupBy("id").agg(F.collect_list("at").alias("anchors")), "substring-anchors")
    again = semi(texts, by_text.select("id"), "id").join(by_text, "id").select("id", "text", "anchors")
    rows = again.mapInArrow(_window_rows, "deal long, name long, id long, start int, offset int, z long, windows binary")
    later = rows.repartition(n, "deal").drop("deal").sortWithinPartitions("name", "id", "start").mapInArrow(_later, "id long, a long, z long")
    # a window's ranges overlap the next one's: joined, they are a few a text, and mostly few enough to be broadcast
    return later.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("a", "z"))).alias("spans")).mapInArrow(_disjoint, "id long, spans array<struct<a: bigint, z: bigint>>")


def marked(docs: DataFrame) -> DataFrame:
    """(row, text, spans): a struct of all columns of each row, its text and the sorted, disjoint byte ranges to remove."""
    text_hash = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    docs = row_ids(docs, "substring-rows")
    keyed = materialize(docs.select(F.col("_id").alias("id"), text_hash.alias("key"), F.octet_length("text").alias("n")), "substring-keys")
    first = materialize(keyed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1"), "substring-first")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").cast("long").alias("z")))
    copies = materialize(keyed.join(first, "key").filter("id > first").select("id", F.when(F.col("n") >= LENGTH, whole).alias("spans")), "substring-copies")
    rest = docs.select(F.col("_id").alias("id"), "text")
    rest = rest.join(F.broadcast(copies.select("id")) if copies.count() <= BROADCAST_IDS else copies.select("id"), "id", "left_anti")
    found = materialize(spans(rest).unionByName(copies.filter("spans is not null")), "substring-spans").withColumnRenamed("id", "_id")
    if (found.agg(F.sum(F.size("spans") + 2)).first()[0] or 0) <= BROADCAST_IDS:
        found = F.broadcast(found)
    # the text goes once through a shuffle, in its row
    return docs.select("row", "_id").join(found, "_id", "left").select("row", "row.text", "spans")


def merged(ranges: list[dict] | None) -> list[list[int]]:
    out: list[list[int]] = []
    for r in ranges or ():
        if out and r["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r["z"])
        else:
            out.append([r["a"], r["z"]])
    return out


def kept(raw: bytes, ranges: list[list[int]]) -> bytes:
    at, parts = 0, []
    for a, z in ranges:
        parts.append(raw[at:a])
        at = z
    return b"".join([*parts, raw[at:]])


def whole_characters(raw: bytes, ranges: list[list[int]]) -> list[list[int]]:
    """The ranges, made smaller so that no UTF-8 character is cut."""
    out = []
    for a, z in ranges:
        while a < z and raw[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(raw) and raw[z] & 0xC0 == 0x80:
            z -= 1
        if z > a:
            out.append([a, z])
    return out


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated bytes, in the same columns; ``n_chars`` follows where there is one.

    Characters of which only a part is covered stay whole.
    """
    schema = docs.schema
    at = schema.names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.slices(batches, "text", 8 << 20):
            old = b.column("text")
            texts = [t if t is None or not s else kept(t, whole_characters(t, merged(s))) for t, s in zip(old.cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True)]
            new = pa.array([t if t is None else t.decode("utf-8", "replace") for t in texts], old.type)
            columns = b.column("row").flatten()
            columns[at] = new
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    out = marked(docs).mapInArrow(cut, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in schema.names else out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 4 + [pa.string()]
    for b in A.slices(batches, "text", 8 << 20):
        rows = []
        for doc_id, text, found in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True):
            raw, ranges = text or b"", merged(found)
            rest = kept(raw, ranges)
            rows.append((doc_id, len(raw), len(raw) - len(rest), len(ranges), hashlib.sha256(rest).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def query(docs: DataFrame) -> DataFrame:
    return marked(docs.select("doc_id", "text")).select("row.doc_id", "text", "spans").mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

"""WARC archives through a chunked record table.

``chunk_table`` cuts payloads into rows (record, chunk) of bounded size, each with the running SHA-1 of its payload up
to its end, so that neither writing nor reading ever holds more of a record than one chunk. ``write`` settles from the
last chunks' rows which records are responses and which revisit an equal payload, and writes the archive: each chunk
is a WARC record, the first a ``response``, the others its ``continuation`` segments. ``read`` streams the archive back:
records in one segment are checked where they are read, segments of others are sorted by number and digested in turn.

Archives are files of Spark's text writer, so they are written and committed on any file system that Spark knows, and a
lost task is repeated. A line that is a boundary, drawn anew for each archive, follows the version line of every record;
it is an extension field of the standard, and Spark reads the files back by it, record by record, from any place.
Files are compressed whole. Records of other writers have no such line; ``read`` takes archives of ``write`` alone.

Defined results: a null html is an empty payload; rows with equal payloads have one response, that with the largest
page_id (nulls are smallest; of equal ids, any one row), and the others, repeated rows too, revisit it; payloads of any
length are read whole; control characters and spaces of a url are percent-encoded, a null url is left out; further
columns are ignored; an empty table makes an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .common import BROADCAST_IDS, drop_table, materialize, shared_dir

#: Bytes of a chunk, and of chunks that go on together.
CHUNK, BATCH = 1 << 16, 1 << 22
#: A key with more than one in so many rows is hot; there are at most so many hot keys.
HOT = 4096
CHUNKS = "record long, page_id long, url string, chunk int, chunks int, total long, data binary, so_far string"
VERSION = "WARC/1.1\r\n"
BOUNDARY = "X-Archive-Boundary: "
#: The archive's date of capture; pages have none of their own.
DATE = "2024-01-01T00:00:00Z"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def chunk_table(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows of ``CHUNKS``, at least one for each page; numbers of records are distinct, and settled once the table is written."""
    schema = pa.schema([("record", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("total", pa.int64()), ("data", pa.binary()), ("so_far", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in A.slices(batches, "html", BATCH):
            data, offsets = A.flat(b.column("html"))
            for i, (record, page, url) in enumerate(zip(*(b.column(c).to_pylist() for c in ("record", "page_id", "url")), strict=True)):
                digest, at, end = hashlib.sha1(), int(offsets[i]), int(offsets[i + 1])
                chunks = max(1, -(-(end - at) // size))
                for k in range(chunks):
                    part = data[at + k * size : min(end, at + (k + 1) * size)].tobytes()
                    digest.update(part)
                    rows.append((record, page, url, k, chunks, end - at, part, base32(digest.digest())))
                    held += len(part) + 200
                    if held >= BATCH:
                        yield _batch(rows, schema)
                        rows, held = [], 0
        yield _batch(rows, schema)

    p = pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long"), "url", "html")
    return p.mapInArrow(cut, CHUNKS)


def looked_up(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Left join with ``facts``, which has each key once. Keys of a large share of ``rows`` are few, so their facts are
    broadcast; for the others no task gets more than a small share. ``rows`` is a written table: it is read twice."""
    total = rows.count()
    hot = materialize(rows.groupBy(key).count().filter(F.col("count") * HOT > total).join(facts, key, "left").drop("count"), "warc-hot")
    much = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts, key, "left")
    return much.select(rest.columns).unionAll(rest)


def revisits(table: DataFrame) -> DataFrame:
    """(record, page_id, url, digest, response, response_url): the records that revisit another of the chunk table."""
    ends = materialize(table.filter("chunk = chunks - 1").select("record", "page_id", "url", F.col("so_far").alias("digest"), "total"), "warc-ends")
    equal = ends.groupBy("digest").agg(F.max(F.struct("page_id", "record", "url")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    equal = materialize(equal.select("digest", F.col("first.record").alias("response"), F.col("first.url").alias("response_url")), "warc-equal")
    return looked_up(ends, equal, "digest").filter("record <> response").select("record", "page_id", "url", "digest", "response", "response_url")


def _name(run: str, record: int, chunk: int = 0) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{run} {record} {chunk}'.encode()).hexdigest())}>"


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record(run: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A WARC record but for its last line feed, which the text writer adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    digest = base32(hashlib.sha1(block).digest())
    return f"{VERSION}{BOUNDARY}{run}\r\n{head}WARC-Block-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r"


def write(pages: DataFrame, path: str, size: int = CHUNK) -> None:
    """Write ``pages`` (page_id, url, html) as an archive below ``path``."""
    run = uuid.uuid4().hex
    table = materialize(chunk_table(pages, size), "warc-chunks")
    again = materialize(revisits(table), "warc-revisits")
    ids = again.select(F.col("record").alias("_r"))
    if again.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    kept = table.join(ids, table["record"] == ids["_r"], "left_anti")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.slices(batches, "data", BATCH):
            out = []
            for r in b.to_pylist():
                first, last, own = r["chunk"] == 0, r["chunk"] == r["chunks"] - 1, _name(run, r["record"], r["chunk"])
                fields = [("WARC-Type", "response" if first else "continuation"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", None if r["url"] is None else _uri(r["url"])), ("X-Page-ID", r["page_id"])]
                if r["chunks"] > 1:
                    fields += [("WARC-Segment-Number", r["chunk"] + 1), ("WARC-Segment-Origin-ID", None if first else _name(run, r["record"]))]
                    fields += [("WARC-Segment-Total-Length", r["total"] if last else None)]
                fields += [("WARC-Payload-Digest", f"sha1:{r['so_far']}" if last else None), ("X-Payload-Digest-So-Far", f"sha1:{r['so_far']}"), ("Content-Type", "application/http; msgtype=response" if first else None)]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['total']}\r\n\r\n".encode() if first else b""
                out.append(_record(run, fields, http + r["data"]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    def pointers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", _name(run, r["record"])), ("WARC-Date", DATE), ("WARC-Target-URI", None if r["url"] is None else _uri(r["url"])), ("X-Page-ID", r["page_id"])]
                fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _name(run, r["response"])), ("WARC-Refers-To-Target-URI", None if r["response_url"] is None else _uri(r["response_url"])), ("WARC-Payload-Digest", f"sha1:{r['digest']}")]
                out.append(_record(run, fields, b""))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    both = kept.mapInArrow(segments, "value binary").unionAll(again.mapInArrow(pointers, "value binary"))
    both.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", "gzip").text(path)
    drop_table(table)


#: A row of a segment; ``data`` is empty where the record has no other.
SEGMENTS = "name string, origin string, segment int, kind string, page_id long, url string, refers string, total long, digest string, so_far string, data binary, bytes long, intact boolean"
#: A record as it was read back: a revisit has the digest it claims, and no bytes.
RECORDS = "name string, kind string, page_id long, url string, refers string, bytes long, digest string, segments int, intact boolean"


def _parsed(raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    field = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
    block = rest[: int(field["Content-Length"])]
    intact = len(rest) == int(field["Content-Length"]) + 4 and f"sha1:{base32(hashlib.sha1(block).digest())}" == field["WARC-Block-Digest"]
    kind, number = field["WARC-Type"], int(field.get("WARC-Segment-Number", 1))
    data = block.partition(b"\r\n\r\n")[2] if kind == "response" else block
    page, total = field.get("X-Page-ID"), field.get("WARC-Segment-Total-Length")
    claimed, so_far = (field.get(k, "").removeprefix("sha1:") or None for k in ("WARC-Payload-Digest", "X-Payload-Digest-So-Far"))
    several = "WARC-Segment-Number" in field
    if not several and kind == "response":
        so_far = base32(hashlib.sha1(data).digest())
        intact &= so_far == claimed
    name = field["WARC-Record-ID"]
    return name, field.get("WARC-Segment-Origin-ID", name), number, kind, None if page is None else int(page), field.get("WARC-Target-URI"), field.get("WARC-Refers-To"), None if total is None else int(total), claimed, so_far, data if several else None, len(data), intact


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``RECORDS``, one for each record of an archive, its segments put together and checked."""
    line = spark.read.option("lineSep", "\r\n").text(path).filter(F.col("value").startswith(BOUNDARY)).first()
    if line is None:
        return spark.createDataFrame([], RECORDS)
    raw = spark.read.option("lineSep", f"{VERSION}{line.value}\r\n").text(path).filter("value <> ''")
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    arrow = lambda ddl: pa.schema([(n, kinds[t]) for n, t in (f.split(" ") for f in ddl.split(", "))])
    parts, whole = arrow(SEGMENTS), arrow(RECORDS)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in A.slices(batches, "value", BATCH):
            yield _batch([_parsed(v) for v in b.column(0).to_pylist()], parts)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments in the order of (origin, segment): one record's digest and counts are held at a time."""
        head, digest, size, count, intact = None, None, 0, 0, True
        for b in batches:
            out = []
            for name, origin, segment, kind, page, url, refers, total, claimed, so_far, data, length, good in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if data is None:
                    out.append((name, kind, page, url, refers, length, claimed if kind == "revisit" else so_far, 1, good))
                    continue
                if head is None or head[0] != origin:
                    if head is not None:  # it had no last segment
                        out.append((*head, size, base32(digest.digest()), count, False))
                    head, digest, size, count, intact = (origin, "response", page, url, None), hashlib.sha1(), 0, 0, True
                digest.update(data)
                size, count = size + length, count + 1
                intact &= good and segment == count and base32(digest.digest()) == so_far
                if total is not None:
                    out.append((*head, size, base32(digest.digest()), count, intact and size == total and claimed == so_far))
                    head = None
            yield _batch(out, whole)
        if head is not None:
            yield _batch([(*head, size, base32(digest.digest()), count, False)], whole)

    segments = raw.select(F.col("value").cast("binary")).mapInArrow(parse, SEGMENTS)
    return segments.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(fold, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Records with revisits given the bytes and the page_id of their response; a revisit that finds none is not intact."""
    r = materialize(records, "warc-records")
    answer = r.filter("kind = 'response'").select(F.col("name").alias("refers"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("_bytes"), F.col("digest").alias("_digest"))
    found = looked_up(materialize(r.filter("kind = 'revisit'"), "warc-pointers"), answer, "refers")
    back = found.select("name", "page_id", F.col("_bytes").alias("bytes"), "digest", "kind", "refers_to", "segments", F.coalesce(F.col("intact") & (F.col("digest") == F.col("_digest")), F.lit(False)).alias("intact"))
    return r.filter("kind = 'response'").select("name", "page_id", "bytes", "digest", "kind", F.lit(None).cast("long").alias("refers_to"), "segments", "intact").unionAll(back)


def query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    out = resolved(read(spark, path))
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)  # its records have been read and written
    return out.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "segments", "intact")


#: Five hexadecimal digits make four digits of base 32.
_B32 = "list_aggregate(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, (j//4)*5+1, 5) AS INT) >> CAST(15-5*(j%4) AS INT)) & 31)+1, 1)), 'string_agg', '')"
ORACLE = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), h AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h FROM p),
 f AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM h) SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, CAST(greatest(1, (n + {CHUNK - 1}) // {CHUNK}) AS INT) AS segments, true AS intact FROM f"""

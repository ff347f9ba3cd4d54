"""Event-sourced chat formatting: partition the log by conversation, sort by sequence, fold, render.

Events have conv_id, seq, message, kind, role, text. Kinds: ``start`` opens a message with its role,
``delta`` adds text, ``edit`` replaces the text so far, ``regenerate`` throws it away. Messages
are in the order of their number. A sorted partition is folded as a stream, one message in memory.

Each message is rendered as ``<turn role>text</turn>`` and a newline; backslash, < and > inside roles and
texts are escaped by a backslash, so that no text can close or open a turn, and reading back restores it.
The loss mask is the span of the escaped text in each assistant turn.

Defined results: null texts and roles are empty; an event for a message without a start opens it with
an empty role unless it has one; unknown kinds are ignored; repeated rows of a conversation are turns of
their own, in the order of turn, role, text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

EVENT = ["conv_id", "seq", "message", "kind", "role", "text"]
SEGMENT = "conv_id long, message long, segment string, loss_from long, loss_to long"
TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>\n", re.S)


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<", "\\<").replace(">", "\\>")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The segment of a turn and its loss span (empty but for assistants), in code points."""
    head, body = f"<turn {escape(role)}>", escape(text)
    span = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return f"{head}{body}</turn>\n", *span


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, message, role, text) from events in order; deltas of one message are joined at its end."""
    key, role, parts = None, "", []
    for conv, _, message, kind, who, text in events:
        if (conv, message) != key:
            if key is not None:
                yield *key, role, "".join(parts)
            key, role, parts = (conv, message), "", []
        role = who or role
        if kind in ("edit", "regenerate"):
            parts = []
        if kind in ("start", "delta", "edit"):
            parts.append(text or "")
    if key is not None:
        yield *key, role, "".join(parts)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def events():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in EVENT), strict=True)

    rows, size = [], 0
    for conv, message, role, text in fold(events()):
        rows.append((conv, message, *render(role, text)))
        size += len(text)
        if size > 4 << 20 or len(rows) >= 10_000:
            yield _batch(rows)
            rows, size = [], 0
    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SEGMENT.split(", ")])


def formatted(events: DataFrame) -> DataFrame:
    """The rendered segments of each conversation in order, sorted in partitions by conversation."""
    log = events.select(*EVENT).repartition(partitions(events.sparkSession), "conv_id").sortWithinPartitions("conv_id", "message", "seq")
    return log.mapInArrow(_segments, SEGMENT)


def table_events(rows: DataFrame) -> DataFrame:
    """A table of finished turns as a log: each row opens a message and streams its text as one delta."""
    from pyspark.sql import Window as W

    ordered = rows.select("conv_id", "turn", "role", "text").withColumn("message", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    kinds = F.posexplode(F.array(F.lit("start"), F.lit("delta")))
    return ordered.select("*", kinds.alias("seq", "kind")).select("conv_id", F.col("seq").cast("long"), "message", "kind", "role", F.when(F.col("kind") == "delta", F.col("text")).alias("text"))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, state = [], None

    def close():
        conv, n, turns, chars, loss, size = state
        out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    for b in batches:
        for conv, segment, a, z in zip(*(b.column(c).to_pylist() for c in ("conv_id", "segment", "loss_from", "loss_to")), strict=True):
            if state is None or state[0] != conv:
                if state:
                    close()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = map(unescape, TURN.fullmatch(segment).groups())
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            masked = unescape(segment[a:z])
            state[3] += len(masked)
            state[4].update(masked.encode())
            state[5] += len(segment)
    if state:
        close()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    cols = list(zip(*out, strict=True)) if out else [[]] * 6
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def query(conversations: DataFrame) -> DataFrame:
    """Digests of all conversations, read back from the rendered segments."""
    spark = conversations.sparkSession
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    return formatted(table_events(rows)).mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(15 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""

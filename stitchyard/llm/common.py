"""Shared plumbing of the training-data operators: tables, materialised steps, row numbering.

Steps that several jobs read are written as Parquet below the folder that the session names in
``spark.checkpoint.dir``; a lost executor then costs a re-read and no recomputation.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids that a broadcast semi-join may hold (8 MB of bigint); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where the setting is unset, a folder of this machine, which all
    tasks of a local session see; on a cluster they would not, so there the setting is needed."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    app = spark.sparkContext
    if not re.match(r"local(\[[^,\]]*\]|$)", app.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _OWN.setdefault(app.applicationId, tempfile.mkdtemp(prefix="stitchyard-"))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and is safe to reuse.

    The folder goes when the driver's JVM ends, if ``drop_table`` has not deleted it before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def packed_rows(docs: DataFrame, *names: str) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, beside copies of the named ones.

    Own columns of an operator can't clash with further columns of the input, whatever their names.
    """
    return docs.select(F.struct(docs["*"]).alias("row"), *[docs[c] for c in names])


def unpacked_rows(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def drop_table(df: DataFrame) -> None:
    """Delete the files of a materialised step that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def semi(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (already distinct). The count is checked before a broadcast."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def numbered(df: DataFrame, order: list[str], name: str, group: str | None, tag: str, descending: tuple[str, ...] = ()) -> DataFrame:
    """Add ``name``: a gapless number from 0 in the given order, by itself in each ``group`` (then first in ``order``).

    The rows are dealt by ranges and sorted, and each partition counts its own rows. A group that goes on
    from an earlier partition is the first of its own; the numbers at which those go on (one for each
    partition) are added afterwards. No group is gathered in one task, and the driver gets two rows a partition.
    """
    spark = df.sparkSession
    keys = [F.col(c).desc() if c in descending else F.col(c) for c in order]
    dealt = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    schema = T.StructType([*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_part", T.IntegerType()), T.StructField(name, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, part, at = TaskContext.get().partitionId(), None, -1, 0
        for b in batches:
            if not b.num_rows:
                continue
            values = b.column(group) if group else pa.array([0] * b.num_rows)
            same = np.zeros(b.num_rows, bool)
            if b.num_rows > 1:
                same[1:] = pc.fill_null(pc.equal(values[1:], values[:-1]), False).to_numpy(zero_copy_only=False)
                same[1:] |= pc.and_(pc.is_null(values[1:]), pc.is_null(values[:-1])).to_numpy(zero_copy_only=False)
            first = values[0].as_py()
            same[0] = part >= 0 and first == last
            heads = np.flatnonzero(~same)
            parts = part + np.cumsum(~same)
            begin = np.concatenate(([0], heads)) if same[0] else heads
            size = np.diff(np.append(begin, b.num_rows))
            n = np.arange(b.num_rows) - np.repeat(begin, size)
            if same[0]:
                n[: size[0]] += at
            last, part, at = values[b.num_rows - 1].as_py(), int(parts[-1]), int(n[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([pid] * b.num_rows, pa.int32()), pa.array(parts.astype(np.int32)), pa.array(n.astype(np.int64))], names=[*b.schema.names, "_pid", "_part", name])

    out = materialize(dealt.mapInArrow(count, schema), tag)
    value = F.col(group) if group else F.lit(0)
    sizes = out.groupBy("_pid", "_part").agg(F.first(value, False).alias("g"), F.count("*").alias("n"))
    ends = sizes.groupBy("_pid").agg(F.min(F.struct("_part", "g", "n")).alias("a"), F.max(F.struct("_part", "g", "n")).alias("z")).orderBy("_pid").collect()
    starts, open_, held = [], None, 0
    for pid, a, z in ends:
        before = held if open_ is not None and open_ == (a.g,) else 0
        if before:
            starts.append((pid, before))
        held = z.n + (before if z._part == a._part else 0)
        open_ = (z.g,)
    if not starts:
        return out.drop("_pid", "_part")
    first = F.broadcast(spark.createDataFrame(starts, "_p int, _start bigint"))
    joined = out.join(first, (out["_pid"] == first["_p"]) & (out["_part"] == 0), "left")
    return joined.withColumn(name, F.col(name) + F.coalesce("_start", F.lit(0))).drop("_pid", "_part", "_p", "_start")


def row_ids(docs: DataFrame, tag: str) -> DataFrame:
    """(row, text, _id): ``row`` is a struct of all columns; ``_id`` the doc_id where all are distinct and not null,
    else numbers in the order of (doc_id, text)."""
    rows = packed_rows(docs, "doc_id", "text")
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count():
        keyed = rows.withColumn("_key", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
        return numbered(keyed, ["doc_id", "_key"], "_id", None, tag).select("row", "text", "_id")
    return rows.select("row", "text", F.col("doc_id").cast("long").alias("_id"))


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of (a, b): rows (node, comp), comp the smallest node of the component.

    Labels are spread along edges and shortened by one hop a round, so long chains need few rounds;
    each round is a written table. Without edges the result is empty.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), f"{tag}-edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "node"), f"{tag}-labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"], "left").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        hop = labels.select(F.col("node").alias("h"), F.col("comp").alias("far"))
        new = materialize(spread.join(hop, spread["comp"] == hop["h"], "left").select("node", F.least("comp", "far").alias("comp"), "was"), f"{tag}-labels")
        moved = new.filter("comp <> was").limit(1).count()
        drop_table(labels)
        labels = new.select("node", "comp")
        if not moved:
            drop_table(both)
            return labels

"""Rounds over tables: written steps, connected components and ordered walks, all by joins of keyed rows.

Each round of an iteration is a Parquet table in the shared folder that the session names in
``spark.checkpoint.dir``, so that plans stay short and a lost executor costs a re-read alone.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; where none is set, one of this machine, which serves a local session alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    app = spark.sparkContext
    if not re.match(r"local(\[[^,\]]*\]|$)", app.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _OWN.setdefault(app.applicationId, tempfile.mkdtemp(prefix="stitchyard-"))


def written(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """``df`` as a table of its own. ``by``: dealt into as many buckets by that column as a shuffle has partitions, so
    that later joins and groups by it move none of its rows. Its files go when the driver's JVM ends.

    Files are many times smaller than the rows in them, and Spark takes a table for as big as its files: without the hint it
    would send tables of millions of rows through the driver."""
    spark = df.sparkSession
    name = f"{re.sub(r'[^a-z0-9]', '_', tag)}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    if by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path).hint("merge")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, by).write.bucketBy(n, by).sortBy(by).option("path", path).saveAsTable(name)
    return spark.table(name)


def dropped(df: DataFrame) -> None:
    """Delete the files of a written step that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Edges of a key that are one row.
MOST = 20_000


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that edges (a, b) lead to."""
    top = np.arange(n)
    while True:
        now = top.copy()
        low = np.minimum(top[a], top[b])
        np.minimum.at(now, top[a], low)
        np.minimum.at(now, top[b], low)
        while (now != now[now]).any():
            now = now[now]
        if (now == top).all():
            return top
        top = now


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, comp) from rows of a key with the lists of its edges' ends; the rows of a batch are worked out together."""
    for rows in batches:
        a, b = rows.column("a"), rows.column("b")
        row = np.repeat(np.arange(rows.num_rows), np.diff(a.offsets.to_numpy()))
        a, b = a.flatten().to_numpy(), b.flatten().to_numpy()
        if len(row):
            row, ends = np.concatenate((row, row)), np.concatenate((a, b))
            order = np.lexsort((ends, row))
            new = np.concatenate(([True], (np.diff(row[order]) != 0) | (np.diff(ends[order]) != 0)))
            place = np.empty(len(row), np.int64)
            place[order] = np.cumsum(new) - 1
            row, node = row[order][new], ends[order][new]
            top = least_reached(len(node), place[: len(a)], place[len(a) :])
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), pa.array(node), pa.array(node[top])], names=[rows.schema.names[0], "node", "comp"])


def components(edges: DataFrame, key: str, tag: str) -> DataFrame:
    """Connected components of undirected edges (``key``, a, b): rows (``key``, node, comp), comp the smallest node.

    The edges of a key are one row of arrays where they are at most ``MOST``, and all such keys take no round. The others
    are joined in rounds by ``components_in_rounds``, so that no task holds a large key.
    """
    ends = edges.filter("a <> b").select(key, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct()
    counted = written(ends.withColumn("n", F.count("*").over(Window.partitionBy(key))), f"{tag}_counted")
    small = counted.filter(F.col("n") <= MOST).groupBy(key).agg(F.collect_list(F.struct("a", "b")).alias("e")).select(key, "e.a", "e.b")
    schema = T.StructType([counted.schema[key], T.StructField("node", T.LongType()), T.StructField("comp", T.LongType())])
    found = small.mapInArrow(_reached, schema)
    large = counted.filter(F.col("n") > MOST)
    if large.limit(1).count():
        found = found.unionByName(components_in_rounds(large, key, tag))
    return written(found, f"{tag}_labels")


def components_in_rounds(edges: DataFrame, key: str, tag: str) -> DataFrame:
    """Connected components of undirected edges (``key``, a, b): rows (``key``, node, comp), comp the smallest node.

    Every round takes the least label among a node's neighbours, passes it to the node whose label it had, and then takes
    its label's own label, so that long chains take few rounds. A node with many neighbours is met as rows of (label),
    combined before they are shuffled.
    """
    turned = edges.select(key, F.col("b").alias("a"), F.col("a").alias("b"))
    both = written(edges.select(key, "a", "b").unionAll(turned).filter("a <> b").distinct(), f"{tag}_edges")
    labels = written(both.groupBy(key, F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("comp")), f"{tag}_labels")
    while True:
        near = both.join(labels.select(key, F.col("node").alias("b"), F.col("comp").alias("c")), [key, "b"]).groupBy(key, F.col("a").alias("node")).agg(F.min("c").alias("near"))
        spread = labels.join(near, [key, "node"]).select(key, "node", F.col("comp").alias("was"), F.least("comp", "near").alias("to"))
        passed = spread.groupBy(key, F.col("was").alias("node")).agg(F.min("to").alias("passed"))
        spread = spread.join(passed, [key, "node"], "left").select(key, "node", "was", F.least("to", "passed").alias("to"))
        hop = spread.select(key, F.col("node").alias("to"), F.col("to").alias("far"))
        new = written(spread.join(hop, [key, "to"], "left").select(key, "node", F.least("to", "far").alias("comp"), "was"), f"{tag}_labels")
        moved = new.filter("comp <> was").limit(1).count()
        dropped(labels)
        labels = new.drop("was")
        if not moved:
            dropped(both)
            return labels


def walks(steps: DataFrame, key: str, tag: str) -> DataFrame:
    """List ranking by pointer doubling: ``steps`` (``key``, node, next), each node in at most one step's next.

    Rows (``key``, node, first, at, closed): ``at`` counts from 0 along the line that begins at ``first``. A ring begins at its
    smallest node. Every round doubles how far a node sees, so that a line of n nodes takes log2(n) rounds of
    joins, and no task walks a line. (Ranks are counted to the end of a line, then turned.)
    """
    begin = steps.select(key, "node", F.col("next").alias("jump"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.col("node").alias("end"), F.col("node").alias("low"), F.lit(0).cast("long").alias("to_low"))
    seen = written(begin, f"{tag}_seen")
    while True:
        ahead = seen.select(key, F.col("node").alias("jump"), *[F.col(c).alias(f"n_{c}") for c in ("jump", "dist", "end", "low", "to_low")])
        both = seen.filter("jump is not null").join(ahead, [key, "jump"])
        lower = F.col("n_low") < F.col("low")
        moved = both.select(key, "node", F.col("n_jump").alias("jump"), (F.col("dist") + F.col("n_dist")).alias("dist"), F.col("n_end").alias("end"), F.least("low", "n_low").alias("low"), F.when(lower, F.col("dist") + F.col("n_to_low")).otherwise(F.col("to_low")).alias("to_low"), (lower | F.col("n_jump").isNull()).alias("news"))
        new = written(moved.unionAll(seen.filter("jump is null").select(key, "node", "jump", "dist", "end", "low", "to_low", F.lit(False).alias("news"))), f"{tag}_seen")
        news = new.filter("news").limit(1).count()
        dropped(seen)
        seen = new.drop("news")
        if not news:
            break
    line = F.col("jump").isNull()
    named = seen.select(key, "node", line.alias("open"), F.when(line, F.col("end")).otherwise(F.col("low")).alias("name"), F.when(line, F.col("dist")).otherwise(F.col("to_low")).alias("left"))
    # a line's first node is the farthest from its end; a ring's is its smallest
    whole = named.groupBy(key, "open", "name").agg(F.count("*").alias("n"), F.max_by("node", "left").alias("far"))
    joined = named.join(whole, [key, "open", "name"])
    at = F.when(F.col("open"), F.col("n") - 1 - F.col("left")).otherwise((F.col("n") - F.col("left")) % F.col("n"))
    return joined.select(key, "node", F.when(F.col("open"), F.col("far")).otherwise(F.col("name")).alias("first"), at.alias("at"), (~F.col("open")).alias("closed"))


def thousandths(c: Column) -> Column:
    return F.floor(c * 1000 + 0.5).cast("long")

"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension.

Points are groups of equal texts, weighted by their bytes, so that copies stay together. A group that outweighs
both the largest document and ``WHOLE`` of a shard is dealt as single documents: shards can't be near equal
with it in one of them. Dimensions are the size on a log scale, the language and the source. Those two are
codes in the order of their values: the number of cut points up to the value, cut points being up to ``STEPS``
quantiles of the distinct values' first bytes. Ties of a dimension are cut by a hash of the point. At each level, one
aggregation gives every node's histogram along every dimension (at most nodes x dimensions x STEPS
rows), the widest dimension of each node that is over the target bytes is split at its weighted median, and two
further histograms find the place inside the median's bin, to a 2^24th of the bin. Splitting ends when no leaf
is over the target, or at the given number of levels. The tree is a short list of cuts; assigning shards
is a column expression.

Defined results: a null text counts one byte; null metadata comes first in its dimension; repeated rows are
documents of their own, with the slots of ties in any order; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered

DIMS = ["size_dim", "lang_dim", "source_dim"]
STEPS, FINE = 1024, 4096
WHOLE, SLACK = 0.05, 1.5


def _value(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _cuts(docs: DataFrame, c: str) -> list[str]:
    """Up to ``STEPS`` whole values in order: all distinct ones, or, where there are more, those at equal distances in their order."""
    values = materialize(docs.select(_value(c).alias("v")).distinct(), "shard-values")
    n = values.count()
    if n > STEPS:
        ranked = numbered(values, ["v"], "k", None, "shard-ranks")
        values = ranked.filter(F.floor(F.col("k") * STEPS / n) != F.floor((F.col("k") - 1) * STEPS / n)).select("v")
    return [r.v for r in values.orderBy("v").collect()]


def _code(c: str, cuts: list[str]) -> Column:
    """The number of cut points under the value, by halving."""

    def count(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(_value(c) > cuts[middle], count(middle + 1, high)).otherwise(count(low, middle))

    if len(cuts) <= 64:
        return count(0, len(cuts))
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < _value(c)))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, size, checksum, a hash of the text, and the dimensions of each document."""
    text = F.coalesce("text", F.lit(""))
    codes = [_code(c, _cuts(docs, c)).cast("int").alias(f"{c}_dim") for c in ("lang", "source")]
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.substring(F.sha2(text.cast("binary"), 256), 1, 32).alias("group_key"),
        *codes,
    ).withColumn("size_dim", F.least(F.lit(STEPS - 1), F.floor(F.log2("size") * 32)).cast("int"))


def points(docs: DataFrame, shards: int) -> DataFrame:
    """Documents with the dimensions and tie hash of their group's point."""
    rows = materialize(described(docs), "shard-docs")
    total, largest = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    meta = F.struct("doc_id", "lang_dim", "source_dim")
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("bytes"), F.min(meta).alias("m"))
    hot = F.col("bytes") > F.lit(max(largest, WHOLE * total / shards))
    # written first, so that the join deals both sides itself and may split a hot group's rows
    groups = materialize(groups.select(F.col("group_key").alias("g"), F.col("m.lang_dim").alias("lang_dim"), F.col("m.source_dim").alias("source_dim"), hot.alias("hot")), "shard-groups")
    joined = rows.drop("lang_dim", "source_dim").join(groups, rows["group_key"] == F.col("g"))
    tie = F.when(F.col("hot"), F.xxhash64("group_key", "doc_id")).otherwise(F.xxhash64("group_key"))
    return joined.withColumn("tie", F.pmod(tie, F.lit(FINE * FINE)).cast("int")).drop("g", "hot", "group_key")


def _beyond(dim: str, value: int, tie: int) -> Column:
    return (F.col(dim) > value) | ((F.col(dim) == value) & (F.col("tie") >= tie))


def _median(bins: dict[int, int], half: float) -> tuple[int, float]:
    """The bin in which the running weight passes ``half``, and the weight before it."""
    at = 0.0
    for k in sorted(bins):
        if at + bins[k] > half:
            return k, at
        at += bins[k]
    return max(bins), at - bins[max(bins)]


def tree(rows: DataFrame, levels: int, target: int = 0) -> list[dict[int, tuple[str, int, int]]]:
    """For each level, node -> (dimension, value, tie). Leaves at or under ``target`` bytes aren't split."""
    made: list[dict[int, tuple[str, int, int]]] = []
    spans: dict[str, int] = {}
    while len(made) < levels:
        at = rows.withColumn("node", node(made))
        long = at.select("node", "size", F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("v")) for d in DIMS])).alias("x"))
        hist: dict[int, dict[str, dict[int, int]]] = defaultdict(lambda: defaultdict(dict))
        for n, d, v, w in long.groupBy("node", "x.dim", "x.v").agg(F.sum("size")).collect():
            hist[n][d][v] = w
        for d in DIMS if not spans else ():
            values = [v for h in hist.values() for v in h[d]]
            spans[d] = max(max(values, default=0) - min(values, default=0), 1)
        place: dict[int, tuple[str, int, float]] = {}
        for n, h in hist.items():
            weight = sum(h[DIMS[0]].values())
            if weight > target:
                wide = max(DIMS, key=lambda d: ((max(h[d]) - min(h[d])) / spans[d], -DIMS.index(d)))
                value, before = _median(h[wide], weight / 2)
                place[n] = (wide, value, weight / 2 - before)
        if not place:
            break
        cut: dict[int, int] = {n: 0 for n in place}
        for width in (FINE, 1):
            digit, inside = F.floor(F.col("tie") / width), F.lit(False)
            for n, (dim, value, _) in place.items():
                inside = inside | ((F.col("node") == n) & (F.col(dim) == value) & (F.col("tie") >= cut[n]) & (F.col("tie") < cut[n] + FINE * width))
            bins: dict[int, dict[int, int]] = defaultdict(dict)
            for n, k, w in at.filter(inside).groupBy("node", digit.alias("k")).agg(F.sum("size")).collect():
                bins[n][k] = w
            for n, (dim, value, half) in place.items():
                k, before = _median(bins[n], half)
                if width == 1 and half - before > bins[n][k] / 2:
                    k += 1
                cut[n], place[n] = k * width, (dim, value, half - before)
        made.append({n: (dim, value, cut[n]) for n, (dim, value, _) in place.items()})
    return made


def node(made: list[dict[int, tuple[str, int, int]]]) -> Column:
    out: Column = F.lit(0)
    for level in made:
        side = F.lit(0)
        for n, (dim, value, tie) in level.items():
            side = F.when(out == n, _beyond(dim, value, tie).cast("int")).otherwise(side)
        out = out * 2 + side
    return out


def sharded(docs: DataFrame, target: int, levels: int = 4) -> DataFrame:
    """Documents with their size, checksum and shard: up to 2^levels shards, split while they are over ``target`` bytes."""
    rows = materialize(points(docs, 1 << levels), "shard-points")
    made = tree(rows, levels, target)
    return rows.withColumn("shard", node(made) * (1 << (levels - len(made))))


def query(docs: DataFrame) -> DataFrame:
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    # half of a level's bytes are under the target, a level above over it: leaves are 16 shards
    out = sharded(docs, int(SLACK * total / 16)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.lit(None).cast("int").alias("grown_shard"))
    return numbered(out, ["shard", "doc_id"], "slot", "shard", "shard-slots")

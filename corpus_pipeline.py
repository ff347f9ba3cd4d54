"""The training-data pipeline: rules, near-duplicates, repeated passages, benchmark passages, packing.

Each stage takes the documents that its predecessor kept, with their columns, and all but the last return those
columns. Defined results: a document with a null or empty text fails the rules and goes; rows that repeat a doc_id, or
have none, are documents of their own in every stage; of equal rows one stays; further columns, whatever their names,
stay with their rows up to the last stage; an empty table gives no rows; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stitchyard.llm import decontaminate, near_dedup, packing, quality_rules, substring_dedup
from stitchyard.llm.common import materialize, table
from stitchyard.llm.queries import vocabulary


#: Bytes of text that packing tokenizes together, in processes that earlier stages have used.
PACKED_GROUP = 3 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of the policy keep: at least 50 words, little repetition, few symbols and capitals."""
    return quality_rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one of the smallest doc_id, then text; a null doc_id comes first."""
    return near_dedup.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes or more that occur earlier; all documents stay, an emptied one too."""
    return substring_dedup.cleaned(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; items without a text match none."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, by sequence; an empty text is its end id."""
    return packing.query(docs, vocabulary(), PACKED_GROUP)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("packed", packed),
]
#: Sampling, latent search and tokenizing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Readers: Parquet tables, JSON collections, SKU grids and PNG headers."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collection(spark: SparkSession, path: str, schema: T.StructType, array: str) -> DataFrame:
    """The rows of one array of a whole-store JSON document."""
    store = spark.read.schema(T.StructType([T.StructField(array, T.ArrayType(schema))])).json(path, multiLine=True)
    return store.select(F.explode(array).alias("row")).select("row.*")


def png_dims(content: Column) -> tuple[Column, Column]:
    """Width and height from the header of a PNG, without decoding it."""
    part = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return part(17), part(21)


def kind_of(content: Column) -> Column:
    """The kind of an image file by its first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("52494646") & head.endswith("57454250"), "webp").when(F.substring(content, 1, 400).cast("string").rlike("(?i)<svg"), "svg")


def blank_items(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The items of a catalog of blanks; a missing file, one that is no JSON, or one without items gives none."""
    try:
        return collection(spark, path, schema, "items")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)

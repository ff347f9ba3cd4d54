"""Folds over ordered rows of a key: rows are dealt by key and sorted by Spark, and a task folds them as a stream, with the state of one key in memory."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def folded(rows: DataFrame, key: str, order: list[str], schema: str, begin: Callable[[], Callable[[dict], tuple]]) -> DataFrame:
    """A row of ``schema`` for each row, made by ``begin()`` of its key, which is called with the rows in order.

    A step that returns None makes no row.
    """
    kinds = T._parse_datatype_string(schema)
    names, arrow = kinds.names, [to_arrow_type(f.dataType) for f in kinds.fields]
    columns = rows.columns

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(arrow)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for b in batches:
            out = []
            for values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row = dict(zip(columns, values, strict=True))
                if step is None or row[key] != last:
                    last, step = row[key], begin()
                got = step(row)
                if got is not None:
                    out.append(got)
            yield batch(out)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)

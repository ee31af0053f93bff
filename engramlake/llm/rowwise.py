"""Adding a column beside the scan: whole rows pass through, so nothing is shuffled or joined."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


def add_column(
    docs: DataFrame, text_col: str, name: str, kind: str, make: Callable[[], Callable[[pa.Array], pa.Array]]
) -> DataFrame:
    """``docs`` with the column ``name`` of the DDL type ``kind``; an input column of that name is replaced.

    ``make`` runs once in each task and returns the function from texts to values.
    """
    docs = docs.drop(name)
    at = docs.columns.index(text_col)
    names = [*docs.columns, name]
    schema = StructType([*docs.schema.fields, StructField(name, DataType.fromDDL(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, values(b.column(at))], names)

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, schema)

"""Python functions over rows in small slices: Spark hands over batches of 10,000 rows, and what is made of them is far larger than they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows and bytes of a slice; one row may have more.
ROWS, BYTES = 256, 4 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = max(1, min(ROWS, BYTES * b.num_rows // max(b.nbytes, 1)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def frames_of(frames: Iterator[pd.DataFrame], rows: int = ROWS) -> Iterator[pd.DataFrame]:
    for f in frames:
        for at in range(0, len(f), rows):
            yield f.iloc[at : at + rows]


def with_value(rows: DataFrame, name: str, columns: list[str], kind: str, type_: pa.DataType, value: Callable) -> DataFrame:
    """rows with a column, last: value(of the columns) for each row. A slice is sent back before the next one is made."""
    kept = [f for f in rows.schema.fields if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [value(*v) for v in zip(*(b.column(c).to_pylist() for c in columns))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(made, type_)], [*names, name])

    names = [f.name for f in kept]
    return rows.mapInArrow(run, StructType(kept + StructType.fromDDL(f"`{name}` {kind}").fields))

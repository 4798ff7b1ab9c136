"""Small helpers around mapInArrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomwright.llm import kernel

#: Rows that a Python worker takes at a time; a text may be long.
ROWS = 2_000


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores until df has no such column, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def add_columns(df: DataFrame, make: Callable[[pa.RecordBatch], list[pa.Array]], fields: list[T.StructField], keep: list[str] | None = None) -> DataFrame:
    """df's columns (or those in `keep`) and the arrays that `make` returns for each batch.

    Columns go by position inside, so equal or clashing names of further columns do no harm.
    """
    kept = list(range(len(df.columns))) if keep is None else [df.columns.index(c) for c in keep]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), *fields])
    step = ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *make(batch)], names=[f.name for f in schema.fields])
        kernel.relax()

    return df.mapInArrow(run, schema)

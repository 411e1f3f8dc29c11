"""Running a candidate model that may fail on some rows.

The model takes an Arrow batch and gives an array of as many values. Where it raises, or gives another number of values,
the batch is halved down to the rows that fail: these get a null output and the message, all others what the model gives.
A batch of n rows with f failing ones costs some f log n more calls, so the model has to give the same for a row in any
batch and must change nothing else. A model that ends its process ends the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def outcomes(model: Callable[[pa.RecordBatch], pa.Array], batch: pa.RecordBatch, kind: pa.DataType) -> tuple[pa.Array, pa.Array]:
    """Outputs and messages of a batch; one of both is null in every row whose output is not null itself."""
    outputs, errors = [], []
    todo = [(0, batch.num_rows)] if batch.num_rows else []
    while todo:
        a, b = todo.pop()
        try:
            got = model(batch.slice(a, b - a))
            got = (got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got if isinstance(got, pa.Array) else pa.array(got)).cast(kind)
            if len(got) != b - a:
                raise ValueError(f"{len(got)} values for {b - a} rows")
            outputs.append(got)
            errors.append(pa.nulls(b - a, pa.string()))
        except Exception as e:
            if b - a > 1:
                middle = (a + b) // 2
                todo += [(middle, b), (a, middle)]
            else:
                outputs.append(pa.nulls(1, kind))
                errors.append(pa.array([f"{type(e).__name__}: {e}"], pa.string()))
    return (pa.concat_arrays(outputs), pa.concat_arrays(errors)) if outputs else (pa.nulls(0, kind), pa.nulls(0, pa.string()))


def run_safely(rows: DataFrame, model: Callable[[pa.RecordBatch], pa.Array], kind: str, *, output: str = "output", error: str = "error") -> DataFrame:
    """The rows with the model's output, of a type such as ``long``, and null or the message of its failure."""
    arrow = to_arrow_type(T.StructType.fromDDL(f"x {kind}")[0].dataType)
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(f"`{output}` {kind}, `{error}` string").fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, failed = outcomes(model, batch, arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, made, failed], [*batch.schema.names, output, error])

    return rows.mapInArrow(scan, schema)

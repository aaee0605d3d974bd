"""Small helpers to run a batch function over texts inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A task works on slices of about so many text bytes at a time; a longer text forms a slice of its own.
SLICE_BYTES = 1 << 20


def texts_of(column: pa.Array) -> list[str]:
    """Python strings, the empty one for null."""
    return [t or "" for t in column.to_pylist()]


def beside(taken: str | list[str], *names: str) -> list[str]:
    """The names; one that is taken, in any case of its letters, gets ``_`` at its end until it is not."""
    used = {n.lower() for n in ([taken] if isinstance(taken, str) else taken)}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def keyed(df: DataFrame, key: str, **fields: T.DataType) -> T.StructType:
    """The schema of a key, of any name and type, and the outputs beside it."""
    made = T.StructType([T.StructField(key, df.schema[key].dataType)])
    for name, kind in zip(beside(key, *fields), fields.values(), strict=True):
        made = made.add(name, kind)
    return made


def map_rows(df: DataFrame, columns: dict, schema: T.StructType, rows: Callable[..., Iterator[tuple]]) -> DataFrame:
    """Runs ``rows`` over each Arrow batch of the given columns and returns its tuples under ``schema``.

    ``columns`` maps the names ``rows`` gets as keyword lists to columns of ``df``; columns of ``df`` that are not named never
    reach the task, so their names cannot clash with those of ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    with_types = to_arrow_schema(schema)
    names = list(columns)

    def run(batches):
        for batch in batches:
            made = list(rows(**{n: batch.column(i).to_pylist() for i, n in enumerate(names)}))
            by_column = zip(*made, strict=True) if made else [[] for _ in with_types]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, type=f.type) for values, f in zip(by_column, with_types, strict=True)], schema=with_types
            )

    return df.select(*[F.col(f"`{c}`").alias(n) if isinstance(c, str) else c.alias(n) for n, c in columns.items()]).mapInArrow(run, schema)


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of rows: first row, row after the last, their bytes, and each row's start in them.

    The starts have one entry more than rows, the length of all. Null counts as empty.
    """
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def replace_column(df: DataFrame, column: str, values: Callable[[list], list]) -> DataFrame:
    """The same rows and columns, one column's values replaced batch by batch."""
    at = df.columns.index(column)

    def run(batches):
        for batch in batches:
            made = pa.array(values(batch.column(at).to_pylist()), type=batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), made)

    return df.mapInArrow(run, df.schema)

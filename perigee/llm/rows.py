"""What the operators share: how rows and their texts reach Python and come back.

An operator reads one text column and carries other columns in a struct named `row`, so the
names of a table's own columns can never clash with those of a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Texts are worked on in slices of about so many bytes, which bounds a task's memory.
SLICE_BYTES = 4 << 20


def named(name: str):
    """The column of exactly this name, dots included."""
    return F.col(f"`{name}`")


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one like it, that no column of the table has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rows_and_text(df: DataFrame, text: str = "text", keep: list[str] | None = None, **more) -> DataFrame:
    """`row`: a struct of the kept columns (all by default); `text`; further named columns."""
    kept = F.struct(*[named(c) for c in (keep or df.columns)])
    kind = df.select(kept.alias("row")).schema["row"].dataType
    return df.select(kept.cast(_nullable(kind)).alias("row"), named(text).cast("string").alias("text"),
                     *[c.alias(k) for k, c in more.items()])


def _nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere: batches do not carry that nulls are ruled out."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(_nullable(kind.keyType), _nullable(kind.valueType), True)
    return kind


def schema_with_row(rows: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """The schema of a result that carries `row` and has the fields given as (name, type)."""
    more = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in fields))
    return T.StructType([rows.schema["row"], *more.fields])


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a slice have about `limit` bytes; a longer text
    is a slice of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.diff(flat(batch.column("text"))[1])
        begin, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > begin and total + size > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += size
        yield batch.slice(begin)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its values; a null has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    if column.null_count:
        missing = column.is_null().to_numpy(zero_copy_only=False)
        sizes = np.where(missing, 0, np.diff(bounds))
        if sizes.sum() != bounds[-1] - bounds[0]:
            return flat(column.fill_null(b""))
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def texts(column) -> list[bytes]:
    """The values of a string column as bytes; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]

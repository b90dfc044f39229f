"""Bulk exchange of hashed keys between tasks.

A chunk is a row that holds a slice of documents. For a question about all documents ("how
often does this key occur?"), each chunk sends its distinct keys, a row for each shard of the
key space, to the task that owns the shard, and gets an answer for its own keys back. Copies
inside a chunk are one key before the shuffle, so a hot key is at most one entry per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from perigee.llm.rows import slices

CHUNK_SCHEMA = "chunk long, body binary"
U = np.uint64


def to_body(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_body(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(body)).read_all()


def chunked(rows: DataFrame) -> DataFrame:
    """The rows in chunks of about four megabytes of text, dealt out by chunk.

    The explicit exchange is planned once and reused by every join on `chunk`. Chunk numbers
    come from the task and its order of reading, and are only used inside one plan. The rows
    must come in the same order when a lost task is run again, as those of files and of
    checkpoints do; write a table to files first whose order can change.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, part in enumerate(slices(batches)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([task | number], pa.int64()), pa.array([to_body(part)], pa.binary())],
                ["chunk", "body"],
            )

    return rows.mapInArrow(pack, CHUNK_SCHEMA).repartition("chunk")


def size_of(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, by one scan."""
    return df.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string"))).alias("n")).first()["n"] or 0


def planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value, all first bytes before all second ones: sorted
    keys compress well that way."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(held: bytes, width: int) -> np.ndarray:
    n = len(held) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(held, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def shard_bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's keys begin in sorted 64-bit keys; shards are equal key ranges."""
    owner = ((keys >> U(32)) * U(shards)) >> U(32)
    return np.searchsorted(owner, np.arange(shards + 1, dtype=U))


def by_shard(keys: np.ndarray, shards: int, *more) -> list[tuple]:
    """(shard, keys, ...) for each shard that has keys; `more` are arrays beside the keys."""
    bounds = shard_bounds(keys, shards)
    return [
        (s, keys[a:b], *[x[a:b] for x in more])
        for s, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        if b > a
    ]

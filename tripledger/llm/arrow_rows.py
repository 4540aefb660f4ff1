"""Row-wise work in Python on Arrow batches, in slices of bounded text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 8_000_000


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the given text column holds about as many bytes at most; a row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        at = 0
        for end in range(256, batch.num_rows + 256, 256):
            end = min(end, batch.num_rows)
            if end == batch.num_rows or texts.slice(at, end - at).nbytes > most:
                yield batch.slice(at, end - at)
                at = end
        if at < batch.num_rows:
            yield batch.slice(at)


def map_rows(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: int = 1) -> DataFrame:
    """make on every slice of df; column: the one that holds the long texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            yield make(batch)

    return df.mapInArrow(run, schema)


def id_lists(ids: list[bytes]) -> pa.ListArray:
    """Little-endian 32-bit ids of each row as a list column."""
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def list_bytes(column: pa.ListArray) -> list[bytes]:
    """The bytes of each list of 32-bit integers; null counts as empty."""
    if column.null_count:
        column = column.fill_null(pa.scalar([], column.type))
    offsets = column.offsets.to_numpy()
    raw = memoryview(np.ascontiguousarray(column.values.to_numpy(), "<i4")).cast("B")
    cut = (offsets.astype(np.int64) * 4).tolist()
    return [bytes(raw[a:b]) for a, b in zip(cut, cut[1:], strict=False)]

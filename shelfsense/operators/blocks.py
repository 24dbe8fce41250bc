"""Tables kept as one folder per block in the shared folder, for tasks that walk a large table block by block.

Where a task meets every row of another table (all items for some users, all item vectors for some rows of a
sparse matrix), sending one side to each part of the other multiplies it in a shuffle. Here
that side is written once, and a task reads it block by block, so that nothing is multiplied
and a task holds one block at a time. The folder has a scheme that pyarrow's file systems know.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame

from shelfsense.session import durable_path


def write_blocks(df: DataFrame, *by: str) -> str:
    """Write ``df`` with one folder per value of the columns ``by`` (small numbers) and return its path."""
    path = durable_path(df.sparkSession)
    df.repartition(*by).write.partitionBy(*by).parquet(path)
    return path


def read_block(path: str, columns: Sequence[str], **at: int) -> Iterator[pa.RecordBatch]:
    """The rows of one block in batches; none where the block has no rows."""
    store, base = fs.FileSystem.from_uri(path)
    folder = "/".join([base, *[f"{k}={v}" for k, v in at.items()]])
    for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if info.base_name.endswith(".parquet"):
            with store.open_input_file(info.path) as file:
                yield from pq.ParquetFile(file).iter_batches(columns=list(columns))


def whole_block(path: str, columns: Sequence[str], **at: int) -> pa.Table | None:
    found = list(read_block(path, columns, **at))
    return pa.Table.from_batches(found).combine_chunks() if found else None


def vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of equal length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def as_vectors(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel()))


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches of a task put together to tables of up to ``most`` rows."""
    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - rows)
            held.append(part)
            rows += part.num_rows
            batch = batch.slice(part.num_rows)
            if rows == most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def cells_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a matrix that is rarely true (``np.nonzero`` of two dimensions is slow)."""
    at = np.flatnonzero(mask.ravel())
    return at // mask.shape[1], at % mask.shape[1]

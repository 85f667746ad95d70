"""What the operators share: folds, grouped streams of Arrow batches, and the carried row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "carried_row"
#: Rows that a task of a step with few rows takes at least: narrow ones, and ones that hold sets of tokens.
TASK_ROWS = 20_000
TASK_SETS = 1_000
#: Narrow rows up to here are broadcast, more are joined by shuffle.
FEW_ROWS = 100_000
#: Bytes of a batch of whole texts.
TEXT_BYTES = 1 << 20


def carried(docs: DataFrame, *extra: Column) -> DataFrame:
    """All columns of ``docs`` as one struct beside ``extra``, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), *extra)


def released(df: DataFrame) -> DataFrame:
    """The columns that :func:`carried` packed."""
    return df.select(f"{ROW}.*")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether a row is kept back from learning; rows without an id are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def in_few_tasks(df: DataFrame, rows: int, least: int = TASK_ROWS) -> DataFrame:
    """``df``, which holds about ``rows`` rows or fewer, in tasks of about ``least`` rows, and at least one for each core.

    Where many shuffle partitions are set, tasks and files of a few rows cost more than the rows. A large table keeps its tasks.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // least)))


def sent(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of ``rows`` narrow rows as a join side: broadcast where they are few."""
    return F.broadcast(df) if rows <= FEW_ROWS else df


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int | None = None) -> Iterator[None]:
    """Arrow batches of ``rows``, and of about ``size`` bytes where given, for the jobs run inside: whole texts make batches large
    on both sides of the pipe, and large buffers leave holes in an executor's memory that it keeps."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows} | ({"spark.sql.execution.arrow.maxBytesPerBatch": size} if size else {})
    was = {key: spark.conf.get(key) for key in limits}
    for key, limit in limits.items():
        spark.conf.set(key, str(limit))
    try:
        yield
    finally:
        for key, limit in was.items():
            spark.conf.set(key, limit)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Blocks of whole groups from a partition sorted by ``keys``, with the group starts under ``"starts"``.

    A block holds as many groups as one batch ends; only the last group of a batch is carried over.
    """
    rest: list[pa.RecordBatch] = []

    def block(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        out = {c: column_values(table.column(c)) for c in table.column_names}
        new = np.ones(table.num_rows, bool)
        new[1:] = np.logical_or.reduce([out[k][1:] != out[k][:-1] for k in keys])
        out["starts"] = np.flatnonzero(new)
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [column_values(batch.column(k)) for k in keys]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))
        last = int(new[-1]) + 1 if len(new) else 0
        fresh = not rest or any(column_values(rest[-1].column(k))[-1] != c[0] for k, c in zip(keys, cols, strict=True))
        if last or fresh:
            head = [*rest, *([batch.slice(0, last)] if last else [])]
            if head:
                yield block(head)
            rest = [batch.slice(last)]
        else:
            rest.append(batch)
    if rest:
        yield block(rest)


def column_values(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column without nulls as NumPy; binary columns of one width as a matrix of bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if pa.types.is_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
        return data.reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def per_batch(work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function from a function on one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield work(batch)

    return run

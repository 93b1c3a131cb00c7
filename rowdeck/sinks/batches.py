"""Batches of exactly so many rows, in position order, streamed to the driver.

Rows are laid out by position over tasks, packed into Arrow messages there, and fetched one
partition at a time, the next one while the present one is used. The driver cuts the stream anew,
so a batch may span partitions. It holds one partition and one batch, never the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowdeck.sinks import in_order

MESSAGE_BYTES = 1 << 22  # of one Arrow message, unless a single row is larger

Batch = pd.DataFrame | dict[str, np.ndarray] | pa.Table


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Halves of halves until each is small enough or a single row."""
    if batch.num_rows < 2 or batch.get_total_buffer_size() <= MESSAGE_BYTES or batch.nbytes <= MESSAGE_BYTES:
        yield batch
        return
    half = batch.num_rows // 2
    yield from _pieces(batch.slice(0, half))
    yield from _pieces(batch.slice(half))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in _pieces(batch):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, piece.schema) as writer:
                writer.write_batch(piece)
            yield pa.RecordBatch.from_pydict({"message": pa.array([out.getvalue().to_pybytes()], pa.binary())})


def _as(table: pa.Table, kind: str) -> Batch:
    if kind == "arrow":
        return table
    frame = table.to_pandas()
    if kind == "pandas":
        return frame
    return {name: frame[name].to_numpy() for name in frame.columns}


def iter_batches(
    df: DataFrame,
    size: int,
    pos: str = "pos",
    columns: list[str] | None = None,
    kind: str = "pandas",
    start: int = 0,
    drop_last: bool = False,
    prefetch: bool = True,
    **layout,
) -> Iterator[Batch]:
    """Yield batches of ``size`` consecutive rows; the last one may be short, or is dropped.

    ``columns`` are all but the position unless named; ``kind`` is "pandas", "numpy" (a dict of
    arrays) or "arrow". ``start`` resumes at a position, as after an interrupted epoch.
    ``layout`` is handed to ``in_order`` (``rows``, ``files``, ``laid_out``). Positions that are not
    dense (missing, repeated, NULL or outside) end the iteration with an error, so no row is skipped
    silently. An empty table yields nothing.
    """
    if size < 1:
        raise ValueError("a batch needs at least one row")
    if kind not in ("pandas", "numpy", "arrow"):
        raise ValueError(f"unknown kind of batch: {kind}")
    names = [c for c in df.columns if c != pos] if columns is None else list(columns)
    return _batches(df, size, pos, names, kind, start, drop_last, prefetch, layout)


def _batches(df, size, pos, names, kind, start, drop_last, prefetch, layout) -> Iterator[Batch]:
    if not layout.get("laid_out"):
        # out of range they would meet the wrong partition; here they fail at the first batch
        df = df.select(pos, *[c for c in names if c != pos])
    ordered = in_order(df, pos, **layout)
    if start:
        ordered = ordered.where((F.col(pos) >= start) | F.col(pos).isNull())
    wanted = ordered.select(F.col(pos).cast("bigint").alias("_at"), *names)
    held: list[pa.Table] = []
    count, expected = 0, start
    for row in wanted.mapInArrow(_packed, "message binary").toLocalIterator(prefetchPartitions=prefetch):
        table = pa.ipc.open_stream(row["message"]).read_all()
        at = table.column("_at")
        if at.null_count or not np.array_equal(at.to_numpy(), np.arange(expected, expected + len(table))):
            raise ValueError(f"positions are not dense after {expected}")
        expected += len(table)
        held.append(table.drop_columns(["_at"]))
        count += len(table)
        if count < size:
            continue
        whole = pa.concat_tables(held)
        low = 0
        while count - low >= size:
            yield _as(whole.slice(low, size).combine_chunks(), kind)
            low += size
        held, count = [whole.slice(low)], count - low
    if count and not drop_last:
        yield _as(pa.concat_tables(held).combine_chunks(), kind)

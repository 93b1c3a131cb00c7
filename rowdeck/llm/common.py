"""Word, hash and Arrow helpers shared by the corpus operators.

A word is a run of characters other than space and ``\\t \\n \\v \\f \\r``; that is exactly what
``bytes.split`` cuts at, so texts are split as UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowdeck.session import checkpoint_folder, durable

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
SLICE_ROWS = 512

# Odd 64-bit multipliers; fixed so that hashes agree between tasks and runs.
MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93],
    dtype=np.uint64,
)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of every word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` word hashes, in text order; empty if there are fewer words."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total += codes[k : k + size] * MULTIPLIERS[k]
        total ^= total >> np.uint64(29)
    return mix(total)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles of the A-Z-lowered text; a shorter
    text is one shingle, a text without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    codes = word_hashes(words)
    if len(codes) < n:
        return mix(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64))
    return np.unique(gram_hashes(codes, n))


def signed(values: np.ndarray) -> np.ndarray:
    """The same bits as BIGINT values."""
    return values.astype(np.uint64, copy=False).view(np.int64)


def give_back() -> None:
    """Return what this process has freed to the system. Left alone, the allocators of a Python worker, which
    serves task after task, keep it: as much as the largest task so far took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for ``mapInArrow``, with memory given back before its first and after its last batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from function(batches)
        give_back()

    return run


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function that yields dicts of columns for a batch."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in function(batch):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(lean(run), schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut into ``rows`` at most, so that the Python copies of few texts are held at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Spark send Python at most ``rows`` rows in one Arrow batch; a lower bound of the session stays.
    Its own bound of 10,000 rows is one for narrow rows: as texts they take some 100 MB on either side."""
    held = int(spark.conf.get(ARROW_ROWS))
    if not 0 < held <= rows:
        spark.conf.set(ARROW_ROWS, str(rows))


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def narrow(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, so that extra or clashing ones never reach an operator."""
    return df.select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()])


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and go on from the written table:
    compressed, and read by column, which suits wide intermediate results."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def first_rows(df: DataFrame, key: str, limit: int, seed: int = 1) -> DataFrame:
    """A bounded sample: the ``limit`` rows with the smallest hash of ``key``; used for training only.

    Rows are first cut to those below a hash that leaves a little over ``limit`` of them, so few
    more than that ever meet, whatever the number of tasks. The cut is counted, and widened where it
    left too few.
    """
    pool = df.withColumn("_draw", F.xxhash64(F.lit(seed), F.col(key)))
    total, wanted = df.count(), limit + 10 * int(limit**0.5) + 100
    while wanted < total:
        below = pool.where(F.col("_draw") < wanted * (1 << 64) // total - (1 << 63))
        if below.count() >= limit:
            pool = below
            break
        wanted *= 4
    return pool.orderBy("_draw", key).limit(limit).drop("_draw")


__all__ = ["MULTIPLIERS", "arrow_schema", "bounded_batches", "checkpoint_folder", "durable", "first_rows", "give_back", "gram_hashes", "lean", "map_batches", "mix", "narrow", "shingle_set", "signed", "slices", "stored", "table", "word_hashes"]

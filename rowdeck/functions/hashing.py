"""Seeded randomness as column expressions.

Every random choice is a 64-bit hash of a seed and a row key, so it does not depend on
how rows are partitioned, survives task retries and can be recomputed elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# One number per use of randomness, hashed with the seed: the same seed gives unrelated
# streams to values, orders, coins, samples and fingerprints. Fixed values.
GENERATE, ORDER, LANES, COIN, SAMPLE, PRINT = 1, 2, 3, 4, 5, 6


def draw(use: int, seed: int, *key: Column | str) -> Column:
    """Signed 64-bit draw for a row, in the stream of ``use``."""
    columns = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.xxhash64(F.lit(seed).cast("bigint"), F.lit(use).cast("bigint"), *columns)


def row_draw(df: DataFrame, use: int, seed: int, keys: list[str]) -> Column:
    """Draw for the rows of a table. Integer keys are widened, so that the same keys draw
    the same whether they are stored as INT or BIGINT."""
    kinds = {field.name: field.dataType for field in df.schema.fields}
    narrow = (T.ByteType, T.ShortType, T.IntegerType)
    return draw(use, seed, *[F.col(k).cast("bigint") if isinstance(kinds[k], narrow) else F.col(k) for k in keys])


def slice_of(value: Column, slices: int | Column) -> Column:
    """Which of ``slices`` equal parts of the 64-bit range a draw falls in.

    Never decreases when the draw grows, so slices read in order keep the draw order.
    """
    if isinstance(slices, int):
        if slices == 1:
            return F.lit(0).cast("bigint")
        slices = F.lit(slices).cast("bigint")
    top = F.shiftright(value, 33) + F.lit(1 << 30)
    return F.shiftright(top * slices, 31)


def uniform(seed: int, *key: Column | str) -> Column:
    """Double in [0, 1) from the top 53 bits of the draw."""
    return F.shiftrightunsigned(draw(GENERATE, seed, *key), 11).cast("double") * F.lit(2.0**-53)


def uniform_int(seed: int, low: int, high: int, *key: Column | str, inclusive: bool = False) -> Column:
    """Integer in [low, high), or in [low, high] when ``inclusive``."""
    width = high - low + (1 if inclusive else 0)
    if width <= 0:
        raise ValueError("the integer range is empty")
    return F.floor(uniform(seed, *key) * F.lit(width)).cast("bigint") + F.lit(low)


def coin(seed: int, *key: Column | str) -> Column:
    """Fair coin: true means heads."""
    return draw(COIN, seed, *key) < 0

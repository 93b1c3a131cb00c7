"""Sorted orders as dense position columns, and the order of lanes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowdeck.functions import digit, digit_count, reversed_digits
from rowdeck.operators.lanes import Lanes
from rowdeck.operators.ranking import LANE, position_by_value, position_in_lanes, sum_of_earlier
from rowdeck.operators.shuffles import _keys
from rowdeck.functions.hashing import LANES, row_draw


def stable_sort(
    df: DataFrame,
    value: str | Column,
    pos: str = "pos",
    out: str = "new_pos",
    rows: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Ascending order of a numeric value; equal values keep their order. ``tasks`` sets how many
    tasks sort, else they follow rows and bytes."""
    column = F.col(value) if isinstance(value, str) else value
    return position_by_value(df, column, F.col(pos), [pos], out, rows, tasks)


def max_digits(df: DataFrame, value: str) -> DataFrame:
    """One row: how many characters the largest value has in decimal."""
    return df.agg(digit_count(F.max(value)).alias("max_digits"))


def radix_order(
    df: DataFrame,
    value: str,
    pos: str = "pos",
    out: str = "new_pos",
    rows: int | None = None,
    digits: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Order by units digit first, then tens, and so on (10 comes before 1); stable.

    ``digits`` is how many digits count; by default as many as the largest value has,
    found by one aggregate.
    """
    if digits is None:
        found = df.agg(F.count(F.lit(1)).alias("rows"), digit_count(F.max(value)).alias("digits")).first()
        rows, digits = found["rows"], found["digits"] or 1
    return stable_sort(df, reversed_digits(F.col(value), digits), pos, out, rows, tasks)


def digit_buckets(df: DataFrame, value: str, place: int, out: str = "bucket") -> DataFrame:
    """Deal rows into ten buckets by one decimal digit."""
    return df.withColumn(out, digit(F.col(value), place))


def argsort(table: DataFrame, by: str, tie: str, out: str = "rank") -> DataFrame:
    """Rank of each row in ascending order of the numeric ``by``; equal ones keep the order of
    ``tie``, a distinct number from 0 up."""
    return position_by_value(table, F.col(by), F.col(tie).cast("bigint"), [tie], out)


def lane_offsets(lane_table: DataFrame, by: str, lane: str = "lane", rows: str = "rows") -> DataFrame:
    """``(lane, rank, offset)`` when lanes are concatenated in ascending order of ``by``.

    One row per lane; equal measures keep lane order. Use bytes, a distance or
    rows / rate as the measure.
    """
    ranked = argsort(lane_table.select(lane, by, F.col(rows).alias("_rows")), by, lane)
    return sum_of_earlier(ranked, "rank", "_rows", "offset").select(lane, "rank", "offset")


def concat_in_order(
    df: DataFrame,
    lanes: Lanes,
    offsets: DataFrame,
    pos: str = "pos",
    out: str = "new_pos",
    shuffle_key: str | list[str] | None = None,
    seed: int = 0,
) -> DataFrame:
    """Concatenate lanes in the order of ``offsets``, shuffled inside if a key is given.

    A row whose lane has no offset, or two, fails the job. The table of offsets is broadcast
    only where Spark finds it small.
    """
    if shuffle_key is None:
        ranked = df.withColumn(LANE, lanes.lane(F.col(pos))).withColumn("_rank", lanes.rank(F.col(pos)))
    else:
        keys = _keys(shuffle_key)
        ranked = position_in_lanes(df, lanes, F.col(pos), row_draw(df, LANES, seed, keys), keys, "_rank")
        ranked = ranked.withColumn("_rank", F.col("_rank") - lanes.start(F.col(LANE)))
    table = offsets.groupBy(F.col("lane").alias(LANE)).agg(F.count("*").alias("_times"), F.min("offset").alias("_offset"))
    wrong = F.raise_error(F.lit("every lane needs exactly one offset")).cast("bigint")
    placed = F.when(F.col("_times") == 1, F.col("_offset") + F.col("_rank")).otherwise(wrong)
    return ranked.join(table, LANE, "left").withColumn(out, placed).drop(LANE, "_rank", "_offset", "_times")


def take_first(df: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """The first ``size`` rows: a filter on the dense position, pushed to the scan."""
    return df.filter(F.col(pos) < size)

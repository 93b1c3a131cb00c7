"""The cycles of a permutation table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowdeck.operators.verify import fingerprints_equal
from rowdeck.session import durable


def cycle_of(table: DataFrame, pos: str = "pos", to: str = "new_pos") -> DataFrame:
    """``(pos, cycle)``: the smallest position on the cycle of each position.

    Pointer doubling: after k rounds a position knows where 2^k steps lead and the smallest
    position on the way, so the longest cycle of n positions takes log2(n) rounds and one more that changes
    nothing. A round is a join by position, whose keys are distinct; each is written to the checkpoint
    folder. A table whose ``to`` are not its ``pos`` in another order is refused.
    """
    steps = durable(table.select(F.col(pos).cast("bigint").alias("at"), F.col(to).cast("bigint").alias("jump"), F.col(pos).cast("bigint").alias("low")))
    if not fingerprints_equal(steps.select("at"), steps.select(F.col("jump").alias("at")), ["at"]):
        raise ValueError("the table is not a permutation")
    while True:
        ahead = steps.select(F.col("at").alias("jump"), F.col("jump").alias("further"), F.col("low").alias("lower"))
        lower = F.least("low", "lower")
        steps = durable(steps.join(ahead, "jump").select("at", F.col("further").alias("jump"), lower.alias("low"), (lower != F.col("low")).alias("changed")))
        if steps.where("changed").isEmpty():
            return steps.select(F.col("at").alias(pos), F.col("low").alias("cycle"))
        steps = steps.drop("changed")


def cycle_lengths(table: DataFrame, pos: str = "pos", to: str = "new_pos") -> DataFrame:
    """``(cycle, length)`` per cycle, named by its smallest position; fixed points have length 1."""
    return cycle_of(table, pos, to).groupBy("cycle").agg(F.count(F.lit(1)).alias("length"))

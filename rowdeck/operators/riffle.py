"""Random merges of ordered inputs.

By coins, a fair coin per output slot picks the side while both have rows left. Uniformly, the
slots of the left side are those with the smallest draws, as many as it has rows: every choice of
slots is equally likely, which is the same as drawing a side with the probability of its rows
among all that are left. Merging uniformly shuffled sides uniformly leaves a uniform shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rowdeck.functions import coin, draw, idiv
from rowdeck.functions.hashing import COIN
from rowdeck.operators.lanes import Batches
from rowdeck.operators.ranking import INDEX_BITS, LANE, position_in_lanes, sum_of_earlier
from rowdeck.session import row_count, task_limit

TASK_SLOTS = 1 << 16  # slots tossed in one task, where the cluster has tasks to spare
SMALL_LANE = 1 << 14  # lanes of up to so many slots are counted one by one in a window
BROADCAST_LANES = 1 << 18


def _counted(slots: DataFrame, rows: int, tasks: int) -> DataFrame:
    """Number the kept slots of a range from 0 in slot order, as ``nth``.

    Tasks of a range hold consecutive slots, so a slot's number is its index among the
    kept slots of its task plus those of earlier tasks (one broadcast row per task).
    """
    home = (idiv((F.col("slot") + 1) * F.lit(tasks) + F.lit(rows - 1), rows) - 1).alias("home")
    before = Window.orderBy("home").rowsBetween(Window.unboundedPreceding, -1)
    counts = slots.groupBy(home).agg(F.count(F.lit(1)).alias("kept"))
    base = counts.select("home", F.coalesce(F.sum("kept").over(before), F.lit(0)).alias("base"))
    numbered = slots.select("slot", home, F.monotonically_increasing_id().alias("spot"))
    index = F.col("spot").bitwiseAND(F.lit((1 << INDEX_BITS) - 1))
    astray = F.raise_error(F.lit("a slot was numbered outside its task")).cast("bigint")
    at_home = F.shiftright("spot", INDEX_BITS) == F.col("home")
    numbered = numbered.select("slot", "home", F.when(at_home, index).otherwise(astray).alias("index"))
    return numbered.join(F.broadcast(base), "home").select("slot", (F.col("index") + F.col("base")).alias("nth"))


def _drawn_sides(slots: DataFrame, rows: int, lane_slots: int, width: int, seed: int) -> tuple[DataFrame, Column]:
    """Slots with, and the condition for, a draw among the smallest of their lane, as many as the left
    side has rows. The last such draw of each lane is found by ranking slots in one exchange."""
    lanes = Batches(rows, lane_slots)
    ranked = position_in_lanes(slots, lanes, F.col("slot"), draw(COIN, seed, "slot"), ["slot"], "_seat")
    start = lanes.start(F.col(LANE))
    left, _ = _sides(start, rows, lane_slots, width)
    lasts = ranked.filter(F.col("_seat") == start + left - 1).select(F.col(LANE).alias("_in"), F.struct(draw(COIN, seed, "slot").alias("d"), F.col("slot").alias("s")).alias("_last"))
    joined = slots.withColumn("_in", idiv(F.col("slot"), lane_slots)).join(F.broadcast(lasts), "_in")
    return joined, F.struct(draw(COIN, seed, "slot").alias("d"), F.col("slot").alias("s")) <= F.col("_last")


def _drawn_in_window(slots: DataFrame, rows: int, lane_slots: int, width: int, seed: int) -> DataFrame:
    """The uniform choice where lanes are small or many: each is ordered twice in one task."""
    start = (idiv(F.col("slot"), lane_slots) * F.lit(lane_slots)).alias("start")
    left, right = _sides(F.col("start"), rows, lane_slots, width)
    by_draw = F.row_number().over(Window.partitionBy("start").orderBy(draw(COIN, seed, "slot"), "slot"))
    before = Window.partitionBy("start").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    flagged = slots.select("slot", start).withColumn("head", (by_draw <= left).cast("bigint"))
    heads = F.coalesce(F.sum("head").over(before), F.lit(0))
    counted = flagged.withColumn("heads", heads).withColumn("tails", F.col("slot") - F.col("start") - F.col("heads"))
    # slots after the end of a side are left to the rule for rows that no slot took
    both = counted.filter((F.col("heads") < left) & (F.col("tails") < right))
    src = F.col("start") + F.when(F.col("head") == 1, F.col("heads")).otherwise(left + F.col("tails"))
    return both.select(src.alias("src"), "slot")


def _coin_slots(spark: SparkSession, rows: int, lane_slots: int, width: int, seed: int, uniform: bool) -> DataFrame:
    """``(src, slot)`` for every slot filled while both sides have rows, in lanes of ``lane_slots``
    slots whose first ``width`` positions are the left side. No slot is exchanged by coins."""
    total = max(rows, 1)
    tasks = max(1, min(-(-total // TASK_SLOTS), task_limit(spark, total)))
    slots = spark.range(0, rows, 1, tasks).withColumnRenamed("id", "slot")
    start = (idiv(F.col("slot"), lane_slots) * F.lit(lane_slots)).alias("start")
    chosen = coin(seed, "slot")
    if uniform and (lane_slots <= SMALL_LANE or -(-rows // lane_slots) > BROADCAST_LANES):
        return _drawn_in_window(slots, rows, lane_slots, width, seed)
    if uniform:
        slots, chosen = _drawn_sides(slots, rows, lane_slots, width, seed)
    heads = slots.filter(chosen)
    tails = slots.filter(~chosen)

    def ranked(kept: DataFrame) -> DataFrame:
        """``nth`` counted from the start of the lane."""
        if lane_slots <= SMALL_LANE < rows:
            in_lane = Window.partitionBy("start").orderBy("slot")
            nth = (F.row_number().over(in_lane).cast("bigint") - 1).alias("nth")
            return kept.select("slot", start).select("slot", nth, "start")
        numbered = _counted(kept, total, tasks).select("slot", "nth", start)
        if rows <= lane_slots:
            return numbered
        lanes = kept.groupBy(start).agg(F.count(F.lit(1)).alias("kept"))
        lanes = lanes.withColumn("lane", idiv(F.col("start"), lane_slots))
        earlier = sum_of_earlier(lanes, "lane", "kept", "earlier").select("start", "earlier")
        if -(-rows // lane_slots) <= BROADCAST_LANES:
            earlier = F.broadcast(earlier)
        joined = numbered.join(earlier, "start")
        return joined.select("slot", (F.col("nth") - F.col("earlier")).alias("nth"), "start")

    left, right = _sides(F.col("start"), rows, lane_slots, width)
    nth, other = F.col("nth"), F.col("slot") - F.col("start") - F.col("nth")
    # a slot has a coin only while both sides have rows left
    from_left = ranked(heads).filter((nth < left) & (other < right))
    from_right = ranked(tails).filter((nth < right) & (other < left))
    return from_left.select((F.col("start") + nth).alias("src"), "slot").unionAll(
        from_right.select((F.col("start") + left + nth).alias("src"), "slot")
    )


def _sides(start: Column, rows: int, lane_slots: int, width: int) -> tuple[Column, Column]:
    """Rows of the left and the right side of the lane that begins at ``start``."""
    size = F.least(F.lit(lane_slots), F.lit(rows) - start)
    left = F.least(F.lit(width), size)
    return left, size - left


def _riffle(
    df: DataFrame, rows: int, lane_slots: int, width: int, seed: int, pos: str, out: str, uniform: bool
) -> DataFrame:
    source = df.withColumnRenamed(pos, "_at")
    at = F.col("_at")
    start = idiv(at, lane_slots) * F.lit(lane_slots)
    left, right = _sides(start, rows, lane_slots, width)
    # rows of the left side that no coin placed follow the whole right side; those of
    # the right side end where they already are
    unplaced = F.when(at - start < left, at + right).otherwise(at)
    slots = _coin_slots(df.sparkSession, rows, lane_slots, width, seed, uniform)
    slots = slots.select(F.col("src").alias("_at"), F.col("slot").alias("_slot"))
    merged = source.join(slots, "_at", "left").withColumn("_slot", F.coalesce(F.col("_slot"), unplaced))
    if pos == out:
        return merged.drop("_at").withColumnRenamed("_slot", out)
    return merged.withColumnsRenamed({"_at": pos, "_slot": out})


def riffle_pairs(
    df: DataFrame, rows: int, width: int, seed: int, pos: str = "pos", out: str = "new_pos", uniform: bool = False
) -> DataFrame:
    """Merge neighbouring blocks of ``width`` positions, two by two, at random, by coins or uniformly.

    Both blocks keep their inner order; when one runs out the rest of the other follows.
    A last block without a partner stays as it is.
    """
    return _riffle(df, rows, 2 * width, width, seed, pos, out, uniform)


def riffle_merge(
    left: DataFrame,
    right: DataFrame,
    seed: int,
    pos: str = "pos",
    out: str = "new_pos",
    left_rows: int | None = None,
    right_rows: int | None = None,
    uniform: bool = False,
) -> DataFrame:
    """Random merge of two ordered tables of any sizes, by coins or uniformly; each side keeps its order.

    ``pos`` comes back as the position in the two tables laid end to end.
    """
    first, second = row_count(left, left_rows), row_count(right, right_rows)
    stacked = left.unionByName(right.withColumn(pos, F.col(pos) + F.lit(first)))
    return _riffle(stacked, first + second, max(first + second, 1), first, seed, pos, out, uniform)

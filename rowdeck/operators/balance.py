"""Lanes of even loads: moving only the surplus of uneven lanes, and dealing rows by their cost.

Plans are made on tables with a row per lane or per class of costs. Rows learn their part of
a plan by position: a plan is a list of intervals of positions, cut into cells of CELL positions, so
that the join is by cell, where no key has more than CELL rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rowdeck.functions import idiv
from rowdeck.operators.ranking import position_by_value, refuse_existing, sum_of_earlier
from rowdeck.session import row_count

CELL = 1 << 12  # positions of one cell of a plan


def in_interval(df: DataFrame, at: str, intervals: DataFrame, first: str, size: str, payload: list[str]) -> DataFrame:
    """Left join of rows with the interval ``[first, first + size)`` that holds their ``at``.

    Intervals do not overlap; empty ones and those of NULL size are ignored. Cells hold at most CELL
    rows and CELL intervals. Spark broadcasts the intervals where it finds them small.
    """
    start, end = F.col(first), F.col(first) + F.col(size) - 1
    cells = intervals.where(F.col(size) > 0).withColumn("_cell", F.explode(F.sequence(idiv(start, CELL), idiv(end, CELL))))
    entry = F.struct(start.alias("first"), end.alias("last"), *payload)
    plan = cells.groupBy("_cell").agg(F.collect_list(entry).alias("_plan"))
    found = F.get(F.filter("_plan", lambda x: (x["first"] <= F.col(at)) & (x["last"] >= F.col(at))), 0)
    joined = df.withColumn("_cell", idiv(F.col(at), CELL)).join(plan, "_cell", "left").withColumn("_found", found)
    return joined.select(*df.columns, *[F.col(f"_found.{name}").alias(name) for name in payload])


def lane_table(df: DataFrame, lane: str, count: int) -> DataFrame:
    """``(lane, load)`` of lanes ``0 .. count-1``, empty ones included; any other lane fails the job."""
    loads = df.groupBy(F.col(lane).cast("bigint").alias("lane")).agg(F.count(F.lit(1)).alias("load"))
    outside = F.raise_error(F.lit(f"a lane is not within 0 .. {count - 1}")).cast("bigint")
    inside = F.col("lane").isNotNull() & (F.col("lane") >= 0) & (F.col("lane") < count)
    loads = loads.select(F.when(inside, F.col("lane")).otherwise(outside).alias("lane"), "load")
    every = df.sparkSession.range(count).select(F.col("id").alias("lane"), F.lit(0).cast("bigint").alias("load"))
    return loads.unionByName(every).groupBy("lane").agg(F.sum("load").alias("load"))


def transfer_plan(loads: DataFrame, count: int, rows: int) -> DataFrame:
    """``(lane, load, target, surplus, deficit, start, given, taken)`` per lane.

    Targets differ by at most one; the fullest lanes (lower number first) get the larger ones, so as few
    rows as possible move. ``start`` is the lane's offset when lanes are laid end to end, ``given``
    and ``taken`` are the running sums of earlier surplus and deficit: the surplus rows, numbered on
    through the lanes, fill the gaps, numbered in the same way.
    """
    spread = loads.select((-F.col("load")).alias("_key"), "lane", "load")
    ranked = position_by_value(spread, F.col("_key"), F.col("lane"), ["lane"], "_place", count).drop("_key")
    whole, extra = divmod(rows, count)
    target = F.lit(whole).cast("bigint") + (F.col("_place") < extra).cast("bigint")
    plan = ranked.withColumn("target", target).drop("_place")
    plan = plan.withColumn("surplus", F.greatest(F.col("load") - F.col("target"), F.lit(0)))
    plan = plan.withColumn("deficit", F.greatest(F.col("target") - F.col("load"), F.lit(0)))
    for value, out in (("load", "start"), ("surplus", "given"), ("deficit", "taken")):
        plan = sum_of_earlier(plan, "lane", value, out)
    return plan


def rebalance(
    df: DataFrame, lane: str, count: int, pos: str = "pos", out: str = "new_lane", rows: int | None = None, tasks: int | None = None
) -> DataFrame:
    """Even out lanes of any loads: sizes then differ by at most one, and only surplus rows move.

    A lane over its target gives away its last rows by position; they fill the lanes below
    their target, in lane order. All other rows keep their lane. Adds ``out``. One lane may
    hold any share of the rows: rows are ranked by cells of (lane, position), in one exchange.
    ``pos`` is a distinct number from 0 up.
    """
    refuse_existing(df, out)
    total = row_count(df, rows)
    plan = transfer_plan(lane_table(df, lane, count), count, total)
    placed = position_by_value(df, F.col(lane), F.col(pos), [pos], "_seat", total, tasks)
    # the surplus of a lane is the end of its interval of spots, numbered from ``given`` on
    kept = F.least(F.col("load"), F.col("target"))
    moving = plan.where("surplus > 0").select((F.col("start") + kept).alias("_first"), "surplus", (F.col("given") - F.col("start") - kept).alias("_shift"))
    moved = in_interval(placed, "_seat", moving, "_first", "surplus", ["_shift"])
    moved = moved.withColumn("_gap", F.col("_seat") + F.col("_shift"))
    gaps = plan.where("deficit > 0").select("taken", "deficit", F.col("lane").alias("_to"))
    # rows that stay have no number among the moved; they find no gap, and are spread by their spot
    number = F.coalesce(F.col("_gap"), -1 - F.col("_seat"))
    filled = in_interval(moved.withColumn("_number", number), "_number", gaps, "taken", "deficit", ["_to"])
    return filled.withColumn(out, F.coalesce("_to", F.col(lane).cast("bigint"))).drop("_seat", "_shift", "_gap", "_number", "_to")


def cost_class(cost: Column, bits: int) -> Column:
    """The cost with all but its highest ``bits`` bits cleared; small costs are their own class."""
    size = F.length(F.bin(cost))
    low = F.greatest(size - F.lit(bits), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", cost, low), low)


def fill(loads: np.ndarray, cost: int, rows: int) -> np.ndarray:
    """How many of ``rows`` rows of one cost each lane gets when every row goes to the least loaded
    lane, the lowest of several; by a search for the level reached instead of row by row."""
    if cost == 0:
        each, extra = divmod(rows, len(loads))
        return np.full(len(loads), each, np.int64) + (np.arange(len(loads)) < extra)

    def taken(level: int) -> np.ndarray:
        """Rows each lane has taken when all lanes with a load up to ``level`` took one."""
        return np.where(loads <= level, (level - loads) // cost + 1, 0)

    low, high = int(loads.min()) - 1, int(loads.min()) + cost * rows
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if int(taken(middle).sum()) >= rows else (middle, high)
    counts = taken(low)
    (last,) = np.nonzero(taken(high) > counts)
    counts[last[: rows - int(counts.sum())]] += 1
    return counts


def least_loaded(
    df: DataFrame, cost: str, count: int, pos: str = "pos", out: str = "lane", rows: int | None = None, bits: int = 12, tasks: int | None = None
) -> DataFrame:
    """Deal rows to ``count`` lanes, each to the lane of the least cost so far, dearest rows first.

    Costs are integers from 0 up, NULL counts as 0. Rows of one cost class are alike, so the greedy
    rule runs on counts per class, on the driver: there are at most ``2^bits + 64 * 2^(bits-1)``
    classes whatever the table (costs under ``2^bits`` are exact classes, dearer ones keep their
    highest ``bits`` bits and are planned with their mean). With exact classes loads are just those
    of the greedy rule row by row, so they differ by no more than the dearest row. The rows of a
    class are then dealt by position, in one exchange, however many rows share one cost.
    """
    refuse_existing(df, out)
    if count < 1:
        raise ValueError("at least one lane is needed")
    total = row_count(df, rows)
    value = F.greatest(F.coalesce(F.col(cost).cast("bigint"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))
    classed = df.withColumn("_class", cost_class(value, bits))
    sizes = classed.groupBy("_class").agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("sum")).toPandas()
    sizes = sizes.sort_values("_class", ascending=False)
    loads, first, parts = np.zeros(count, np.int64), 0, []
    for number, summed in zip(sizes["rows"].tolist(), sizes["sum"].tolist()):
        counts = fill(loads, round(summed / number), number)
        loads += np.rint(counts * (summed / number)).astype(np.int64) if summed % number else counts * (summed // number)
        (some,) = np.nonzero(counts)
        starts = first + np.cumsum(counts[some]) - counts[some]
        parts.append(pd.DataFrame({"first": starts, "size": counts[some], "_lane": some}))
        first += number
    plan = pd.concat(parts) if parts else pd.DataFrame({"first": [], "size": [], "_lane": []}, dtype="int64")
    intervals = df.sparkSession.createDataFrame(plan.astype("int64"), "first bigint, size bigint, _lane bigint")
    keyed = classed.withColumn("_order", -F.col("_class"))
    placed = position_by_value(keyed, F.col("_order"), F.col(pos), [pos], "_seat", total, tasks)
    dealt = in_interval(placed, "_seat", intervals, "first", "size", ["_lane"])
    return dealt.withColumnRenamed("_lane", out).drop("_class", "_order", "_seat")

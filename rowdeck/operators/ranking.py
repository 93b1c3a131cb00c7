"""Dense positions without a single-partition window.

Rows are cut into *cells*: ordered, non-overlapping slices of the wanted order, about as
many as there are reduce tasks. Contiguous runs of cells go to tasks by number and are
sorted there, so the output is laid out in order after one exchange. A row's position is
its index in its task plus the rows of earlier tasks, which is arithmetic for small
lanes and else one count per task, broadcast.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from rowdeck.functions import idiv
from rowdeck.functions.hashing import slice_of
from rowdeck.operators.lanes import Lanes
from rowdeck.session import row_count, row_width, task_limit

CELL_ROWS = 1 << 17  # a lane of up to so many rows is one cell and needs no counting pass
TASK_ROWS = 1 << 13  # no more tasks than one per so many rows
CELL_BYTES, TASK_BYTES, MAX_TASK_BYTES = 1 << 24, 1 << 22, 1 << 28  # the same for wide rows, and the most for a task
SAMPLES_PER_CELL = 64

LANE, DRAW, CELL, TASK, BASE, SPOT = "_lane", "_draw", "_cell", "_task", "_base", "_spot"
INDEX_BITS = 33  # of monotonically_increasing_id: the row's index in its partition


def shares(df: DataFrame, rows: int, tasks: int | None) -> tuple[int, int, int]:
    """Rows of a cell, rows a task has at least, and the most tasks: by rows and by bytes, or as
    the caller asks."""
    if tasks is not None:
        if tasks < 1:
            raise ValueError("at least one task is needed")
        return max(1, -(-rows // tasks)), 1, tasks
    width = row_width(df)
    limit = max(task_limit(df.sparkSession, rows), -(-rows * width // MAX_TASK_BYTES))
    return min(CELL_ROWS, max(1, CELL_BYTES // width)), min(TASK_ROWS, max(1, TASK_BYTES // width)), limit


def laid_out(df: DataFrame, pos: str) -> DataFrame:
    """Note on a result that its partitions hold consecutive positions, for ordered sinks."""
    df._rowdeck_laid_out = pos
    return df


def refuse_existing(df: DataFrame, out: str) -> None:
    if out in df.columns:
        raise ValueError(f"the table already has a column {out}")


def _with_task(df: DataFrame, cells: int, tasks: int) -> DataFrame:
    """Contiguous runs of cells make a task; cell order becomes partition order."""
    task = F.col(CELL) if tasks == cells else idiv(F.col(CELL) * F.lit(tasks), cells)
    return df.withColumn(TASK, task.cast("int"))


def _with_index(tagged: DataFrame, tasks: int, order: list[Column | str], out: str) -> DataFrame:
    """Place the tasks, sort each by ``order`` and number its rows from 0.

    The number counts rows of a partition, so a row found in a partition other than its
    task's fails the job instead of being numbered wrongly.
    """
    placed = tagged.repartitionById(tasks, F.col(TASK)).sortWithinPartitions(*order)
    placed = placed.withColumn(SPOT, F.monotonically_increasing_id())
    index = F.col(SPOT).bitwiseAND(F.lit((1 << INDEX_BITS) - 1))
    at_home = F.shiftright(F.col(SPOT), INDEX_BITS) == F.col(TASK)
    astray = F.raise_error(F.lit("a row left its partition before it was numbered"))
    return placed.withColumn(out, F.when(at_home, index).otherwise(astray.cast("bigint"))).drop(SPOT)


def _with_counted_base(indexed: DataFrame, tagged: DataFrame, out: str) -> DataFrame:
    """Add the rows of earlier tasks to the index. The counts have one row per task."""
    before = Window.orderBy(TASK).rowsBetween(Window.unboundedPreceding, -1)
    counts = tagged.groupBy(TASK).agg(F.count(F.lit(1)).alias("rows"))
    base = counts.select(TASK, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(BASE))
    return indexed.join(F.broadcast(base), TASK).withColumn(out, F.col(out) + F.col(BASE)).drop(BASE)


def _checked(lanes: Lanes, pos: Column) -> Column:
    """The position's lane; a position outside the lanes fails the job."""
    outside = F.raise_error(F.lit(f"a position is not within 0 .. {lanes.rows - 1}")).cast("bigint")
    return F.when((pos >= 0) & (pos < lanes.rows), lanes.lane(pos)).otherwise(outside)


def cells_in_lanes(
    df: DataFrame, lanes: Lanes, pos: Column, draw: Column, tasks: int | None = None
) -> tuple[DataFrame, int, int]:
    """Tag rows with lane, draw, cell and task; returns cells per lane and tasks too.

    Draws must be hash-uniform: equal slices of the draw range are what keeps the cells
    of a lane even, however large the lane is.
    """
    cell_rows, task_rows, limit = shares(df, lanes.rows, tasks)
    needed = -(-lanes.largest // cell_rows)
    per_lane = max(1, min(needed, -(-limit // lanes.count)))
    tagged = df.withColumn(LANE, _checked(lanes, pos)).withColumn(DRAW, draw)
    tagged = tagged.withColumn(CELL, F.col(LANE) * F.lit(per_lane) + slice_of(F.col(DRAW), per_lane))
    cells = lanes.count * per_lane
    parts = min(cells if cells <= 2 * limit else limit, max(1, -(-lanes.rows // task_rows)))
    return _with_task(tagged, cells, parts), per_lane, parts


def _uneven(df: DataFrame, lanes: Lanes, pos: Column, draw: Column, tasks: int | None) -> tuple[DataFrame, int]:
    """Tag rows of lanes of very different sizes with lane, draw and task: a row's task follows
    from where its slice of its lane should begin in the result, so tasks are even in rows."""
    cell_rows, task_rows, limit = shares(df, lanes.rows, tasks)
    parts = max(1, min(limit, -(-lanes.rows // min(cell_rows, max(task_rows, -(-lanes.rows // limit))))))
    tagged = df.withColumn(LANE, _checked(lanes, pos)).withColumn(DRAW, draw)
    size = lanes.size(F.col(LANE))
    slices = F.greatest(idiv(size * F.lit(parts), max(1, lanes.rows)), F.lit(1).cast("bigint"))
    spot = lanes.start(F.col(LANE)) + idiv(slice_of(F.col(DRAW), slices) * size, slices)
    return tagged.withColumn(TASK, idiv(spot * F.lit(parts), max(1, lanes.rows)).cast("int")), parts


def position_in_lanes(
    df: DataFrame, lanes: Lanes, pos: Column, draw: Column, key: list[str], out: str, tasks: int | None = None
) -> DataFrame:
    """Add ``_lane`` and the position of each row when lanes are laid end to end and
    rows inside a lane are in the order of (draw, key)."""
    refuse_existing(df, out)
    if not lanes.even:
        tagged, parts = _uneven(df, lanes, pos, draw, tasks)
        placed = _with_index(tagged, parts, [LANE, DRAW, *key], out)
        placed = _with_counted_base(placed, tagged, out) if parts > 1 else placed
        return placed.drop(DRAW, TASK)
    tagged, per_lane, parts = cells_in_lanes(df, lanes, pos, draw, tasks)
    cells = lanes.count * per_lane
    order = [DRAW, *key] if parts == cells else [CELL, DRAW, *key]
    placed = _with_index(tagged, parts, order, out)
    if per_lane == 1:
        # whole lanes per task: the task starts where its first lane does, and ends before the next one's
        def first(task: Column) -> Column:
            lane = idiv(task * F.lit(cells) + F.lit(parts - 1), parts) if parts < cells else task
            return lanes.start(F.least(lane, F.lit(lanes.count).cast("bigint")))

        task = F.col(TASK).cast("bigint")
        spot = first(task) + F.col(out)
        over = F.raise_error(F.lit("a lane holds more rows than its rule allows")).cast("bigint")
        placed = placed.withColumn(out, F.when(spot < first(task + 1), spot).otherwise(over))
    else:
        placed = _with_counted_base(placed, tagged, out)
    return placed.drop(DRAW, CELL, TASK)


def position_by_value(
    df: DataFrame,
    value: Column,
    tie: Column,
    key: list[str],
    out: str,
    rows: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Add the position of each row in the order of (value, tie, key).

    ``value`` is numeric and may be skewed at will: cell borders come from a sample of
    (value, tie) pairs, so one value that holds a third of all rows is cut into many
    cells along ``tie``. ``tie`` is a non-negative BIGINT, ``key`` unique. NaN sorts
    after numbers and NULL last.
    """
    refuse_existing(df, out)
    total = row_count(df, rows)
    cell_rows, _, limit = shares(df, total, tasks)
    cells = max(1, min(limit, -(-total // cell_rows)))
    tagged = df.withColumn("_value", value).withColumn("_tie", tie)
    if not isinstance(tagged.schema["_value"].dataType, T.NumericType):
        raise TypeError("rows can be put in the order of numbers only")
    if cells == 1:
        tagged = tagged.withColumn(CELL, F.lit(0).cast("bigint"))
    else:
        tagged = _cut(tagged, total, cells)
    tagged = _with_task(tagged, cells, cells)
    placed = _with_index(tagged, cells, [F.col("_value").asc_nulls_last(), F.col("_tie"), *key], out)
    if cells > 1:
        placed = _with_counted_base(placed, tagged, out)
    return laid_out(placed.drop("_value", "_tie", CELL, TASK), out)


BLOCK = 1 << 16


def sum_of_earlier(df: DataFrame, index: str, value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over rows of a smaller ``index``, a distinct number from 0 up.

    Two levels: inside blocks of neighbouring indices, then over one row per block.
    """
    blocks = df.withColumn("_block", idiv(F.col(index), BLOCK))
    inside = Window.partitionBy("_block").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("_block").agg(F.sum(value).alias("_sum"))
    totals = totals.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_earlier"))
    summed = blocks.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(totals, "_block")
    return summed.withColumn(out, (F.col(out) + F.col("_earlier")).cast("bigint")).drop("_block", "_earlier")


LIMIT = 1.7976931348623157e308  # the largest finite double


def _as_number(value: Column) -> Column:
    """The value as a finite double; never decreases when the value grows. NaN and NULL,
    which sort last, get the largest one."""
    wide = F.nanvl(value.cast("double"), F.lit(LIMIT))
    return F.coalesce(F.least(F.greatest(wide, F.lit(-LIMIT)), F.lit(LIMIT)), F.lit(LIMIT))


def _kind(value: Column) -> Column:
    return F.when(value.isNull(), 2).when(F.isnan(value.cast("double")), 1).otherwise(0)


def _cut(df: DataFrame, rows: int, cells: int) -> DataFrame:
    """Add ``_cell``: how many sampled borders are at or before the row.

    Only the borders, fewer than ``cells`` of them, reach the driver.
    """
    every = max(1, rows // (SAMPLES_PER_CELL * cells))
    sample = df.select(
        _kind(F.col("_value")).alias("kind"),
        _as_number(F.col("_value")).alias("number"),
        F.col("_tie").alias("tie"),
    ).filter(F.pmod(F.xxhash64("tie", "number"), F.lit(every)) == 0)
    # the sample holds about SAMPLES_PER_CELL * cells rows, whatever the table holds
    by_order = Window.orderBy("kind", "number", "tie")
    borders = (
        sample.withColumn("at", F.row_number().over(by_order).cast("bigint"))
        .withColumn("size", F.count(F.lit(1)).over(Window.partitionBy()))
        .withColumn("slot", idiv(F.col("at") * F.lit(cells), F.col("size") + 1))
        .groupBy("slot")
        .agg(F.min(F.struct("at", "kind", "number", "tie")).alias("border"))
        .filter("slot > 0")
        .select("border.*")
        .collect()
    )
    numbers = sorted({b["number"] for b in borders if b["kind"] == 0})
    if len(numbers) == len(borders):
        # no value fills a cell: borders between values are enough
        tagged = _bucket(df.withColumn("_number", _as_number(F.col("_value"))), "_number", numbers, "_slot")
        tagged = tagged.drop("_number")
    else:
        tagged = _cut_along_tie(df, borders, numbers)
    # never NULL, and said so: else the join on the cell filters the scan by all this
    return tagged.withColumn(CELL, F.coalesce(F.col("_slot").cast("bigint"), F.lit(0).cast("bigint"))).drop("_slot")


def _cut_along_tie(df: DataFrame, borders: list[Row], numbers: list[float]) -> DataFrame:
    """Add ``_slot`` where some value, NaN or NULL fills whole cells by itself.

    Value and tie become one number, ``place of the value * span + tie``, compared with
    the borders' numbers.
    """
    place = {number: index for index, number in enumerate(numbers)}
    span = float(max(b["tie"] for b in borders) + 2)
    spots = {
        (place[b["number"]] if b["kind"] == 0 else len(numbers) + b["kind"] - 1) * span + b["tie"]
        for b in borders
    }
    tagged = _bucket(df.withColumn("_number", _as_number(F.col("_value"))), "_number", numbers, "_below")
    tagged = tagged.withColumn("_below", F.col("_below") - 1)  # last border at or below, -1 if none
    below, last = F.col("_below"), F.lit(span - 1)
    listed = F.split(F.lit(",".join(repr(n) for n in numbers)), ",").cast("array<double>")
    if numbers:
        tagged = tagged.withColumn("_border", F.get(listed, F.greatest(below, F.lit(0.0)).cast("int")))
    else:
        tagged = tagged.withColumn("_border", F.lit(None).cast("double"))
    tagged = tagged.withColumn("_exact", F.col("_border").try_cast(df.schema["_value"].dataType))
    # several long integers can share one double: only the one equal to the border is cut
    # along the tie, smaller ones stay before it and larger ones after it
    same = (below >= 0) & (F.col("_number") == F.col("_border"))
    tie = F.least(F.col("_tie").cast("double"), last)
    spot = (
        F.when(_kind(F.col("_value")) > 0, (F.lit(len(numbers) - 1) + _kind(F.col("_value"))) * F.lit(span) + tie)
        .when(same & (F.col("_value") == F.col("_exact")), below * F.lit(span) + tie)
        .when(same & (F.col("_value") < F.col("_exact")), (below - 1) * F.lit(span) + last)
        .otherwise(below * F.lit(span) + last)
    )
    tagged = _bucket(tagged.withColumn("_spot", spot), "_spot", sorted(spots), "_slot")
    return tagged.drop("_number", "_below", "_border", "_exact", "_spot")


def _bucket(df: DataFrame, column: str, borders: list[float], out: str) -> DataFrame:
    """Number of borders at or below the value (a binary search on the JVM)."""
    if not borders:
        return df.withColumn(out, F.lit(0.0))
    infinity = float("inf")
    splits = [-infinity, *borders, infinity]
    return Bucketizer(splits=splits, inputCol=column, outputCol=out).transform(df)

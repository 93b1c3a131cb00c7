"""Radix sort of integers: exact borders from digit histograms.

The key of a row is its value and then its position, cut into digits of eight bits from the top.
A histogram of the first digit shows which prefixes hold more rows than a cell may; only
these are counted by their next digit, and so on down. A value that fills a third of the
table is refined by the digits of the positions. Nothing is sampled and nothing is ordered in one
task: borders follow from counts, and so does the place where each cell begins in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowdeck.operators.ranking import TASK, _with_index, laid_out, refuse_existing, shares
from rowdeck.session import row_count

BITS = 8  # of a digit
SIGN = -(1 << 63)
NODE, CELL, DIGIT, NEXT, START = "_node", "_leaf", "_digit", "_next", "_start"
NULLS = 1 << BITS  # the first digit of rows without a value, after all others


def _digits(low: int | None, high: int | None, nulls: int, rows: int) -> list[tuple[str, int, int]]:
    """``(column, shift, width)`` of the digits, top down; leading bits that never differ are left out."""
    found = []
    unsigned = [x ^ SIGN & (1 << 64) - 1 if x >= 0 else x + (1 << 63) for x in (low, high)] if low is not None else [0, 0]
    spans = [("_key", (unsigned[0] ^ unsigned[1]).bit_length()), ("_at", max(rows - 1, 1).bit_length())]
    for column, span in spans:
        if column == "_key" and nulls and not span:
            span = 1  # values and nulls are told apart by the first digit
        while span > 0:
            width = min(BITS, span)
            span -= width
            found.append((column, span, width))
    return found


def _digit(column: str, shift: int, width: int, first: bool) -> Column:
    bits = F.shiftrightunsigned(column, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
    if column == "_at":
        return bits
    return F.when(F.col(column).isNull(), F.lit(NULLS if first else 0)).otherwise(bits)


def _step(tagged: DataFrame, entries: list[tuple[int, int, int | None, int | None]], digit: Column) -> DataFrame:
    """Follow one digit: rows of an open prefix get the next one, or their leaf. Prefixes are fewer
    than cells, and each has at most 257 digits, so the table has a proven size."""
    kinds = f"{NODE} int, {DIGIT} int, {NEXT} int, _found int"
    entries = tagged.sparkSession.createDataFrame(entries, kinds)
    joined = tagged.withColumn(DIGIT, digit).join(F.broadcast(entries), [NODE, DIGIT], "left")
    return joined.withColumn(CELL, F.coalesce(CELL, "_found")).drop(NODE, DIGIT, "_found").withColumnRenamed(NEXT, NODE)


def radix_sort(
    df: DataFrame, value: str, pos: str = "pos", out: str = "new_pos", rows: int | None = None, tasks: int | None = None
) -> DataFrame:
    """Ascending order of an integer column; equal values keep their order, NULL comes last.

    ``pos`` is a distinct number from 0 up. The input is read once for its range, once per digit
    that is needed (with d rows per cell wanted, values spread over r numbers need about
    ``log256(r / d)``), and once for the rows, which are exchanged once.
    """
    if not isinstance(df.schema[value].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError("digits are those of integers")
    refuse_existing(df, out)
    total = row_count(df, rows)
    cell_rows, _, limit = shares(df, total, tasks)
    cells = max(1, min(limit, -(-total // cell_rows)))
    key = F.col(value).cast("bigint").bitwiseXOR(F.lit(SIGN))  # unsigned order
    tagged = df.withColumn("_key", key).withColumn("_at", F.col(pos).cast("bigint"))
    order = [F.col(value).asc_nulls_last(), F.col(pos)]
    if cells == 1:
        placed = _with_index(tagged.withColumn(TASK, F.lit(0)), 1, order, out)
        return laid_out(placed.drop("_key", "_at", TASK), out)

    span = df.agg(F.min(value), F.max(value), F.count_if(F.col(value).isNull())).first()
    levels = _leaves(tagged, _digits(*span, total), -(-total // cells))
    leaves = sorted((path, count, number) for _, _, found in levels for path, count, number in found)
    starts, task_of, begins = 0, {}, {}
    for _, count, number in leaves:
        task = starts * cells // total
        begins.setdefault(task, starts)
        task_of[number] = task
        starts += count
    names = {task: k for k, task in enumerate(sorted(begins))}  # cells without a leaf of their own go
    for digit, entries, _ in levels:
        final = [(node, d, following, None if leaf is None else names[task_of[leaf]]) for node, d, following, leaf in entries]
        start = tagged if NODE in tagged.columns else tagged.withColumn(NODE, F.lit(0)).withColumn(CELL, F.lit(None).cast("int"))
        tagged = _step(start, final, digit)
    changed = F.raise_error(F.lit("the table changed while it was sorted")).cast("int")
    tagged = tagged.withColumn(TASK, F.coalesce(CELL, changed)).drop(NODE, CELL)
    base = df.sparkSession.createDataFrame([(names[t], s) for t, s in begins.items()], f"{TASK} int, {START} bigint")
    placed = _with_index(tagged, len(names), order, out).join(F.broadcast(base), TASK)
    return laid_out(placed.withColumn(out, F.col(out) + F.col(START)).drop("_key", "_at", TASK, START), out)


def _leaves(tagged: DataFrame, digits: list[tuple[str, int, int]], most: int):
    """Refine prefixes until none holds more than ``most`` rows: per level the digit, its entries
    ``(prefix, digit, next prefix, leaf)`` and the leaves ``(path, rows, number)`` found there.

    At most ``rows / most`` prefixes stay open on a level, so the counts of a level are at most
    257 times the number of cells.
    """
    levels, paths, leaf = [], {0: ()}, 0
    rows = tagged.select("_key", "_at").withColumn(NODE, F.lit(0)).withColumn(CELL, F.lit(None).cast("int"))
    for place, (column, shift, width) in enumerate(digits):
        digit = _digit(column, shift, width, place == 0)
        counts = rows.where(F.col(NODE).isNotNull()).groupBy(NODE, digit.alias(DIGIT)).agg(F.count(F.lit(1)).alias("rows"))
        entries, found, following = [], [], {}
        for node, d, count in sorted(map(tuple, counts.collect())):
            path = (*paths[node], d)
            if count <= most or place == len(digits) - 1:
                entries.append((node, d, None, leaf))
                found.append((path, count, leaf))
                leaf += 1
            else:
                entries.append((node, d, len(following), None))
                following[len(following)] = path
        levels.append((digit, entries, found))
        if not following:
            break
        rows = _step(rows, entries, digit)
        paths = following
    return levels

"""Random reorders. Each adds a new position column and keeps every row.

``key`` must be unique (equal keys would draw equal hashes and land side by side); a
dense position column always qualifies. Results depend on data and seed only, never on
partitioning. ``tasks`` sets how many tasks sort; else they follow rows and bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowdeck.functions.hashing import LANES, ORDER, SAMPLE, row_draw
from rowdeck.operators.lanes import Batches, Lanes, Pairs, Strided, ceil_chunks, half_rotate, merge_blocks
from rowdeck.operators.ranking import (
    BASE,
    CELL,
    DRAW,
    LANE,
    TASK,
    cells_in_lanes,
    laid_out,
    position_by_value,
    position_in_lanes,
    refuse_existing,
)
from rowdeck.operators.riffle import riffle_pairs
from rowdeck.session import row_count

TOP_LIMIT = 10_000  # samples up to this size are taken as a top-k
_RANK = "_rank"


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def keyed_shuffle(
    df: DataFrame, key: str | list[str], seed: int, out: str = "pos", rows: int | None = None, tasks: int | None = None
) -> DataFrame:
    """Uniform random order of the whole table as a dense position column."""
    keys = _keys(key)
    total = row_count(df, rows)
    whole = Batches(total, max(total, 1))
    nowhere = F.lit(0).cast("bigint")  # one lane, whatever the position
    placed = position_in_lanes(df, whole, nowhere, row_draw(df, ORDER, seed, keys), keys, out, tasks)
    return laid_out(placed.drop(LANE), out)


def rand_shuffle(df: DataFrame, seed: int | None = None) -> DataFrame:
    """The plain form: sort by ``rand``. No position column, repeatable only for equal
    input partitioning."""
    return df.orderBy(F.rand(seed))


def shuffle_order(
    df: DataFrame, key: str | list[str], seed: int, draw: str = "draw", use: int = ORDER
) -> tuple[DataFrame, list[str]]:
    """Columns to sort by for the order of ``keyed_shuffle``, for sinks that only need
    the rows in that order and no position."""
    keys = _keys(key)
    return df.withColumn(draw, row_draw(df, use, seed, keys)), [draw, *keys]


def lane_shuffle(
    df: DataFrame,
    lanes: Lanes,
    key: str | list[str],
    seed: int,
    pos: str = "pos",
    out: str = "new_pos",
    draw: Column | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Shuffle inside each lane and concatenate the lanes."""
    keys = _keys(key)
    chosen = row_draw(df, LANES, seed, keys) if draw is None else draw
    return laid_out(position_in_lanes(df, lanes, F.col(pos), chosen, keys, out, tasks).drop(LANE), out)


def lane_shuffle_in_place(
    df: DataFrame, lanes: Lanes, key: str | list[str], seed: int, pos: str = "pos", out: str = "new_pos", tasks: int | None = None
) -> DataFrame:
    """Permute the rows of each lane among the positions the lane already holds."""
    keys = _keys(key)
    ranked = position_in_lanes(df, lanes, F.col(pos), row_draw(df, LANES, seed, keys), keys, out, tasks)
    rank = F.col(out) - lanes.start(F.col(LANE))
    return ranked.withColumn(out, lanes.member(F.col(LANE), rank)).drop(LANE)


def column_lane_shuffle(
    df: DataFrame,
    lane: str,
    key: str | list[str],
    seed: int,
    out: str = "new_pos",
    rows: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Lane shuffle where the lane is a numeric data column of any skew: lanes follow
    one another in ascending order, rows inside a lane are in random order."""
    keys = _keys(key)
    drawn = df.withColumn("_order", row_draw(df, LANES, seed, keys))
    tie = F.shiftright(F.col("_order"), 1) + F.lit(1 << 62)
    placed = position_by_value(drawn, F.col(lane), tie, ["_order", *keys], out, rows, tasks)
    return laid_out(placed.drop("_order"), out)


def batch_shuffle(
    df: DataFrame,
    size: int,
    key: str | list[str],
    seed: int,
    pos: str = "pos",
    out: str = "new_pos",
    rows: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Shuffle inside fixed-size batches of consecutive rows."""
    return lane_shuffle(df, Batches(row_count(df, rows), size), key, seed, pos, out, tasks=tasks)


def rotate_shuffle(
    df: DataFrame, lanes: Lanes, seed: int, pos: str = "pos", out: str = "new_pos", tasks: int | None = None
) -> DataFrame:
    """Half-rotate each lane, then shuffle it; draws belong to the rotated places."""
    turned = half_rotate(df, lanes, pos, "_turned")
    return laid_out(lane_shuffle(turned, lanes, "_turned", seed, pos, out, tasks=tasks).drop("_turned"), out)


def chunk_then_global_shuffle(
    df: DataFrame, key: str | list[str], seed: int, out: str = "pos", rows: int | None = None, tasks: int | None = None
) -> DataFrame:
    """Shuffled chunks followed by a shuffle of the whole: the last step alone decides
    the order, so one keyed shuffle gives the same distribution for one exchange."""
    return keyed_shuffle(df, key, seed, out, rows, tasks)


def pair_exchange(
    df: DataFrame,
    count: int,
    key: str | list[str],
    seed: int,
    pos: str = "pos",
    out: str = "new_pos",
    rows: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Strided lanes mixed two by two: lanes 2i and 2i+1 are shuffled together."""
    return lane_shuffle(df, Pairs(Strided(row_count(df, rows), count)), key, seed, pos, out, tasks=tasks)


def cyclic_shuffle(
    df: DataFrame,
    count: int,
    key: str | list[str],
    seed: int,
    pos: str = "pos",
    out: str = "new_pos",
    rows: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Contiguous chunks permuted by one random cycle each, so that no row of a chunk
    with two or more rows stays where it was.

    Rows of a chunk in draw order hand on their positions: each takes the position of
    the next one, the last takes the first's.
    """
    keys = _keys(key)
    lanes = ceil_chunks(row_count(df, rows), count)
    refuse_existing(df, out)
    tagged, per_lane, parts = cells_in_lanes(df, lanes, F.col(pos), row_draw(df, LANES, seed, keys), tasks)
    order = Window.partitionBy(TASK, CELL).orderBy(DRAW, *keys)
    placed = tagged.repartitionById(parts, F.col(TASK)).withColumn(out, F.lead(pos).over(order))
    if per_lane == 1:
        closed = placed.withColumn(out, F.coalesce(F.col(out), F.first(pos).over(order)))
        return closed.drop(LANE, DRAW, CELL, TASK)
    # the last row of a cell takes over from the first of the chunk's next cell
    named = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    first = F.min(F.struct(F.col(DRAW), *named, F.col(pos).alias("at")))
    heads = tagged.groupBy(LANE, CELL).agg(first["at"].alias("first"))
    cells = Window.partitionBy(LANE).orderBy(CELL)
    heads = heads.select(
        CELL, F.coalesce(F.lead("first").over(cells), F.first("first").over(cells)).alias(BASE)
    )
    # where lanes have several cells, all cells together are at most twice the task limit
    return (
        placed.join(F.broadcast(heads), CELL)
        .withColumn(out, F.coalesce(F.col(out), F.col(BASE)))
        .drop(LANE, DRAW, CELL, TASK, BASE)
    )


def merge_shuffle(
    df: DataFrame,
    k: int,
    key: str | list[str],
    seed: int,
    pos: str = "pos",
    out: str = "new_pos",
    rows: int | None = None,
    coarse: bool = False,
    uniform: bool = False,
) -> DataFrame:
    """About 2k shuffled blocks, merged pair by pair until one is left.

    By default every merge ends in a shuffle of the merged block, which makes the result
    uniform, so the one keyed shuffle that has that distribution is run. ``coarse``
    leaves those shuffles out and really merges, by fair coins: rows keep their order inside a block.
    ``uniform`` merges too, drawing sides by the rows they have left, so that merging alone makes
    every order equally likely. Only positions go through the rounds; the other columns are joined
    once, at the end.
    """
    total = row_count(df, rows)
    if coarse and uniform:
        raise ValueError("merges are either by coins or uniform")
    if not (coarse or uniform):
        return keyed_shuffle(df, key, seed, out, total)
    refuse_existing(df, out)
    blocks = merge_blocks(total, k)
    narrow = df.select(*dict.fromkeys([pos, *_keys(key)]))
    moved = lane_shuffle(narrow, blocks, key, seed, pos, out).select(pos, out)
    width, step = blocks.batch, 0
    while width < total:
        step += 1
        moved = riffle_pairs(moved, total, width, seed + step, pos=out, out=out, uniform=uniform)
        width *= 2
    return df.join(moved, pos).select(*df.columns, out)


def permutation(df: DataFrame, key: str, seed: int, rows: int | None = None) -> DataFrame:
    """Random permutation table ``(pos, src)``; ``key`` is the dense position column."""
    return keyed_shuffle(df.select(F.col(key).alias("src")), "src", seed, "pos", rows)


def sample_k(
    df: DataFrame, size: int, key: str | list[str], seed: int, rows: int | None = None
) -> DataFrame:
    """Exactly ``min(size, rows)`` rows, uniformly without replacement: those with the
    smallest draws.

    The table is first cut to the rows below a draw that leaves a few more than ``size``;
    the cut is counted, and widened in the rare case that it left too few.
    """
    keys = _keys(key)
    total = row_count(df, rows)
    pool, order = shuffle_order(df, keys, seed, DRAW, SAMPLE)
    wanted = size + 10 * int(size**0.5) + 100
    while wanted < total:
        limit = wanted * (1 << 64) // total - (1 << 63)
        smaller = pool.filter(F.col(DRAW) < limit)
        if smaller.count() >= size:
            pool = smaller
            break
        wanted *= 4
    if size <= TOP_LIMIT:
        return pool.orderBy(*order).limit(size).drop(DRAW)
    nowhere = F.lit(0).cast("bigint")
    placed = position_by_value(pool, F.col(DRAW), nowhere, order, _RANK)
    return placed.filter(F.col(_RANK) < size).drop(_RANK, DRAW)

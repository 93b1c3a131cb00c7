"""Row maps, batched models and per-lane functions."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowdeck.functions import idiv
from rowdeck.operators.lanes import Batches, Lanes
from rowdeck.session import row_count, task_limit

_LOADED: dict[str, Callable] = {}  # in a Python worker: the model of the latest call


def map_features(df: DataFrame, source: str, out: str, change: Callable[[Column], Column]) -> DataFrame:
    """Add a transformed copy of an array column; the original stays."""
    return df.withColumn(out, F.transform(F.col(source), change))


def batch_predict(
    df: DataFrame,
    build_model: Callable[[], Callable[[pd.DataFrame], pd.Series]],
    inputs: list[str],
    out: str,
    out_type: str,
    batch_size: int = 360,
    tasks: int | None = None,
) -> DataFrame:
    """Add a model's answer per row.

    ``build_model`` runs once per Python worker and returns the model, which is called with
    batches of exactly ``batch_size`` rows of the input columns, only the last batch of a task being
    shorter, and answers one value per row; an exception in it fails the job. Rows left over from
    one Arrow batch wait for the next one, at most a batch of them. Only the inputs travel to
    Python, all columns stay as they are. ``tasks`` sets how many models run at most, without an
    exchange. For models whose answer depends on the batch see ``predict_in_batches``.
    """
    predict = _predictor(build_model, inputs, out_type, batch_size, None)
    source = df if tasks is None else df.coalesce(tasks)
    return source.withColumn(out, predict(*[F.col(c) for c in inputs]))


def predict_in_batches(
    df: DataFrame,
    build_model: Callable[[], Callable[[pd.DataFrame], pd.Series]],
    inputs: list[str],
    out: str,
    out_type: str,
    batch_size: int = 360,
    pos: str = "pos",
    rows: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Add a model's answer per row, the batches being rows ``0 .. size-1``, ``size .. 2*size-1`` and
    so on of the whole table, however it was partitioned.

    Rows are laid out by position, whole batches to a task (one exchange). Positions must be
    dense; a gap or a repeated one fails the job.
    """
    total = max(row_count(df, rows), 1)
    lanes = Batches(total, batch_size)
    parts = min(lanes.count, tasks or task_limit(df.sparkSession, total))
    task = F.least(idiv(lanes.lane(F.col(pos)) * F.lit(parts), lanes.count), F.lit(parts - 1)).cast("int")
    placed = df.withColumn("_task", task).repartitionById(parts, F.col("_task")).sortWithinPartitions(pos).drop("_task")
    predict = _predictor(build_model, inputs, out_type, batch_size, total)
    # nondeterministic, so that the sort under it is kept whatever follows
    return placed.withColumn(out, predict.asNondeterministic()(F.col(pos).cast("bigint"), *[F.col(c) for c in inputs]))


def _predictor(build_model: Callable, inputs: list[str], out_type: str, batch_size: int, rows: int | None):
    """The model as a function of columns. With ``rows``, the first column is the position, and
    batches must begin at multiples of their size."""
    if batch_size < 1:
        raise ValueError("a batch needs at least one row")
    name = uuid.uuid4().hex
    ordered = rows is not None

    def answers(model: Callable, frame: pd.DataFrame) -> np.ndarray:
        if ordered:
            at = frame.pop("_at").to_numpy()
            whole = len(frame) == batch_size or at[-1] == rows - 1
            if at[0] % batch_size or not whole or not np.array_equal(at, np.arange(at[0], at[0] + len(at))):
                raise ValueError("positions are not dense")
        found = np.asarray(model(frame))
        if len(found) != len(frame):
            raise ValueError("the model must answer one value per row")
        return found

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        if name not in _LOADED:
            _LOADED.clear()
            _LOADED[name] = build_model()
        model = _LOADED[name]
        held, count = [], 0
        names = ["_at", *inputs] if ordered else inputs
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            held.append(pd.DataFrame(dict(zip(names, columns))))
            count += len(held[-1])
            if count >= batch_size:
                frame = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                full = count - count % batch_size
                yield pd.Series(np.concatenate([answers(model, frame.iloc[low : low + batch_size].copy()) for low in range(0, full, batch_size)]))
                held, count = [frame.iloc[full:]], count - full
        if count:
            yield pd.Series(answers(model, pd.concat(held, ignore_index=True)))

    return F.pandas_udf(run, out_type)


def linear_model(weights: np.ndarray, features: str) -> Callable[[], Callable]:
    """A pluggable model: index of the class (row of ``weights``) with the top score."""

    def build():
        matrix = np.asarray(weights, dtype="float64").T

        def predict(batch: pd.DataFrame) -> np.ndarray:
            rows = np.stack(batch[features].to_numpy()).astype("float64")
            return (rows @ matrix).argmax(axis=1)

        return predict

    return build


def predict_sample(df: DataFrame, size: int, order: str, **predict) -> DataFrame:
    """The model on the first ``size`` rows only."""
    return batch_predict(df.orderBy(order).limit(size), **predict)


def apply_per_lane(
    df: DataFrame,
    lanes: Lanes,
    function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: str | T.StructType,
    pos: str = "pos",
) -> DataFrame:
    """Run a pandas function on each lane, its rows in the order of their positions.

    The function gets an iterator of frames, one lane's rows bit by bit, and yields frames,
    so a lane may be of any size: its rows are sorted on disk and streamed. One lane is
    one task's work, since the function may carry state along it.
    """
    laned = df.withColumn("_lane", lanes.lane(F.col(pos))).repartition("_lane").sortWithinPartitions("_lane", pos)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts() -> Iterator[tuple[int, pd.DataFrame]]:
            for frame in frames:
                borders = np.flatnonzero(np.diff(frame["_lane"].to_numpy())) + 1
                for low, high in itertools.pairwise([0, *borders.tolist(), len(frame)]):
                    if high > low:
                        part = frame.iloc[low:high]
                        yield part["_lane"].iloc[0], part.drop(columns="_lane").reset_index(drop=True)

        for _, group in itertools.groupby(parts(), key=lambda part: part[0]):
            yield from function(part for _, part in group)

    return laned.mapInPandas(run, schema)


def write_predictions(predictions: DataFrame, path: str, drop: list[str]) -> None:
    """Drop the heavy input columns and write parquet."""
    predictions.drop(*drop).write.mode("errorifexists").parquet(path)

"""Small in-memory data as DataFrames, with explicit column names and positions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def from_items(spark: SparkSession, items: list, kind: str | None = None) -> DataFrame:
    """Scalars land in a column ``item``; records keep their field names."""
    if items and isinstance(items[0], dict):
        return from_pandas(spark, pd.DataFrame.from_records(items))
    if kind is not None:
        rows = [(index, item) for index, item in enumerate(items)]
        return spark.createDataFrame(rows, f"pos bigint, item {kind}")
    return from_pandas(spark, pd.DataFrame({"item": items}))


def from_numpy(spark: SparkSession, array: np.ndarray, out: str = "data") -> DataFrame:
    """A one-dimensional array as column ``data``."""
    return from_pandas(spark, pd.DataFrame({out: array}))


def from_pandas(spark: SparkSession, frame: pd.DataFrame) -> DataFrame:
    """A pandas frame with the row number as ``pos``."""
    numbered = frame.reset_index(drop=True)
    numbered.insert(0, "pos", np.arange(len(numbered), dtype="int64"))
    return spark.createDataFrame(numbered)

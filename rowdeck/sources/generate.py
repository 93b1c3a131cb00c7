"""Generated tables. Values are hashes of the row number: any partitioning gives the same
table, and a lost task regenerates its own rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowdeck.functions import uniform, uniform_int


def sequence(spark: SparkSession, rows: int, out: str = "data") -> DataFrame:
    """``0 .. rows-1`` with its position."""
    return spark.range(rows).select(F.col("id").alias("pos"), F.col("id").alias(out))


def uniforms(spark: SparkSession, rows: int, seed: int, kind: str = "double", out: str = "value") -> DataFrame:
    """Uniform numbers in [0, 1)."""
    return spark.range(rows).select(F.col("id").alias("pos"), uniform(seed, "id").cast(kind).alias(out))


def integers(
    spark: SparkSession, rows: int, seed: int, low: int, high: int, inclusive: bool = False, out: str = "value"
) -> DataFrame:
    """Uniform integers; ``inclusive`` says whether ``high`` itself can come up."""
    value = uniform_int(seed, low, high, "id", inclusive=inclusive)
    return spark.range(rows).select(F.col("id").alias("pos"), value.alias(out))

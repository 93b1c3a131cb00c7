"""Operators over two ordered tables, or a table and its permutation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowdeck.session import row_count


def zip_join(left: DataFrame, right: DataFrame, pos: str = "pos") -> DataFrame:
    """Pair rows by position; the longer table's tail is dropped, as ``zip`` does."""
    return left.join(right, pos)


def zip_add(left: DataFrame, right: DataFrame, a: str, b: str, pos: str = "pos", out: str = "total") -> DataFrame:
    """Element-wise sum of two aligned columns."""
    return zip_join(left, right, pos).withColumn(out, F.col(a) + F.col(b))


def gather(df: DataFrame, indices: DataFrame, pos: str = "pos", src: str = "src") -> DataFrame:
    """``out[i] = data[indices[i]]``: ``indices`` is ``(pos, src)``.

    An index at which the data has no row fails the job, as it does for a list.
    """
    data = df.withColumnRenamed(pos, src).withColumn("_there", F.lit(True))
    absent = F.raise_error(F.lit("an index points at no row")).cast("bigint")
    joined = indices.join(data, src, "left")
    return joined.withColumn(pos, F.when(F.col("_there"), F.col(pos)).otherwise(absent)).drop("_there")


def concat(left: DataFrame, right: DataFrame, pos: str = "pos", left_rows: int | None = None) -> DataFrame:
    """Rows of ``right`` after those of ``left``; duplicates stay."""
    shift = F.lit(row_count(left, left_rows)).cast("bigint")
    return left.unionByName(right.withColumn(pos, F.col(pos) + shift))


def missing_elements(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Rows of ``left`` whose value is nowhere in ``right``; left duplicates stay.

    The right side is made distinct first, so a value that fills much of it costs one
    row; a hot value on the left is split at run time by the skew join.
    """
    return left.join(right.select(value).distinct(), value, "left_anti")


def flatten(df: DataFrame, columns: list[str], kind: str, pos: str = "pos") -> DataFrame:
    """All values of each record in column order, as ``(pos, value)``."""
    width = len(columns)
    values = F.array(*[F.col(c).cast(kind) for c in columns])
    exploded = df.select(F.col(pos).alias("_row"), F.posexplode(values).alias("_nth", "value"))
    return exploded.select((F.col("_row") * F.lit(width) + F.col("_nth")).alias(pos), "value")


def lookup_label(df: DataFrame, labels: DataFrame, index: str, key: str, strict: bool = False) -> DataFrame:
    """Class index to label; every row stays. A class without a label gets NULLs or, when
    ``strict``, fails the job. No broadcast is forced: Spark checks the table's size."""
    joined = df.join(labels.withColumn("_known", F.lit(True)), F.col(index) == F.col(key), "left").drop(key)
    if strict:
        absent = F.raise_error(F.lit("a class has no label")).cast(df.schema[index].dataType)
        joined = joined.withColumn(index, F.when(F.col("_known"), F.col(index)).otherwise(absent))
    return joined.drop("_known")


def apply_cast(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Strict casts by column name; a bad value raises."""
    casts: dict[str, Column] = {name: F.col(name).cast(kind) for name, kind in columns.items()}
    return df.withColumns(casts)

"""Ordered text sinks and parquet.

Part files are written so that reading them by name gives the wanted order. With a dense
position column the target file is computed from the position, so nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from rowdeck.functions import idiv
from rowdeck.operators.lanes import Lanes
from rowdeck.session import row_count, row_width, shuffle_width, task_limit

FILE_ROWS = 1 << 17  # no more files than one per so many rows, unless asked for
FILE_BYTES, MAX_FILE_BYTES = 1 << 24, 1 << 28  # the same for wide rows, and the most for a file


def in_order(
    df: DataFrame, pos: str = "pos", rows: int | None = None, files: int | None = None, laid_out: bool = False
) -> DataFrame:
    """Lay rows out by dense position: partition 0 holds the first, and so on.

    Pass ``laid_out`` for the very result of a keyed, lane, batch or split shuffle or of a sort:
    its partitions already hold consecutive positions, and nothing is exchanged. Anything
    else, and a wish for a number of files, is refused then. (Partitions are sorted again,
    because Spark drops an inner sort that nothing seems to need.)
    """
    if laid_out:
        if getattr(df, "_rowdeck_laid_out", None) != pos:
            raise ValueError(f"this table is not known to be laid out by {pos}")
        if files is not None:
            raise ValueError("the files of a laid-out table are its partitions")
        return df.sortWithinPartitions(pos)
    total = max(row_count(df, rows), 1)
    parts = min(_files(df, total) if files is None else files, total)
    spot = F.least(idiv(F.col(pos) * F.lit(parts), total), F.lit(parts - 1)).cast("int")
    placed = df.withColumn("_file", spot).repartitionById(parts, F.col("_file"))
    return placed.sortWithinPartitions(pos).drop("_file")


def _files(df: DataFrame, total: int) -> int:
    """How many files the rows are worth, by their number and width."""
    width = row_width(df)
    most = max(task_limit(df.sparkSession, total), -(-total * width // MAX_FILE_BYTES))
    return min(most, -(-total // min(FILE_ROWS, max(1, FILE_BYTES // width))))


def in_key_order(df: DataFrame, order: list[str], files: int | None = None) -> DataFrame:
    """Lay rows out by any sort key (a draw, say) when there is no position column."""
    parts = files or shuffle_width(df.sparkSession)
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _write_text(ordered: DataFrame, text: Column, path: str, separator: str = "\n") -> None:
    ordered.select(text.alias("value")).write.mode("errorifexists").option("lineSep", separator).text(path)


def write_lines(df: DataFrame, path: str, value: str, pos: str = "pos", **layout) -> None:
    """One element per line, in position order."""
    _write_text(in_order(df, pos, **layout), F.col(value).cast("string"), path)


def write_integers(df: DataFrame, path: str, value: str, pos: str = "pos", **layout) -> None:
    """One integer per line; fractions are cut off toward zero."""
    _write_text(in_order(df, pos, **layout), F.col(value).cast("bigint").cast("string"), path)


def write_tokens(df: DataFrame, path: str, value: str, pos: str = "pos", **layout) -> None:
    """All elements separated by blanks instead of line ends."""
    _write_text(in_order(df, pos, **layout), F.col(value).cast("string"), path, " ")


def write_dicts(df: DataFrame, path: str, value: str, pos: str = "pos", **layout) -> None:
    """One ``{"item": x}`` record per line."""
    ordered = in_order(df, pos, **layout)
    ordered.select(F.col(value).alias("item")).write.mode("errorifexists").json(path)


def write_shuffled_lines(df: DataFrame, path: str, value: str, order: list[str], files: int | None = None) -> None:
    """Lines in the order of sort columns, for output that needs no positions."""
    _write_text(in_key_order(df, order, files), F.col(value).cast("string"), path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Parquet, one file per task."""
    df.write.mode("errorifexists").parquet(path)


def write_lanes(df: DataFrame, lanes: Lanes, path: str, pos: str = "pos", files: int | None = None) -> DataFrame:
    """Write all lanes in one pass and return the manifest ``(lane, rows, files)``.

    Rows are dealt to tasks by where they stand when lanes are laid end to end (one exchange), so a
    large lane is written by many tasks, many small ones by one, and there are no more files than
    tasks and lanes together. Below ``path`` are ``rows`` (a folder per lane), ``manifest``, with empty
    lanes too, and ``schema``. ``read_lane`` reads one lane without looking at the others.
    """
    total = max(lanes.rows, 1)
    parts = min(_files(df, total) if files is None else files, total)
    lane = lanes.lane(F.col(pos))
    spot = lanes.start(lane) + lanes.rank(F.col(pos))
    task = F.least(idiv(spot * F.lit(parts), total), F.lit(parts - 1)).cast("int")
    placed = df.withColumn("_lane", lane).withColumn("_task", task).repartitionById(parts, F.col("_task"))
    ordered = placed.sortWithinPartitions("_lane", pos).drop("_task")
    ordered.write.mode("errorifexists").partitionBy("_lane").parquet(f"{path}/rows")
    spark = df.sparkSession
    df.limit(0).write.mode("errorifexists").parquet(f"{path}/schema")
    every = spark.range(lanes.count).withColumnRenamed("id", "lane")
    if lanes.rows:
        found = spark.read.parquet(f"{path}/rows").groupBy(F.col("_lane").cast("bigint").alias("lane"))
        counts = found.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("_metadata.file_path").alias("files"))
        zero = F.lit(0).cast("bigint")
        every = every.join(counts, "lane", "left").select("lane", F.coalesce("rows", zero).alias("rows"), F.coalesce("files", zero).alias("files"))
    else:
        every = every.select("lane", *[F.lit(0).cast("bigint").alias(name) for name in ("rows", "files")])
    every.write.mode("errorifexists").parquet(f"{path}/manifest")
    return lane_manifest(spark, path)


def lane_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(lane, rows, files)`` of what ``write_lanes`` left."""
    return spark.read.parquet(f"{path}/manifest")


def read_lane(spark: SparkSession, path: str, number: int) -> DataFrame:
    """One lane of what ``write_lanes`` left, from its own files only."""
    schema = spark.read.parquet(f"{path}/schema").schema
    found = lane_manifest(spark, path).where(F.col("lane") == number).first()
    if found is None:
        raise ValueError(f"there is no lane {number}")
    if found["rows"] == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/rows/_lane={number}")


def iterate(df: DataFrame, pos: str = "pos") -> Iterator[Row]:
    """Rows in order, one partition at a time on the driver; for small results."""
    return in_order(df, pos).toLocalIterator()

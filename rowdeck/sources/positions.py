"""Dense positions for tables that carry none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rowdeck.session import durable

BROADCAST_PARTS = 1 << 18  # files or file blocks whose offsets are broadcast


def _offsets(counts: DataFrame, order: list[str]) -> DataFrame:
    """Add ``_offset``: rows in earlier parts. One row per file, block or partition."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def _shifted(df: DataFrame, offsets: DataFrame, on: list[str], local: Column, parts: int, out: str) -> DataFrame:
    """Add part offset and local row number. A row that is not among the counted rows of
    its part fails the job rather than vanish or take another row's place."""
    table = F.broadcast(offsets) if parts <= BROADCAST_PARTS else offsets
    changed = F.raise_error(F.lit("the input changed between two reads")).cast("bigint")
    counted = (local >= 0) & (local < F.col("_rows"))
    return df.join(table, on, "left").withColumn(out, F.when(counted, F.col("_offset") + local).otherwise(changed))


def number_parquet(spark: SparkSession, path: str | list[str], out: str = "pos") -> DataFrame:
    """Read parquet with dense positions: files by path, rows by their index in the file.

    The count per file reads no column; no row is exchanged.
    """
    paths = [path] if isinstance(path, str) else path
    source = spark.read.parquet(*paths)
    tagged = source.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    counts = tagged.groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = _offsets(counts, ["_file"]).select("_file", "_rows", "_offset")
    numbered = _shifted(tagged, offsets, ["_file"], F.col("_row"), len(source.inputFiles()), out)
    return numbered.drop("_file", "_row", "_rows", "_offset")


def number_text(spark: SparkSession, path: str | list[str], out: str = "pos") -> DataFrame:
    """Read text lines with dense positions: files by path, then lines in file order.

    A line is placed by the file block it was read from and its place in that block.
    """
    source = spark.read.text(path)
    tagged = source.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seen"),
    )
    counts = tagged.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_seen").alias("_first")
    )
    offsets = _offsets(counts, ["_file", "_block"]).select("_file", "_block", "_first", "_rows", "_offset")
    parts = source.rdd.getNumPartitions() + len(source.inputFiles())
    local = F.col("_seen") - F.col("_first")
    numbered = _shifted(tagged, offsets, ["_file", "_block"], local, parts, out)
    return numbered.select(out, "value")


def number_rows(df: DataFrame, out: str = "pos") -> DataFrame:
    """Dense positions for any DataFrame, in partition order.

    The rows are first written to the checkpoint folder, so both reads (count and rows)
    see the same partitions.
    """
    fixed = durable(df.withColumn("_seen", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_seen"), 33)
    tagged = fixed.withColumn("_part", part).withColumn("_row", F.col("_seen").bitwiseAND((1 << 33) - 1))
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = _offsets(counts, ["_part"]).select("_part", "_rows", "_offset")
    numbered = _shifted(tagged, offsets, ["_part"], F.col("_row"), fixed.rdd.getNumPartitions(), out)
    return numbered.select(out, *df.columns)

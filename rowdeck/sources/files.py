"""Text and binary scans. Schemas are fixed by the reader, never inferred, and a line that
does not parse fails the job.

Each text scan is a file read plus a ``parse_*`` function over a string column, so the
same parsing works on any table of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowdeck.functions import strip


def parse_numbers(lines: DataFrame, kind: str = "double", line: str = "value", out: str = "value") -> DataFrame:
    """One number per line, blanks around it ignored."""
    return lines.withColumn(out, strip(F.col(line)).cast(kind))


def parse_tokens(lines: DataFrame, kind: str = "double", line: str = "value", out: str = "value") -> DataFrame:
    """One row per whitespace-separated number; ``nth`` is its place in the line."""
    tokens = F.filter(F.split(F.col(line), r"\s+"), lambda token: token != "")
    kept = [c for c in lines.columns if c not in (line, out)]
    return lines.select(*kept, F.posexplode(tokens.cast(f"array<{kind}>")).alias("nth", out))


def parse_dicts(lines: DataFrame, kind: str = "double", line: str = "value", out: str = "item") -> DataFrame:
    """One ``{'item': x}`` record per line, single or double quotes."""
    options = {"allowSingleQuotes": "true", "mode": "FAILFAST"}
    parsed = F.from_json(F.col(line), f"item {kind}", options)
    return lines.withColumn(out, parsed["item"])


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw lines, stripped, not parsed: ``value STRING``."""
    return spark.read.text(path).select(strip(F.col("value")).alias("value"))


def read_numbers(spark: SparkSession, path: str | list[str], kind: str = "double") -> DataFrame:
    """A file of one number per line (``double``, ``int``, ``float``, ...)."""
    return parse_numbers(spark.read.text(path), kind)


def read_tokens(
    spark: SparkSession, path: str | list[str], kind: str = "double", separator: str = " "
) -> DataFrame:
    """A file of numbers separated by any whitespace.

    Records end at ``separator``, so that a file on one line is split among tasks; other
    whitespace inside a record is split as well.
    """
    return parse_tokens(spark.read.option("lineSep", separator).text(path), kind).select("value")


def read_dicts(spark: SparkSession, path: str | list[str], kind: str = "double") -> DataFrame:
    """A file of ``{'item': x}`` lines, reduced to ``item``."""
    return parse_dicts(spark.read.text(path), kind).select("item")


def read_binary(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Images or other binary files: path, modificationTime, length, content.

    A plan that does not use ``content`` does not read it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)

"""Intermediate tables of one run, and joins that no single key can slow down."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowdeck.session import checkpoint_folder

HOT = 1024  # a key with more than one in HOT of all rows is hot, so there are fewer than HOT of them


class Shelf:
    """Tables written to the shared checkpoint folder and deleted when a later one replaces them.

    A result that is still to be read depends on the tables that were not dropped; these stay in
    the folder, like files of ``checkpoint()``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_folder(spark)}/shelf-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and go on from the written table."""
        path = f"{self.folder}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = table, path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[id(table)][1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], times: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with a table that has one row per key and, as ``times``, how many
    of the ``total`` rows hold it.

    Hot keys are fewer than HOT whatever the table holds, so their entries are broadcast and
    their rows stay where they are; all other rows are exchanged by key, no key of them
    holding more than one in HOT. Both inputs are read twice and should be written tables.
    """
    hot = F.col(times) * F.lit(HOT) > F.lit(total)
    few = table.where(hot).drop(times)
    still = rows.join(F.broadcast(few), keys)
    moved = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(table.where(~hot).drop(times), keys)
    return still.unionByName(moved)

"""Session helpers: a tuned local session, conf lookups and durable cuts of lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

MAX_TASK_ROWS = 1 << 24
WIDTH_ROWS = 100  # rows looked at for the width of strings, arrays and the like


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rowdeck")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shuffle_width(spark: SparkSession) -> int:
    """The number of reduce tasks the cluster is sized for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def task_limit(spark: SparkSession, rows: int) -> int:
    """Most tasks to cut ``rows`` into: twice the shuffle partitions, or more where that
    would leave tasks of over MAX_TASK_ROWS rows."""
    return max(2 * shuffle_width(spark), -(-rows // MAX_TASK_ROWS))


def row_width(df: DataFrame) -> int:
    """Bytes of a row: known for numbers and times, else the mean over a few first rows.

    Looking runs one small job, and only where columns of no fixed width exist.
    """

    def measured(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.octet_length(F.col(f"`{field.name}`"))
        return F.length(F.to_json(F.struct(F.col(f"`{field.name}`"))))

    loose = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)
    fields = [field for field in df.schema.fields if isinstance(field.dataType, loose)]
    fixed = 16 * (len(df.columns) - len(fields))
    if not fields:
        return max(1, fixed)
    size = sum((F.coalesce(measured(field), F.lit(0)) for field in fields), F.lit(0))
    mean = df.limit(WIDTH_ROWS).select(size.alias("size")).agg(F.avg("size")).first()[0]
    return max(1, fixed + int(mean or 0))


def row_count(df: DataFrame, rows: int | None) -> int:
    """``rows`` if the caller knows it, else one count (footer-only on a parquet scan)."""
    return df.count() if rows is None else rows


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all machines must share.

    Where it is unset a session of one machine, as in tests, gets a temporary folder; a
    cluster is refused, since no other machine could read the driver's disk.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="rowdeck-checkpoint-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written copy.

    Use it between operators when the input is expensive: most operators here read
    their input twice (once for a small count, once for the rows).
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)

"""Session helpers: the shared work folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only on a local master (tests,
    a laptop), and when neither that setting nor a checkpoint directory exists, is a
    scratch folder made: on a cluster executors would not see each other's files.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="run-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the files.

    Used where a result is read several times or by an iterative operator: a
    lost executor then costs a re-read, never a replay of earlier rounds.
    """
    work_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """As :func:`cut`, for wide results of many rows: columns in compressed Parquet files, of which a reader takes only what it needs.

    Names must differ and types be those that Parquet has.
    """
    path = scratch_path(df.sparkSession, "kept")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """Partition count for compute-heavy stages over few bytes.

    AQE sizes partitions by bytes. Similarity joins are small in bytes and
    large in work, so they ask for this many partitions explicitly.
    """
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(shuffle, 4 * spark.sparkContext.defaultParallelism)

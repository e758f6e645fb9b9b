"""Session settings and shared scratch folders."""

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", **conf) -> SparkSession:
    """Session for tests and single-machine runs."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("merchframe")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g"))
    for key, val in conf.items():
        builder = builder.config(key, val)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's spark.checkpoint.dir.

    Where that is unset, a temporary folder stands in for a local master; on a cluster, where
    executors would not share it, this is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="merchframe-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffles of an execution are removed at its end, not at some later collection of garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str, lean: bool = False) -> DataFrame:
    """Write a table that several branches read to the shared folder, and read it back.

    The branches then share one computation, survive lost executors, and plan with the table's
    real size. `lean` is for large tables (see `write_lean`).
    """
    folder = shared_folder(df.sparkSession, name)
    if lean:
        return write_lean(df, folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def settle_parts(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """One table of several parts (at least one), each written by its own job and with only its own shuffles on the disk."""
    folder = None
    for part in parts:
        folder = folder or shared_folder(part.sparkSession, name)
        table = write_lean(part, folder, mode="append")
    return table


def write_lean(df: DataFrame, folder: str, by: str | None = None, mode: str = "error") -> DataFrame:
    """The table in `folder`, one folder for each value of `by`, packed closer than Spark packs tables if not told.

    The shuffles that made it leave the disk once it is written.
    """
    spark = df.sparkSession
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(folder, mode=mode, partitionBy=by, compression="zstd")
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(folder)

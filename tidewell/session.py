"""Session factory: UTC, ANSI, adaptive execution; everything else is the cluster's."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tidewell", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def setting(spark: SparkSession, flag: str | None, key: str, default: str) -> str:
    """SC17: an explicit flag, else the session's setting, else the default."""
    return flag if flag is not None else spark.conf.get(key, default)


def small_batches(df: DataFrame, most: str = "4194304b") -> DataFrame:
    """df, with its session's Arrow batches bounded to `most` bytes unless they were set otherwise.

    Where whole texts go to Python workers, the usual bounds of 10,000 rows or 64 MiB, held by every task as
    a batch, its pandas copy and its results, grow an executor with its files until all batches are full.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) in (None, "67108864b", "64m", "64MB"):
        df.sparkSession.conf.set(key, most)
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all machines reach; a temporary one under a local master alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")

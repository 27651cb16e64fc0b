"""Session settings the jobs rely on, and where they may write scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(app: str = "telemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # call-site capture costs two driver round trips per column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """All times are compared as UTC microseconds."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a private one is
    chosen only where none is set, which a cluster refuses."""
    context = spark.sparkContext
    folder = (
        context.getCheckpointDir()
        or context.getConf().get(CHECKPOINT_DIR)
        or spark.conf.get(CHECKPOINT_DIR, None)
    )
    if folder is None:
        # "local-cluster" has executors of its own, like any cluster
        if context.master.partition("[")[0] != "local":
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="telemark-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write a DataFrame once as a table in the shared folder and read it back.

    Used where several branches read the same shuffled result: each branch then
    scans the columns it needs instead of repeating the upstream joins, and a
    lost executor costs a re-read only.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

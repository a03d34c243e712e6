"""Session helpers: a local session for tests, and the shared folder that cuts lineage."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "datamill", **conf: str) -> SparkSession:
    """A local session for tests and the benchmark. A cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("DATAMILL_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.datamill.spread", str(cpus))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.checkpoint.dir", os.environ.get("DATAMILL_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="datamill-checkpoint-"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of this session, below the one that ``spark.checkpoint.dir`` names.

    Only a session that runs wholly on one machine may leave the setting out and gets a temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="datamill-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written copy."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows to as many partitions as ``spark.datamill.spread`` says; without it they stay.

    For tables of a few files with heavy work per row. A large table has enough partitions of its own, so a
    cluster leaves the setting out and pays no shuffle.
    """
    want = df.sparkSession.conf.get("spark.datamill.spread", None)
    return df.repartition(int(want)) if want and want.isdigit() else df

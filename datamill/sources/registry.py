"""Registry of trained models: an append-only table; the last row of a task is its current model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from datamill.sources.tables import append, latest, read_table

REGISTRY = T.StructType([
    T.StructField("task", T.StringType()), T.StructField("version", T.StringType()), T.StructField("task_type", T.StringType()),
    T.StructField("algorithm", T.StringType()), T.StructField("feature_mode", T.StringType()), T.StructField("accuracy", T.DoubleType()),
    T.StructField("train_size", T.LongType()), T.StructField("val_size", T.LongType()), T.StructField("path", T.StringType()),
    T.StructField("member", T.BooleanType()), T.StructField("ts", T.TimestampType()),
])


def register(rows: DataFrame, path: str) -> None:
    """Adds model versions; ``member`` marks models that only serve an ensemble."""
    have = set(rows.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in REGISTRY]
    stamped = rows.select(*cols).withColumn("ts", F.coalesce("ts", F.current_timestamp())).withColumn("member", F.coalesce("member", F.lit(False)))
    append(stamped, path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, REGISTRY)


def current(registry: DataFrame) -> DataFrame:
    """The current model of every task."""
    return latest(registry.where(~F.col("member")), ["task"], ["ts", "version"])


def versions(registry: DataFrame, task: str | None = None) -> DataFrame:
    """Versions, newest first; a version made current again is listed once, at its first time."""
    rows = registry.where(~F.col("member"))
    rows = rows if task is None else rows.where(F.col("task") == task)
    first = rows.groupBy("task", "version").agg(F.min_by(F.struct("algorithm", "accuracy", "path", "ts"), "ts").alias("r"))
    return first.select("task", "version", "r.*").orderBy("task", F.desc("ts"), F.desc("version"))


def members(registry: DataFrame, task: str | None = None) -> DataFrame:
    """The last model per algorithm that serves the ensemble of a task."""
    rows = registry.where("member")
    rows = rows if task is None else rows.where(F.col("task") == task)
    return latest(rows, ["task", "algorithm"], ["ts", "version"])


def rollback(spark: SparkSession, path: str, task: str, version: str) -> None:
    """Makes an older version current by adding its row again."""
    old = versions(read_registry(spark, path), task).where(F.col("version") == version)
    if old.isEmpty():
        raise ValueError(f"unknown version {version!r} of task {task!r}")
    register(old.drop("ts"), path)

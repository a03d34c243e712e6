"""Steps of a job that are made once: a state table says which attempt of a step counts.

The rows of an attempt are written to a folder of their own and become visible by one row in the state table,
keyed by task, round and step. A job that is run again, or whose driver was lost between the two, reads the steps that are
there and makes the others; folders without such a row are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from datamill.sources.tables import append, read_table

STATE = T.StructType([
    T.StructField("task", T.StringType()), T.StructField("round", T.IntegerType()), T.StructField("step", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("ts", T.TimestampType()),
])


@dataclass
class Steps:
    """The steps below one folder."""

    spark: SparkSession
    root: str

    def state(self) -> DataFrame:
        """One row per finished step; of two attempts that both finished the earlier one counts."""
        rows = read_table(self.spark, f"{self.root}/state", STATE)
        first = rows.groupBy("task", "round", "step").agg(F.min_by(F.struct("path", "rows", "ts"), F.struct("ts", "path")).alias("r"))
        return first.select("task", "round", "step", "r.*")

    def rounds(self, task: str) -> int:
        """Number of the last round of a task that finished a step, 0 if none."""
        return self.state().where(F.col("task") == task).agg(F.coalesce(F.max("round"), F.lit(0))).first()[0]

    def once(self, task: str, number: int, step: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The rows of a step, which is made if the state table doesn't have it."""
        here = (F.col("task") == task) & (F.col("round") == number) & (F.col("step") == step)
        found = self.state().where(here).first()
        if not found:
            path = f"{self.root}/{step}/{uuid.uuid4().hex}"
            make().write.parquet(path)
            n = self.spark.read.parquet(path).count()
            row = [(task, number, step, path, n)]
            done = self.spark.createDataFrame(row, T.StructType(STATE.fields[:-1])).withColumn("ts", F.current_timestamp())
            append(done.coalesce(1), f"{self.root}/state")
            found = self.state().where(here).first()
        return self.spark.read.parquet(found["path"])

    def every(self, task: str, step: str) -> DataFrame | None:
        """The rows of a step of all rounds, with the number of the round; nothing before the first."""
        out = None
        for found in self.state().where((F.col("task") == task) & (F.col("step") == step)).orderBy("round").collect():
            rows = self.spark.read.parquet(found["path"]).withColumn("round", F.lit(found["round"]))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

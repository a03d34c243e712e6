"""Shared vocabulary of many tasks: document frequencies per task, which add up to those of all.

A task's statistics are appended on their own, so a task is added or counted anew without reading the texts of the
others. Of several counts of a task the last one stands.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from datamill.functions.text import tokenize
from datamill.session import spread
from datamill.sources.tables import append, read_table

TERMS = T.StructType([
    T.StructField("term", T.StringType()), T.StructField("df", T.LongType()), T.StructField("run", T.StringType()), T.StructField("task", T.StringType()),
])
RUNS = T.StructType([
    T.StructField("task", T.StringType()), T.StructField("docs", T.LongType()), T.StructField("run", T.StringType()), T.StructField("ts", T.TimestampType()),
])


def count_terms(rows: DataFrame, text: str = "text") -> DataFrame:
    """``(term, df)``: in how many texts each word occurs; counted in the tasks before the shuffle."""
    words = spread(rows.select(F.coalesce(F.col(text), F.lit("")).alias("_t"))).select(F.array_distinct(tokenize("_t")).alias("_w"))
    return words.select(F.explode("_w").alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def add_task(rows: DataFrame, root: str, task: str, text: str = "text") -> None:
    """Count a task's texts and add them; the row in ``runs`` is written last and makes the count stand."""
    run = uuid.uuid4().hex
    append(count_terms(rows, text).withColumn("run", F.lit(run)).withColumn("task", F.lit(task)), f"{root}/terms", by="task")
    size = rows.agg(F.count("*").alias("docs")).select(F.lit(task).alias("task"), "docs", F.lit(run).alias("run"), F.current_timestamp().alias("ts"))
    append(size.coalesce(1), f"{root}/runs")


def task_sizes(spark: SparkSession, root: str) -> DataFrame:
    """``(task, docs, run)`` of the last count of every task."""
    runs = read_table(spark, f"{root}/runs", RUNS)
    last = runs.groupBy("task").agg(F.max_by(F.struct("docs", "run"), F.struct("ts", "run")).alias("r"))
    return last.select("task", "r.*")


def vocabulary(spark: SparkSession, root: str) -> DataFrame:
    """``(task, term, df, docs, total_df, total_docs)``: frequencies in the task and in all tasks together."""
    sizes = task_sizes(spark, root)
    own = read_table(spark, f"{root}/terms", TERMS).join(sizes, ["task", "run"]).select("task", "term", "df", "docs")
    total = own.groupBy("term").agg(F.sum("df").alias("total_df"))
    docs = sizes.agg(F.sum("docs")).scalar()
    return own.join(total, "term").select("task", "term", "df", "docs", "total_df", docs.alias("total_docs"))

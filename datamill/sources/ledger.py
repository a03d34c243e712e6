"""Ledger of model requests: what was asked, what was answered, what failed, by the content of the request.

A job that is repeated, after a failed call or a lost driver, asks only what has no answer yet. Open requests go out in
waves, each appended on its own, so a job that ends in the middle keeps the waves before. Open requests are stored by wave, and a
wave reads only its own. A prompt made of smaller columns is stored as these and put together again when it is asked.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from datamill.functions.hashing import text_key
from datamill.operators.responses import ask
from datamill.session import checkpoint_dir
from datamill.sources.tables import append, read_table

LEDGER = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("model", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("response", T.StringType()), T.StructField("ts", T.TimestampType()),
])
ANSWERED, FAILED = "answered", "failed"
#: Requests of a wave, which is kept whatever happens after it.
WAVE_ROWS = 10_000


def read_ledger(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """Per (key, model) its last answer, or its last failure if it was never answered."""
    rows = read_table(spark, path, LEDGER)
    rows = rows if model is None else rows.where(F.col("model") == model)
    order = F.struct((F.col("status") == ANSWERED).alias("a"), "ts", "response")
    last = rows.groupBy("key", "model").agg(F.max_by(F.struct("status", "response", "ts"), order).alias("r"), F.count("*").alias("asked"))
    return last.select("key", "model", "r.*", "asked")


def open_requests(requests: DataFrame, path: str, model: str, prompt: str = "prompt", parts: tuple[str, ...] | None = None) -> DataFrame:
    """``(key, prompt)``, or ``(key, *parts)``: distinct requests without an answer. A null request is none."""
    columns = list(parts or (prompt,))
    rows = requests.where(F.col(prompt).isNotNull()).select(text_key(prompt).alias("key"), F.struct(*columns).alias("_parts"))
    keyed = rows.groupBy("key").agg(F.any_value("_parts").alias("_parts"))
    done = read_ledger(requests.sparkSession, path, model).where(F.col("status") == ANSWERED).select("key")
    return keyed.join(done, "key", "left_anti").select("key", *[F.col(f"_parts.{c}").alias("prompt" if parts is None else c) for c in columns])


def _waves(sizes: list[tuple[int, int]], rows: int) -> list[list[int]]:
    """Stored shares put together to waves of about so many rows; a share is never cut."""
    waves: list[list[int]] = []
    held = rows
    for share, n in sorted(sizes):
        if held + n > rows:
            waves.append([])
            held = 0
        waves[-1].append(share)
        held += n
    return waves


def ask_open(
    requests: DataFrame, path: str, model: str, call: Callable[[list[str]], list[str]], prompt: str = "prompt", wave_rows: int = WAVE_ROWS,
    parts: tuple[str, ...] | None = None, made: Callable[[DataFrame], DataFrame] | None = None, **options,
) -> DataFrame:
    """Requests with ``status`` and ``response``, after asking those that the ledger has no answer for.

    With ``parts``, the columns that fix a prompt, only these are shuffled and stored, and ``made`` adds the prompt to them.
    ``options`` go to :func:`ask`: calls that keep failing are rows with status 'failed', asked again by the next job.
    """
    spark = requests.sparkSession
    todo = open_requests(requests, path, model, prompt, parts)
    shares = max(1, -(-requests.agg(F.count(prompt)).first()[0] // wave_rows))
    dealt = todo.withColumn("_share", F.pmod(F.xxhash64("key"), F.lit(shares).cast("bigint")))
    stored = f"{checkpoint_dir(spark)}/open-{uuid.uuid4().hex}"
    dealt.write.partitionBy("_share").parquet(stored)
    dealt = spark.read.schema(dealt.schema).parquet(stored)
    for wave in _waves([tuple(r) for r in dealt.groupBy("_share").count().collect()], wave_rows):
        part = dealt.where(F.col("_share").isin(wave)).drop("_share")
        if made is not None:
            part = made(part).select("key", F.col(prompt).alias("prompt"))
        status = F.when(F.col("response").isNull(), F.lit(FAILED)).otherwise(F.lit(ANSWERED))
        answers = ask(part, call, "prompt", **options).select("key", F.lit(model).alias("model"), status.alias("status"), "response", F.current_timestamp().alias("ts"))
        append(answers, path, by="model")
    said = read_ledger(spark, path, model).select(F.col("key").alias("_key"), "status", "response")
    # The key is a column of its own, so that the join carries a prompt only if the caller wants it.
    return requests.withColumn("_ask", text_key(prompt)).join(said, F.col("_ask") == F.col("_key"), "left").drop("_key", "_ask")

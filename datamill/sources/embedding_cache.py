"""Cache of embeddings as an append-only table: key of the text, model, vector, time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from datamill.functions.fixed_values import EMBED_BATCH
from datamill.functions.hashing import text_key
from datamill.session import cut_lineage
from datamill.sources.tables import append, clear, latest, live, read_table

CACHE = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("created_at", T.TimestampType()), T.StructField("model", T.StringType()),
])


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Per (key, model) the vector written last."""
    return latest(live(read_table(spark, path, CACHE)), ["key", "model"], ["created_at"])


def put(rows: DataFrame, path: str) -> None:
    """Adds vectors (key, model, embedding); a later one replaces an earlier one."""
    stamped = rows if "created_at" in rows.columns else rows.withColumn("created_at", F.current_timestamp())
    append(stamped.select(*CACHE.fieldNames()), path, by="model")


def clear_model(spark: SparkSession, path: str, model: str) -> int:
    return clear(read_table(spark, path, CACHE), path, "model", model)


def counts(cache: DataFrame) -> DataFrame:
    return cache.groupBy("model").agg(F.count_distinct("key").alias("n"))


def with_key(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("key", text_key(text))


def misses(texts: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Distinct texts the cache has no vector for. The model filter prunes partitions."""
    keyed = with_key(texts.where(F.col(text).isNotNull()), text).groupBy("key").agg(F.any_value(text).alias(text))
    return keyed.join(cache.where(F.col("model") == model).select("key"), "key", "left_anti")


def hits(texts: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    known = cache.where(F.col("model") == model).select("key")
    return with_key(texts, text).join(known, "key", "left_semi")


def attach(texts: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Texts with their vector, null where the cache has none."""
    vectors = cache.where(F.col("model") == model).select("key", "embedding")
    return with_key(texts, text).join(vectors, "key", "left")


def embed(missing: DataFrame, model: str, call: Callable[[list[str]], list[list[float]]], text: str = "text", size: int = EMBED_BATCH) -> DataFrame:
    """Vectors of the given texts from a user function, called with at most ``size`` texts.

    A call fails if it raises or does not return a vector per text; its texts are then sent one by one. Texts that fail
    alone too are left out and stay open in the cache.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def some(texts: list[str]) -> list | None:
            try:
                vectors = list(call(texts))
            except Exception:
                return None
            return vectors if len(vectors) == len(texts) else None

        for pdf in frames:
            for start in range(0, len(pdf), size):
                part = pdf.iloc[start:start + size]
                texts = part[text].tolist()
                vectors = some(texts)
                if vectors is None:
                    vectors = [(some([t]) or [None])[0] for t in texts] if len(texts) > 1 else [None]
                rows = [(k, model, v) for k, v in zip(part["key"], vectors) if v is not None]
                yield pd.DataFrame(rows, columns=["key", "model", "embedding"])

    return missing.select("key", text).mapInPandas(run, "key string, model string, embedding array<float>")


def embed_through_cache(
    texts: DataFrame, path: str, model: str, call: Callable[[list[str]], list[list[float]]], text: str = "text", wave_rows: int = 100_000,
) -> DataFrame:
    """Texts with vectors; only texts the cache does not know are embedded, once each, and kept.

    They are embedded in waves, each put into the cache on its own, so a job that ends early keeps the waves before.
    """
    spark = texts.sparkSession
    todo = cut_lineage(misses(texts, read_cache(spark, path), model, text))
    waves = -(-todo.count() // wave_rows)
    for wave in range(waves):
        put(embed(todo.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave), model, call, text), path)
    return attach(texts, read_cache(spark, path), model, text)


def join_embeddings(rows: DataFrame, vectors: DataFrame, id: str = "id") -> DataFrame:
    """Rows with the vector of a side table, matched by id."""
    return rows.join(vectors.select(id, "embedding"), id)

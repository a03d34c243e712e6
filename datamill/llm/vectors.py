"""What both vector searches share: usable vectors, blocks of bounded size, and the best k of every query."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

BLOCK = 2048  # rows of a block, about
QUERIES_AT_ONCE = 8192  # queries that one task holds against a block, about


def usable(vectors: DataFrame, key: str, vector: str, zero: bool) -> DataFrame:
    """(id, v) of the vectors that take part: not null, all components finite, and not zero unless ``zero``.

    Vectors of another length than the most frequent one (of equally frequent ones the shortest) take no part.
    Null ids take no part; repeated rows are candidates one by one, and of a repeated id one vector asks, see :func:`one_of_each`.
    """
    v = F.transform(vectors[vector], lambda x: x.cast("double"))
    rows = vectors.select(vectors[key].cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad)
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def one_of_each(rows: DataFrame) -> DataFrame:
    """A row for each id: of a repeated id the one with the smallest vector, compared component by component."""
    rest = [c for c in rows.columns if c not in ("id", "v")]
    return rows.groupBy("id").agg(F.min(F.struct("v", *rest)).alias("first")).select("id", "first.*")


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def sample_of(rows: DataFrame, total: int, size: int) -> pd.DataFrame:
    """About ``size`` different rows, at most so many, of a table of ``total`` rows, chosen by hash.

    The hash is cut before anything is ordered, so that what tasks send does not grow with their number.
    """
    share = min(1.0, 1.25 * size / max(1, total))
    key = F.xxhash64(*rows.columns)
    cut = F.pmod(key, F.lit(1 << 32)) < F.lit(math.ceil(share * (1 << 32)))
    return rows.where(cut).distinct().orderBy(key, *rows.columns).limit(size).toPandas()


def in_chunks(rows: DataFrame, cell: str, size: int = BLOCK) -> DataFrame:
    """Add the int ``chunk`` so that a (cell, chunk) has about ``size`` rows, also where a cell is crowded."""
    counts = rows.groupBy(F.col(cell).alias("_cell")).agg(F.ceil(F.count("*") / F.lit(size)).alias("_chunks"))
    # A row per cell, of which there are a bounded number.
    return rows.join(F.broadcast(counts), rows[cell] == F.col("_cell")).withColumn("chunk", F.pmod(F.xxhash64("id", "v"), F.col("_chunks")).cast("int")).drop("_cell", "_chunks")


def search(blocks: DataFrame, asked: DataFrame, visits: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], Iterator[tuple]], score: str) -> DataFrame:
    """(query_id, vec_id, score) found by ``kernel`` in every visit (id, cell, chunk, bound) of a query to a block.

    ``asked`` has a row for each query. A task holds one block and at most about ``QUERIES_AT_ONCE`` of its visitors: a
    block travels once for so many visits, and not at all if none comes.
    """

    def run(block: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        found = list(kernel(block, part)) if len(block) and len(part) else []
        return pd.concat([pd.DataFrame({"query_id": np.full(len(i), q), "vec_id": i, "score": s}) for q, i, s in found]) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    # All sides come from one table: new names' identities for each.
    visits = visits.select("id", "cell", "chunk", "bound").toDF("id", "cell", "chunk", "bound")
    parts = visits.groupBy("cell", "chunk").agg(F.ceil(F.count("*") / F.lit(QUERIES_AT_ONCE)).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    # No broadcasts: queries and blocks grow with the table.
    visitors = visits.join(parts.hint("merge"), ["cell", "chunk"]).withColumn("part", part).drop("parts").join(asked.toDF(*asked.columns).hint("merge"), "id")
    visited = blocks.toDF(*blocks.columns).join(parts.toDF("cell", "chunk", "parts").hint("merge"), ["cell", "chunk"])
    visited = visited.withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))).drop("parts")
    names = ["cell", "chunk", "part"]
    return visited.groupBy(*names).cogroup(visitors.groupBy(*names)).applyInPandas(run, f"query_id long, vec_id long, score {score}")


def best(found: DataFrame, k: int, largest: bool) -> DataFrame:
    """The k best of every query with rank from 1; ties go to the smaller vec_id."""
    order = [F.desc("score") if largest else F.asc("score"), F.asc("vec_id")]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top(scores: np.ndarray, ids: np.ndarray, k: int, largest: bool) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    signed = -scores if largest else scores
    if len(signed) > k:
        bound = np.partition(signed, k - 1)[k - 1]
        places = np.nonzero(signed <= bound)[0]
    else:
        places = np.arange(len(signed))
    return places[np.lexsort((ids[places], signed[places]))[:k]]

"""Deterministic shuffles: train/validation splits, folds and global row numbers.

Rows are shuffled by a hash of their id. A split needs no sort of the table: hash values are counted
in a fixed number of buckets, only the bucket that holds a cut is ranked, and the cut then acts
as a plain filter on (hash, id). The texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from datamill.functions.fixed_values import DEFAULT_SPLIT_RATIO
from datamill.functions.hashing import draw
from datamill.session import cut_lineage

BUCKETS = 4096
#: Strata whose cuts are sent to all tasks instead of a shuffle.
SENT_STRATA = 10_000


def _stratum(by: list[str]) -> Column:
    """The stratum of a row as text, so that null is a stratum like any other."""
    return F.to_json(F.struct(*by)) if by else F.lit("")


def _keys(df: DataFrame, place: Column, id: str, by: list[str]) -> DataFrame:
    """(stratum, u, id, bucket) for placements in [0, 1)."""
    return df.select(
        _stratum(by).alias("_s"), place.alias("_u"), F.col(id).alias("_id"), F.floor(place * BUCKETS).cast("int").alias("_b")
    )


def _offsets(keys: DataFrame) -> DataFrame:
    """Rows before each bucket and in all, per stratum; at most BUCKETS rows per stratum."""
    counts = keys.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_s")
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        "_s", "_b", "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_total"),
    )


def _cuts(df: DataFrame, place: Column, id: str, by: list[str], wanted: Column) -> DataFrame:
    """Per stratum the sorted (u, id) of the rows at the wanted 0-based ranks (an array of ranks)."""
    keys = _keys(df, place, id, by)
    at = (
        _offsets(keys)
        .withColumn("_rank", F.explode(wanted))
        .where("_rank >= _before AND _rank < _before + _n")
        .select("_s", "_b", (F.col("_rank") - F.col("_before") + 1).alias("_rn"))
    )
    within = Window.partitionBy("_s", "_b").orderBy("_u", "_id")
    ranked = keys.join(at.select("_s", "_b").distinct(), ["_s", "_b"], "left_semi").withColumn(
        "_rn", F.row_number().over(within)
    )
    found = ranked.join(at, ["_s", "_b", "_rn"])
    cut = F.struct(F.col("_u").alias("u"), F.col("_id").alias("id"))
    cuts = F.sort_array(F.collect_list(cut)).alias("_cuts")
    return found.groupBy("_s").agg(cuts) if by else found.agg(cuts)


def split(df: DataFrame, ratio: float = DEFAULT_SPLIT_RATIO, id: str = "id", salt: str = "split") -> DataFrame:
    """Adds ``is_train``: exactly floor(n * ratio) rows, chosen by the hash of the id."""
    return _split(df, draw(id, salt), ratio, id)


def ordered_split(df: DataFrame, ratio: float = DEFAULT_SPLIT_RATIO, id: str = "id") -> DataFrame:
    """Adds ``is_train`` for the first floor(n * ratio) rows by id; rows with the id at the cut stay together behind it."""
    positions = id_positions(df, id)
    total = df.agg(F.floor(F.count("*") * F.lit(ratio))).scalar()
    cut = positions.where((F.col("first") <= total) & (total < F.col("first") + F.col("n"))).agg(F.min("id")).scalar()
    return df.withColumn("is_train", F.coalesce(F.col(id) < cut, F.lit(True)))


def _split(df: DataFrame, place: Column, ratio: float, id: str) -> DataFrame:
    size = F.floor(F.col("_total") * F.lit(ratio)).cast("bigint")
    cut = _cuts(df, place, id, [], F.array(size)).select(F.get("_cuts", 0)).scalar()
    here = F.struct(place.alias("u"), F.col(id).alias("id"))
    return df.withColumn("is_train", F.coalesce(here < cut, F.lit(True)))


def stratified_split(
    df: DataFrame, by: str = "label", ratio: float = DEFAULT_SPLIT_RATIO, id: str = "id", salt: str = "split"
) -> DataFrame:
    """Adds ``is_train``: floor(n * ratio) rows of every stratum."""
    place = draw(id, salt)
    size = F.floor(F.col("_total") * F.lit(ratio)).cast("bigint")
    cuts = _cuts(df, place, id, [by], F.array(size)).select("_s", F.get("_cuts", 0).alias("_cut"))
    cuts = cut_lineage(cuts)
    # A small row per stratum: sent to the rows if it is few, so that they are not shuffled by their label.
    cuts = F.broadcast(cuts) if cuts.count() <= SENT_STRATA else cuts
    here = F.struct(place.alias("u"), F.col(id).alias("id"))
    joined = df.withColumn("_s", _stratum([by])).join(cuts, "_s", "left")
    return joined.withColumn("is_train", F.coalesce(here < F.col("_cut"), F.lit(True))).drop("_s", "_cut")


def hash_split(df: DataFrame, ratio: float = DEFAULT_SPLIT_RATIO, id: str = "id", salt: str = "split") -> DataFrame:
    """Adds ``is_train`` by comparing the hash with the ratio: sizes are close, no second pass."""
    return df.withColumn("is_train", draw(id, salt) < F.lit(ratio))


def kfold(df: DataFrame, k: int = 5, id: str = "id", salt: str = "fold") -> DataFrame:
    """Adds ``fold`` (0..k-1): k-1 folds of floor(n / k) rows, the last one takes the rest."""
    if k < 2:
        return df.withColumn("fold", F.lit(0))
    place = draw(id, salt)
    size = F.floor(F.col("_total") / k).cast("bigint")
    wanted = F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda j: j * size)
    cuts = _cuts(df, place, id, [], wanted).select("_cuts").scalar()
    here = F.struct(place.alias("u"), F.col(id).alias("id"))
    passed = [F.coalesce((F.get(cuts, j) <= here).cast("int"), F.lit(0)) for j in range(k - 1)]
    return df.withColumn("fold", reduce(lambda a, b: a + b, passed))


def fold_rows(folds: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of one fold: the complement and the fold itself."""
    return folds.where(F.col("fold") != fold), folds.where(F.col("fold") == fold)


def id_positions(df: DataFrame, id: str = "id") -> DataFrame:
    """``(id, n, first)``: how often each id occurs and the 0-based position of its first row in the order of the ids.

    Ids of any type that has an order are dealt over tasks by ranges and counted there; a task's counts are moved up by
    those of the ranges before it, a table with a row per task.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = before + np.cumsum(batch.column(1).to_numpy())
            if len(ends):
                before = int(ends[-1])
                first = ends - batch.column(1).to_numpy()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first), pa.array(np.full(len(ends), part, np.int32))], ["id", "n", "first", "part"])

    ids = df.groupBy(F.col(id).alias("id")).agg(F.count("*").alias("n")).repartitionByRange("id").sortWithinPartitions("id")
    kind = ids.schema["id"].dataType.simpleString()
    placed = cut_lineage(ids.mapInArrow(count, f"id {kind}, n bigint, first bigint, part int"))
    sizes = placed.groupBy("part").agg(F.sum("n").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(offsets), "part").select("id", "n", (F.col("first") + F.col("before")).alias("first"))


def number_rows(df: DataFrame, id: str = "id") -> DataFrame:
    """Adds ``row_no``, the 0-based position in the order of the ids, null first; rows with one id follow each other.

    Only ids are ordered; the rows meet their positions in a join by id.
    """
    positions = id_positions(df, id).select(F.col("id").alias("_id"), "first")
    again = F.row_number().over(Window.partitionBy("_id").orderBy("first"))
    return (
        df.join(positions, df[id].eqNullSafe(positions["_id"]))
        .withColumn("row_no", (F.col("first") + again - 1).cast("bigint"))
        .drop("_id", "first")
    )


def batches(df: DataFrame, size: int, id: str = "id") -> DataFrame:
    """Adds ``batch`` and ``index`` (position inside the batch) for requests of ``size`` rows."""
    return in_batches(number_rows(df, id), size)


def in_batches(numbered: DataFrame, size: int) -> DataFrame:
    """:func:`batches` of rows that have their ``row_no``, so that requests of several sizes number them once."""
    return numbered.withColumn("batch", F.floor(F.col("row_no") / size).cast("bigint")).withColumn(
        "index", (F.col("row_no") % size).cast("int")
    ).drop("row_no")

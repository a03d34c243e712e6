"""Shards by a hierarchical weighted hash tree (region, rack, shard).

At every level each child draws ``-ln(u) / weight`` from the hash of (seed, level, child, id) and the smallest
draw wins, so a child is chosen with probability weight / sum of weights. A child's draw depends only on
itself: when one weight changes, rows move only into (or out of) that child's subtree.

Shards fill racks and racks fill regions in order. A new shard after the last full region opens a region
of its own, all other weights stay, and rows move only into the new shard. A new shard inside a region that
is not full draws rows into that region, where they may also land in its neighbours.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from datamill.llm.common import null_key, text_of, written

RACKS, SHARDS = 2, 4  # racks of a region, shards of a rack
SEED = "shard"
NUMBERED = 20_000  # rows that one numbering task orders


def _sums(weights: list[float], width: int) -> list[float]:
    return [math.fsum(weights[i:i + width]) for i in range(0, len(weights), width)]


def levels(weights: list[float], racks: int = RACKS, shards: int = SHARDS) -> list[tuple[str, list[float], int]]:
    """(name, weights of all nodes, children of a parent) from the regions down to the shards."""
    if not weights or min(weights) <= 0 or not all(map(math.isfinite, weights)):
        raise ValueError("at least one shard is needed, and all weights above zero")
    rack = _sums(weights, shards)
    region = _sums(rack, racks)
    return [("region", region, len(region)), ("rack", rack, racks), ("shard", list(map(float, weights)), shards)]


def _child(key: Column, level: str, weights: list[float], width: int, parent: Column, seed: str) -> Column:
    """Number, within its level, of the child of ``parent`` with the smallest draw."""
    table = F.array(*[F.lit(w) for w in weights])

    def drawn(i: int) -> Column:
        node = parent * width + i
        bits = F.shiftrightunsigned(F.xxhash64(F.concat(F.lit(f"{seed}/{level}/"), node.cast("string"), F.lit("/"), key)), 11)
        return F.struct((-F.log((bits + F.lit(0.5)) / F.lit(2.0**53)) / F.get(table, node)).alias("draw"), node.alias("node"))

    found = F.array(*[drawn(i) for i in range(width)])
    return F.array_min(F.filter(found, lambda x: x["draw"].isNotNull()))["node"]


def with_shard(rows: DataFrame, key: Column, weights: list[float], out: str, racks: int = RACKS, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """Add the int column ``out``: the shard of ``key``, a string. Only the key and the weights decide.

    A null key is a key of its own (use :func:`datamill.llm.common.null_key`); equal keys share a shard.
    """
    node = F.lit(0)
    for level, all_weights, width in levels(weights, racks, shards):
        rows = rows.withColumn(f"_{out}_{level}", _child(key, level, all_weights, width, node, seed).cast("int"))
        node = F.col(f"_{out}_{level}")
    return rows.withColumn(out, node).drop(*[f"_{out}_{level}" for level, *_ in levels(weights, racks, shards)])


def with_slot(rows: DataFrame, shard: str, order: list[str], out: str = "slot", numbered: int = NUMBERED) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, however many rows a shard has.

    Rows fall into hash buckets of about ``numbered`` rows; a bucket's numbers start after the counts of the
    buckets before it. Equal rows get consecutive numbers in any order. ``rows`` is read twice.
    """
    buckets = max(1, math.ceil(rows.count() / numbered))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(shard, "_bucket").agg(F.count("*").alias("_n")).select(
        F.col(shard).alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(*order))
    numbers = rows.withColumn("_inside", inside)
    joined = numbers.join(starts, (numbers[shard] == starts["_s"]) & (numbers["_bucket"] == starts["_b"]))
    return joined.withColumn(out, F.col("_start") + F.col("_inside") - 1).drop("_bucket", "_b", "_s", "_start", "_inside")


def assign(docs: DataFrame, weights: list[float], grown: list[float] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row, by the law ``key``.

    A null text has size 8 and checksum 0; a null key is a key of its own; rows with one key share a shard
    and have slots of their own. An empty table gives no rows, other columns are left out.
    """
    content = text_of(docs[text]).cast("binary")
    rows = docs.select(docs[key].alias(key), (F.octet_length(content) + 8).cast("long").alias("size"), F.crc32(content).alias("text_crc32"))
    rows = with_shard(rows.withColumn("_key", null_key(key)), F.col("_key"), weights, "shard")
    if grown:
        rows = with_shard(rows, F.col("_key"), grown, "grown_shard")
    else:
        rows = rows.withColumn("grown_shard", F.lit(None).cast("int"))
    rows = written(rows.drop("_key").withColumn("law", F.lit("key")), "shards")
    return with_slot(rows, "shard", [key, "text_crc32", "size"]).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")

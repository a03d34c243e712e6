"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Each source shares the budget by weight, but no target exceeds ``epochs`` times the source's size; what is above
is shared again among the rest, round by round, until no target is above its cap. A round is one aggregation
over the sources; the driver sees only the level (budget per unit of weight).

A target is met by whole repetitions of every document and a fractional one: documents in hash order are taken
until the remaining words are met, the last of them in part. Only the one hash bucket of a source where this
ends needs an order among its rows; all other rows are decided by their bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from datamill.functions.hashing import draw
from datamill.llm.common import WORD, null_key, packed, text_of, unpacked, written

SHARE, EPOCHS, PATTERN, SEED = 1.5, 2.0, (5, 2, 1), "mix"
BUCKET_ROWS = 5000


def words_in(text: Column | str) -> Column:
    """Number of runs without ASCII white space; null: none."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def ranked_weights(sizes: DataFrame, pattern: tuple[int, ...] = PATTERN) -> DataFrame:
    """(source, size, weight): weights of the sources in code-point order, null last, repeating ``pattern``.

    The table has a row per source, so it is ordered in one place.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(w) for w in pattern])
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sources.withColumn("weight", F.get(weights, F.pmod(place, F.lit(len(pattern)))))


def water_level(sources: DataFrame, budget: float, epochs: float = EPOCHS) -> float:
    """The level L for which ``sum(min(epochs * source_size, L * weight))`` is the budget, or infinity."""
    level = 0.0
    while True:
        full = F.col("source_size") * F.lit(epochs) < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("full"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if not row["weight"]:
            return math.inf
        higher = (budget - epochs * row["full"]) / row["weight"]
        if higher <= level:
            return level
        level = higher


def plan(sizes: DataFrame, share: float = SHARE, epochs: float = EPOCHS, pattern: tuple[int, ...] = PATTERN) -> DataFrame:
    """(source, source_size, weight, target) from (source, size). Nothing to mix gives targets of 0."""
    sources = written(ranked_weights(sizes, pattern), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, share * total, epochs) if total else 0.0
    cap = F.col("source_size") * F.lit(float(epochs))
    wanted = cap if math.isinf(level) else F.least(cap, F.lit(level) * F.col("weight"))
    return sources.withColumn("target", F.round(wanted.cast("double"), 6))


def taken_words(sizes: DataFrame, share: float = SHARE, epochs: float = EPOCHS, pattern: tuple[int, ...] = PATTERN, seed: str = SEED, whole: bool = False) -> DataFrame:
    """``sizes`` (doc_id, source, size, pick; pick is a string that orders documents by its hash) with source_size, target and taken.

    The words taken of a source are its target, rounded. With ``whole`` the last document is taken whole or not at
    all, whichever is nearer. ``sizes`` is read several times, so it should be a written table.
    """
    targets = plan(sizes, share, epochs, pattern)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("_rounds", rounds).withColumn("_rest", F.round(F.col("target") - F.col("_rounds") * F.col("source_size")).cast("long"))
    targets = written(targets.withColumn("_source", null_key("source")).drop("source", "weight"), "targets")
    rows = sizes.withColumn("_draw", draw("pick", seed)).withColumn("_source", null_key("source"))
    buckets = max(1, math.ceil(sizes.count() / BUCKET_ROWS))
    rows = rows.withColumn("_bucket", F.least(F.floor(F.col("_draw") * buckets), F.lit(buckets - 1)).cast("int"))
    upto = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("_words")).withColumn("_end", F.sum("_words").over(upto))
    sums = sums.join(targets.select("_source", "_rest"), "_source").where((F.col("_end") >= F.col("_rest")))
    first = F.min(F.struct("_bucket", (F.col("_end") - F.col("_words")).alias("_start")))
    cuts = sums.groupBy("_source").agg(first.alias("_cut"))
    # A row per source; every source has a cut because its rest is below its size.
    cuts = written(targets.join(cuts, "_source").select("*", "_cut.*").drop("_cut").withColumnsRenamed({"_bucket": "_at", "_source": "_s"}), "cuts")
    rows = rows.join(cuts, rows["_source"] == cuts["_s"]).drop("_s")
    order = Window.partitionBy("_source").orderBy("_draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.where(F.col("_bucket") == F.col("_at"))
    inside = inside.withColumn("_left", F.col("_rest") - F.col("_start") - F.coalesce(F.sum("size").over(order), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left")))
    if whole:
        part = F.when(part * 2 >= F.col("size"), F.col("size")).otherwise(0)
    inside = inside.withColumn("_part", part).drop("_left")
    outside = rows.where(F.col("_bucket") != F.col("_at")).withColumn("_part", F.when(F.col("_bucket") < F.col("_at"), F.col("size")).otherwise(0))
    both = inside.unionByName(outside)
    return both.withColumn("taken", (F.col("_rounds") * F.col("size") + F.col("_part")).cast("long")).drop("_source", "_draw", "_bucket", "_rounds", "_rest", "_at", "_start", "_part")


def sizes_of(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size, pick) of every row. Rows without an id are ordered by their text's digest."""
    pick = F.coalesce(docs[key].cast("string"), F.md5(text_of(docs[text])))
    return written(docs.select(docs[key].alias("doc_id"), docs[source].cast("string").alias("source"), words_in(docs[text]).alias("size"), pick.alias("pick")), "sizes")


def mixed_words(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row, empty and null texts included (they take none)."""
    return taken_words(sizes_of(docs), **options).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, whole, with all its columns.

    Documents without words and rows of the same id and size share one decision: without words they stay once.
    """
    chosen = taken_words(sizes_of(docs, key, source, text), whole=True, **options)
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))
    chosen = chosen.groupBy(F.col("pick").alias("_pick"), null_key("source").alias("_source"), F.col("size").alias("_size")).agg(F.sum(times).alias("_times"), F.count("*").alias("_rows"))
    # Rows that can't be told apart share their repetitions evenly, rounded up.
    chosen = written(chosen.select("_pick", "_source", "_size", F.ceil(F.col("_times") / F.col("_rows")).cast("int").alias("_n")), "mix")
    pick = F.coalesce(docs[key].cast("string"), F.md5(text_of(docs[text])))
    rows = packed(docs, pick=pick, from_source=null_key(docs[source]), size=words_in(docs[text]))
    on = (F.col("pick") == F.col("_pick")) & (F.col("from_source") == F.col("_source")) & (F.col("size") == F.col("_size"))
    rows = rows.join(chosen.where("_n > 0"), on)
    return unpacked(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))), docs.columns)

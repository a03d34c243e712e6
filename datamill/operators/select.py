"""Choice of demonstration examples: random, balanced, diverse, similar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from datamill.functions.hashing import draw
from datamill.functions.text import example_features, ngrams, text_similarity, tokenize
from datamill.operators.topk import best_rows
from datamill.session import cut_lineage, spread


def select_random(df: DataFrame, k: int = 5, id: str = "id", salt: str = "random") -> DataFrame:
    return df.orderBy(draw(id, salt), id).limit(k)


def balance_bucket(task_type: str) -> Column:
    """What balanced selection spreads over: label, rounded value, or the set of tags."""
    if task_type == "classification":
        return F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("unknown"))
    if task_type in ("scoring", "regression"):
        return F.floor(F.coalesce(F.col("value"), F.lit(0.0)) + 0.5).cast("bigint").cast("string")
    if task_type == "sequence-labeling":
        tags = F.array_sort(F.array_distinct(F.array_remove(F.coalesce("tags", F.array().cast("array<string>")), "O")))
        return F.when(F.size(tags) > 0, F.array_join(tags, ",")).otherwise(F.lit("O-only"))
    return F.lit("default")


def select_balanced(df: DataFrame, task_type: str = "classification", k: int = 5, id: str = "id", salt: str = "balanced") -> DataFrame:
    """Round-robin over buckets in order of their first row; inside a bucket by hash.

    Only the first k rows of a bucket can be chosen, so each map task keeps no more than that.
    """
    rows = df.withColumn("_bucket", balance_bucket(task_type))
    firsts = rows.groupBy("_bucket").agg(F.min(id).alias("_first"))
    turn = F.row_number().over(Window.partitionBy("_bucket").orderBy(draw(id, salt), id))
    picks = rows.withColumn("_turn", turn).where(F.col("_turn") <= k)
    ranked = picks.join(firsts, "_bucket").orderBy("_turn", "_first").limit(k)
    return ranked.drop("_bucket", "_turn", "_first")


def feature_rows(df: DataFrame, task_type: str = "classification", id: str = "id") -> DataFrame:
    """``(id, feature)`` of every example."""
    has = set(df.columns)
    text = F.col("text") if "text" in has else F.array_join("tokens", " ")
    extra = {
        "classification": {"label": "label"}, "scoring": {"value": "value"}, "regression": {"value": "value"},
        "sequence-labeling": {"tags": "tags"},
    }.get(task_type, {})
    extra = {arg: c for arg, c in extra.items() if c in has}
    rows = spread(df.select(id, *extra.values(), text.alias("_t")))
    rows = rows.select(id, *extra.values(), tokenize("_t").alias("_tokens"))
    return rows.select(id, F.explode(example_features("_tokens", **extra)).alias("feature"))


def select_diverse(df: DataFrame, task_type: str = "classification", k: int = 5, id: str = "id") -> DataFrame:
    """Greedy cover: k times the row that adds most features not covered yet (ties: lowest id).

    Each round drops covered features and counts the rest per row; the driver sees one id per
    round. Adds ``pick``, the round a row was chosen in.
    """
    features = cut_lineage(feature_rows(df, task_type, id))
    covered = features.select("feature").limit(0)
    chosen: list = []
    while len(chosen) < k:
        best = (
            features.where(~F.col(id).isin(chosen) if chosen else F.lit(True))
            .join(covered, "feature", "left_anti")
            .groupBy(id).count().orderBy(F.desc("count"), id).first()
        )
        if best is None:
            break
        chosen.append(best[id])
        covered = features.where(F.col(id).isin(chosen)).select("feature").distinct()
    if len(chosen) < k:
        # Everything is covered: no row adds anything, so the lowest ids follow.
        rest = df.where(~F.col(id).isin(chosen)).select(id).orderBy(id).limit(k - len(chosen))
        chosen += [row[id] for row in rest.toLocalIterator()]
    order = F.array_position(F.array(*[F.lit(c) for c in chosen]), F.col(id)) if chosen else F.lit(0)
    return df.where(F.col(id).isin(chosen)).withColumn("pick", order.cast("int"))


def select_similar(df: DataFrame, query: str, k: int = 5, id: str = "id", text: str = "text") -> DataFrame:
    """The k rows most similar to one query text; adds ``similarity``."""
    scored = spread(df).withColumn("similarity", text_similarity(F.coalesce(F.col(text), F.lit("")), F.lit(query)))
    return scored.orderBy(F.desc("similarity"), id).limit(k)


def _terms(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, words, pairs, term): distinct words and word pairs, one row each, with their numbers."""
    rows = spread(df.select(id, F.coalesce(F.col(text), F.lit("")).alias("_t"))).select(id, tokenize("_t").alias("_w"))
    rows = rows.select(id, F.array_distinct("_w").alias("_u"), ngrams("_w", 2).alias("_b"))
    terms = F.concat(F.transform("_u", lambda x: F.concat(F.lit("u "), x)), F.transform("_b", lambda x: F.concat(F.lit("b "), x)))
    return rows.select(id, F.size("_u").alias("words"), F.size("_b").alias("pairs"), terms.alias("terms"))


def similar_for_queries(df: DataFrame, queries: DataFrame, k: int = 5, id: str = "id", query_id: str = "query_id", text: str = "text") -> DataFrame:
    """``(query_id, id, similarity, rank)``: the k most similar rows of every query.

    Rows meet queries through shared words and word pairs, see :mod:`datamill.operators.topk`; rows sharing nothing
    have similarity 0 and only fill up queries with fewer than k partners, lowest ids first.
    """
    q = _terms(queries, query_id, text).select(query_id, F.col("words").alias("q_words"), F.col("pairs").alias("q_pairs"), "terms")
    q = cut_lineage(q)
    d = _terms(df, id, text)
    best = Window.partitionBy(query_id).orderBy(F.desc("similarity"), id)
    top = cut_lineage(best_rows(d, q, k, id, query_id).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))

    # At most 2k lowest ids (and k rows without words, equal to a query without words) can fill up.
    low = d.select(id, "words").orderBy(id).limit(2 * k).unionByName(
        d.select(id, "words").where("words = 0").orderBy(id).limit(k)
    ).distinct().agg(F.collect_list(F.struct(id, "words")).alias("low")).select("low").scalar()
    counts = top.groupBy(query_id).agg(F.count("*").alias("have"))
    short = q.join(counts, query_id, "left").where(F.coalesce("have", F.lit(0)) < k).select(query_id, "q_words")
    fill = short.select(query_id, "q_words", F.explode(low).alias("l")).select(
        query_id, F.col(f"l.{id}").alias(id),
        F.when((F.col("q_words") == 0) & (F.col("l.words") == 0), F.lit(1.0)).otherwise(F.lit(0.0)).alias("similarity"),
    ).join(top.select(query_id, id), [query_id, id], "left_anti")
    every = top.select(query_id, id, "similarity").unionByName(fill)
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def select_examples(strategy: str, df: DataFrame, task_type: str = "classification", k: int = 5, query: str | None = None, id: str = "id") -> DataFrame:
    """Selection by name of the strategy."""
    if strategy == "random":
        return select_random(df, k, id)
    if strategy == "balanced":
        return select_balanced(df, task_type, k, id)
    if strategy == "diverse":
        return select_diverse(df, task_type, k, id)
    if strategy == "similar":
        if not query:
            raise ValueError("the similar strategy needs a query")
        return select_similar(df, query, k, id)
    raise ValueError(f"unknown strategy: {strategy}")


def candidate_sets(
    df: DataFrame, task_type: str = "classification", k: int = 5,
    strategies: tuple[str, ...] = ("random", "balanced", "diverse"), random_trials: int = 3, id: str = "id",
) -> DataFrame:
    """Demonstration sets to compare, with the name of their ``strategy``; random ones several times."""
    parts = []
    for name in strategies:
        if name == "random":
            parts += [(f"random_{t}", select_random(df, k, id, f"random_{t}")) for t in range(1, random_trials + 1)]
        else:
            parts.append((name, select_examples(name, df, task_type, k, id=id)))
    tagged = [part.select(*df.columns, F.lit(name).alias("strategy")) for name, part in parts]
    out = tagged[0]
    for part in tagged[1:]:
        out = out.unionByName(part)
    return out

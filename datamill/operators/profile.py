"""Dataset statistics: counts by source and label, deficits, composition, shared corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from datamill.functions.hashing import fingerprint


def label_or_unknown(df: DataFrame) -> Column:
    """Label, else value, else 'unknown'; only null and empty count as missing."""
    choices = [F.nullif(F.col("label"), F.lit(""))] if "label" in df.columns else []
    if "value" in df.columns:
        choices.append(F.col("value").cast("string"))
    return F.coalesce(*choices, F.lit("unknown"))


def dataset_stats(df: DataFrame) -> DataFrame:
    """``(kind, name, n)``: total, rows per source and rows per label from one pass."""
    rows = df.select(F.coalesce("_source", F.lit("synthetic")).alias("source"), label_or_unknown(df).alias("lbl"))
    sets = rows.groupingSets([[], ["source"], ["lbl"]], "source", "lbl").agg(
        F.grouping("source").alias("gs"), F.grouping("lbl").alias("gl"), F.count("*").alias("n")
    )
    kind = F.when(F.col("gs") == 0, F.lit("source")).when(F.col("gl") == 0, F.lit("label")).otherwise(F.lit("total"))
    return sets.select(kind.alias("kind"), F.coalesce("source", "lbl", F.lit("all")).alias("name"), "n")


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(label_or_unknown(df).alias("label")).agg(F.count("*").alias("n"))


def label_composition(df: DataFrame) -> DataFrame:
    """Rows and share of all rows per label."""
    total = df.agg(F.count("*")).scalar()
    return label_counts(df).withColumn("percent", F.col("n") * 100.0 / total)


def label_list(df: DataFrame, labels: list[str]) -> DataFrame:
    """The given labels as a table."""
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))


def distinct_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.select(label).where(F.col(label).isNotNull()).distinct()


def label_deficit(df: DataFrame, labels: list[str] | DataFrame, tolerance: float = 0.8) -> DataFrame:
    """Labels with fewer rows than ``tolerance`` times an even share, and how many are missing.

    The even share counts all rows, those of foreign labels too.
    """
    wanted = labels if isinstance(labels, DataFrame) else label_list(df, labels)
    even = df.agg(F.count("*")).scalar() / wanted.agg(F.count("*")).scalar()
    joined = wanted.join(label_counts(df), "label", "left").select(
        "label", F.coalesce("n", F.lit(0)).alias("n"), even.cast("double").alias("expected")
    )
    return joined.where(F.col("n") < F.col("expected") * tolerance).withColumn(
        "deficit", F.ceil(F.col("expected") - F.col("n")).cast("bigint")
    )


def quality_bands(df: DataFrame, quality: str = "_quality") -> DataFrame:
    """Rows of high (>= 0.8), middle and low (< 0.5) quality."""
    q = F.coalesce(F.col(quality), F.lit(0.0))
    return df.agg(
        F.count_if(q >= 0.8).alias("high"), F.count_if((q >= 0.5) & (q < 0.8)).alias("middle"), F.count_if(q < 0.5).alias("low")
    )


def provider_counts(df: DataFrame, provider: str = "_provider") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(provider), F.lit("unknown")).alias("provider")).agg(F.count("*").alias("n"))


def stage_counts(df: DataFrame, stage: Column) -> DataFrame:
    """Rows and misclassified rows per curriculum stage."""
    return df.groupBy(stage.alias("stage")).agg(
        F.count("*").alias("n"), F.count_if(~F.col("_correct")).alias("wrong")
    )


def dataset_fingerprint(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """One row: the row count and a fingerprint that does not depend on row order."""
    return df.agg(F.count("*").alias("n"), fingerprint(text, label).alias("data_hash"))


def shared_corpus(tables: dict[str, tuple[DataFrame, DataFrame]], text: str = "text") -> DataFrame:
    """Train and validation texts of several tasks as one table with ``task`` and ``part``."""
    if not tables:
        raise ValueError("no task has prepared rows")
    parts = [
        df.select(F.lit(task).alias("task"), F.lit(part).alias("part"), F.col(text).alias("text"))
        for task, pair in tables.items()
        for part, df in zip(("train", "val"), pair)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def corpus_summary(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count_distinct("task").alias("tasks"), F.count("text").alias("texts"))

"""Row checks per task type; rows stay in the table with a ``reason`` (null where valid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from datamill.functions.hashing import _col
from datamill.functions.text import not_blank


def tag_set(labels: list[str]) -> list[str]:
    """All tags of a labelling scheme: O, then B- and I- of every label."""
    return ["O", *[f"{edge}-{label}" for label in labels for edge in ("B", "I")]]


def tag_set_column(labels: Column | str) -> Column:
    """The same over an array column of labels."""
    pairs = F.transform(_col(labels), lambda x: F.array(F.concat(F.lit("B-"), x), F.concat(F.lit("I-"), x)))
    return F.concat(F.array(F.lit("O")), F.flatten(pairs))


def classification_reason(text: str = "text", label: str = "label", labels: list[str] | None = None) -> Column:
    known = F.lit(True) if labels is None else F.col(label).isin(labels)
    return (
        F.when(~not_blank(text), F.lit("text"))
        .when(F.col(label).isNull(), F.lit("label"))
        .when(~known, F.lit("unknown_label"))
    )


def extraction_reason(text: str = "text", fields: str = "fields") -> Column:
    return F.when(~not_blank(text), F.lit("text")).when(F.col(fields).isNull(), F.lit("fields"))


def scoring_reason(text: str = "text", value: str = "value", lo: float | None = None, hi: float | None = None) -> Column:
    """Numeric and inside the inclusive range, where one is given."""
    inside = F.lit(True) if lo is None or hi is None else F.col(value).between(lo, hi)
    return (
        F.when(~not_blank(text), F.lit("text"))
        .when(F.col(value).isNull() | F.isnan(value), F.lit("value"))
        .when(~inside, F.lit("range"))
    )


def sequence_reason(labels: list[str], tokens: str = "tokens", tags: str = "tags") -> Column:
    known = F.array(*[F.lit(t) for t in tag_set(labels)])
    return (
        F.when(F.col(tokens).isNull() | (F.size(tokens) == 0), F.lit("tokens"))
        .when(F.col(tags).isNull() | (F.size(tags) != F.size(tokens)), F.lit("length"))
        .when(F.exists(tags, lambda t: t.isNull()) | (F.size(F.array_except(tags, known)) > 0), F.lit("unknown_tag"))
    )


def reason_for(task: dict) -> Column:
    """The check of a task definition."""
    kind, labels = task["type"], task.get("labels")
    if kind == "classification":
        return classification_reason(labels=labels)
    if kind == "extraction":
        return extraction_reason()
    if kind == "sequence-labeling":
        return sequence_reason(labels or [])
    if kind in ("scoring", "regression"):
        span = task.get("scoreRange") or {}
        return scoring_reason(lo=span.get("min"), hi=span.get("max"))
    raise ValueError(f"unknown task type: {kind}")


def check(df: DataFrame, reason: Column) -> DataFrame:
    """Adds ``valid`` and ``reason``."""
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def trainable(df: DataFrame, task_type: str) -> DataFrame:
    """Rows a trainer can use: arrays present for sequences, a number for scores."""
    if task_type == "sequence-labeling":
        return df.where(F.col("tokens").isNotNull() & F.col("tags").isNotNull())
    if task_type in ("scoring", "regression"):
        return df.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return df.where(F.col("text").isNotNull())


def quality_filter(df: DataFrame, threshold: float = 0.7, quality: str = "_quality") -> DataFrame:
    """Rows of at least this quality; no quality counts as 0."""
    return df.where(F.coalesce(F.col(quality), F.lit(0.0)) >= threshold)


def quality_removed(df: DataFrame, threshold: float = 0.7, quality: str = "_quality") -> DataFrame:
    """One row: how many rows the quality filter keeps and removes."""
    good = F.coalesce(F.col(quality), F.lit(0.0)) >= threshold
    return df.agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("removed"))


def reject_unsure(preds: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds ``rejected``: a confidence is known and too low."""
    return preds.withColumn("rejected", F.coalesce(F.col("confidence") < threshold, F.lit(False)))


def difficulty(preds: DataFrame, actual: str = "actual") -> DataFrame:
    """Adds _difficulty (1 - confidence, 0.5 if unknown), _predicted and _correct."""
    return preds.select(
        "*",
        F.coalesce(F.lit(1.0) - F.col("confidence"), F.lit(0.5)).alias("_difficulty"),
        F.col("label").alias("_predicted"),
        F.col("label").eqNullSafe(F.col(actual)).alias("_correct"),
    )


def curriculum_stage(easy: float = 0.3, hard: float = 0.7, score: str = "_difficulty") -> Column:
    d = F.coalesce(F.col(score), F.lit(0.0))
    return F.when(d >= hard, F.lit("hard")).when(d >= easy, F.lit("medium")).otherwise(F.lit("easy"))


def easy_to_hard(df: DataFrame, score: str = "_difficulty", id: str = "id") -> DataFrame:
    return df.orderBy(F.coalesce(F.col(score), F.lit(0.0)), id)

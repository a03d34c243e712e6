"""Request texts as column expressions. The wording itself is in :mod:`fixed_values`."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from datamill.functions import fixed_values as V
from datamill.functions.hashing import _col


def fill(template: str, **values: Column) -> Column:
    """A template with ``{name}`` replaced by columns; other braces stay as they are."""
    names = "|".join(values)
    pieces = re.split(r"\{(" + names + r")\}", template) if names else [template]
    parts = [values[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def listed(items: Column | str, between: str = ", ") -> Column:
    return F.array_join(F.coalesce(_col(items), F.array().cast("array<string>")), between)


def replace_first(text: Column, what: str, by: Column) -> Column:
    """Only the first occurrence is replaced."""
    at = F.locate(what, text) if not isinstance(text, str) else F.locate(what, F.col(text))
    return F.when(at > 0, F.overlay(text, by, at, F.lit(len(what)))).otherwise(text)


def range_end(column: str, default: float) -> Column:
    """An end of the score range as text; whole numbers without decimals."""
    v = F.coalesce(F.col(column), F.lit(default))
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def _range() -> dict[str, Column]:
    return {"lo": range_end("score_min", V.SCORE_MIN), "hi": range_end("score_max", V.SCORE_MAX)}


def _by_type(classification: Column, extraction: Column, scoring: Column, sequence: Column, other: Column | None = None) -> Column:
    kind = F.col("type")
    out = (
        F.when(kind == "classification", classification).when(kind == "extraction", extraction)
        .when(kind.isin("scoring", "regression"), scoring).when(kind == "sequence-labeling", sequence)
    )
    return out if other is None else out.otherwise(other)


def system_prompt() -> Column:
    """System text over a task table (name, type, description, labels, fields, score_min, score_max)."""
    base = fill(V.GENERATE_SYSTEM, description=F.col("description"), type=F.col("type"))
    extra = _by_type(
        fill(V.SYSTEM_LABELS, labels=listed("labels")), fill(V.SYSTEM_FIELDS, fields=listed("fields")),
        fill(V.SYSTEM_RANGE, **_range()), fill(V.SYSTEM_TAGS, labels=listed("labels")), F.lit(""),
    )
    return F.concat(base, extra)


def batch_prompt(n: Column) -> Column:
    """Generation request for ``n`` examples over a task table that also has ``prompt``."""
    head = fill(V.BATCH_HEAD, n=n.cast("string"))
    row = _by_type(F.lit(V.ROW_FORMAT_LABEL), F.lit(V.ROW_FORMAT_FIELDS), F.lit(V.ROW_FORMAT_VALUE), F.lit(V.ROW_FORMAT_TAGS))
    rules = _by_type(
        F.concat(F.lit("\n"), fill(V.BATCH_LABELS, labels=listed("labels"))), F.lit("\n"),
        F.concat(F.lit("\n"), fill(V.BATCH_RANGE, **_range())), fill(V.BATCH_TAGS, labels=listed("labels")),
    )
    context = replace_first(F.col("prompt"), "{label}", listed("labels", " or "))
    context = F.when(F.col("type") == "sequence-labeling", context).otherwise(replace_first(context, "{field}", listed("fields")))
    return F.concat(head, row, rules, fill(V.BATCH_TAIL, context=context))


def fixed2(number: Column) -> Column:
    """Two decimals without grouping."""
    return F.format_string("%.2f", number.cast("double"))


def percent(confidence: Column) -> Column:
    return F.concat(F.format_string("%.0f", confidence * 100), F.lit("%"))


def example_text(task_type: str) -> Column:
    """One demonstration, by task type."""
    if task_type == "classification":
        return F.concat(F.lit("Input: "), F.col("text"), F.lit("\nLabel: "), F.col("label"))
    if task_type in ("scoring", "regression"):
        return F.concat(F.lit("Input: "), F.col("text"), F.lit("\nScore: "), F.coalesce(fixed2(F.col("value")), F.lit("?")))
    if task_type == "sequence-labeling":
        return F.concat(F.lit("Tokens: "), F.to_json("tokens"), F.lit("\nTags: "), F.to_json("tags"))
    if task_type == "extraction":
        return F.concat(F.lit("Input: "), F.col("text"), F.lit("\nOutput: "), F.to_json("fields"))
    raise ValueError(f"unknown task type: {task_type}")


def task_header() -> Column:
    """Head of a few-shot prompt over a task table."""
    base = F.concat(F.lit("Task: "), F.col("description"))
    return F.concat(base, _by_type(
        F.concat(F.lit("\nLabels: "), listed("labels")), F.lit(""),
        F.concat(F.lit("\nScore range: "), _range()["lo"], F.lit(" to "), _range()["hi"]),
        F.concat(F.lit("\nEntity types: "), listed("labels"), F.lit("\nTag scheme: BIO")), F.lit(""),
    ))


def few_shot_prompt(header: Column, demos: Column, query: Column, task_type: str = "classification") -> Column:
    """Header, demonstrations and the query to answer."""
    asked = F.concat(F.lit("Tokens: "), F.to_json(F.split(query, r"\s+"))) if task_type == "sequence-labeling" else F.concat(F.lit("Input: "), query)
    return F.concat(header, F.lit("\n\nExamples:\n\n"), demos, F.lit("\n\nNow classify:\n"), asked, F.lit("\n"))

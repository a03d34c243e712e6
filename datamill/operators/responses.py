"""Labelling and judging as tables: requests, answers, and what answers say about rows.

The call itself is a function of the user, ``list[str] -> list[str]``, run on Arrow batches inside
tasks. Everything before and after it is relational: a request table goes out, an answer table
(key, response) comes back, is parsed, and joined to the rows it is about.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from datamill.functions import fixed_values as V
from datamill.functions.prompts import fill, fixed2, percent
from datamill.operators.split import batches
from datamill.operators.validate import check, reason_for

OK, NO_ARRAY, ERROR = "ok", "no_array", "error"


def ask(
    requests: DataFrame, call: Callable[[list[str]], list[str]], prompt: str = "prompt", tries: int = 3, size: int = 1, wait: float = 1.0,
) -> DataFrame:
    """Adds ``response`` from a user function, called with ``size`` prompts at a time; what keeps failing gets null.

    A call fails if it raises or does not return one answer per prompt. After a failed call its prompts are
    asked one by one, up to ``tries`` times each, waiting ``wait`` seconds, then twice as long, between tries.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def some(texts: list[str]) -> list[str] | None:
            try:
                answers = list(call(texts))
            except Exception:
                return None
            return answers if len(answers) == len(texts) else None

        def one(text: str, left: int) -> str | None:
            for i in range(left):
                time.sleep(wait * 2**i)
                if found := some([text]):
                    return found[0]
            return None

        for pdf in frames:
            for start in range(0, len(pdf), size):
                part = pdf.iloc[start:start + size]
                texts = part[prompt].tolist()
                answers = some(texts)
                if answers is None:
                    answers = [one(t, tries - (len(texts) == 1)) for t in texts]
                yield part.assign(response=answers)

    plain = requests.drop("response")
    return plain.mapInPandas(run, T.StructType([*plain.schema.fields, T.StructField("response", T.StringType())]))


def array_text(response: Column | str) -> Column:
    """From the first opening to the last closing bracket; empty if there is no such part."""
    response = F.col(response) if isinstance(response, str) else response
    return F.regexp_extract(response, r"(?s)\[.*\]", 0)


def parse(answers: DataFrame, item: str, response: str = "response") -> DataFrame:
    """Adds ``parse_status`` and ``items``, an array of the given item type (a DDL string).

    An absent answer is an error. An item of a wrong shape has null fields.
    """
    text = array_text(response)
    rows = answers.withColumn("items", F.when(text != "", F.from_json(text, f"array<{item}>")))
    status = (
        F.when(F.col(response).isNull(), F.lit(ERROR)).when(text == "", F.lit(NO_ARRAY))
        .when(F.col("items").isNull(), F.lit(ERROR)).otherwise(F.lit(OK))
    )
    return rows.withColumn("parse_status", status)


# --- generation ----------------------------------------------------------------------------------

def request_plan(tasks: DataFrame, total: str = "count", size: str = "batch_size") -> DataFrame:
    """One row per request: ``batch`` and ``n``, the rows to ask for."""
    number = F.ceil(F.col(total) / F.col(size)).cast("int")
    rows = tasks.where(F.col(total) > 0).select("*", F.explode(F.sequence(F.lit(0), number - 1)).alias("batch"))
    return rows.withColumn("n", F.least(F.col(size), F.col(total) - F.col("batch") * F.col(size)).cast("int"))


def accept(candidates: DataFrame, reason: Column, total: int | Column, by: list[str], order: list[str]) -> DataFrame:
    """Adds reason, valid and ``accepted``: the first ``total`` valid rows of each group by order."""
    rows = check(candidates, reason)
    place = F.row_number().over(Window.partitionBy(*by, "valid").orderBy(*order))
    limit = F.lit(total) if isinstance(total, int) else total
    return rows.withColumn("accepted", F.col("valid") & (place <= limit))


def first_valid(candidates: DataFrame, reason: Column, total: int, by: list[str], order: list[str]) -> DataFrame:
    """Only the accepted rows. Map tasks keep at most ``total`` rows per group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return candidates.where(reason.isNull()).withColumn("_place", place).where(F.col("_place") <= total).drop("_place")


def generated(answers: DataFrame, task: dict, item: str, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid examples of generation answers (batch, response), and one row of counts."""
    parsed = parse(answers, item)
    rows = parsed.select("batch", F.posexplode("items").alias("index", "item")).select("batch", "index", "item.*")
    marked = check(rows, reason_for(task))
    counts = marked.agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("dropped"))
    good = marked.where("valid").drop("valid", "reason")
    return (good if total is None else good.orderBy("batch", "index").limit(total)), counts


def provider_merge(rows: DataFrame, total: int, providers: list[str], order: list[str]) -> DataFrame:
    """The first rows of every provider, each an equal share of the total (rounded up)."""
    quota = -(-total // len(providers))
    place = F.row_number().over(Window.partitionBy("_provider").orderBy(*order))
    return rows.where(F.col("_provider").isin(providers)).withColumn("place", place).where(F.col("place") <= quota)


def label_pairs_column(labels: Column) -> Column:
    """Array of (a, b), a before b, of the labels of one task."""
    tails = F.transform(labels, lambda x, i: F.transform(F.slice(labels, i + 2, F.size(labels)), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    return F.flatten(tails)


def contrast_requests(tasks: DataFrame, count: int = 5) -> DataFrame:
    """One request per pair of labels of a classification task with at least two labels."""
    pairs = tasks.where((F.col("type") == "classification") & (F.size("labels") >= 2)).select(
        "name", F.inline(label_pairs_column(F.col("labels")))
    )
    return pairs.withColumn("prompt", fill(V.CONTRAST, n=F.lit(str(count)), a=F.col("a"), b=F.col("b")))


def contrast_rows(answers: DataFrame, labels: list[str]) -> DataFrame:
    """Rows of contrastive answers that have a text and a label of the task."""
    parsed = parse(answers, "struct<text:string,label:string,confused_with:string>")
    rows = parsed.select(F.inline("items"))
    good = rows.where((F.coalesce("text", F.lit("")) != "") & F.col("label").isin(labels))
    return good.select("text", "label", F.lit(True).alias("_contrastive"), F.col("confused_with").alias("_confused_with"))


# --- judging -----------------------------------------------------------------------------------------

def _numbered(line: Column) -> Column:
    """Aggregate: the lines of a batch in order, one per row. A batch has a fixed small size."""
    lines = F.array_sort(F.collect_list(F.struct(F.col("index"), line.alias("line"))))
    return F.array_join(F.transform(lines, lambda x: x["line"]), "\n")


def _row_json(*columns: str) -> Column:
    return F.concat(F.col("index").cast("string"), F.lit(": "), F.to_json(F.struct(*columns)))


def _asked(body: DataFrame, head: str, tail: str, system: str, task: dict | None) -> DataFrame:
    """(batch, prompt) of batch bodies; with a task also ``system``, the text that says what the task is."""
    rows = body.select("batch", F.concat(F.lit(head), F.col("body"), F.lit(tail)).alias("prompt"))
    if task is None:
        return rows
    said = {"type": task["type"], "description": task.get("description") or "", "labels": ", ".join(task.get("labels") or [])}
    return rows.withColumn("system", fill(system, **{k: F.lit(v) for k, v in said.items()}))


def whole_prompt() -> Column:
    """System text and prompt in one, for model functions that take one text."""
    return F.concat("system", F.lit("\n\n"), "prompt")


def quality_requests(batched: DataFrame, task: dict | None = None, columns: tuple[str, ...] = ("text", "label")) -> DataFrame:
    """Requests to score the rows of (batch, index, ..) by the given columns, those of the whole row for other task types."""
    body = batched.groupBy("batch").agg(_numbered(_row_json(*columns)).alias("body"))
    return _asked(body, V.QUALITY_HEAD, V.QUALITY_TAIL, V.QUALITY_SYSTEM, task)


def judge_requests(batched: DataFrame, task: dict | None = None) -> DataFrame:
    """Requests to judge rows by text and label, or value where there is no label."""
    if "value" in batched.columns:
        value = F.col("value").cast("string")
        batched = batched.withColumn("label", F.coalesce("label", value) if "label" in batched.columns else value)
    body = batched.groupBy("batch").agg(_numbered(_row_json("text", "label")).alias("body"))
    return _asked(body, V.JUDGE_HEAD, V.JUDGE_TAIL, V.JUDGE_SYSTEM, task)


def zero_shot_requests(batched: DataFrame, task: dict | None = None) -> DataFrame:
    # A null text is written out, so that the answers by position stay with their rows.
    said = F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), F.col("text"), F.lit('"')))
    line = F.concat(F.col("index").cast("string"), F.lit(": "), said)
    body = batched.groupBy("batch").agg(_numbered(line).alias("body"))
    return _asked(body, V.ZERO_SHOT_HEAD, V.ZERO_SHOT_TAIL, V.ZERO_SHOT_SYSTEM, task)


def _answers_by_row(batched: DataFrame, parsed: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of failed batches without scores, and rows named by an answer with its scores."""
    named = parsed.where(F.col("parse_status") == OK).select(
        "batch", F.explode("items").alias("x")
    ).select("batch", F.col("x.index").alias("index"), *[F.col(f"x.{f}").alias(f) for f in fields])
    failed = parsed.where(F.col("parse_status") == ERROR).select("batch")
    scored = batched.join(named, ["batch", "index"]).withColumn("parse_status", F.lit(OK))
    kept = batched.join(failed, "batch", "left_semi").select(
        "*", *[F.lit(None).cast("double").alias(f) for f in fields], F.lit(ERROR).alias("parse_status")
    )
    return scored.unionByName(kept)


def confidence_filter(df: DataFrame, answers: DataFrame, threshold: float = 0.7, size: int = V.CONFIDENCE_BATCH, id: str = "id") -> DataFrame:
    """Rows scored at least the threshold; a failed batch stays whole, an answer without an array drops it."""
    parsed = parse(answers, "struct<index:int,score:double>")
    rows = _answers_by_row(batches(df, size, id), parsed, ["score"])
    return rows.where((F.col("parse_status") == ERROR) | (F.col("score") >= threshold)).drop("batch", "index")


def judge(df: DataFrame, answers: DataFrame, size: int = V.JUDGE_BATCH, id: str = "id") -> DataFrame:
    """Adds three scores and ``_quality``, their mean; rows of a failed batch get 0.5."""
    fields = ["relevance", "naturalness", "label_correctness"]
    parsed = parse(answers, "struct<index:int,relevance:double,naturalness:double,label_correctness:double>")
    rows = _answers_by_row(batches(df, size, id), parsed, fields)
    mean = (F.col(fields[0]) + F.col(fields[1]) + F.col(fields[2])) / 3
    rows = rows.withColumn("_quality", F.when(F.col("parse_status") == ERROR, F.lit(0.5)).otherwise(mean))
    return rows.withColumnsRenamed({f: f"_{f}" for f in fields}).drop("batch", "index")


def zero_shot(df: DataFrame, answers: DataFrame, size: int = V.ZERO_SHOT_BATCH, id: str = "id", label: str = "label") -> DataFrame:
    """``(.., actual, predicted, correct)``: labels by position in the answer to the batch.

    A missing label is 'unknown', a failed batch 'error'; batches without an array are not counted.
    """
    parsed = parse(answers, "string").where(F.col("parse_status") != NO_ARRAY).select("batch", "items", "parse_status")
    rows = batches(df, size, id).join(parsed, "batch")
    said = F.get("items", F.col("index"))
    predicted = F.when(F.col("parse_status") == ERROR, F.lit("error")).otherwise(F.coalesce(F.nullif(said, F.lit("")), F.lit("unknown")))
    return rows.select(
        id, F.col(label).alias("actual"), predicted.alias("predicted"),
        ((F.col("parse_status") == OK) & F.coalesce(said == F.col(label), F.lit(False))).alias("correct"),
    )


def zero_shot_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total"), F.count_if("correct").alias("correct"),
        F.coalesce(F.avg(F.col("correct").cast("double")), F.lit(0.0)).alias("accuracy"),
    )


# --- labelling of selected rows --------------------------------------------------------------------------

def label_line(task_type: str, rank: Column) -> Column:
    """One line of a labelling request for a selected row."""
    head = F.concat(rank.cast("string"), F.lit(". "))
    quoted = F.concat(F.lit('"'), F.col("text"), F.lit('"'))
    if task_type == "classification":
        sure = F.coalesce(percent(F.col("confidence")), F.lit("unknown"))
        return F.concat(head, quoted, F.lit(" (model confidence: "), sure, F.lit(")"))
    if task_type == "sequence-labeling":
        return F.concat(head, F.lit("tokens: "), F.to_json(F.coalesce("tokens", F.split("text", r"\s+"))))
    if task_type in ("scoring", "regression"):
        guess = F.coalesce(fixed2(F.col("prediction")), F.lit("?"))
        return F.concat(head, quoted, F.lit(" (model predicted: "), guess, F.lit(")"))
    raise ValueError(f"unsupported task type: {task_type}")


def relabel_line(rank: Column) -> Column:
    return F.concat(
        rank.cast("string"), F.lit('. "'), F.col("text"), F.lit('" (model predicted: '), F.col("predicted"),
        F.lit(", confidence: "), percent(F.col("confidence")), F.lit(")"),
    )


def label_request(selected: DataFrame, task: dict, order: list[Column]) -> DataFrame:
    """One row with the labelling request for the (few) selected rows, in the given order."""
    labels = F.lit(", ".join(task.get("labels") or []))
    span = task.get("scoreRange") or {}
    ends = {"lo": F.lit(f"{span.get('min', V.SCORE_MIN):g}"), "hi": F.lit(f"{span.get('max', V.SCORE_MAX):g}")}
    kind = task["type"]
    if kind == "classification":
        head, tail = fill(V.LABEL_HEAD, labels=labels), V.LABEL_TAIL
    elif kind == "sequence-labeling":
        head, tail = fill(V.TAG_HEAD, labels=labels), V.TAG_TAIL
    else:
        head, tail = fill(V.SCORE_HEAD, **ends), V.SCORE_TAIL
    ranked = selected.withColumn("index", F.row_number().over(Window.orderBy(*order)))
    return ranked.agg(_numbered(label_line(kind, F.col("index"))).alias("body")).select(
        F.concat(head, F.col("body"), F.lit(tail)).alias("prompt")
    )


def relabel_request(selected: DataFrame, labels: list[str], order: list[Column]) -> DataFrame:
    """Request to correct the labels of selected rows (text, predicted, confidence)."""
    ranked = selected.withColumn("index", F.row_number().over(Window.orderBy(*order)))
    head = fill(V.RELABEL_HEAD, labels=F.lit(", ".join(labels)))
    return ranked.agg(_numbered(relabel_line(F.col("index"))).alias("body")).select(
        F.concat(head, F.col("body"), F.lit(V.RELABEL_TAIL)).alias("prompt")
    )


# --- demonstrations ----------------------------------------------------------------------------------------

def answer_correct(task_type: str, answer: Column, label: Column | None = None, value: Column | None = None, tags: Column | None = None) -> Column:
    """Whether an answer to a few-shot prompt counts as correct."""
    answer = F.trim(answer)
    if task_type == "classification":
        return F.lower(answer) == F.lower(F.coalesce(label, F.lit("")))
    if task_type in ("scoring", "regression"):
        return F.coalesce(F.abs(answer.try_cast("double") - value) < 0.5, F.lit(False))
    if task_type == "sequence-labeling":
        def kinds(x: Column) -> Column:
            return F.array_distinct(F.array_remove(F.coalesce(x, F.array().cast("array<string>")), "O"))

        said = F.from_json(answer, "array<string>")
        gold, found = kinds(tags), kinds(said)
        share = F.size(F.array_intersect(gold, found)) / F.size(gold)
        right = F.when(F.size(gold) > 0, share >= 0.5).otherwise(F.size(found) == 0)
        return F.coalesce(said.isNotNull() & right, F.lit(False))
    raise ValueError(f"unknown task type: {task_type}")


def rank_strategies(answers: DataFrame) -> DataFrame:
    """``(strategy, total, correct, accuracy)`` of candidate demonstration sets, best first."""
    out = answers.groupBy("strategy").agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"))
    return out.withColumn("accuracy", F.col("correct") / F.col("total")).orderBy(F.desc("accuracy"), "strategy")

"""One round of active labelling: pool, uncertainty, selection, request, answer, checked rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from datamill.operators import active, responses
from datamill.operators.validate import check, reason_for
from datamill.sources.tables import tag_labelled

ITEMS = {
    "classification": "struct<text:string,label:string>",
    "scoring": "struct<text:string,value:double>",
    "regression": "struct<text:string,value:double>",
    "sequence-labeling": "struct<tokens:array<string>,tags:array<string>>",
}


def choose(uncertain: DataFrame, k: int = 10) -> DataFrame:
    """The k most uncertain rows of a pool."""
    return active.most_uncertain(uncertain, k)


def request(selected: DataFrame, task: dict) -> DataFrame:
    return responses.label_request(selected, task, [F.desc("uncertainty"), F.asc("id")])


def labelled(answers: DataFrame, task: dict) -> DataFrame:
    """Valid rows of the answers, tagged with their source; an answer that failed adds nothing."""
    rows = responses.parse(answers, ITEMS[task["type"]]).select(F.inline("items"))
    text = "text" if "text" in rows.columns else None
    marked = check(rows if text else rows.withColumn("text", F.array_join("tokens", " ")), reason_for(task))
    return tag_labelled(marked.where("valid").drop("valid", "reason"))


def label_round(uncertain: DataFrame, task: dict, call: Callable[[list[str]], list[str]], k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Selected rows and the newly labelled ones, with the model call of the user."""
    selected = choose(uncertain, k)
    return selected, labelled(responses.ask(request(selected, task), call), task)


def iteration(task: str, method: str, pool: DataFrame, selected: DataFrame, new: DataFrame, accuracy: float | None = None) -> DataFrame:
    """One history row of a round."""
    one = pool.agg(F.count("*").alias("pool"))
    return one.select(
        F.lit(task).alias("task"), F.lit(method).alias("method"), "pool",
        selected.agg(F.count("*")).scalar().alias("selected"), new.agg(F.count("*")).scalar().alias("added"),
        F.lit(accuracy).cast("double").alias("accuracy_before"), F.current_timestamp().alias("ts"),
    )

"""Active learning, round by round: uncertainty, selection, request, answer, labelled rows, history.

Every step is made once per (task, round), so a round that broke off or is run again goes on where it was: the
same rows are selected, answered requests are not asked again and nothing is appended twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from datamill.operators.active import uncertainty
from datamill.plans.label_round import choose, iteration, labelled, request
from datamill.session import cut_lineage
from datamill.sources.ledger import ask_open
from datamill.sources.steps import Steps
from datamill.sources.tables import tag_labelled

METHODS = {"classification": "confidence", "scoring": "dropout", "regression": "dropout", "sequence-labeling": "margin"}


@dataclass
class Round:
    selected: DataFrame
    labelled: DataFrame
    history: DataFrame


def active_round(
    steps: Steps, pool: DataFrame, task: dict, number: int, call: Callable[[list[str]], list[str]],
    k: int = 10, model: str = "labeller", accuracy: float | None = None, measured: bool = False, **options,
) -> Round:
    """One round on a pool of predictions; ``measured`` says that it has its ``uncertainty`` already.

    ``options`` go to :func:`datamill.operators.responses.ask`. A round without an answer adds no rows and can be run again
    under the next number.
    """
    name, kind = task["name"], task["type"]
    rated = pool if measured else uncertainty(kind, pool)
    selected = steps.once(name, number, "selected", lambda: choose(rated, k))
    answers = ask_open(request(selected, task), f"{steps.root}/ledger", model, call, **options)
    new = steps.once(name, number, "labelled", lambda: labelled(answers, task))
    history = steps.once(name, number, "history", lambda: iteration(name, METHODS[kind], pool, selected, new, accuracy))
    return Round(selected, new, history)


def training_rows(steps: Steps, existing: DataFrame, task: str) -> DataFrame:
    """The training rows with those of all finished rounds, marked by their source."""
    added = steps.every(task, "labelled")
    return existing if added is None else existing.unionByName(tag_labelled(added.drop("round")), allowMissingColumns=True)


def history(steps: Steps, task: str) -> DataFrame:
    """One row per finished round, oldest first."""
    rows = steps.every(task, "history")
    return steps.spark.createDataFrame([], "task string, round int") if rows is None else rows.orderBy("round")


def active_loop(
    steps: Steps, pool_of: Callable[[int], DataFrame], task: dict, rounds: int, call: Callable[[list[str]], list[str]], k: int = 10, **options,
) -> DataFrame:
    """Rounds up to number ``rounds``, each on the pool that ``pool_of`` gives for its number, after retraining; their history.

    Texts selected in an earlier round are not asked about again.
    """
    for number in range(1, rounds + 1):
        pool = pool_of(number)
        before = steps.every(task["name"], "selected")
        if before is not None:
            seen = cut_lineage(before.where(F.col("round") < number).select("text").distinct())
            pool = pool.join(seen, "text", "left_anti")
        active_round(steps, pool, task, number, call, k, **options)
    return history(steps, task["name"])

"""Search for the demonstrations that make a model answer best, and keep the winner.

Every (set of demonstrations, validation row) is one request in one table; answers are scored and sets ranked in one
aggregation. Requests go through the ledger, so a search that broke off asks only what is open. Demonstrations are not shuffled
or stored with every request: a request is its set's name and the validation row's text until it is asked.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from datamill.functions.prompts import example_text, few_shot_prompt, task_header
from datamill.operators.responses import answer_correct, rank_strategies
from datamill.operators.select import candidate_sets
from datamill.session import cut_lineage
from datamill.sources.ledger import ask_open
from datamill.sources.tables import load_few_shot, save_few_shot

STRATEGIES = ("random", "balanced", "diverse")


@dataclass
class Search:
    ranking: DataFrame
    best: DataFrame


def demonstration_sets(train: DataFrame, task_type: str, k: int, strategies: tuple[str, ...], trials: int) -> DataFrame:
    """(strategy, demos, examples): one row per candidate set, at most ``k`` rows in each, by id."""
    rows = candidate_sets(train, task_type, k, strategies, trials)
    label = F.col("label") if "label" in rows.columns else F.col("value").cast("string") if "value" in rows.columns else F.lit(None).cast("string")
    text = F.col("text") if "text" in rows.columns else F.array_join("tokens", " ")
    demo = F.struct("id", example_text(task_type).alias("t"), text.alias("text"), label.alias("label"))
    sets = rows.groupBy("strategy").agg(F.array_sort(F.collect_list(demo)).alias("d"))
    return sets.select(
        "strategy", F.array_join(F.transform("d", lambda x: x["t"]), "\n\n").alias("demos"),
        F.transform("d", lambda x: F.struct(x["text"].alias("text"), x["label"].alias("label"))).alias("examples"))


def requests(sets: DataFrame, val: DataFrame, header: str, task_type: str) -> DataFrame:
    """One request per set and validation row; the few sets are carried along as one literal table."""
    every = sets.agg(F.collect_list(F.struct("strategy", "demos"))).scalar()
    query = F.col("text") if "text" in val.columns else F.array_join("tokens", " ")
    return _prompted(val.select("*", query.alias("_query"), F.inline(every)), header, task_type)


def _prompted(rows: DataFrame, header: str, task_type: str) -> DataFrame:
    return rows.withColumn("prompt", few_shot_prompt(F.lit(header), F.col("demos"), F.col("_query"), task_type)).drop("demos")


def search(
    train: DataFrame, val: DataFrame, task: dict, root: str, call: Callable[[list[str]], list[str]], model: str = "answerer",
    k: int = 5, strategies: tuple[str, ...] = STRATEGIES, trials: int = 3, **options,
) -> Search:
    """Ranked sets, best first, and the saved configuration of the best one. A request that got no answer counts as wrong."""
    spark, kind = train.sparkSession, task["type"]
    described = spark.createDataFrame(
        [(kind, task.get("description") or "", task.get("labels"), *[(task.get("scoreRange") or {}).get(e) for e in ("min", "max")])],
        "type string, description string, labels array<string>, score_min double, score_max double")
    header = described.select(task_header().alias("h")).first()["h"]
    sets = cut_lineage(demonstration_sets(train, kind, k, strategies, trials))
    few = F.broadcast(sets.select("strategy", "demos"))
    answers = ask_open(
        requests(sets, val, header, kind), f"{root}/ledger", model, call, parts=("strategy", "_query"),
        made=lambda rows: _prompted(rows.join(few, "strategy"), header, kind), **options)
    gold = {c: F.col(c) for c in ("label", "value", "tags") if c in val.columns}
    scored = answers.select("strategy", F.coalesce(answer_correct(kind, F.col("response"), **gold), F.lit(False)).alias("correct"))
    ranking = cut_lineage(rank_strategies(scored))
    best = ranking.orderBy(F.desc("accuracy"), "strategy").limit(1).join(sets, "strategy").select(
        F.lit(task["name"]).alias("task"), "strategy", F.lit(k).alias("k"), "accuracy", "examples", F.current_timestamp().alias("ts"))
    save_few_shot(best, f"{root}/few_shot")
    return Search(ranking, load_few_shot(spark, f"{root}/few_shot", task["name"]))

"""Whole jobs that break off and run again, the model store, and the request ledger."""

import re
import uuid

import pytest
from conftest import values
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from datamill.operators import active, ml, validate
from datamill.plans import active_round as A, few_shot as S
from datamill.plans.train import run_log, train_and_register
from datamill.session import checkpoint_dir
from datamill.sources import registry, steps as steps_module
from datamill.sources import ledger as L
from datamill.sources.ledger import ask_open, open_requests, read_ledger
from datamill.sources.model_store import ModelStore
from datamill.sources.steps import Steps

TASK = {"name": "mood", "type": "classification", "description": "mood", "labels": ["good", "bad"]}


@pytest.fixture
def folder(spark):
    return f"{checkpoint_dir(spark)}/jobs-{uuid.uuid4().hex}"


def test_waves_read_their_own_requests(rows, folder, monkeypatch):
    """Every wave reads only stored shares of its own, and prompts made of parts are stored without what is added to them."""
    seen, ask = [], L.ask
    def noted(part, *a, **k):
        plan = part._jdf.queryExecution().executedPlan().toString()
        seen.append((bool(re.search(r"PartitionFilters: \[[^\]]*_share", plan)), {r[0] for r in part.select("prompt").collect()}))
        return ask(part, *a, **k)

    monkeypatch.setattr(L, "ask", noted)
    head = "long " * 1000
    asked = rows([(f"t{i}", i) for i in range(40)] + [("t1", 40), (None, 41)], "text string, n int").withColumn("prompt", F.concat(F.lit(head), "text"))
    out = L.ask_open(
        asked, folder, "m", lambda texts: [t.upper() for t in texts], wave_rows=10, parts=("text",),
        made=lambda part: part.withColumn("prompt", F.concat(F.lit(head), "text")), tries=1, wait=0.0)
    assert {r.n: r.response for r in out.select("n", "response").collect()} == {
        **{i: (head + f"t{i}").upper() for i in range(40)}, 40: (head + "t1").upper(), 41: None}
    assert len(seen) > 2 and all(pruned for pruned, _ in seen) and sorted(t for _, texts in seen for t in texts) == sorted(f"{head}t{i}" for i in range(40))
    assert L.open_requests(asked, folder, "n", parts=("text",)).columns == ["key", "text"]
    assert L._waves([(0, 6), (1, 4), (2, 1), (3, 30)], 10) == [[0, 1], [2], [3]] and L._waves([], 10) == []


def test_a_broken_job_keeps_its_waves(rows, folder):
    requests = rows([(f"p{i}",) for i in range(40)] + [("p1",), (None,)], "prompt string")

    def breaks(texts):
        if "p7" in texts:
            raise SystemExit("driver or executor gone")
        return [f"first {t}" for t in texts]

    with pytest.raises(Exception):
        ask_open(requests, folder, "m", breaks, wave_rows=4, tries=1, wait=0.0)
    spark = requests.sparkSession
    kept = {r.key for r in read_ledger(spark, folder, "m").collect()}
    left = {r.prompt for r in open_requests(requests, folder, "m").collect()}
    assert kept and "p7" in left and len(kept) + len(left) == 40
    out = ask_open(requests, folder, "m", lambda texts: [f"second {t}" for t in texts], wave_rows=4, tries=1, wait=0.0)
    said = {r.prompt: r.response for r in out.collect()}
    assert {p for p, r in said.items() if r and r.startswith("second")} == left
    assert said[None] is None and out.count() == 42
    assert read_ledger(spark, folder, "m").where("asked > 1").isEmpty()
    # Another model has answered nothing yet.
    assert open_requests(requests, folder, "other").count() == 40


def test_failed_requests_stay_open_and_answers_stand(rows, folder):
    requests = rows([("a",), ("bb",)], "prompt string")

    def no(texts):
        raise ValueError("no")

    out = ask_open(requests, folder, "m", lambda t: t if "a" in t else no(t), tries=1, wait=0.0)
    assert sorted(values(out, "prompt", "status")) == [("a", "answered"), ("bb", "failed")]
    out = ask_open(requests, folder, "m", lambda t: [x * 2 for x in t], tries=1, wait=0.0)
    assert sorted(values(out, "prompt", "response")) == [("a", "a"), ("bb", "bbbb")]


def test_a_step_is_made_once(spark, folder, monkeypatch):
    steps, made = Steps(spark, folder), []

    def make():
        made.append(1)
        return spark.range(3 * len(made))

    def lost(*_):
        raise RuntimeError("driver lost before the state row")

    monkeypatch.setattr(steps_module, "append", lost)
    with pytest.raises(RuntimeError):
        steps.once("t", 1, "rows", make)
    monkeypatch.undo()
    assert steps.rounds("t") == 0 and steps.every("t", "rows") is None
    for _ in range(2):
        assert steps.once("t", 1, "rows", make).count() == 6
    assert len(made) == 2 and steps.once("t", 2, "rows", make).count() == 9
    assert sorted(values(steps.every("t", "rows").groupBy("round").count(), "round", "count")) == [(1, 6), (2, 9)]
    assert steps.rounds("t") == 2 and steps.every("u", "rows") is None


def test_rounds_go_on_where_they_broke_off(spark, rows, folder, monkeypatch):
    pool = rows([(i, f"text {i}", "good", 0.5 + i / 100) for i in range(20)], "id long, text string, label string, confidence double")
    steps = Steps(spark, folder)
    answer = lambda prompts: ['[{"text": "new", "label": "good"}, {"text": "", "label": "bad"}, {"text": "x", "label": "odd"}]' for _ in prompts]
    real = A.labelled
    monkeypatch.setattr(A, "labelled", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        A.active_loop(steps, lambda n: pool, TASK, 2, answer, 3, tries=1, wait=0.0)
    monkeypatch.setattr(A, "labelled", real)
    past = A.active_loop(steps, lambda n: pool, TASK, 2, lambda prompts: answer(prompts), 3, tries=1, wait=0.0)
    assert values(past, "round", "pool", "selected", "added", "method") == [(1, 20, 3, 1, "confidence"), (2, 17, 3, 1, "confidence")]
    assert {r.text for r in steps.every("mood", "selected").collect()} == {f"text {i}" for i in range(6)}
    assert read_ledger(spark, f"{folder}/ledger").where("asked > 1").isEmpty()
    both = A.training_rows(steps, rows([(1, "old", "bad")], "id long, text string, label string"), "mood")
    assert sorted(values(both, "text", "_source"), key=str) == [("new", "active_loop"), ("new", "active_loop"), ("old", None)]


def mood(rows, n=40):
    return rows([(i, ("lovely fine nice" if i % 2 else "awful sad poor") + f" day{i % 5}", "good" if i % 2 else "bad") for i in range(n)], "id long, text string, label string")


def test_train_register_roll_back(spark, rows, folder):
    data, store = mood(rows), ModelStore(spark, folder)
    train, val = data.where("id < 30"), data.where("id >= 30")
    few = {"logistic_regression": {"max_iter": 20}}
    train_and_register(store, train, val, "mood", "v1", ["logistic_regression"], few)
    # The second version has its labels turned.
    turned = train.withColumn("label", F.when(F.col("label") == "good", "bad").otherwise("good"))
    train_and_register(store, turned, val, "mood", "v2", ["logistic_regression"], few)
    train_and_register(store, turned, val, "mood", "v2", ["logistic_regression"], few)
    right = lambda: store.predict("mood", val).where("label = actual").count()
    assert right() == 0
    store.rollback("mood", "v1")
    assert right() == 10
    assert [r.version for r in registry.versions(store.rows(), "mood").collect()] == ["v2", "v1"]
    assert store.rows().where("member").count() == 2 and run_log(store).count() == 2
    assert set(store.members("mood")) == {"logistic_regression"}
    with pytest.raises(ValueError):
        store.current("unknown")


def test_own_estimator_is_stored(spark, rows, folder):
    data, store = mood(rows), ModelStore(spark, folder)
    trained = ml.train_classifier(data.where("id < 30"), data.where("id >= 30"), estimator=NaiveBayes(featuresCol="features", labelCol="_label"))
    path = store.save(trained, "mood", "nb")
    assert store.save(trained, "mood", "nb") == path and store.rows().count() == 1
    assert store.current("mood").meta["algorithm"] == "NaiveBayes"
    assert store.predict("mood", data).where("label = actual").count() == 40
    # Files of a version whose row was never written are not seen.
    trained.model.write().overwrite().save(f"{folder}/models/mood/later/NaiveBayes")
    assert store.current("mood").meta["version"] == "nb"


def test_few_shot_search_keeps_the_best_set(spark, rows, folder):
    train, val = mood(rows, 20), mood(rows, 8)

    def call(prompts):
        if any("day3\n" in p.rsplit("\n\nNow classify:\n", 1)[1] for p in prompts):
            raise RuntimeError
        # Right only where the demonstrations hold both labels.
        return [("good" if "lovely" in p.rsplit("Input:", 1)[1] else "bad") if "Label: good" in p and "Label: bad" in p else "none" for p in prompts]

    found = S.search(train, val, TASK, folder, call, k=2, strategies=("balanced", "random"), trials=2, tries=1, wait=0.0)
    ranking = found.ranking.collect()
    assert {r.total for r in ranking} == {8} and all(r.correct <= 7 for r in ranking)
    best = found.best.first()
    top = max(ranking, key=lambda r: (r.accuracy, [-ord(c) for c in r.strategy]))
    assert (best.strategy, best.accuracy, best.k) == (top.strategy, top.accuracy, 2)
    assert {e.label for e in best.examples} == {"good", "bad"}


def test_uncertainty_by_task_type(rows):
    tagged = rows([(1, 1.0), (2, float("inf"))], "id long, margin double")
    assert values(active.uncertainty("sequence-labeling", tagged).orderBy("id"), "uncertainty") == [(0.5,), (0.0,)]
    scored = (rows([(1, "a"), (1, "b")], "id long, feature string"), rows([("a", 1.0), ("b", 2.0)], "feature string, weight double"))
    assert active.dropout_uncertainty(*scored, lo=0.0, hi=9.0).count() == 1


def test_trainable_rows(rows):
    df = rows([("a b", "x"), ("", "x"), (None, "x"), ("c", None), ("c", "")], "text string, label string")
    assert validate.trainable(df, "classification").count() == 4


def test_task_requests_number_the_rows_once(rows, folder, monkeypatch):
    """Requests of all kinds and sizes come from one numbering, and every row is asked once in each kind."""
    from datamill.operators import split
    from datamill.queries import labelling

    rows([(i, f"text {i}", "en", "web") for i in range(50)], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    calls, number = [], split.id_positions
    monkeypatch.setattr(split, "id_positions", lambda *a: calls.append(a) or number(*a))
    found = labelling.QUERIES["task_requests"](rows([(1,)], "n int").sparkSession, folder).collect()
    assert len(calls) == 1
    assert {k: sum(r.kind == k for r in found) for k in ("judge_requests", "quality_requests", "zero_shot_requests")} == {
        "judge_requests": 4, "quality_requests": 3, "zero_shot_requests": 3}
    for kind in ("judge_requests", "quality_requests", "zero_shot_requests"):
        asked = "\n".join(r.prompt for r in found if r.kind == kind)
        assert all(asked.count(f'"text {i}"') == 1 for i in range(50))

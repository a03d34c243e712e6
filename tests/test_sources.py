import json

import pytest
from conftest import values
from pyspark.sql import functions as F, types as T

from datamill.operators import responses as R
from datamill.plans import label_round as L, prepare as PR
from datamill.sources import embedding_cache as C, experiments as E, jsonl as J, registry as G, tables as B, tasks as K
from datamill.streaming import increments as I

CLASS = J.SCHEMAS["classification"]


def test_jsonl_round_trip(spark, rows, tmp_path):
    path = str(tmp_path / "a")
    J.write_jsonl(rows([(1, "x", "a"), (2, "y", None)], "id long, text string, label string"), path)
    assert sorted(values(J.read_jsonl(spark, path, CLASS), "id", "text", "label")) == [(1, "x", "a"), (2, "y", None)]


def test_jsonl_blank_and_bad_lines(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('\n{"id": 1, "text": "x"}\n\n   \n{"id": 2}\n')
    bad.write_text('{"id": 1}\n{oops\n')
    assert J.read_jsonl(spark, str(good), CLASS).count() == 2
    with pytest.raises(Exception):
        J.read_jsonl(spark, str(bad), CLASS).collect()
    kept = J.read_jsonl(spark, str(bad), CLASS, keep_bad=True).cache()
    assert kept.where(F.col(J.BAD_LINE).isNotNull()).count() == 1


def test_load_and_merge(spark, tmp_path):
    syn, real = tmp_path / "s.jsonl", tmp_path / "r.jsonl"
    syn.write_text('{"text": "a", "label": "x"}\n{"text": "b", "label": "y", "_source": "active_loop"}\n')
    real.write_text('{"message": "c", "sentiment": "z", "more": 1}\n')
    out = J.load_and_merge(spark, str(syn), CLASS, str(real), input_field="message", label_field="sentiment")
    assert sorted(values(out, "text", "label", "_source")) == [("a", "x", "synthetic"), ("b", "y", "active_loop"), ("c", "z", "real")]
    assert J.load_and_merge(spark, str(tmp_path / "no"), CLASS, str(tmp_path / "none")).count() == 0


def test_experiments(spark, rows, tmp_path):
    path = str(tmp_path / "log")
    runs = rows([("t1", "lr", 0.8, {"C": "1"}, ["a", "b"], 10), ("t1", "svm", 0.9, {"C": "2"}, ["a", "b"], 20), ("t2", "lr", 0.5, None, None, None)],
                "task string, algorithm string, accuracy double, hyperparams map<string,string>, labels array<string>, train_size long")
    E.record(runs, path)
    log = E.read_log(spark, path)
    assert log.count() == 3 and values(log.select("feature_mode").distinct(), "feature_mode") == [("tfidf",)]
    first = E.unpack(log.where("task = 't1' AND algorithm = 'lr'")).first()
    assert first["labels"] == ["a", "b"] and first["hyperparams"] == {"C": "1"}
    assert dict(values(E.best(log), "task", "algorithm")) == {"t1": "svm", "t2": "lr"}
    ids = dict(values(log.where("task = 't1'"), "algorithm", "id"))
    diff = E.compare(log, ids["lr"], ids["svm"]).first()
    assert diff["accuracy_delta"] == pytest.approx(0.1) and diff["train_size_delta"] == 10 and not diff["same_algorithm"] and diff["same_data"]
    assert diff["changes"] == ["algorithm: lr → svm", "train size: 10 → 20", "hyperparams changed"]
    with pytest.raises(ValueError):
        E.compare(log, ids["lr"], "nothing")
    assert E.clear_task(spark, path, "t1") == 2
    assert values(E.read_log(spark, path), "task") == [("t2",)]
    assert E.clear_task(spark, path, "t1") == 0
    E.record(runs.where("task = 't1'"), path)
    assert E.read_log(spark, path).count() == 3


def test_cache(spark, rows, tmp_path):
    path = str(tmp_path / "cache")
    calls = []

    def embedder(texts):
        return [[float(len(t)), 1.0] for t in texts]

    texts = rows([(1, "aa"), (2, "b"), (3, "aa")], "id long, text string")
    out = C.embed_through_cache(texts, path, "m", embedder)
    assert sorted(values(out, "id", "embedding")) == [(1, [2.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 1.0])]
    assert C.read_cache(spark, path).count() == 2

    def broken(texts):
        raise RuntimeError("must not be called for known texts")

    assert C.embed_through_cache(texts, path, "m", broken).where("embedding IS NULL").count() == 0
    C.put(C.embed(C.misses(texts, C.read_cache(spark, path), "other"), "other", lambda t: [[0.0]] * len(t)), path)
    assert dict(values(C.counts(C.read_cache(spark, path)), "model", "n")) == {"m": 2, "other": 2}
    C.put(C.with_key(rows([("aa",)], "text string")).select("key", F.lit("m").alias("model"), F.array(F.lit(9.0).cast("float")).alias("embedding")), path)
    assert (1, [9.0]) in values(C.attach(texts, C.read_cache(spark, path), "m"), "id", "embedding")
    assert C.clear_model(spark, path, "m") == 3
    assert dict(values(C.counts(C.read_cache(spark, path)), "model", "n")) == {"other": 2}


def test_registry(spark, rows, tmp_path):
    path = str(tmp_path / "registry")
    for version, member, second in (("v1", False, 1), ("v2", False, 2), ("e1", True, 3)):
        G.register(rows([("t", version, "lr", 0.9, member)], "task string, version string, algorithm string, accuracy double, member boolean")
                   .withColumn("ts", F.timestamp_seconds(F.lit(second))), path)
    reg = lambda: G.read_registry(spark, path)
    assert values(G.current(reg()), "version") == [("v2",)]
    assert values(G.versions(reg(), "t"), "version") == [("v2",), ("v1",)]
    assert values(G.members(reg(), "t"), "version") == [("e1",)]
    G.rollback(spark, path, "t", "v1")
    assert values(G.current(reg()), "version") == [("v1",)]
    assert values(G.versions(reg(), "t"), "version") == [("v2",), ("v1",)]
    with pytest.raises(ValueError):
        G.rollback(spark, path, "t", "v9")


TASK = {"name": "a-b_1", "type": "classification", "description": "d", "labels": ["x", "y"]}


@pytest.mark.parametrize("change,want", [
    ({}, []), ({"name": "A b"}, ["name"]), ({"name": 5}, ["name"]), ({"name": None}, ["name"]), ({"type": "other"}, ["type"]),
    ({"labels": ["x"]}, ["labels"]), ({"labels": "x"}, ["labels"]), ({"labels": None}, ["labels"]), ({"description": None}, ["description"]),
    ({"type": "extraction"}, ["fields"]), ({"type": "extraction", "fields": ["f"]}, []), ({"type": "sequence-labeling", "labels": None}, ["labels"]),
    ({"type": "scoring", "labels": None}, []),
])
def test_task_rules(rows, change, want):
    task = {k: v for k, v in {**TASK, **change}.items() if v is not None}
    found = K.violations(rows([(json.dumps(task),)], "raw string"))
    assert [r["path"] for r in found.collect()] == want


def test_task_files(spark, rows, tmp_path):
    path = str(tmp_path / "tasks")
    K.save_tasks(rows([(json.dumps({**TASK, "synthetic": {"prompt": "p"}}),)], "raw string"), path)
    with pytest.raises(ValueError):
        K.save_tasks(rows([("[1]",)], "raw string"), path)
    got = K.fill_defaults(K.load_task(K.parse_tasks(K.read_tasks(spark, path)), "a-b_1")).first()
    assert got["synthetic"]["count"] == 100 and got["synthetic"]["batchSize"] == 10 and got["scoreRange"] is None


@pytest.mark.parametrize("text,status,n", [
    ('[{"text":"a"}]', "ok", 1), ('```json\n[{"text":"a"}]\n```', "ok", 1), ('Here: [{"text":"a"},\n{"text":"b"}] done', "ok", 2),
    ("nothing", "no_array", None), ("[{broken]", "error", None), (None, "error", None), ("[]", "ok", 0),
])
def test_parse(rows, text, status, n):
    r = R.parse(rows([(text,)], "response string"), "struct<text:string>").first()
    assert r["parse_status"] == status and (None if r["items"] is None else len(r["items"])) == n


def test_ask_survives_failures(rows):
    def call(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [t.upper() for t in texts]

    df = rows([(1, "a"), (2, "bad"), (3, "c")], "batch long, prompt string").coalesce(1)
    assert sorted(values(R.ask(df, call, wait=0.0), "batch", "response")) == [(1, "A"), (2, None), (3, "C")]


def test_confidence_filter_keeps_failed_batches(rows):
    df = rows([(i, "t") for i in range(6)], "id long, text string")
    answers = rows([(0, '[{"index":0,"score":0.7},{"index":1,"score":0.1}]'), (1, "[{broken]"), (2, "sorry")], "batch long, response string")
    assert sorted(values(R.confidence_filter(df, answers, size=2), "id")) == [(0,), (2,), (3,)]


def test_plan_and_quota(rows):
    plan = R.request_plan(rows([("t", 25, 10), ("u", 5, 10)], "name string, count int, batch_size int"))
    assert sorted(values(plan, "name", "batch", "n")) == [("t", 0, 10), ("t", 1, 10), ("t", 2, 5), ("u", 0, 5)]
    merged = R.provider_merge(rows([(i, "ab"[i % 2]) for i in range(20)], "id long, _provider string"), 5, ["a", "b"], ["id"])
    assert dict(values(merged.groupBy("_provider").count(), "_provider", "count")) == {"a": 3, "b": 3}


def test_label_round(rows):
    task = {"type": "classification", "labels": ["x", "y"]}
    pool = rows([(i, f"t{i}", i / 10, i / 10) for i in range(10)], "id long, text string, confidence double, uncertainty double")
    reply = 'Sure: [{"text":"t9","label":"x"},{"text":"t8","label":"zzz"}]'
    selected, new = L.label_round(pool, task, lambda prompts: [reply] * len(prompts), 3)
    assert values(selected, "id") == [(9,), (8,), (7,)]
    assert values(new, "text", "label", "_source") == [("t9", "x", "active_loop")]
    row = L.iteration("t", "conf", pool, selected, new, 0.5).first()
    assert (row["pool"], row["selected"], row["added"]) == (10, 3, 1)


def test_prepare(rows):
    syn = rows([(i, f"text number {i} " + "abcdefgh"[i % 8] * 30, "a") for i in range(8)] + [(20, "same", "b"), (21, "same ", "b")], "id long, text string, label string")
    out = PR.prepare(syn, labels=["a", "b"], ratio=0.8)
    assert out.rows.count() == 9 and out.train.count() == 7 and out.val.count() == 2
    assert values(out.deficit, "label", "deficit") == [("b", 4)]


def test_streams_add_once(spark, rows, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("_source", T.StringType())])
    inbox, table = str(tmp_path / "in"), str(tmp_path / "table")
    rows([(1, "a"), (2, "b")], "id long, text string").write.parquet(inbox)
    step = I.append_labelled_batch(table, schema)
    stream = lambda: spark.readStream.schema("id long, text string").parquet(inbox)
    I.run_once(stream(), step, str(tmp_path / "c1"))
    # A second query reads the same rows again, as after a lost checkpoint.
    I.run_once(stream(), step, str(tmp_path / "c2"))
    rows([(3, "c")], "id long, text string").write.mode("append").parquet(inbox)
    I.run_once(stream(), step, str(tmp_path / "c1"))
    assert sorted(values(B.read_table(spark, table, schema), "id", "_source")) == [(i, "active_loop") for i in (1, 2, 3)]
    I.run_once(stream(), I.embed_batch(str(tmp_path / "cache"), "m", lambda t: [[1.0]] * len(t)), str(tmp_path / "c3"))
    assert C.read_cache(spark, str(tmp_path / "cache")).count() == 3


def test_ask_in_small_calls(rows):
    def call(texts):
        assert len(texts) <= 2
        if "bad" in texts:
            return ["only one answer for all"] if len(texts) > 1 else []
        return [t.upper() for t in texts]

    df = rows([(i, t) for i, t in enumerate(["a", "b", "bad", "d", "e"])], "batch long, prompt string").coalesce(1)
    got = dict(values(R.ask(df, call, size=2, wait=0.0), "batch", "response"))
    assert got == {0: "A", 1: "B", 2: None, 3: "D", 4: "E"}

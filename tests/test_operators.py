import math

import numpy as np
import pyarrow as pa
import pytest
from conftest import values
from pyspark.sql import functions as F

from datamill.functions import text as T
from datamill.operators import active as A, augment as G, metrics as M, profile as P, select as S, sequences as Q, split as W, topk, validate as V, vote as O
from datamill.plans import evaluate


def test_stats(rows):
    df = rows([("a", "pos", None, "real"), ("b", "pos", None, None), ("c", "neg", None, "real"), ("d", "", 3.5, "x"), ("e", None, None, None)],
              "text string, label string, value double, _source string")
    got = {(k, n): c for k, n, c in values(P.dataset_stats(df), "kind", "name", "n")}
    assert got == {("total", "all"): 5, ("source", "real"): 2, ("source", "synthetic"): 2, ("source", "x"): 1,
                   ("label", "pos"): 2, ("label", "neg"): 1, ("label", "3.5"): 1, ("label", "unknown"): 1}


def test_deficit(rows):
    df = rows([("pos",)] * 80 + [("neg",)] * 10 + [("neutral",)] * 10, "label string")
    assert sorted(values(P.label_deficit(df, ["pos", "neg", "neutral"]), "label", "deficit")) == [("neg", 24), ("neutral", 24)]
    even = rows([("a",)] * 33 + [("b",)] * 33 + [("c",)] * 34, "label string")
    assert values(P.label_deficit(even, ["a", "b", "c"]), "label") == []
    assert ("d", 25) in values(P.label_deficit(even, ["a", "b", "c", "d"]), "label", "deficit")


@pytest.mark.parametrize("n,ratio,want", [(100, 0.8, 80), (50, 0.7, 35), (10, 0.8, 8), (3, 1.0, 3), (3, 0.0, 0)])
def test_split_sizes(spark, n, ratio, want):
    out = W.split(spark.range(n), ratio)
    assert out.count() == n and out.where("is_train").count() == want
    ordered = W.ordered_split(spark.range(n), ratio).where("is_train")
    assert sorted(r[0] for r in ordered.collect()) == list(range(want))


@pytest.mark.parametrize("n,k", [(20, 4), (15, 3), (17, 5), (3, 5)])
def test_folds(spark, n, k):
    sizes = dict(values(W.kfold(spark.range(n), k).groupBy("fold").count(), "fold", "count"))
    assert sum(sizes.values()) == n
    assert all(sizes.get(f, 0) == n // k for f in range(k - 1))


@pytest.mark.parametrize("kind", ["string", "double", "date"])
def test_row_numbers_of_any_id(spark, rows, kind):
    """Ids of other types, with repeats and nulls, are numbered in their own order; splits by order follow."""
    names = {"string": lambda i: f"{i * 7919 % 1000:04d}-x", "double": lambda i: i * 7919 % 1000 / 8, "date": lambda i: f"20{10 + i % 80}-01-{1 + i % 28:02d}"}
    data = [(names[kind](i), i) for i in range(500)] + [(None, 500), (None, 501), (names[kind](3), 502)]
    df = rows(data, f"id {'string' if kind == 'date' else kind}, n long").withColumn("id", F.col("id").cast(kind)).repartition(6)
    got = values(W.number_rows(df).orderBy("row_no"), "row_no", "id", "n")
    assert [r[0] for r in got] == list(range(503)) and len({r[2] for r in got}) == 503
    ids = [r[1] for r in got]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert sorted(r[0] for r in values(W.batches(df, 100).groupBy("batch").count(), "batch")) == list(range(6))
    train = values(W.ordered_split(df, 0.8).where("is_train"), "id")
    assert 395 <= len(train) <= 402 and all(x is None or x < ids[402] for x, in train)


def test_stratified_split_without_broadcast(spark, rows, monkeypatch):
    df = rows([(i, f"l{i % 5}") for i in range(100)], "id long, label string")
    sent = sorted(values(W.stratified_split(df), "id", "is_train"))
    monkeypatch.setattr(W, "SENT_STRATA", 0)
    assert sorted(values(W.stratified_split(df), "id", "is_train")) == sent and sum(t for _, t in sent) == 80


def test_row_numbers_and_batches(spark):
    df = spark.range(1000).select((F.col("id") * 7 - 3000).alias("id"))
    got = values(W.number_rows(df).orderBy("id"), "row_no")
    assert got == [(i,) for i in range(1000)]
    b = W.batches(df, 20).groupBy("batch").agg(F.count("*").alias("n"), F.max("index").alias("m"))
    assert set(values(b, "n", "m")) == {(20, 19)}


def test_stratified(rows):
    df = rows([(i, "a" if i < 70 else None) for i in range(100)], "id long, label string")
    got = dict(values(W.stratified_split(df, ratio=0.5).where("is_train").groupBy("label").count(), "label", "count"))
    assert got == {"a": 35, None: 15}


def test_classification_checks(rows):
    df = rows([("x", "a"), (" ", "a"), (None, "a"), ("x", None), ("x", "z")], "text string, label string")
    got = [r[0] for r in V.check(df, V.classification_reason(labels=["a"])).select("reason").collect()]
    assert got == [None, "text", "text", "label", "unknown_label"]


def test_score_checks(rows):
    df = rows([("x", 0.0), ("x", 5.0), ("x", 5.1), ("x", None), ("x", float("nan"))], "text string, value double")
    got = [r[0] for r in V.check(df, V.scoring_reason(lo=0, hi=5)).select("reason").collect()]
    assert got == [None, None, "range", "value", "value"]
    assert V.check(df, V.scoring_reason()).where("valid").count() == 3


def test_sequence_checks(rows):
    df = rows([(["a"], ["O"]), ([], []), (["a", "b"], ["O"]), (["a"], ["B-X"]), (["a"], ["B-PER"]), (["a"], [None])], "tokens array<string>, tags array<string>")
    got = [r[0] for r in V.check(df, V.sequence_reason(["PER"])).select("reason").collect()]
    assert got == [None, "tokens", "length", "unknown_tag", None, "unknown_tag"]
    assert V.tag_set(["PER", "LOC"]) == ["O", "B-PER", "I-PER", "B-LOC", "I-LOC"]


def test_quality_and_stages(rows):
    df = rows([(1, 0.7), (2, None), (3, 0.69)], "id long, _quality double")
    assert values(V.quality_filter(df), "id") == [(1,)]
    d = rows([(x,) for x in (0.1, 0.2, 0.5, 0.6, 0.8, 0.95)], "_difficulty double")
    assert dict(values(d.groupBy(V.curriculum_stage().alias("s")).count(), "s", "count")) == {"easy": 2, "medium": 2, "hard": 2}


def test_augment(rows):
    df = rows([(i, "good bad big small fast slow happy", "a") for i in range(20)], "id long, text string, label string")
    assert G.augment(df, 1).count() == 20
    out = G.augment(df, 3)
    assert out.where("copy = 0").count() == 20 and 20 < out.count() <= 60
    assert out.where("copy > 0 AND text = 'good bad big small fast slow happy'").count() == 0
    assert sorted(out.collect()) == sorted(G.augment(df.repartition(5), 3).collect())


def test_confusion(rows):
    pairs = list(zip(["pos", "pos", "neg", "neg", "pos", "neg"], ["pos", "neg", "neg", "neg", "pos", "pos"]))
    df = rows([(i, a, p) for i, (a, p) in enumerate(pairs)] + [(9, "pos", "other")], "id long, actual string, label string")
    cells = M.confusion(df.where("id < 9"), ["pos", "neg"])
    assert sorted(values(cells, "actual", "predicted", "n")) == [("neg", "neg", 2), ("neg", "pos", 1), ("pos", "neg", 1), ("pos", "pos", 2)]
    for _, p, r, f, s in values(M.per_label(cells), "label", "precision", "recall", "f1", "support"):
        assert p == r == pytest.approx(2 / 3) and f == pytest.approx(2 / 3) and s == 3
    assert M.confusion(df, ["pos", "neg"]).agg(F.sum("n")).first()[0] == 6


def test_calibration(rows):
    df = rows([(i, "a", "a" if i else "b", 0.95) for i in range(10)], "id long, actual string, label string, confidence double")
    bins = M.calibration(df)
    assert bins.count() == 10
    assert M.expected_calibration_error(bins).first()["ece"] == pytest.approx(0.05)
    none = M.expected_calibration_error(M.calibration(df.withColumn("confidence", F.lit(None).cast("double")))).first()
    assert none["has_confidence"] is False and none["ece"] == 0.0


def test_regression(rows):
    r = M.regression_metrics(rows([(1.0, 2.0), (2.0, 4.0)], "value double, score double")).first()
    assert (r["mse"], r["mae"], r["n"]) == (2.5, 1.5, 2) and r["correlation"] == pytest.approx(1.0)
    down = M.regression_metrics(rows([(1.0, 2.0), (2.0, 1.0)], "value double, score double")).first()
    assert down["correlation"] == pytest.approx(-1.0)
    empty = M.regression_metrics(rows([], "value double, score double")).first()
    assert (empty["n"], empty["mse"], empty["correlation"], empty["r2"]) == (0, 0.0, 0.0, None)
    flat = M.regression_metrics(rows([(1.0, 2.0), (1.0, 2.0)], "value double, score double")).first()
    assert (flat["correlation"], flat["r2"]) == (0.0, 0.0)


def test_report(rows):
    gold = rows([(1, "x" * 10, "a", None), (2, "x" * 100, "a", "p"), (3, "x" * 200, "b", None)], "id long, text string, label string, _provider string")
    gold = gold.withColumn("_source", F.lit("real"))
    preds = rows([(1, "b", 0.9), (2, "b", 0.6)], "id long, label string, confidence double")
    out = evaluate.report(gold, preds, ["a", "b"])
    got = {(k, n): c for k, n, c in values(out["errors"], "kind", "name", "n")}
    assert got == {("total", "all"): 3, ("pair", "a -> b"): 2, ("pair", "b -> none"): 1, ("length", "short"): 1, ("length", "medium"): 1,
                   ("length", "long"): 1, ("provider", "real"): 2, ("provider", "p"): 1}
    assert out["summary"].first()["accuracy"] == 0.0
    assert out["samples"].count() == 3


def test_vote(rows):
    df = rows([(1, "m1", 1, 0.9, "a"), (1, "m2", 2, 0.5, "b"), (1, "m3", 3, 0.5, "b"), (2, "m1", 1, 0.5, "a"), (2, "m2", 2, 0.5, "b")],
              "id long, model string, model_order int, weight double, label string")
    got = {r["id"]: r for r in O.weighted_vote(df).collect()}
    assert got[1]["label"] == "b" and got[1]["confidence"] == pytest.approx(1.0 / 1.9) and got[1]["agreement"] == pytest.approx(2 / 3)
    assert got[2]["label"] == "a" and got[2]["votes"] == {"a": 0.5, "b": 0.5}
    assert {r["id"]: r["label"] for r in O.weighted_vote(df, 0.52).collect()} == {1: "b", 2: None}


def test_tag_errors(rows):
    df = rows([(1, ["O", "B-X", "I-X"]), (2, ["O", "I-X"]), (3, ["B-Y", "I-X", "I-X"])], "id long, tags array<string>")
    assert sorted(values(Q.tag_errors(df), "id", "pos", "tag")) == [(2, 1, "I-X"), (3, 1, "I-X")]


def test_entities(rows):
    df = rows([
        (1, "in New York City now".split(), ["O", "B-LOC", "I-LOC", "I-LOC", "O"]),
        (2, "Ann met Bob".split(), ["B-PER", "O", "B-PER"]), (3, "no one".split(), ["O", "O"]),
        (4, "a b c".split(), ["B-X", "I-Y", "I-Y"]), (5, "a b".split(), ["B-X", "B-X"]), (6, [], []),
    ], "id long, tokens array<string>, tags array<string>")
    assert sorted(values(Q.entities(df), "id", "type", "start", "end", "text")) == [
        (1, "LOC", 1, 4, "New York City"), (2, "PER", 0, 1, "Ann"), (2, "PER", 2, 3, "Bob"), (4, "X", 0, 1, "a"), (5, "X", 0, 1, "a"), (5, "X", 1, 2, "b")]


def test_entity_metrics(rows):
    gold = rows([(1, ["a", "b", "c"], ["B-PER", "I-PER", "O"]), (2, ["d", "e"], ["B-LOC", "O"])], "id long, tokens array<string>, tags array<string>")
    pred = rows([(1, ["B-PER", "O", "O"]), (2, ["B-LOC", "O"])], "id long, tags array<string>")
    m = Q.match_tags(gold, pred)
    got = {r["type"]: r for r in Q.entity_metrics(m).collect()}
    assert got["PER"]["f1"] == 0 and got["LOC"]["f1"] == 1 and got["*"]["precision"] == 0.5
    assert Q.token_accuracy(m).first()["accuracy"] == pytest.approx(4 / 5)


def test_uncertainty(rows):
    df = rows([(1, 0.9), (2, None), (3, 0.2)], "id long, confidence double")
    assert values(A.most_uncertain(A.classification_uncertainty(df), 2), "id") == [(2,), (3,)]
    assert values(A.least_confident(df, 5), "id") == [(3,), (1,)]
    with pytest.raises(ValueError):
        A.uncertainty("extraction", df)


def test_dropout(rows):
    f = rows([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "id long, feature string")
    w = rows([("a", 1.0), ("b", 2.0), ("c", 1.0)], "feature string, weight double")
    got = {r["id"]: r for r in A.dropout_uncertainty(f, w, lo=0.0, hi=3.0).collect()}
    assert got[1]["prediction"] == 3.0
    # One feature only: dropped rounds fall back to the full score, so nothing varies.
    assert got[2]["uncertainty"] == 0.0


def test_selection(rows):
    df = rows([(i, f"text {i}", "a" if i < 10 else "b") for i in range(20)], "id long, text string, label string")
    assert dict(values(S.select_balanced(df, k=6).groupBy("label").count(), "label", "count")) == {"a": 3, "b": 3}
    assert S.select_examples("random", df, k=4).count() == 4
    assert set(values(S.select_diverse(df, k=3), "label")) == {("a",), ("b",)}
    assert S.select_diverse(df.limit(2), k=5).count() == 2
    cats = rows([(1, "stocks fell today", ""), (2, "the cat sat on the mat", "")], "id long, text string, label string")
    assert values(S.select_similar(cats, "a cat on a mat", 1), "id") == [(2,)]
    with pytest.raises(ValueError):
        S.select_examples("similar", df)
    with pytest.raises(ValueError):
        S.select_examples("best", df)


def test_covered_rows_still_fill_up(rows):
    df = rows([(i, "same words", "a") for i in range(5)], "id long, text string, label string")
    assert values(S.select_diverse(df, k=3).orderBy("pick"), "id", "pick") == [(0, 1), (1, 2), (2, 3)]


def test_similar_for_queries_fills_up(rows):
    docs = rows([(1, "a b c"), (2, "x y"), (3, ""), (4, "a")], "id long, text string")
    queries = rows([(1, "a b"), (2, "zzz"), (3, "")], "query_id long, text string")
    got = sorted(values(S.similar_for_queries(docs, queries, 2), "query_id", "rank", "id"))
    assert got == [(1, 1, 1), (1, 2, 4), (2, 1, 1), (2, 2, 2), (3, 1, 3), (3, 2, 1)]


def test_vote_with_missing_labels(rows):
    from datamill.operators.vote import weighted_vote

    data = [(1, "a", 1, 0.5, None), (1, "b", 2, 0.4, "x"), (2, "a", 1, 0.5, None)]
    got = {r["id"]: r for r in weighted_vote(rows(data, "id long, model string, model_order int, weight double, label string")).collect()}
    assert got[1]["label"] is None and got[1]["votes"] == {"x": 0.4} and got[2]["votes"] == {}


def test_null_text_keeps_its_line(rows):
    from datamill.operators.responses import zero_shot_requests

    df = rows([(0, 0, "a"), (0, 1, None), (0, 2, "c")], "batch long, index int, text string")
    assert '0: "a"\n1: null\n2: "c"' in zero_shot_requests(df).first()["prompt"]


def test_similar_for_queries_against_brute_force(rows, monkeypatch):
    """Same ranks as scoring every pair, while far fewer pairs are scored than there are."""
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(400)]
    share = 1 / np.arange(1, 401)
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=share / share.sum()))
    docs = [(i, text(rng.integers(0, 60))) for i in range(600)]
    queries = [(i, text(rng.integers(0, 30))) for i in range(12)] + [(20 + i, docs[7 * i][1] + " more words") for i in range(12)] + [(50, None), (51, "w0"), (52, "unseen")]
    docs += [(900, None), (901, ""), (902, "w0")]
    d, q = rows(docs, "id long, text string"), rows(queries, "query_id long, text string")
    monkeypatch.setattr(topk, "BLOCK_TERMS", 300)  # several passes
    got = {(r.query_id, r.rank): (r.id, round(r.similarity, 9)) for r in S.similar_for_queries(d, q, 4).collect()}
    pairs = d.join(q.withColumnRenamed("text", "other"), F.lit(True)).select(
        "query_id", "id", F.round(T.text_similarity(F.coalesce("text", F.lit("")), F.coalesce("other", F.lit(""))), 9).alias("s"))
    by = {}
    for query, id_, s in pairs.collect():
        by.setdefault(query, []).append((-s, id_))
    want = {(query, r + 1): (id_, -s) for query, found in by.items() for r, (s, id_) in enumerate(sorted(found)[:4])}
    assert got == want


def test_similar_rows_are_scored_for_few_pairs():
    """Copies and rarer words decide; pairs that share common words only are not looked at in full."""
    rng = np.random.default_rng(6)
    share = 1 / np.arange(1, 2001)
    texts = [sorted({f"u w{i}" for i in rng.choice(2000, 25, p=share / share.sum())}) for _ in range(3000)]
    queries = [texts[i][:-2] for i in range(0, 1000, 20)]
    index = topk.QueryIndex([len(t) for t in queries], [0] * 50, queries, 1)
    search = topk.Search(index)
    for low in range(0, 3000, 100):
        part = texts[low:low + 100]
        search.add(np.arange(low, low + 100), np.array([len(t) for t in part]), np.zeros(100, np.int64), pa.array(part))
    assert search.found[0].tolist() == list(range(50)) and search.found[2].tolist() == list(range(0, 1000, 20))
    assert search.scored < 0.2 * 3000 * 50


def test_copies_are_made_once(rows):
    """The condition on changed copies does not have their text made again."""
    spark = rows([(1,)], "id long").sparkSession
    df = spark.range(20).selectExpr("id", "concat('the good ', id) AS text")
    plan = G.augment(df, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan and not any("md5" in line for line in plan.splitlines() if "Filter " in line)


def test_absent_token_features_are_left_out_by_compiled_code(rows):
    df = rows([(1, ["New", "York", None])], "id long, tokens array<string>")
    cols = [F.col(c) for c in ("token", "prev1", "prev2", "next1", "next2")]
    out = Q.token_rows(df).select("pos", Q.token_features(*cols).alias("f"))
    assert "array_compact" not in out._jdf.queryExecution().analyzed().toString()
    found = dict(values(out, "pos", "f"))
    assert "BOS" in found[0] and "nw=york" in found[0] and "bigram=new|york" in found[1] and None not in found[2] and "len=10" in found[2]

import math
import re
import threading
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import RandomForestClassifier
from conftest import values
from pyspark.sql import functions as F

from datamill.functions.hashing import draw, drawn_from, hash_texts
from datamill.operators import metrics as M, ml, sequences as Q
from datamill.operators.active import dropout_uncertainty
from datamill.operators.tagger import Lists, Tagger, _packed, best_path, best_paths, doubts, train_tagger

GOOD, BAD = "great lovely product works well", "terrible awful broken waste money"


@pytest.fixture(scope="module")
def sentiment(spark):
    data = [(i, f"{GOOD if i % 2 else BAD} item{i % 5}", "pos" if i % 2 else "neg") for i in range(24)]
    df = spark.createDataFrame(data, "id long, text string, label string")
    return df.where("id < 18"), df.where("id >= 18")


@pytest.mark.parametrize("algorithm", ml.ALGORITHMS)
def test_classifiers(spark, sentiment, algorithm, tmp_path):
    train, val = sentiment
    t = ml.train_classifier(train, val, algorithm, {"max_iter": 20, "n_estimators": 10, "max_depth": 3})
    assert t.accuracy == 1.0 and t.meta["train_size"] == 18 and t.meta["val_size"] == 6
    t.model.write().overwrite().save(str(tmp_path / "m"))
    out = ml.predictions(type(t.model).load(str(tmp_path / "m")), val)
    assert out.where("label = actual").count() == 6
    assert (out.where("confidence IS NULL").count() == 6) == (algorithm == "svm")


def test_comparison_survives_a_failure(sentiment):
    results = ml.compare_classifiers(*sentiment, algorithms=["nonsense", "logistic_regression"], params={"logistic_regression": {"max_iter": 10}})
    assert [r["algorithm"] for r in results] == ["logistic_regression", "nonsense"] and results[1]["accuracy"] == 0.0


def test_importance(sentiment):
    train, val = sentiment
    top = ml.feature_importance(ml.train_classifier(train, val, params={"max_iter": 20}).model, train, 5)
    words = {r["feature"] for r in top.where("label = 'pos'").collect()}
    assert words & set(GOOD.split()) and top.where("label = 'neg'").count() == 5


def test_fields(rows):
    df = rows([(i, "mail me" if i % 2 else "call me", {"mail": "x" if i % 2 else None, "never": None}) for i in range(12)],
              "id long, text string, fields map<string,string>")
    stages, models = ml.train_fields(df, ["mail", "never"], steps=20)
    out = M.field_summary(ml.predict_fields(stages, models, df))
    assert dict(values(out, "field", "accuracy")) == {"mail": 1.0, "never": 1.0}
    assert models["never"] is False


def test_scorer(spark, rows, tmp_path):
    df = rows([(i, "good " * (i % 5) + "bad " * (4 - i % 5), float(i % 5)) for i in range(40)], "id long, text string, value double")
    s = ml.train_scorer(df, steps=50, hash_size=1024)
    r = M.regression_metrics(s.predict(df)).first()
    assert r["correlation"] > 0.9 and (s.lo, s.hi) == (0.0, 4.0)
    s.save(str(tmp_path / "s"))
    again = ml.Scorer.load(str(tmp_path / "s"))
    assert sorted(values(again.predict(df), "id", "score")) == sorted(values(s.predict(df), "id", "score"))
    feats, weights = ml.scorer_weights(s, df)
    raw = feats.join(weights, "feature").groupBy("id").agg(F.sum("weight").alias("w"))
    base = ml.scorer_offset(s)
    out = dropout_uncertainty(feats, weights, lo=s.lo, hi=s.hi, offset=base)
    pairs = out.join(s.predict(df).select("id", "score"), "id").select("prediction", "score").collect()
    assert pairs and all(abs(p - q) < 1e-9 for p, q in pairs)
    got = s.model.transform(ml._hash_input(df)).join(raw, "id").select(F.max(F.abs(F.col("prediction") - F.col("w") - base))).first()[0]
    assert got < 1e-9


def test_map_2d(rows):
    rng = np.random.default_rng(0)
    data = [(i, (rng.normal(size=6) * 0.1 + (5 if i % 2 else -5)).tolist()) for i in range(40)]
    pts = np.array(sorted(values(ml.map_2d(rows(data, "id long, embedding array<double>")), "id", "x", "y")))
    a, b = pts[0::2, 1:], pts[1::2, 1:]
    inter = np.linalg.norm(a.mean(0) - b.mean(0))
    assert inter > 5 * max(a.std(0).max(), b.std(0).max()) and abs(pts[:, 1:].mean()) < 1e-6


def test_best_path_is_optimal():
    rng = np.random.default_rng(0)
    emit, moves = rng.normal(size=(4, 3)), rng.normal(size=(4, 3))
    from itertools import product

    def total(p):
        return moves[-1, p[0]] + emit[0, p[0]] + sum(moves[p[i - 1], p[i]] + emit[i, p[i]] for i in range(1, 4))

    path, score = best_path(emit, moves)
    assert tuple(path) == max(product(range(3), repeat=4), key=total) and score.max() == pytest.approx(total(path))


def test_tagger(spark, rows, tmp_path):
    names = ["Ann", "Bob", "Eve", "Tom"]
    data = [(i, [names[i % 4], "visited", "Old", "Town", "today"], ["B-PER", "O", "B-LOC", "I-LOC", "O"]) for i in range(16)]
    data.append((99, [], []))
    df = rows(data, "id long, tokens array<string>, tags array<string>")
    tags = ["O", "B-PER", "I-PER", "B-LOC", "I-LOC"]
    model = train_tagger(df, tags, epochs=5, slots=4096, shards=2)
    m = Q.match_tags(df, model.predict(df))
    assert Q.token_accuracy(m).first()["accuracy"] == 1.0
    margins = model.margins(df)
    assert margins.where("id = 99").first()["uncertainty"] == 1.0 and margins.where("margin < 0").count() == 0
    model.save(spark, str(tmp_path / "t"))
    again = Tagger.load(spark, str(tmp_path / "t"))
    assert np.array_equal(again.weights, model.weights) and np.array_equal(again.moves, model.moves) and again.tags == tags


def test_no_label_is_made_up(rows):
    data = [(i, ("good fine nice " if i % 2 else "bad poor sad ") * 3, "pos" if i % 2 else "neg") for i in range(40)]
    df = rows(data, "id long, text string, label string")
    found = ml.feature_importance(ml.train_classifier(df, df).model, df, 2)
    assert {r["label"] for r in found.collect()} == {"neg", "pos"}
    missing = rows(data + [(99, "odd words here", None)], "id long, text string, label string")
    shared = ml.Features(missing, missing)
    assert shared.labels.labels == ["neg", "pos", "unknown"]
    shared.release()


def test_svd_keeps_the_mean(rows):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4)) * [3, 1, 0.5, 0.1] + [0, 0, 50, 0]
    df = ml.with_vector(rows([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>"))
    for method, data in (("svd", x), ("pca", x - x.mean(0))):
        first = ml.fit_reduction(df, method, 50).stages[-1].pc.toArray()
        assert first.shape == (4, 4)  # no more directions than dimensions
        assert abs(first[:, 0] @ np.linalg.svd(data)[2][0]) > 1 - 1e-6


def test_depth_beyond_spark_is_refused():
    with pytest.raises(ValueError):
        ml.classifier("random_forest", {"max_depth": 31})


def test_repeats_of_a_feature_are_dropped_by_themselves(rows):
    weights = rows([(1, 1.0)], "feature int, weight double")
    together = dropout_uncertainty(rows([(1, 1)] * 10, "id long, feature int"), weights).first()["uncertainty"]
    apart = dropout_uncertainty(rows([(1, 1, i) for i in range(10)], "id long, feature int, occurrence int"), weights).first()["uncertainty"]
    assert together == 0 and apart > 0


def test_tagger_margin_does_not_depend_on_idle_epochs(rows):
    data = [(i, ["Rome", "is", "big"], ["B-L", "O", "O"]) for i in range(4)]
    df = rows(data, "id long, tokens array<string>, tags array<string>")
    few, many = (train_tagger(df, ["O", "B-L"], epochs=n, shards=1).margins(df).first()["margin"] for n in (8, 40))
    assert abs(few - many) < 1e-9
    with pytest.raises(ValueError):
        train_tagger(df, ["O"])


def test_paths_side_by_side_are_those_one_by_one():
    """Whole numbers make ties, which must fall alike; eight tags take the way over arrays."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 8):
        sizes = rng.integers(0, 9, 40)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        emit, moves = rng.integers(-2, 3, (cuts[-1], n)) / 1.0, rng.integers(-1, 2, (n + 1, n)) / 1.0
        path, scores = best_paths(emit, cuts, moves)
        for k in np.flatnonzero(sizes):
            one, score = best_path(emit[cuts[k]:cuts[k + 1]], moves)
            plain = emit[cuts[k]] + moves[-1]
            for line in emit[cuts[k] + 1:cuts[k + 1]]:
                plain = (plain[:, None] + moves[:-1]).max(axis=0) + line
            assert (one == path[cuts[k]:cuts[k + 1]]).all() and (score == scores[k]).all() and (score == plain).all()


def test_texts_are_hashed_as_by_spark(rows):
    texts = ["", "a", "abcd", "bigram=a|b", "é" * 9, "12345678", "x" * 31, "y" * 32, "z" * 45, "ß" * 100]
    want = [r[0] for r in rows([(i, t) for i, t in enumerate(texts)], "id int, t string").orderBy("id").select(F.xxhash64("t")).collect()]
    assert hash_texts(pa.array([t.encode() for t in texts])).tolist() == want


def test_features_are_made_once_for_a_word(rows):
    """Packed words give every token the features that it has by itself; absent tokens and rows and the ends of rows too."""
    data = [(1, ["Ann", "saw", "Ann", "x" * 40]), (2, []), (3, None), (4, ["-"]), (5, ["a", None, "É1", "a"])]
    df = rows(data, "id int, tokens array<string>").coalesce(1)
    feats = F.transform(Q.token_features(*map(F.col, ("token", "prev1", "prev2", "next1", "next2"))), lambda f: F.pmod(F.xxhash64(f), F.lit(4096)))
    want = [sorted(r[0]) for r in Q.token_rows(df.where("id <> 3")).orderBy("id", "pos").select(feats).collect()]
    batch = _packed(df, 4096).toArrow().to_batches()[0]
    lists = Lists.of(batch, 0, 4096)
    got = lists.features(0, len(lists.codes))
    assert [sorted(int(x) for x in line if x < 4096) for line in got] == want
    weights = np.concatenate([np.random.default_rng(0).normal(size=(4096, 3)), np.zeros((1, 3))])
    assert np.allclose(lists.emissions(weights, 0, 5), weights[got].sum(axis=1))


def test_a_path_without_doubts_is_the_best(rows):
    rng = np.random.default_rng(2)
    sure = 0
    for k in range(300):
        sizes = rng.integers(0, 7, 5)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        emit, moves = 3 * rng.normal(size=(cuts[-1], 3)), rng.normal(size=(4, 3))
        best, _ = best_paths(emit, cuts, moves)
        path = np.where(rng.random(len(best)) < 0.1, rng.integers(0, 3, len(best)), best)
        places = doubts(emit, cuts, moves, path)
        for low, high in zip(cuts, cuts[1:]):
            right = (path[low:high] == best[low:high]).all()
            assert right == (not ((places >= low) & (places < high)).any())
            sure += bool(right and high > low)
    assert sure > 300


def test_wrong_sequences_are_learned_one_after_the_other(rows):
    """Looking ahead gives the weights of plain passes, which decode every sequence."""
    rng = np.random.default_rng(3)
    data = []
    for i in range(300):
        tokens = [rng.choice(["Ann", "Bob", "x", "yy", "zz1", "É"]) + str(rng.integers(0, 4)) for _ in range(rng.integers(1, 30) if i % 50 else 500)]
        data.append((i, tokens, ["B" if t[0].isupper() and rng.random() < 0.95 else "O" for t in tokens]))
    df = rows(data, "id long, tokens array<string>, tags array<string>")
    model = train_tagger(df, ["O", "B"], epochs=3, slots=512, shards=1)
    batch = _packed(df.repartition(1, "id").sortWithinPartitions(draw("id", "order")).select("id", "tokens"), 512).toArrow().to_batches()[0]
    lists, tags = Lists.of(batch, 0, 512), {r[0]: np.array([t == "B" for t in r[2]], np.int64) for r in data}
    weights, moves, total = np.zeros((513, 2)), np.zeros((3, 2)), [np.zeros((513, 2)), np.zeros((3, 2))]
    for _ in range(3):
        lag, seen, old = [np.zeros((513, 2)), np.zeros((3, 2))], 0, [weights.copy(), moves.copy()]
        for k, i in enumerate(batch.column("id")[0].values.to_pylist()):
            begin, end = lists.rows[k:k + 2]
            feats, gold = lists.features(begin, end), tags[i]
            path, _ = best_path(lists.emissions(weights, k, k + 1), moves)
            for at in np.flatnonzero(path != gold):
                for tag, sign in ((gold[at], 1.0), (path[at], -1.0)):
                    there = feats[at][feats[at] < 512]
                    np.add.at(weights, (there, tag), sign)
                    np.add.at(lag[0], (there, tag), sign * seen)
            if (path != gold).any():
                for way, sign in ((gold, 1.0), (path, -1.0)):
                    step = (np.concatenate([[2], way[:-1]]), way)
                    np.add.at(moves, step, sign)
                    np.add.at(lag[1], step, sign * seen)
            seen += 1
        for t, w, l in zip(total, (weights, moves), lag):
            t += w - l / seen
    assert np.allclose(model.weights, total[0][:-1] / 3) and np.allclose(model.moves, total[1] / 3)


def test_sequences_that_do_not_fit_their_tags_do_not_count(rows):
    data = [(1, ["Rome", "is"], ["B-L", "O"]), (2, ["Rome"], ["O", "O"]), (3, [], []), (4, None, None), (5, ["Rome"], None)]
    kind = "id long, tokens array<string>, tags array<string>"
    few, all_rows = (train_tagger(rows(d, kind), ["O", "B-L"], epochs=2, slots=64, shards=1) for d in (data[:1], data))
    assert np.array_equal(few.weights, all_rows.weights)
    found = {r["id"]: r["tags"] for r in all_rows.predict(rows(data, kind)).collect()}
    assert found[1] == ["B-L", "O"] and found[3] == [] and found[4] == []


def _talk(n):
    return [(i, ("good fine nice " if i % 2 else "bad poor sad ") * 3, "pos" if i % 2 else "neg") for i in range(n)]


def test_a_draw_is_compared_as_its_number(spark):
    df = spark.range(2000).selectExpr("cast(id AS string) AS k")
    at = df.select(draw("k", "s")).first()[0]
    for least in (0.0, 0.3, at, math.nextafter(at, 1), 0.999, 1.0):
        assert df.where((draw("k", "s") >= least) != drawn_from("k", "s", least)).isEmpty()
    assert spark.sql("SELECT cast(NULL AS string) AS k").where(drawn_from("k", "s", 0.0)).isEmpty()


def test_features_meet_their_weights_without_a_shuffle(rows):
    df = rows([(i, GOOD if i % 2 else BAD, float(i % 2)) for i in range(20)], "id long, text string, value double")
    feats, weights = ml.scorer_weights(ml.train_scorer(df, steps=5, hash_size=64), df)
    found = dropout_uncertainty(feats, weights)
    assert found.count() == 20
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString()


def test_commonest_terms_are_those_of_a_plain_count(rows, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [[f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(0, 40)) if x < 60] for _ in range(200)]
    plain = Counter(w for t in texts for w in t) + Counter(f"{a} {b}" for t in texts for a, b in zip(t, t[1:]))
    want = [t for t, _ in sorted(plain.items(), key=lambda x: (-x[1], x[0]))]
    df = rows([(t,) for t in texts] + [([],)], "_words array<string>").repartition(3)
    for hashes in (4, 64, 1 << 20):
        monkeypatch.setattr(ml, "PAIR_HASHES", hashes)
        for most in (5, 40, 10**5):
            assert ml.commonest_terms(df, most) == want[:most]


def test_a_limit_that_is_not_reached_needs_no_fit_of_its_own(sentiment, monkeypatch):
    train, val = sentiment
    fitted, plain = [], ml.classifier
    monkeypatch.setattr(ml, "classifier", lambda a, p, n: fitted.append(p) or plain(a, p, n))
    found = ml.grid_search(train, val, grid={"C": [0.1, 1.0], "max_iter": [2, 500, 1000]})
    assert [(p["C"], p["max_iter"]) for p in sorted(fitted, key=str)] == [(0.1, 1000), (0.1, 2), (1.0, 1000), (1.0, 2)]
    assert sorted((r["params"]["C"], r["params"]["max_iter"]) for r in found) == [(c, i) for c in (0.1, 1.0) for i in (2, 500, 1000)]
    assert all(r["error"] is None and r["model"] is not None for r in found)


def test_terms_that_occur_equally_often_come_in_order(rows):
    df = rows([(1, "zz yy xx"), (2, "yy zz"), (3, None)], "id long, text string")
    stages, found = ml.fit_text(df.where("text IS NOT NULL"), ["id"], 3)
    assert next(s.vocabulary for s in stages.stages if hasattr(s, "vocabulary")) == ["yy", "zz", "xx"]
    assert sorted(r["id"] for r in found.collect()) == [1, 2]
    found.unpersist()


def test_folds_are_trained_at_the_same_time(rows, monkeypatch):
    together = threading.Barrier(3, timeout=60)
    monkeypatch.setattr(ml, "train_classifier", lambda train, val, *a: together.wait() * 0 or ml.Trained(None, val.count() / 6, {}))
    folds = rows([(*r, i % 3) for i, r in enumerate(_talk(18))], "id long, text string, label string, fold int")
    assert {tuple(r) for r in ml.cross_validate(folds, 3).collect()} == {(0, 1.0), (1, 1.0), (2, 1.0)}


def test_forests_get_partitions_of_bounded_rows(rows, monkeypatch):
    class Forest(RandomForestClassifier):
        def fit(self, df, params=None):
            seen.append(df.rdd.getNumPartitions())
            return super().fit(df, params)

    seen: list[int] = []
    monkeypatch.setattr(ml, "FOREST_ROWS", 2)
    df = rows(_talk(40), "id long, text string, label string")
    shared = ml.Features(df, df)
    shared.fit(Forest(numTrees=2, maxDepth=2, featuresCol="features", labelCol="_label"))
    shared.release()
    assert seen == [20]


def _tfidf(documents, common, monkeypatch):
    """The rows of :func:`ml.tfidf` by brute force, of rows with repeated and absent ids."""
    monkeypatch.setattr(ml, "COMMON_TERMS", common)
    monkeypatch.setattr(ml, "TERMS_AT_ONCE", 2)
    counts = {}
    for key, text in documents:
        counts.setdefault(key, Counter()).update(re.findall(r"[^ \t\n\x0b\f\r]+", (text or "").lower()))
    df = Counter(term for found in counts.values() for term in found)
    return {
        (key, term): (n, n * math.log((len(documents) + 1) / (df[term] + 1)))
        for key, found in counts.items() for term, n in found.items()
    }


DOCUMENTS = [
    (1, "The cat the cat\tTHE"), (2, " the \n\x0bdog\x1cdog Été "), (3, None), (4, ""), (1, "the dog  cat"), (None, "the bird"), (5, "rare the dog"),
    (None, "bird été"), (6, "\x0c \r"), (1, "dog"), (7, "the été other"),
]


@pytest.mark.parametrize("common", [0, 5, 8, 1000])
def test_tfidf_of_common_and_rare_terms(rows, monkeypatch, common):
    expected = _tfidf(DOCUMENTS, common, monkeypatch)
    df = rows(DOCUMENTS, "doc long, body string")
    found = ml.tfidf(df, "doc", "body").collect()
    assert len(found) == len(expected)
    for r in found:
        tf, weight = expected[r["doc"], r["term"]]
        assert r["tf"] == tf and r["weight"] == pytest.approx(weight)


def test_tfidf_does_not_shuffle_words_of_documents(rows):
    plan = ml.tfidf(rows(DOCUMENTS, "id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not re.search(r"hashpartitioning\(id#\w+, term#", plan)
    # Common terms have their frequency where they were counted.
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan

"""Queries that train models. SQL gives their rows, gold labels and counts, and what must hold for every model."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from datamill.functions.text import tokenize
from datamill.operators import metrics as M, ml, sequences as Q, split as W
from datamill.operators.tagger import train_tagger
from datamill.operators.vote import weighted_vote
from datamill.operators.active import dropout_uncertainty, most_uncertain
from datamill.queries.views import EXAMPLES, LABELS, examples, sequences, table, u, with_views

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def _halves(df, salt: str = "split"):
    rows = W.hash_split(df, salt=salt)
    return rows.where("is_train").drop("is_train"), rows.where("NOT is_train").drop("is_train")


@query("tfidf_top", with_views(EXAMPLES) + r"""
, t AS (SELECT id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS term FROM examples),
tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT id, term, tf, tf * ln((1.0::double + (SELECT count(*) FROM examples)) / (df + 1.0::double)) AS weight FROM tf JOIN df USING (term))
SELECT id, term, tf, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(weight, 9) DESC, term) AS r FROM w) WHERE r <= 3""")
def _(spark, sf):
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("weight", 9)), "term"))
    rows = ml.tfidf(examples(spark, sf)).withColumn("r", rank).where("r <= 3")
    return rows.select("id", "term", "tf", F.round("weight", 6).alias("weight"))


VAL = f"val AS (SELECT id, label FROM examples WHERE NOT {u('id', 'split')} < 0.8)"


def _known():
    """A label that was trained on."""
    return F.col("label").isin(LABELS).alias("known")


def _sure():
    """A probability."""
    return ((F.col("confidence") > 0) & (F.col("confidence") <= 1 + 1e-9)).alias("sure")


def _fine():
    """A run without an error and with an accuracy that is a share."""
    return (F.col("error").isNull() & F.col("accuracy").between(0, 1)).alias("fine")


@query("text_classifier", with_views(EXAMPLES, VAL) + "SELECT id, label AS actual, true AS known, true AS sure, true AS better FROM val")
def _(spark, sf):
    """``better``: more validation rows are right than the commonest label alone would make right."""
    train, val = _halves(examples(spark, sf))
    trained = ml.train_classifier(train, val)
    found = ml.predictions(trained.model, val)
    commonest = val.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n") / F.sum("n")).scalar()
    return found.select("id", "actual", _known(), _sure(), (F.lit(trained.accuracy) > commonest).alias("better"))


@query("compare_algorithms", "SELECT algorithm, true AS fine FROM (VALUES ('logistic_regression'), ('svm'), ('random_forest')) a(algorithm)")
def _(spark, sf):
    train, val = _halves(examples(spark, sf))
    return ml.results_table(train, ml.compare_classifiers(train, val)).select("algorithm", _fine())


@query("grid_search", """
SELECT '{"C": ' || c || ', "max_iter": ' || i || '}' AS params, true AS fine FROM (VALUES ('0.01'), ('0.1'), ('1.0'), ('10.0')) a(c), (VALUES ('500'), ('1000')) b(i)""")
def _(spark, sf):
    train, val = _halves(examples(spark, sf))
    return ml.results_table(train, ml.grid_search(train, val)).select("params", _fine())


@query("vector_classifier", f"""
SELECT vec_id AS id, label::varchar AS actual, true AS known, true AS sure FROM embeddings WHERE NOT {u('vec_id', 'split')} < 0.8""")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("label"))
    train, val = _halves(rows)
    trained = ml.train_classifier(train, val, embedding="embedding", dim_reduce="pca")
    found = ml.predictions(trained.model, ml.with_vector(val))
    return found.select("id", "actual", F.col("label").isin([str(i) for i in range(10)]).alias("known"), _sure())


@query("cross_validation")
def _(spark, sf):
    folds = W.kfold(examples(spark, sf), 5)
    return M.fold_summary(ml.cross_validate(folds, 5))


@query("trained_ensemble", with_views(EXAMPLES, VAL) + "SELECT id, true AS known, true AS agreed, true AS decided FROM val")
def _(spark, sf):
    train, val = _halves(examples(spark, sf))
    models = ml.train_ensemble(train, val)
    found = weighted_vote(ml.ensemble_predictions(models, val), 0.5)
    return found.select(
        "id", (F.col("rejected") | F.col("label").isin(LABELS)).alias("known"), F.col("agreement").between(0.33, 1).alias("agreed"), (F.col("rejected") == (F.col("confidence") < 0.5)).alias("decided"))


@query("feature_importance", """
SELECT label, rank::integer AS rank, true AS ordered FROM (SELECT DISTINCT lang AS label FROM documents WHERE lang IS NOT NULL), range(1, 11) r(rank)""")
def _(spark, sf):
    train, val = _halves(examples(spark, sf))
    found = ml.feature_importance(ml.train_classifier(train, val).model, train, 10)
    stronger = F.lag("weight").over(Window.partitionBy("label").orderBy("rank"))
    return found.select("label", "rank", F.coalesce(stronger >= F.col("weight"), F.lit(True)).alias("ordered"))


@query("field_models", with_views(EXAMPLES, VAL) + "SELECT field, (SELECT count(*) FROM val) AS n, true AS fine FROM (VALUES ('number'), ('address')) f(field)")
def _(spark, sf):
    """Presence of a capitalised and of a numeric word as extraction fields."""
    rows = examples(spark, sf).withColumn("fields", F.create_map(
        F.lit("number"), F.nullif(F.regexp_extract("text", "[0-9]+", 0), F.lit("")),
        F.lit("address"), F.nullif(F.regexp_extract("text", r"\S+@\S+", 0), F.lit("")),
    ))
    train, val = _halves(rows)
    stages, models = ml.train_fields(train, ["number", "address"])
    return M.field_summary(ml.predict_fields(stages, models, val)).select("field", "n", F.col("accuracy").between(0.5, 1).alias("fine"))


def _scored(spark, sf):
    docs = examples(spark, sf).where(F.col("text").isNotNull())
    return docs.withColumn("value", F.least(F.size(tokenize("text")) / 200.0, F.lit(5.0)))


@query("scorer", with_views(EXAMPLES, VAL) + "SELECT count(*) AS n, true AS errors, true AS follows FROM val JOIN examples USING (id) WHERE text IS NOT NULL")
def _(spark, sf):
    train, val = _halves(_scored(spark, sf))
    found = M.regression_metrics(ml.train_scorer(train, 0.0, 5.0).predict(val))
    errors = (F.col("mse") >= 0) & (F.col("mae") <= F.col("rmse") + 1e-9) & (F.abs(F.col("rmse") * F.col("rmse") - F.col("mse")) < 1e-6)
    return found.select("n", errors.alias("errors"), (F.col("correlation") > 0).alias("follows"))


@query("scorer_uncertainty")
def _(spark, sf):
    train, val = _halves(_scored(spark, sf))
    scorer = ml.train_scorer(train, 0.0, 5.0)
    return most_uncertain(dropout_uncertainty(*ml.scorer_weights(scorer, val), lo=scorer.lo, hi=scorer.hi, offset=ml.scorer_offset(scorer)), 10)


@query("map_2d", """
WITH d AS (SELECT vec_id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE embedding IS NOT NULL)
SELECT (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS n, true AS centred, true AS uncorrelated, true AS widest_first, max(v) AS widest_axis, true AS wider
FROM (SELECT round(var_pop(x), 9) AS v FROM d GROUP BY i)""")
def _(spark, sf):
    """The first axis of the map is at least as wide as any axis of the embeddings, and no other axis of the map is wider."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = ml.map_2d(rows).agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    widths = rows.where("embedding IS NOT NULL").select(F.posexplode("embedding").alias("i", "v")).groupBy("i").agg(F.var_pop(F.col("v").cast("double")).alias("v"))
    widest = widths.agg(F.round(F.max("v"), 9)).scalar()
    near = lambda c: F.abs(F.col(c)) < 1e-6
    return found.select(
        "n", (near("mx") & near("my")).alias("centred"), near("c").alias("uncorrelated"), (F.col("vx") >= F.col("vy")).alias("widest_first"),
        widest.alias("widest_axis"), (F.col("vx") >= widest - 1e-6).alias("wider"))


@query("tagger")
def _(spark, sf):
    train, val = _halves(sequences(spark, sf).select("id", "tokens", F.col("gold").alias("tags")))
    model = train_tagger(train, ["O", "B-CAP", "I-CAP"])
    return Q.entity_metrics(Q.match_tags(val, model.predict(val)))


@query("tagger_uncertainty")
def _(spark, sf):
    train, val = _halves(sequences(spark, sf).select("id", "tokens", F.col("gold").alias("tags")))
    model = train_tagger(train, ["O", "B-CAP", "I-CAP"])
    return most_uncertain(model.margins(val), 10).select("id", "margin", "uncertainty")

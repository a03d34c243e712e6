"""Example, prediction, score, tag and experiment tables derived from the given tables.

Each view exists twice: as a DataFrame and as a SQL text for the side-by-side check. All rows and
whole texts take part. ``u(x, salt)`` is the seeded draw of :mod:`datamill.functions.hashing`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from datamill.functions.hashing import draw

LABELS = ["de", "en", "es", "fr"]
MODELS = [("lr", 0.85, 1), ("svm", 0.80, 2), ("rf", 0.70, 3)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def u(x: str, salt: str) -> str:
    """SQL text of the seeded draw."""
    return (
        f"(cast(concat('0x', substr(md5(concat(cast({x} as varchar), ':{salt}')), 1, 8)) as bigint)"
        " / 4294967296.0::double)"
    )


def with_views(*views: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(views) + "\n"


# --- examples -------------------------------------------------------------------------------

EXAMPLES = """examples AS (
  SELECT doc_id AS id, text, lang AS label,
         CASE WHEN doc_id % 3 = 0 THEN 'real' ELSE 'synthetic' END AS _source, source AS _provider
  FROM documents)"""


def examples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"),
        F.when(F.col("doc_id") % 3 == 0, "real").otherwise("synthetic").alias("_source"),
        F.col("source").alias("_provider"),
    )


# --- predictions of three models ------------------------------------------------------------

PREDS = f"""models(model, weight, model_order) AS (VALUES ('lr', 0.85::double, 1), ('svm', 0.80::double, 2), ('rf', 0.70::double, 3)),
preds AS (
  SELECT e.id, m.model, m.weight, m.model_order, e.label AS actual,
         CASE WHEN {u("concat(e.id, '-', m.model)", "label")} < m.weight THEN e.label
              WHEN e.label = 'en' THEN 'fr' WHEN e.label = 'fr' THEN 'es'
              WHEN e.label = 'es' THEN 'de' ELSE 'en' END AS label,
         CASE WHEN m.model <> 'svm'
              THEN floor({u("concat(e.id, '-', m.model)", "confidence")} * 1000) / 1000 END AS confidence,
         e.text, e._source, e._provider
  FROM examples e, models m)"""


def preds(spark: SparkSession, sf: str, model: str | None = None) -> DataFrame:
    """Predictions of all models, or of one, next to their gold label."""
    models = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(w).alias("weight"), F.lit(o).alias("model_order"))
        for m, w, o in MODELS if model in (None, m)
    ])
    rows = examples(spark, sf).select("*", F.inline(models)).withColumnRenamed("label", "actual")
    key = F.concat(F.col("id").cast("string"), F.lit("-"), F.col("model"))
    other = (
        F.when(F.col("actual") == "en", "fr").when(F.col("actual") == "fr", "es")
        .when(F.col("actual") == "es", "de").otherwise("en")
    )
    return rows.select(
        "*",
        F.when(draw(key, "label") < F.col("weight"), F.col("actual")).otherwise(other).alias("label"),
        F.when(F.col("model") != "svm", F.floor(draw(key, "confidence") * 1000) / 1000.0).alias("confidence"),
    )


# --- scores -----------------------------------------------------------------------------------

SCORES = f"scores AS (SELECT event_id AS id, value, value + 2 * {u('event_id', 's')} - 1 AS score, event_type FROM events)"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "value", (F.col("value") + 2 * draw("event_id", "s") - 1).alias("score"), "event_type"
    )


# --- tag sequences ------------------------------------------------------------------------------

SEQUENCES = f"""words AS (
  SELECT doc_id AS id, string_split_regex(trim(text, E' \\t\\n\\x0b\\f\\r'), '\\s+') AS tokens FROM documents WHERE text IS NOT NULL),
tokens AS (
  SELECT id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM words),
flagged AS (
  SELECT *, regexp_matches(token, '^[A-Z]') AS cap,
         coalesce(regexp_matches(lag(token) OVER (PARTITION BY id ORDER BY pos), '^[A-Z]'), false) AS prev_cap
  FROM tokens),
sequences AS (
  SELECT id, pos, token,
         CASE WHEN cap AND prev_cap THEN 'I-CAP' WHEN cap THEN 'B-CAP' ELSE 'O' END AS gold,
         CASE WHEN {u("concat(id, '-', pos)", "t")} < 0.1 THEN 'O'
              WHEN cap AND prev_cap THEN 'I-CAP' WHEN cap THEN 'B-CAP' ELSE 'O' END AS pred
  FROM flagged)"""


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """(id, tokens, gold, pred): capitalised runs are entities; a tenth of the tags is lost."""
    from datamill.functions.text import trim_ws
    from datamill.session import spread

    rows = spread(table(spark, sf, "documents").where(F.col("text").isNotNull()).select(
        F.col("doc_id").alias("id"), "text"
    )).select("id", F.split(trim_ws("text"), r"\s+").alias("tokens"))
    rows = rows.withColumn("caps", F.transform("tokens", lambda t: t.rlike("^[A-Z]")))
    before = F.concat(F.array(F.lit(False)), F.slice("caps", F.lit(1), F.size("caps") - 1))
    rows = rows.withColumn("gold", F.zip_with("caps", before, lambda c, p: (
        F.when(c & p, F.lit("I-CAP")).when(c, F.lit("B-CAP")).otherwise(F.lit("O"))
    )))
    def lose(tag: Column, pos: Column) -> Column:
        key = F.concat(F.col("id").cast("string"), F.lit("-"), pos.cast("string"))
        return F.when(draw(key, "t") < 0.1, F.lit("O")).otherwise(tag)

    return rows.select("id", "tokens", "gold", F.transform("gold", lose).alias("pred"))


# --- experiment log -------------------------------------------------------------------------------

EXPERIMENTS = f"""experiments AS (
  SELECT event_id AS id, event_type AS task, ts,
         CASE user_id % 3 WHEN 0 THEN 'logistic_regression' WHEN 1 THEN 'svm' ELSE 'random_forest' END AS algorithm,
         floor({u('event_id', 'acc')} * 10000) / 10000 AS accuracy, props AS data_hash,
         user_id % 7 * 100 AS train_size, user_id % 5 * 10 AS val_size,
         CASE WHEN user_id % 2 = 0 THEN 'tfidf' ELSE 'embeddings' END AS feature_mode, props AS hyperparams
  FROM events)"""


def experiments(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("user_id")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("task"), "ts",
        F.when(user % 3 == 0, "logistic_regression").when(user % 3 == 1, "svm").otherwise("random_forest").alias("algorithm"),
        (F.floor(draw("event_id", "acc") * 10000) / 10000.0).alias("accuracy"),
        F.col("props").alias("data_hash"),
        (user % 7 * 100).alias("train_size"), (user % 5 * 10).alias("val_size"),
        F.when(user % 2 == 0, "tfidf").otherwise("embeddings").alias("feature_mode"),
        F.col("props").alias("hyperparams"),
    )

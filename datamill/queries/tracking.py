"""Queries on the experiment log, the model registry, the embedding cache and task definitions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from datamill.functions.hashing import draw, text_key
from datamill.queries.views import EXAMPLES, EXPERIMENTS, examples, experiments, table, u, with_views
from datamill.session import checkpoint_dir
from datamill.sources.tables import append, live, read_table
from datamill.sources import embedding_cache as C, experiments as E, registry as R, tables as T, tasks as K

QUERIES, SQL = {}, {}
LOG = with_views(EXPERIMENTS)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


@query("experiment_stats", LOG + """
SELECT task, count(*) AS total, max(accuracy) AS best_accuracy, min(accuracy) AS worst_accuracy, round(avg(accuracy), 6) AS avg_accuracy,
       count(DISTINCT algorithm) AS algorithms_tried, count(DISTINCT data_hash) AS data_versions FROM experiments GROUP BY task""")
def _(spark, sf):
    return E.stats(experiments(spark, sf)).withColumn("avg_accuracy", F.round("avg_accuracy", 6))


@query("best_experiment", LOG + """
SELECT task, id, accuracy, algorithm FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY accuracy DESC, id) AS r FROM experiments) WHERE r = 1""")
def _(spark, sf):
    return E.best(experiments(spark, sf)).select("task", "id", "accuracy", "algorithm")


@query("recent_experiments", LOG + """
SELECT id, ts, json_extract_string(hyperparams, '$.k') AS k, accuracy FROM experiments WHERE task = 'click' ORDER BY ts DESC, id LIMIT 50""")
def _(spark, sf):
    log = experiments(spark, sf).withColumn("labels", F.lit("a,b"))
    return E.unpack(E.recent(log, "click")).select("id", "ts", F.col("hyperparams")["k"].alias("k"), "accuracy")


@query("compare_experiments", LOG + """
, top AS (SELECT task, id AS best FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY accuracy DESC, id) AS r FROM experiments) WHERE r = 1),
n AS (SELECT e.*, best FROM experiments e JOIN top USING (task) WHERE id <> best)
SELECT a.id AS a, b.id AS b, round(b.accuracy - a.accuracy, 6) AS accuracy_delta, a.data_hash = b.data_hash AS same_data, a.algorithm = b.algorithm AS same_algorithm,
  b.train_size - a.train_size AS train_size_delta, array_to_string(list_filter([
    CASE WHEN a.algorithm <> b.algorithm THEN 'algorithm: ' || a.algorithm || ' → ' || b.algorithm END,
    CASE WHEN a.data_hash <> b.data_hash THEN 'data changed (' || a.data_hash || ' → ' || b.data_hash || ')' END,
    CASE WHEN a.feature_mode <> b.feature_mode THEN 'features: ' || a.feature_mode || ' → ' || b.feature_mode END,
    CASE WHEN a.train_size <> b.train_size THEN 'train size: ' || a.train_size || ' → ' || b.train_size END,
    CASE WHEN a.hyperparams <> b.hyperparams THEN 'hyperparams changed' END], lambda x: x IS NOT NULL), '; ') AS changes
FROM n b JOIN experiments a ON a.id = b.best""")
def _(spark, sf):
    log = experiments(spark, sf)
    top = E.best(log).select("task", F.col("id").alias("a"))
    pairs = log.select("task", F.col("id").alias("b")).join(top, "task").where("a <> b").select("a", "b")
    out = E.compare_pairs(log, pairs)
    return out.withColumn("accuracy_delta", F.round("accuracy_delta", 6)).withColumn("changes", F.array_join("changes", "; "))


@query("prepared_runs", LOG + """
SELECT task, id::varchar AS id, feature_mode, '{"k":"' || json_extract_string(hyperparams, '$.k') || '"}' AS hyperparams, algorithm || ',other' AS labels, train_size, NULL::varchar AS notes
FROM experiments""")
def _(spark, sf):
    log = experiments(spark, sf).withColumn("hyperparams", F.from_json("hyperparams", "map<string,string>")).withColumn(
        "labels", F.array(F.col("algorithm"), F.lit("other"))
    )
    return E.prepare_runs(log).select("task", "id", "feature_mode", "hyperparams", "labels", "train_size", "notes")


@query("leaderboard", LOG + "SELECT id, algorithm, accuracy FROM experiments ORDER BY accuracy DESC, algorithm, id LIMIT 5")
def _(spark, sf):
    return E.leaderboard(experiments(spark, sf)).select("id", "algorithm", "accuracy")


@query("cleared_log", LOG + "SELECT task, count(*) AS n, (SELECT count(*) FROM experiments WHERE task = 'click') AS removed FROM experiments WHERE task <> 'click' GROUP BY task")
def _(spark, sf):
    """The log is written, one task is deleted from it, and what is left is read back."""
    path = f"{checkpoint_dir(spark)}/log-{uuid.uuid4().hex}"
    runs = experiments(spark, sf)
    kept = runs.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in runs.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in E.EXPERIMENTS
    ])
    append(kept, path, by="task")
    removed = E.clear_task(spark, path, "click")
    return E.read_log(spark, path).groupBy("task").agg(F.count("*").alias("n")).withColumn("removed", F.lit(removed).cast("bigint"))


REGISTRY_SQL = EXPERIMENTS + ", registry AS (SELECT task, 'v' || (train_size // 100) AS version, algorithm, accuracy, ts, id, user_id % 2 = 1 AS member FROM experiments JOIN (SELECT event_id, user_id FROM events) ON event_id = id)"


def registry(spark, sf):
    return experiments(spark, sf).select(
        "task", F.concat(F.lit("v"), F.floor(F.col("train_size") / 100).cast("string")).alias("version"), "algorithm", "accuracy", "ts", "id",
        (F.col("feature_mode") == "embeddings").alias("member"), F.concat(F.lit("/models/"), F.col("id").cast("string")).alias("path"),
    )


@query("current_models", with_views(REGISTRY_SQL) + """
SELECT task, version, accuracy, ts FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY ts DESC, version DESC) AS r FROM registry WHERE NOT member) WHERE r = 1""")
def _(spark, sf):
    return R.current(registry(spark, sf)).select("task", "version", "accuracy", "ts")


@query("model_versions", with_views(REGISTRY_SQL) + """
SELECT task, version, ts, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY task, version ORDER BY ts, id) AS r FROM registry WHERE NOT member) WHERE r = 1""")
def _(spark, sf):
    return R.versions(registry(spark, sf)).select("task", "version", "ts", "accuracy")


@query("ensemble_members", with_views(REGISTRY_SQL) + """
SELECT task, algorithm, version, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY task, algorithm ORDER BY ts DESC, version DESC) AS r FROM registry WHERE member) WHERE r = 1""")
def _(spark, sf):
    return R.members(registry(spark, sf)).select("task", "algorithm", "version", "accuracy")


@query("iteration_history", LOG + """
SELECT task AS task, algorithm AS method, train_size AS pool, ts, accuracy AS accuracy_before FROM experiments WHERE task = 'view'""")
def _(spark, sf):
    log = experiments(spark, sf).select("task", F.col("algorithm").alias("method"), F.col("train_size").alias("pool"), "ts", F.col("accuracy").alias("accuracy_before"))
    return T.history(log, "view")


@query("append_labelled", with_views(EXAMPLES) + """
SELECT CASE WHEN _source = 'real' THEN 'active_loop' ELSE _source END AS source, count(*) AS n,
  (SELECT count(*) FROM examples WHERE _source = 'real') AS added, (SELECT count(*) FROM examples) AS total FROM examples GROUP BY 1""")
def _(spark, sf):
    rows = examples(spark, sf)
    both, counts = T.append_labelled(rows.where("_source <> 'real'"), rows.where("_source = 'real'").select("id", "text", "label"))
    return both.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("n")).withColumns(
        {c: counts.select(c).scalar() for c in ("added", "total")}
    )


# Half of the vectors were written by a second model, and every third key was written twice.
CACHE_SQL = """cache AS (
  SELECT sha256(d.text) AS key, CASE WHEN e.vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS model, e.vec_id, v.t AS created_at
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, (SELECT unnest([0, 1]) AS t) v WHERE v.t = 0 OR e.vec_id % 3 = 0)"""


def cache(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    times = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return docs.join(vectors, "doc_id").select(
        text_key("text").alias("key"), F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("model"),
        F.explode(times).alias("created_at"), F.col("doc_id").alias("vec_id"), "embedding",
    )


@query("cache_latest", with_views(CACHE_SQL) + """
SELECT key, model, vec_id, cast(created_at AS integer) AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY key, model ORDER BY created_at DESC, vec_id DESC) AS r FROM cache) WHERE r = 1""")
def _(spark, sf):
    return T.latest(cache(spark, sf), ["key", "model"], ["created_at", "vec_id"]).select("key", "model", "vec_id", "created_at")


@query("cache_counts", with_views(CACHE_SQL) + "SELECT model, count(DISTINCT key) AS n FROM cache GROUP BY model")
def _(spark, sf):
    return C.counts(cache(spark, sf))


@query("cache_misses", with_views(CACHE_SQL) + """
SELECT DISTINCT sha256(text) AS key FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT key FROM cache WHERE model = 'a')""")
def _(spark, sf):
    return C.misses(table(spark, sf, "documents").select("text"), cache(spark, sf), "a").select("key")


@query("cache_hits", with_views(CACHE_SQL) + """
SELECT doc_id AS id, sha256(text) AS key FROM documents WHERE sha256(text) IN (SELECT key FROM cache WHERE model = 'a')""")
def _(spark, sf):
    return C.hits(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), cache(spark, sf), "a").select("id", "key")


@query("cached_vectors", with_views(CACHE_SQL) + """
, l AS (SELECT key, max(vec_id) AS vec_id FROM cache WHERE model = 'a' GROUP BY key)
SELECT d.doc_id AS id, l.vec_id FROM documents d LEFT JOIN l ON l.key = sha256(d.text)""")
def _(spark, sf):
    known = T.latest(cache(spark, sf).withColumn("embedding", F.col("vec_id")), ["key", "model"], ["vec_id"])
    out = C.attach(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), known, "a")
    return out.select("id", F.col("embedding").alias("vec_id"))


@query("cache_cleared", with_views(CACHE_SQL) + "SELECT model, count(*) AS n FROM cache WHERE model <> 'a' GROUP BY model")
def _(spark, sf):
    """The cache is written, one model is deleted from it, and what is left is read back."""
    path = f"{checkpoint_dir(spark)}/cache-{uuid.uuid4().hex}"
    append(cache(spark, sf).select(*C.CACHE.fieldNames()), path, by="model")
    C.clear_model(spark, path, "a")
    left = live(read_table(spark, path, C.CACHE))
    return left.groupBy("model").agg(F.count("*").alias("n"))


@query("embedding_join", """
SELECT d.doc_id AS id, d.lang AS label, len(e.embedding)::integer AS dims FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id""")
def _(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return C.join_embeddings(rows, vectors).select("id", "label", F.size("embedding").alias("dims"))


# Task definitions made of the events: every rule is broken by some of them.
def definitions(spark, sf):
    e = table(spark, sf, "events").select("event_id", draw("event_id", "task").alias("u"), "event_type")
    name = F.when(F.col("u") < 0.2, F.concat(F.lit("Bad "), F.col("event_type"))).when(F.col("u") >= 0.3, F.col("event_type"))
    kind = F.when(F.col("u") < 0.1, "nonsense").when(F.col("u") < 0.5, "classification").when(F.col("u") < 0.7, "extraction").otherwise("scoring")
    labels = F.when(F.col("u") < 0.35, F.array(F.lit("x"))).when(F.col("u") < 0.45, F.array(F.lit("x"), F.lit("y")))
    return e.select("event_id", F.to_json(F.struct(name.alias("name"), kind.alias("type"), F.lit("d").alias("description"), labels.alias("labels"))).alias("raw"))


@query("task_violations", f"""
WITH t AS (SELECT event_id, {u('event_id', 'task')} AS u FROM events),
x AS (
  SELECT event_id, 'name' AS path, 'required field missing' AS message FROM t WHERE u >= 0.2 AND u < 0.3
  UNION ALL SELECT event_id, 'name', 'must match pattern ^[a-z0-9_-]+$' FROM t WHERE u < 0.2
  UNION ALL SELECT event_id, 'type', 'must be one of: classification, extraction, regression, scoring, sequence-labeling' FROM t WHERE u < 0.1
  UNION ALL SELECT event_id, 'labels', 'needs at least 2 items' FROM t WHERE u < 0.35
  UNION ALL SELECT event_id, 'labels', 'required when type is "classification"' FROM t WHERE u >= 0.45 AND u < 0.5
  UNION ALL SELECT event_id, 'fields', 'required when type is "extraction"' FROM t WHERE u >= 0.5 AND u < 0.7)
SELECT * FROM x""")
def _(spark, sf):
    return K.violations(definitions(spark, sf), id="event_id").select("event_id", "path", "message")


@query("task_defaults", """
SELECT event_id, CASE WHEN user_id % 2 = 0 THEN user_id::integer ELSE 100 END AS count, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 10 END AS batch_size,
  CASE WHEN user_id % 5 = 0 THEN 0.8::double END AS split_ratio FROM events WHERE user_id % 3 <> 0
UNION ALL SELECT event_id, NULL, NULL, CASE WHEN user_id % 5 = 0 THEN 0.8::double END FROM events WHERE user_id % 3 = 0""")
def _(spark, sf):
    user = F.col("user_id").cast("string")
    count = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('{"count":'), user, F.lit("}"))).otherwise("{}")
    synthetic = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit(',"synthetic":'), count)).otherwise("")
    training = F.when(F.col("user_id") % 5 == 0, ',"training":{}').otherwise("")
    raw = table(spark, sf, "events").select("event_id", F.concat(F.lit('{"name":"'), F.col("event_id").cast("string"), F.lit('"'), synthetic, training, F.lit("}")).alias("raw"))
    rows = K.fill_defaults(K.parse_tasks(raw))
    return rows.select(
        F.col("name").cast("bigint").alias("event_id"), F.col("synthetic.count").alias("count"),
        F.col("synthetic.batchSize").alias("batch_size"), F.col("training.splitRatio").alias("split_ratio"),
    )

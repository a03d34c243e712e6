"""Queries on judging predictions, scores, votes and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from datamill.functions.numbers import cosine, entropy
from datamill.operators import metrics as M, profile as P, sequences as Q, validate as V, vote as O
from datamill.operators.active import dropout_uncertainty, least_confident, most_uncertain, classification_uncertainty
from datamill.queries.views import (
    EXAMPLES, LABELS, PREDS, SCORES, SEQUENCES, examples, preds, scores, sequences, table, u, with_views,
)
from datamill.session import spread
from datamill.functions.text import text_features

QUERIES, SQL = {}, {}
PR = with_views(EXAMPLES, PREDS)
LR = PR + ", lr AS (SELECT * FROM preds WHERE model = 'lr')\n"
GRID = "(SELECT a.label AS actual, b.label AS predicted FROM (VALUES ('de'), ('en'), ('es'), ('fr')) a(label), (VALUES ('de'), ('en'), ('es'), ('fr')) b(label))"
CELLS = LR + f""", cells AS (
  SELECT g.actual, g.predicted, coalesce(c.n, 0) AS n FROM {GRID} g
  LEFT JOIN (SELECT actual, label AS predicted, count(*) AS n FROM lr GROUP BY 1, 2) c USING (actual, predicted)),
sums AS (
  SELECT label, sum(CASE WHEN actual = label AND predicted = label THEN n ELSE 0 END) AS tp,
         sum(CASE WHEN predicted = label THEN n ELSE 0 END) AS pn, sum(CASE WHEN actual = label THEN n ELSE 0 END) AS support
  FROM cells, (VALUES ('de'), ('en'), ('es'), ('fr')) v(label) GROUP BY label),
pr AS (SELECT label, support, CASE WHEN pn > 0 THEN tp::double / pn ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp::double / support ELSE 0 END AS recall FROM sums),
per AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)
"""


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def rounded(df, *cols, digits: int = 6):
    """Doubles at a fixed number of digits: sums of doubles depend on the order of rows."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("model_accuracy", PR + """
SELECT model, count(*) AS n, count(*) FILTER (actual = label) AS correct, round(avg(CASE WHEN actual = label THEN 1.0::double ELSE 0 END), 6) AS accuracy
FROM preds GROUP BY model""")
def _(spark, sf):
    p = preds(spark, sf)
    out = p.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("actual") == F.col("label")).alias("correct"), M.accuracy(p).alias("accuracy"))
    return rounded(out, "accuracy")


@query("confusion", CELLS + "SELECT actual, predicted, n FROM cells")
def _(spark, sf):
    return M.confusion(preds(spark, sf, "lr"), LABELS)


@query("confusion_wide", CELLS + """
SELECT actual, sum(CASE WHEN predicted = 'de' THEN n END)::bigint AS de, sum(CASE WHEN predicted = 'en' THEN n END)::bigint AS en,
       sum(CASE WHEN predicted = 'es' THEN n END)::bigint AS es, sum(CASE WHEN predicted = 'fr' THEN n END)::bigint AS fr FROM cells GROUP BY actual""")
def _(spark, sf):
    return M.confusion_wide(M.confusion(preds(spark, sf, "lr"), LABELS), LABELS)


@query("per_label", CELLS + """
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::bigint AS support FROM per""")
def _(spark, sf):
    return rounded(M.per_label(M.confusion(preds(spark, sf, "lr"), LABELS)), "precision", "recall", "f1")


@query("class_report", CELLS + """
SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
       round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall,
       round(sum(f1 * support) / sum(support), 6) AS weighted_f1, sum(support)::bigint AS support,
       (SELECT round(avg(CASE WHEN actual = label THEN 1.0::double ELSE 0 END), 6) FROM lr) AS accuracy FROM per""")
def _(spark, sf):
    out = M.class_report(preds(spark, sf, "lr"), LABELS)
    return rounded(out, *[c for c in out.columns if c != "support"])


@query("gold_join", """
SELECT d.doc_id AS id, d.lang AS actual, CASE WHEN l.quality = 1 THEN d.lang WHEN l.quality = 0 THEN 'en' END AS label
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(spark, sf):
    gold = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("label"))
    given = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality"))
    out = M.match(gold, given)
    return out.select("id", "actual", F.when(F.col("quality") == 1, F.col("actual")).when(F.col("quality") == 0, "en").alias("label"))


@query("error_taxonomy", LR + """
, bad AS (SELECT concat(actual, ' -> ', label) AS pair, _provider AS provider,
          CASE WHEN length(text) < 50 THEN 'short' WHEN length(text) < 150 THEN 'medium' ELSE 'long' END AS length FROM lr WHERE actual <> label)
SELECT CASE WHEN grouping(pair) = 0 THEN 'pair' WHEN grouping(length) = 0 THEN 'length' WHEN grouping(provider) = 0 THEN 'provider' ELSE 'total' END AS kind,
       coalesce(pair, length, provider, 'all') AS name, count(*) AS n
FROM bad GROUP BY GROUPING SETS ((), (pair), (length), (provider))""")
def _(spark, sf):
    return M.error_taxonomy(preds(spark, sf, "lr"))


@query("top_confusions", LR + """
SELECT actual, label AS predicted, count(*) AS n FROM lr WHERE actual <> label GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10""")
def _(spark, sf):
    return M.top_confusions(preds(spark, sf, "lr"))


@query("error_samples", LR + """
SELECT id, actual, label, rank FROM (
  SELECT id, actual, label, cast(row_number() OVER (PARTITION BY actual, label ORDER BY id) AS integer) AS rank FROM lr WHERE actual <> label) WHERE rank <= 3""")
def _(spark, sf):
    return M.error_samples(preds(spark, sf, "lr")).select("id", "actual", "label", "rank")


CAL = LR + """, c AS (SELECT cast(least(floor(confidence * 10), 9) AS integer) AS bin, CASE WHEN actual = label THEN 1.0::double ELSE 0 END AS hit, confidence
  FROM lr WHERE confidence IS NOT NULL),
g AS (SELECT bin, count(*) AS n, avg(hit) AS acc, avg(confidence) AS mean_confidence FROM c GROUP BY bin),
bins AS (SELECT b.bin, coalesce(n, 0) AS n, coalesce(acc, 0) AS accuracy, (b.bin + 0.5::double) / 10 AS avg_confidence, mean_confidence,
  coalesce(n / (SELECT count(*) FROM c)::double * abs(acc - (b.bin + 0.5::double) / 10), 0) AS ece_part
  FROM (SELECT unnest(range(10))::integer AS bin) b LEFT JOIN g USING (bin))
"""


@query("calibration", CAL + """
SELECT bin, n, round(accuracy, 6) AS accuracy, round(avg_confidence, 6) AS avg_confidence, round(mean_confidence, 6) AS mean_confidence, round(ece_part, 6) AS ece_part FROM bins""")
def _(spark, sf):
    return rounded(M.calibration(preds(spark, sf, "lr")), "accuracy", "avg_confidence", "mean_confidence", "ece_part")


@query("calibration_error", CAL + "SELECT sum(n) > 0 AS has_confidence, round(sum(ece_part), 6) AS ece FROM bins")
def _(spark, sf):
    return rounded(M.expected_calibration_error(M.calibration(preds(spark, sf, "lr"))), "ece")


@query("rejects", PR + """
SELECT model, coalesce(confidence < 0.5, false) AS rejected, count(*) AS n FROM preds GROUP BY 1, 2""")
def _(spark, sf):
    return V.reject_unsure(preds(spark, sf)).groupBy("model", "rejected").agg(F.count("*").alias("n"))


@query("difficulty", PR + """
SELECT id, model, round(coalesce(1 - confidence, 0.5), 6) AS difficulty, label AS predicted, actual = label AS correct FROM preds""")
def _(spark, sf):
    return V.difficulty(preds(spark, sf)).select(
        "id", "model", F.round("_difficulty", 6).alias("difficulty"), F.col("_predicted").alias("predicted"), F.col("_correct").alias("correct")
    )


@query("curriculum", LR + """
, s AS (SELECT CASE WHEN coalesce(1 - confidence, 0.5) >= 0.7 THEN 'hard' WHEN coalesce(1 - confidence, 0.5) >= 0.3 THEN 'medium' ELSE 'easy' END AS stage, actual <> label AS wrong FROM lr)
SELECT stage, count(*) AS n, count(*) FILTER (wrong) AS wrong FROM s GROUP BY stage""")
def _(spark, sf):
    return P.stage_counts(V.difficulty(preds(spark, sf, "lr")), V.curriculum_stage())


@query("easy_to_hard", PR + "SELECT id, model, round(coalesce(1 - confidence, 0.5), 6) AS difficulty FROM preds")
def _(spark, sf):
    return V.easy_to_hard(V.difficulty(preds(spark, sf))).select("id", "model", F.round("_difficulty", 6).alias("difficulty"))


@query("score_metrics", with_views(SCORES) + """
SELECT count(*) AS n, round(avg((score - value) * (score - value)), 6) AS mse, round(avg(abs(score - value)), 6) AS mae,
       round(sqrt(avg((score - value) * (score - value))), 6) AS rmse, round(corr(value, score), 6) AS correlation,
       round(1 - avg((score - value) * (score - value)) / var_pop(value), 6) AS r2 FROM scores""")
def _(spark, sf):
    return rounded(M.regression_metrics(scores(spark, sf)), "mse", "mae", "rmse", "correlation", "r2")


@query("error_buckets", with_views(SCORES) + """
SELECT CASE WHEN abs(score - value) < 0.5 THEN 'below_0.5' WHEN abs(score - value) < 1 THEN 'below_1' ELSE 'from_1' END AS bucket,
       count(*) AS n, round(count(*) * 100.0::double / (SELECT count(*) FROM scores), 6) AS percent FROM scores GROUP BY 1""")
def _(spark, sf):
    return rounded(M.error_buckets(scores(spark, sf)), "percent")


@query("worst_scores", with_views(SCORES) + """
SELECT id, round(value, 6) AS value, round(score, 6) AS score, round(abs(score - value), 6) AS abs_error FROM scores ORDER BY abs(score - value) DESC, id LIMIT 5""")
def _(spark, sf):
    return rounded(M.worst_scores(scores(spark, sf)).select("id", "value", "score", "abs_error"), "value", "score", "abs_error")


@query("fold_summary", LR + f"""
, f AS (SELECT floor({u('id', 'fold')} * 5) AS fold, avg(CASE WHEN actual = label THEN 1.0::double ELSE 0 END) AS accuracy FROM lr GROUP BY 1)
SELECT round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std FROM f""")
def _(spark, sf):
    from datamill.functions.hashing import pick

    p = preds(spark, sf, "lr")
    folds = p.groupBy(pick("id", "fold", 5).alias("fold")).agg(M.accuracy(p).alias("accuracy"))
    return rounded(M.fold_summary(folds), "mean", "std")


FIELDS = f"""e AS (SELECT event_id AS id, unnest(['kind', 'amount', 'note']) AS field,
  unnest([true, value >= 10, json_extract_string(props, '$.k')::integer < 50]) AS present FROM events),
hits AS (SELECT field, CASE WHEN present = ({u("concat(id, '-', field)", "field")} < 0.8) THEN 1.0::double ELSE 0 END AS hit FROM e)"""


def _field_rows(spark, sf):
    """Extraction rows: field values with their predicted presence, one map each."""
    from datamill.functions.hashing import draw

    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    names = ["kind", "amount", "note"]
    values = [F.col("event_type"), F.when(F.col("value") >= 10, F.col("value").cast("string")), F.when(k.cast("int") < 50, k)]
    pairs = [x for n, v in zip(names, values) for x in (F.lit(n), v)]
    drawn = [x for n in names for x in (F.lit(n), draw(F.concat(F.col("event_id").cast("string"), F.lit(f"-{n}")), "field") < 0.8)]
    return e.select("event_id", F.create_map(*pairs).alias("fields"), F.create_map(*drawn).alias("predicted_fields"))


@query("field_accuracy", with_views(FIELDS) + "SELECT field, round(avg(hit), 6) AS accuracy, count(*) AS n FROM hits GROUP BY field")
def _(spark, sf):
    return rounded(M.field_summary(_field_rows(spark, sf)), "accuracy")


@query("mean_field_accuracy", with_views(FIELDS) + """
SELECT round(avg(a), 6) AS accuracy, count(*) AS fields FROM (SELECT avg(hit) AS a FROM hits GROUP BY field)""")
def _(spark, sf):
    return rounded(M.mean_field_accuracy(M.field_summary(_field_rows(spark, sf))), "accuracy")


@query("ensemble_vote", PR + """
, t AS (SELECT id, label, sum(weight) AS w, count(*) AS models, min(model_order) AS o FROM preds GROUP BY id, label),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(w, 9) DESC, o) AS rn, sum(w) OVER (PARTITION BY id) AS total FROM t)
SELECT id, CASE WHEN w / total >= 0.6 THEN label END AS label, round(w / total, 6) AS confidence, round(models / 3.0::double, 6) AS agreement,
       w / total < 0.6 AS rejected, (SELECT 3) AS members FROM r WHERE rn = 1""")
def _(spark, sf):
    out = O.weighted_vote(preds(spark, sf), threshold=0.6)
    return rounded(out.select("id", "label", "confidence", "agreement", "rejected", F.size("members").alias("members")), "confidence", "agreement")


@query("vote_weights", PR + "SELECT id, label, round(sum(weight), 6) AS weight FROM preds GROUP BY id, label")
def _(spark, sf):
    return rounded(O.weighted_vote(preds(spark, sf)).select("id", F.explode("votes").alias("label", "weight")), "weight")


@query("least_confident", PR + "SELECT id, model, confidence FROM preds WHERE confidence IS NOT NULL ORDER BY confidence, id, model LIMIT 10")
def _(spark, sf):
    return least_confident(preds(spark, sf), 10, ties=["id", "model"]).select("id", "model", "confidence")


@query("uncertainty", PR + "SELECT id, model, round(coalesce(1 - confidence, 1), 6) AS uncertainty FROM preds")
def _(spark, sf):
    return rounded(classification_uncertainty(preds(spark, sf)).select("id", "model", "uncertainty"), "uncertainty")


@query("most_uncertain", LR + "SELECT id, round(coalesce(1 - confidence, 1), 6) AS uncertainty FROM lr ORDER BY coalesce(1 - confidence, 1) DESC, id LIMIT 10")
def _(spark, sf):
    return rounded(most_uncertain(classification_uncertainty(preds(spark, sf, "lr")), 10).select("id", "uncertainty"), "uncertainty")


@query("entropy", PR + """
, s AS (SELECT id, label, sum(weight) AS w FROM preds GROUP BY id, label), p AS (SELECT id, w / sum(w) OVER (PARTITION BY id) AS p FROM s)
SELECT id, round(-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END), 6) AS entropy FROM p GROUP BY id""")
def _(spark, sf):
    votes = O.weighted_vote(preds(spark, sf)).select("id", F.map_values("votes").alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    probs = votes.select("id", "w", total.alias("total")).select("id", F.transform("w", lambda x: x / F.col("total")).alias("p"))
    return probs.select("id", F.round(entropy("p") + 0.0, 6).alias("entropy"))


@query("dropout_std", with_views(f"""
f AS (SELECT doc_id AS id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> ''))) AS feat FROM documents),
fw AS (SELECT id, feat, {u('feat', 'weight')} - 0.5 AS w FROM f),
r AS (SELECT id, round, sum(w) FILTER (d >= 0.3) AS kept, sum(w) AS all_w FROM (
  SELECT id, feat, w, round, {u("concat(id, ':', feat, ':', round)", "drop")} AS d FROM fw, (SELECT unnest(range(10)) AS round)) GROUP BY id, round),
s AS (SELECT id, greatest(-2, least(2, coalesce(kept, all_w))) AS s, greatest(-2, least(2, all_w)) AS full_score FROM r)""") + """
SELECT id, round(any_value(full_score), 6) AS prediction, round(stddev_pop(s), 6) AS uncertainty FROM s GROUP BY id""")
def _(spark, sf):
    from datamill.functions.hashing import draw
    from datamill.functions.text import tokenize

    docs = spread(table(spark, sf, "documents").where(F.col("text").rlike(r"\S")).select(F.col("doc_id").alias("id"), "text"))
    feats = docs.select("id", F.explode(F.array_distinct(tokenize("text"))).alias("feature"))
    weights = feats.select("feature").distinct().select("feature", (draw("feature", "weight") - 0.5).alias("weight"))
    out = dropout_uncertainty(feats, weights, lo=-2.0, hi=2.0)
    return rounded(out.select("id", "prediction", "uncertainty"), "prediction", "uncertainty")


# --- tags -------------------------------------------------------------------------------------

SPANS = SEQUENCES + """,
both_tags AS (SELECT id, pos, token, 'gold' AS side, gold AS tag FROM sequences UNION ALL SELECT id, pos, token, 'pred', pred FROM sequences),
prevs AS (SELECT *, coalesce(lag(tag) OVER (PARTITION BY side, id ORDER BY pos), 'O') AS prev FROM both_tags),
cuts AS (SELECT *, CASE WHEN tag = 'I-CAP' AND prev IN ('B-CAP', 'I-CAP') THEN 0 ELSE 1 END AS cut FROM prevs),
runs AS (SELECT *, sum(cut) OVER (PARTITION BY side, id ORDER BY pos) AS run FROM cuts),
spans AS (SELECT side, id, min(pos) AS start, max(pos) + 1 AS "end", string_agg(token, ' ' ORDER BY pos) AS text
  FROM runs GROUP BY side, id, run HAVING arg_min(tag, pos) = 'B-CAP')"""


@query("entities", with_views(SPANS) + """
SELECT id, 'CAP' AS type, cast(start AS integer) AS start, cast("end" AS integer) AS "end", text FROM spans WHERE side = 'pred'""")
def _(spark, sf):
    return Q.entities(sequences(spark, sf), tags="pred")


@query("entity_metrics", with_views(SPANS) + """
, m AS (SELECT g.id IS NOT NULL AS g, p.id IS NOT NULL AS p FROM (SELECT * FROM spans WHERE side = 'gold') g
  FULL JOIN (SELECT * FROM spans WHERE side = 'pred') p ON g.id = p.id AND g.start = p.start AND g."end" = p."end"),
c AS (SELECT count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM m),
s AS (SELECT *, tp / (tp + fp)::double AS precision, tp / (tp + fn)::double AS recall FROM c)
SELECT unnest(['CAP', '*']) AS type, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, tp + fn AS support,
       round(2 * precision * recall / (precision + recall), 6) AS f1 FROM s""")
def _(spark, sf):
    rows = sequences(spark, sf)
    matched = Q.match_tags(rows.select("id", "tokens", F.col("gold").alias("tags")), rows.select("id", F.col("pred").alias("tags")))
    return rounded(Q.entity_metrics(matched), "precision", "recall", "f1")


@query("token_accuracy", with_views(SEQUENCES) + """
SELECT count(*) FILTER (gold = pred) AS correct, count(*) AS tokens, round(count(*) FILTER (gold = pred) / count(*)::double, 6) AS accuracy FROM sequences""")
def _(spark, sf):
    rows = sequences(spark, sf)
    matched = Q.match_tags(rows.select("id", "tokens", F.col("gold").alias("tags")), rows.select("id", F.col("pred").alias("tags")))
    return rounded(Q.token_accuracy(matched), "accuracy")


@query("token_features", with_views(SEQUENCES) + r"""
, w AS (SELECT id, pos, token, lower(token) AS low, lag(token, 1) OVER p AS p1, lag(token, 2) OVER p AS p2, lead(token, 1) OVER p AS n1, lead(token, 2) OVER p AS n2
  FROM sequences WINDOW p AS (PARTITION BY id ORDER BY pos)),
c AS (SELECT *, string_split(regexp_replace(regexp_replace(regexp_replace(token, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'd', 'g'), '') AS ch FROM w)
SELECT id, cast(pos AS integer) AS pos, array_to_string(list_filter([
  'w=' || low,
  'shape=' || array_to_string(list_filter(ch, lambda x, i: i = 1 OR ch[i - 1] <> x), ''),
  'pre2=' || substr(low, 1, 2), 'pre3=' || substr(low, 1, 3),
  'suf2=' || right(low, 2), 'suf3=' || right(low, 3), 'len=' || least(length(token), 10),
  'cap=' || CASE WHEN substr(token, 1, 1) = upper(substr(token, 1, 1)) AND substr(token, 1, 1) <> lower(substr(token, 1, 1)) THEN 'Y' ELSE 'N' END,
  'allcap=' || CASE WHEN token = upper(token) AND token <> low THEN 'Y' ELSE 'N' END,
  'digit=' || CASE WHEN regexp_matches(token, '[0-9]') THEN 'Y' ELSE 'N' END,
  'hyphen=' || CASE WHEN contains(token, '-') THEN 'Y' ELSE 'N' END,
  coalesce('pw=' || lower(p1), 'BOS'), 'bigram=' || lower(p1) || '|' || low, coalesce('nw=' || lower(n1), 'EOS'),
  'ppw=' || lower(p2), 'nnw=' || lower(n2)], lambda x: x IS NOT NULL), ' ') AS features FROM c""")
def _(spark, sf):
    rows = Q.token_rows(sequences(spark, sf))
    cols = [F.col(c) for c in ("token", "prev1", "prev2", "next1", "next2")]
    return rows.select("id", "pos", F.array_join(Q.token_features(*cols), " ").alias("features"))


@query("text_features", with_views(EXAMPLES) + r"""
, b AS (SELECT id, text, lower(text) AS low, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM examples)
SELECT id, array_to_string(list_concat(list_concat(list_transform(w, lambda x: 'w=' || x),
    list_transform(range(1, len(w)), lambda i: 'bi=' || w[i] || '|' || w[i + 1])),
  list_concat(list_transform(range(1, least(length(low), 200) - 1), lambda i: 'c3=' || substr(low, i, 3)),
  list_filter(['wc=' || least(len(w), 50), 'cc=' || least(length(text), 500),
   'punct=' || least(len(regexp_extract_all(text, '[!?.,:;]')), 20),
   'capr=' || CASE WHEN length(text) > 0 THEN cast(floor(len(regexp_extract_all(text, '[A-Z]')) / length(text)::double * 10 + 0.5) AS bigint) ELSE 0 END,
   CASE WHEN regexp_matches(text, '[0-9]') THEN 'has_digit' END, CASE WHEN contains(text, '!') THEN 'has_excl' END,
   CASE WHEN contains(text, '?') THEN 'has_q' END], lambda x: x IS NOT NULL))), ' ') AS features FROM b""")
def _(spark, sf):
    return spread(examples(spark, sf)).select("id", F.array_join(text_features("text"), " ").alias("features"))


@query("cosine_to_next", """
SELECT a.vec_id AS id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    a = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    b = e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("y"))
    return a.join(b, "id").select("id", F.round(cosine("x", "y"), 6).alias("cosine"))

"""Queries on requests and answers. Answers are derived from the documents: an array inside prose,
some batches without an array, some with a broken one."""

from __future__ import annotations

from pyspark.sql import functions as F

from datamill.functions import fixed_values as V
from datamill.functions.hashing import draw
from datamill.functions.prompts import batch_prompt, example_text, few_shot_prompt, system_prompt, task_header
from datamill.operators import responses as R, select as S
from datamill.operators.active import classification_uncertainty, match_candidates, most_uncertain
from datamill.operators.split import batches, in_batches, number_rows
from datamill.operators.validate import classification_reason
from datamill.queries.views import EXAMPLES, LABELS, PREDS, SCORES, SEQUENCES, examples, preds, scores, sequences, table, u, with_views
from datamill.sources.jsonl import merge_stages, tag_source

QUERIES, SQL = {}, {}
EX = with_views(EXAMPLES)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def q(text: str) -> str:
    """A text as an SQL literal."""
    parts = [f"'{p}'" for p in text.replace("'", "''").split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


def _score(key, salt: str):
    """A number with three decimals as JSON text."""
    return F.concat(F.lit("0."), F.lpad(F.floor(draw(key, salt) * 1000).cast("string"), 3, "0"))


def score_sql(salt: str) -> str:
    return f"'0.' || lpad(cast(cast(floor({u('id', salt)} * 1000) AS bigint) AS varchar), 3, '0')"


def _wrap(body):
    """The answer text of a batch: prose around the array, and two kinds of failures."""
    good = F.concat(F.lit("Here you are:\n```json\n["), body, F.lit("]\n```\nDone."))
    return F.when(F.col("batch") % 5 == 3, "no array here").when(F.col("batch") % 5 == 4, "[{broken]").otherwise(good)


WRAP = ("CASE batch % 5 WHEN 3 THEN 'no array here' WHEN 4 THEN '[{broken]' ELSE "
        "'Here you are:' || chr(10) || '```json' || chr(10) || '[' || string_agg(item, ',' ORDER BY id) || ']' || chr(10) || '```' || chr(10) || 'Done.' END")


def answers(df, size: int, item):
    rows = batches(df, size).withColumn("item", item)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "item"))), lambda x: x["item"]), ",")
    return rows.groupBy("batch").agg(body.alias("body")).select("batch", _wrap(F.col("body")).alias("response"))


def answers_sql(size: int, item: str) -> str:
    return f"""placed AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // {size} AS batch, (row_number() OVER (ORDER BY id) - 1) % {size} AS index FROM examples),
items AS (SELECT *, {item} AS item FROM placed),
answers AS (SELECT batch, {WRAP} AS response FROM items GROUP BY batch),
texts AS (SELECT batch, regexp_extract(response, '\\[.*\\]', 0, 's') AS t FROM answers),
parsed AS (SELECT batch, CASE WHEN t = '' THEN 'no_array' WHEN NOT json_valid(t) THEN 'error' ELSE 'ok' END AS parse_status,
  CASE WHEN t <> '' AND json_valid(t) THEN t END AS t FROM texts),
got AS (SELECT batch, parse_status, unnest(cast(t AS json[])) AS x FROM parsed WHERE parse_status = 'ok')"""


SCORE_ITEM_SQL = "'{\"index\":' || index || ',\"score\":' || " + score_sql("score") + " || '}'"


def score_item():
    return F.concat(F.lit('{"index":'), F.col("index").cast("string"), F.lit(',"score":'), _score("id", "score"), F.lit("}"))


@query("parse_responses", with_views(EXAMPLES, answers_sql(20, SCORE_ITEM_SQL)) + """
SELECT p.batch, p.parse_status, count(g.x) AS items, round(sum(cast(g.x ->> '$.score' AS double)), 6) AS score
FROM parsed p LEFT JOIN got g USING (batch) GROUP BY 1, 2""")
def _(spark, sf):
    parsed = R.parse(answers(examples(spark, sf), 20, score_item()), "struct<index:int,score:double>")
    total = F.aggregate("items", F.lit(0.0), lambda s, x: s + x["score"])
    return parsed.select(
        "batch", "parse_status", F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("items"), F.round(total, 6).alias("score")
    ).withColumn("items", F.when(F.col("items") < 0, 0).otherwise(F.col("items")))


@query("confidence_filter", with_views(EXAMPLES, answers_sql(20, SCORE_ITEM_SQL)) + """
SELECT p.id, cast(g.x ->> '$.score' AS double) AS score FROM placed p JOIN got g ON g.batch = p.batch AND cast(g.x ->> '$.index' AS integer) = p.index
WHERE cast(g.x ->> '$.score' AS double) >= 0.7
UNION ALL SELECT p.id, NULL FROM placed p JOIN parsed s USING (batch) WHERE s.parse_status = 'error'""")
def _(spark, sf):
    rows = examples(spark, sf)
    return R.confidence_filter(rows, answers(rows, 20, score_item())).select("id", "score")


JUDGE_SQL = ("'{\"index\":' || index || ',\"relevance\":' || " + score_sql("relevance") + " || ',\"naturalness\":' || "
             + score_sql("naturalness") + " || ',\"label_correctness\":' || " + score_sql("label") + " || '}'")


def judge_item():
    return F.concat(
        F.lit('{"index":'), F.col("index").cast("string"), F.lit(',"relevance":'), _score("id", "relevance"),
        F.lit(',"naturalness":'), _score("id", "naturalness"), F.lit(',"label_correctness":'), _score("id", "label"), F.lit("}"),
    )


@query("judge_scores", with_views(EXAMPLES, answers_sql(15, JUDGE_SQL)) + """
SELECT p.id, cast(g.x ->> '$.relevance' AS double) AS relevance, cast(g.x ->> '$.naturalness' AS double) AS naturalness,
  round((cast(g.x ->> '$.relevance' AS double) + cast(g.x ->> '$.naturalness' AS double) + cast(g.x ->> '$.label_correctness' AS double)) / 3, 6) AS quality
FROM placed p JOIN got g ON g.batch = p.batch AND cast(g.x ->> '$.index' AS integer) = p.index
UNION ALL SELECT p.id, NULL, NULL, 0.5 FROM placed p JOIN parsed s USING (batch) WHERE s.parse_status = 'error'""")
def _(spark, sf):
    rows = examples(spark, sf)
    out = R.judge(rows, answers(rows, 15, judge_item()))
    return out.select("id", F.col("_relevance").alias("relevance"), F.col("_naturalness").alias("naturalness"), F.round("_quality", 6).alias("quality"))


ZERO_SQL = f"CASE WHEN {u('id', 'answer')} < 0.7 THEN '\"' || label || '\"' WHEN {u('id', 'answer')} < 0.9 THEN '\"en\"' ELSE 'null' END"
ZERO_ROWS = with_views(EXAMPLES, answers_sql(20, ZERO_SQL)) + """
, z AS (SELECT p.id, p.label AS actual, CASE WHEN s.parse_status = 'error' THEN 'error' ELSE coalesce(cast(s.t AS json[])[p.index + 1] ->> '$', 'unknown') END AS predicted
  FROM placed p JOIN parsed s USING (batch) WHERE s.parse_status <> 'no_array')
"""


def _zero_shot(spark, sf):
    rows = examples(spark, sf)
    said = draw("id", "answer")
    item = F.when(said < 0.7, F.concat(F.lit('"'), F.col("label"), F.lit('"'))).when(said < 0.9, '"en"').otherwise("null")
    return R.zero_shot(rows, answers(rows, 20, item))


@query("zero_shot", ZERO_ROWS + "SELECT id, actual, predicted, actual = predicted AS correct FROM z")
def _(spark, sf):
    return _zero_shot(spark, sf)


@query("zero_shot_summary", ZERO_ROWS + """
SELECT count(*) AS total, count(*) FILTER (actual = predicted) AS correct, round(avg(CASE WHEN actual = predicted THEN 1.0::double ELSE 0 END), 6) AS accuracy FROM z""")
def _(spark, sf):
    return R.zero_shot_summary(_zero_shot(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


# Tasks derived from the documents: one per source.
TASKS = """tasks AS (
  SELECT source AS name, CASE cast(substr(source, 4) AS integer) % 4 WHEN 0 THEN 'classification' WHEN 1 THEN 'extraction' WHEN 2 THEN 'scoring' ELSE 'sequence-labeling' END AS type,
         'Texts of ' || source AS description, list_sort(list(DISTINCT lang)) AS labels, ['title', 'author'] AS fields,
         'Write {label} about {field}, again {label}.' AS prompt, count(*) AS count, 10 AS batch_size
  FROM documents GROUP BY source)"""


def tasks(spark, sf):
    number = F.substring("source", 4, 9).cast("int") % 4
    kind = F.when(number == 0, "classification").when(number == 1, "extraction").when(number == 2, "scoring").otherwise("sequence-labeling")
    return table(spark, sf, "documents").groupBy("source").agg(
        F.sort_array(F.collect_set("lang")).alias("labels"), F.count("*").alias("count")
    ).select(
        F.col("source").alias("name"), kind.alias("type"), F.concat(F.lit("Texts of "), F.col("source")).alias("description"), "labels",
        F.array(F.lit("title"), F.lit("author")).alias("fields"), F.lit("Write {label} about {field}, again {label}.").alias("prompt"),
        "count", F.lit(10).alias("batch_size"), F.lit(None).cast("double").alias("score_min"), F.lit(None).cast("double").alias("score_max"),
    )


def fill_sql(template: str, **values: str) -> str:
    out = q(template)
    for name, expr in values.items():
        out = f"replace({out}, '{{{name}}}', {expr})"
    return out


@query("request_plan", with_views(TASKS) + """
SELECT name, cast(batch AS integer) AS batch, cast(least(batch_size, count - batch * batch_size) AS integer) AS n
FROM (SELECT *, unnest(range(cast(ceil(count / batch_size::double) AS bigint))) AS batch FROM tasks)""")
def _(spark, sf):
    return R.request_plan(tasks(spark, sf)).select("name", "batch", "n")


LABEL_LIST = "array_to_string(labels, ', ')"


@query("system_prompts", with_views(TASKS) + f"""
SELECT name, {fill_sql(V.GENERATE_SYSTEM, description='description', type='type')} || CASE type
  WHEN 'classification' THEN {fill_sql(V.SYSTEM_LABELS, labels=LABEL_LIST)} WHEN 'extraction' THEN {fill_sql(V.SYSTEM_FIELDS, fields="array_to_string(fields, ', ')")}
  WHEN 'scoring' THEN {fill_sql(V.SYSTEM_RANGE, lo="'0'", hi="'5'")} ELSE {fill_sql(V.SYSTEM_TAGS, labels=LABEL_LIST)} END AS prompt FROM tasks""")
def _(spark, sf):
    return tasks(spark, sf).select("name", system_prompt().alias("prompt"))


@query("batch_prompts", with_views(TASKS) + f"""
, c AS (SELECT *, regexp_replace(prompt, '\\{{label\\}}', array_to_string(labels, ' or ')) AS p1 FROM tasks),
d AS (SELECT *, CASE WHEN type = 'sequence-labeling' THEN p1 ELSE regexp_replace(p1, '\\{{field\\}}', array_to_string(fields, ', ')) END AS context FROM c)
SELECT name, {fill_sql(V.BATCH_HEAD, n="'10'")} || CASE type
  WHEN 'classification' THEN {q(V.ROW_FORMAT_LABEL)} || chr(10) || {fill_sql(V.BATCH_LABELS, labels=LABEL_LIST)}
  WHEN 'extraction' THEN {q(V.ROW_FORMAT_FIELDS)} || chr(10)
  WHEN 'scoring' THEN {q(V.ROW_FORMAT_VALUE)} || chr(10) || {fill_sql(V.BATCH_RANGE, lo="'0'", hi="'5'")}
  ELSE {q(V.ROW_FORMAT_TAGS)} || {fill_sql(V.BATCH_TAGS, labels=LABEL_LIST)} END || {fill_sql(V.BATCH_TAIL, context='context')} AS prompt FROM d""")
def _(spark, sf):
    return tasks(spark, sf).select("name", batch_prompt(F.lit(10)).alias("prompt"))


@query("label_pairs", with_views(TASKS) + f"""
SELECT a.name, a.l AS a, b.l AS b, {fill_sql(V.CONTRAST, n="'5'", a='a.l', b='b.l')} AS prompt
FROM (SELECT name, unnest(labels) AS l, generate_subscripts(labels, 1) AS i FROM tasks WHERE type = 'classification') a
JOIN (SELECT name, unnest(labels) AS l, generate_subscripts(labels, 1) AS i FROM tasks WHERE type = 'classification') b ON a.name = b.name AND a.i < b.i""")
def _(spark, sf):
    return R.contrast_requests(tasks(spark, sf))


def pair_item():
    """Generated rows as JSON; every fourth one has a label outside the task."""
    label = F.when(draw("id", "foreign") < 0.25, F.lit("xx")).otherwise(F.col("label"))
    return F.to_json(F.struct(F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), label.alias("label"), F.lit("en").alias("confused_with")))


PAIR_SQL = f"'{{\"text\":\"text ' || id || '\",\"label\":\"' || CASE WHEN {u('id', 'foreign')} < 0.25 THEN 'xx' ELSE label END || '\",\"confused_with\":\"en\"}}'"
GOT_ROWS = with_views(EXAMPLES, answers_sql(20, PAIR_SQL))


@query("contrast_rows", GOT_ROWS + """
SELECT x ->> '$.text' AS text, x ->> '$.label' AS label, true AS contrastive, x ->> '$.confused_with' AS confused_with FROM got
WHERE x ->> '$.label' IN ('de', 'en', 'es', 'fr')""")
def _(spark, sf):
    rows = R.contrast_rows(answers(examples(spark, sf), 20, pair_item()), LABELS)
    return rows.select("text", "label", F.col("_contrastive").alias("contrastive"), F.col("_confused_with").alias("confused_with"))


@query("generated_rows", GOT_ROWS + """
SELECT batch, cast(row_number() OVER (PARTITION BY batch ORDER BY cast(substr(x ->> '$.text', 6) AS bigint)) - 1 AS integer) AS index, x ->> '$.text' AS text,
  x ->> '$.label' AS label, x ->> '$.label' IN ('de', 'en', 'es', 'fr') AS valid FROM got""")
def _(spark, sf):
    parsed = R.parse(answers(examples(spark, sf), 20, pair_item()), "struct<text:string,label:string>")
    rows = parsed.select("batch", F.posexplode("items").alias("index", "item")).select("batch", "index", "item.*")
    return R.accept(rows, classification_reason(labels=LABELS), 2**31 - 1, ["batch"], ["index"]).select("batch", "index", "text", "label", "valid")


@query("generated_counts", GOT_ROWS + """
SELECT count(*) FILTER (x ->> '$.label' IN ('de', 'en', 'es', 'fr')) AS valid, count(*) FILTER (x ->> '$.label' NOT IN ('de', 'en', 'es', 'fr')) AS dropped FROM got""")
def _(spark, sf):
    task = {"type": "classification", "labels": LABELS}
    return R.generated(answers(examples(spark, sf), 20, pair_item()), task, "struct<text:string,label:string>")[1]


@query("accepted_rows", EX + f"""
, v AS (SELECT *, {u('id', 'bad')} >= 0.2 AS valid FROM examples)
SELECT id, _provider AS provider FROM (SELECT *, row_number() OVER (PARTITION BY _provider ORDER BY id) AS place FROM v WHERE valid) WHERE place <= 20""")
def _(spark, sf):
    reason = F.when(draw("id", "bad") < 0.2, F.lit("bad"))
    return R.first_valid(examples(spark, sf), reason, 20, ["_provider"], ["id"]).select("id", F.col("_provider").alias("provider"))


@query("provider_merge", EX + """
SELECT id, provider, place FROM (SELECT id, _provider AS provider, cast(row_number() OVER (PARTITION BY _provider ORDER BY id) AS integer) AS place
  FROM examples WHERE _provider IN ('src1', 'src2', 'src3')) WHERE place <= 17""")
def _(spark, sf):
    rows = R.provider_merge(examples(spark, sf), 50, ["src1", "src2", "src3"], ["id"])
    return rows.select("id", F.col("_provider").alias("provider"), "place")


@query("stage_merge", EX + """
SELECT CASE WHEN _source = 'real' THEN 'large' ELSE 'local' END AS stage, CASE WHEN _source = 'real' THEN 'big' ELSE 'small' END AS provider, count(*) AS n
FROM examples GROUP BY 1, 2""")
def _(spark, sf):
    rows = examples(spark, sf)
    merged = merge_stages(rows.where("_source = 'real'"), rows.where("_source <> 'real'"), "big", "small")
    return merged.groupBy(F.col("_distill_stage").alias("stage"), F.col("_provider").alias("provider")).agg(F.count("*").alias("n"))


@query("judge_requests", with_views(EXAMPLES, answers_sql(15, "''")) + f"""
SELECT batch, {q(V.JUDGE_HEAD)} || string_agg(index || ': ' || cast(json_object('text', text, 'label', label) AS varchar), chr(10) ORDER BY index) || {q(V.JUDGE_TAIL)} AS prompt
FROM placed GROUP BY batch""")
def _(spark, sf):
    return R.judge_requests(batches(examples(spark, sf), 15))


@query("quality_requests", with_views(EXAMPLES, answers_sql(20, "''")) + f"""
SELECT batch, {q(V.QUALITY_HEAD)} || string_agg(index || ': ' || cast(json_object('text', text, 'label', label) AS varchar), chr(10) ORDER BY index) || {q(V.QUALITY_TAIL)} AS prompt
FROM placed GROUP BY batch""")
def _(spark, sf):
    return R.quality_requests(batches(examples(spark, sf), 20))


@query("zero_shot_requests", with_views(EXAMPLES, answers_sql(20, "''")) + f"""
SELECT batch, {q(V.ZERO_SHOT_HEAD)} || string_agg(index || ': "' || text || '"', chr(10) ORDER BY index) || {q(V.ZERO_SHOT_TAIL)} AS prompt
FROM placed GROUP BY batch""")
def _(spark, sf):
    return R.zero_shot_requests(batches(examples(spark, sf), 20))


TASK = {"type": "classification", "description": "Guess the language", "labels": LABELS}
TASK_SYSTEMS = {
    "judge_requests": 'You are a training data quality evaluator. Rate examples for a classification task: "Guess the language".',
    "quality_requests": 'You are a training data quality evaluator for a classification task: "Guess the language".',
    "zero_shot_requests": "You are a classifier. Task: Guess the language\nLabels: de, en, es, fr\nRespond with ONLY a JSON array of labels, one per input.",
}


@query("task_requests", "\nUNION ALL\n".join(
    f"SELECT '{name}' AS kind, batch, {q(system)} || chr(10) || chr(10) || prompt AS prompt FROM ({SQL[name]})" for name, system in TASK_SYSTEMS.items()))
def _(spark, sf):
    """Requests that say what the task is and which labels it has."""
    rows = number_rows(examples(spark, sf))
    made = {
        "judge_requests": R.judge_requests(in_batches(rows, 15), TASK), "quality_requests": R.quality_requests(in_batches(rows, 20), TASK),
        "zero_shot_requests": R.zero_shot_requests(in_batches(rows, 20), TASK)}
    parts = [part.select(F.lit(name).alias("kind"), "batch", R.whole_prompt().alias("prompt")) for name, part in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


LR_TOP = with_views(EXAMPLES, PREDS) + """, top AS (SELECT *, row_number() OVER (ORDER BY coalesce(1 - confidence, 1) DESC, id) AS rank FROM preds WHERE model = 'lr' ORDER BY rank LIMIT 10)
"""


def _top(spark, sf):
    return most_uncertain(classification_uncertainty(preds(spark, sf, "lr")), 10)


@query("label_request", LR_TOP + f"""
SELECT {fill_sql(V.LABEL_HEAD, labels="'de, en, es, fr'")} || string_agg(rank || '. "' || text || '" (model confidence: ' || printf('%.0f', confidence * 100) || '%)', chr(10) ORDER BY rank) || {q(V.LABEL_TAIL)} AS prompt FROM top""")
def _(spark, sf):
    task = {"type": "classification", "labels": LABELS}
    return R.label_request(_top(spark, sf), task, [F.desc("uncertainty"), F.asc("id")])


@query("relabel_request", LR_TOP + f"""
SELECT {fill_sql(V.RELABEL_HEAD, labels="'de, en, es, fr'")} || string_agg(rank || '. "' || text || '" (model predicted: ' || label || ', confidence: ' || printf('%.0f', confidence * 100) || '%)', chr(10) ORDER BY rank) || {q(V.RELABEL_TAIL)} AS prompt FROM top""")
def _(spark, sf):
    return R.relabel_request(_top(spark, sf).withColumn("predicted", F.col("label")), LABELS, [F.desc("uncertainty"), F.asc("id")])


@query("score_request", with_views(SCORES) + f"""
, t AS (SELECT *, row_number() OVER (ORDER BY abs(score - value) DESC, id) AS rank FROM scores ORDER BY rank LIMIT 10)
SELECT {fill_sql(V.SCORE_HEAD, lo="'0'", hi="'5'")} || string_agg(rank || '. "' || event_type || '" (model predicted: ' || printf('%.2f', score) || ')', chr(10) ORDER BY rank) || {q(V.SCORE_TAIL)} AS prompt FROM t""")
def _(spark, sf):
    rows = scores(spark, sf).select("id", F.col("event_type").alias("text"), F.col("score").alias("prediction"), F.abs(F.col("score") - F.col("value")).alias("uncertainty"))
    return R.label_request(most_uncertain(rows, 10), {"type": "scoring"}, [F.desc("uncertainty"), F.asc("id")])


@query("tag_request", with_views(SEQUENCES) + f"""
, t AS (SELECT id, count(*) FILTER (pred = 'O') / count(*)::double AS unc, list(token ORDER BY pos) AS tokens FROM sequences GROUP BY id),
r AS (SELECT *, row_number() OVER (ORDER BY unc DESC, id) AS rank FROM t ORDER BY rank LIMIT 10)
SELECT {fill_sql(V.TAG_HEAD, labels="'CAP'")} || string_agg(rank || '. tokens: ' || cast(to_json(tokens) AS varchar), chr(10) ORDER BY rank) || {q(V.TAG_TAIL)} AS prompt FROM r""")
def _(spark, sf):
    rows = sequences(spark, sf).select("id", "tokens", F.lit(None).cast("string").alias("text"), (F.size(F.filter("pred", lambda t: t == "O")) / F.size("pred")).alias("uncertainty"))
    return R.label_request(most_uncertain(rows, 10), {"type": "sequence-labeling", "labels": ["CAP"]}, [F.desc("uncertainty"), F.asc("id")])


@query("match_candidates", LR_TOP + """
, last AS (SELECT text, max(id) AS id, arg_max(label, id) AS label FROM examples GROUP BY text)
SELECT l.id, l.label, t.label AS predicted, t.confidence FROM top t JOIN last l USING (text)""")
def _(spark, sf):
    return match_candidates(_top(spark, sf), examples(spark, sf).select("id", "text", "label")).select("id", "label", "predicted", "confidence")


@query("few_shot_prompts", with_views(EXAMPLES, f"""
demos AS (SELECT *, row_number() OVER (ORDER BY {u('id', 'random')}, id) AS r FROM examples ORDER BY r LIMIT 5),
d AS (SELECT string_agg('Input: ' || text || chr(10) || 'Label: ' || label, chr(10) || chr(10) ORDER BY r) AS demos FROM demos)""") + """
SELECT item_id AS id, 'Task: Guess the language' || chr(10) || 'Labels: de, en, es, fr' || chr(10) || chr(10) || 'Examples:' || chr(10) || chr(10) || demos || chr(10) || chr(10)
  || 'Now classify:' || chr(10) || 'Input: ' || text || chr(10) AS prompt FROM benchmark, d""")
def _(spark, sf):
    rows = examples(spark, sf)
    demo = F.struct(draw("id", "random").alias("u"), "id", example_text("classification").alias("t"))
    demos = S.select_random(rows, 5).agg(F.array_sort(F.collect_list(demo)).alias("d")).select(
        F.array_join(F.transform("d", lambda x: x["t"]), "\n\n")
    ).scalar()
    header = F.lit("Task: Guess the language\nLabels: de, en, es, fr")
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), few_shot_prompt(header, demos, F.col("text")).alias("prompt"))


@query("task_headers", with_views(TASKS) + f"""
SELECT name, 'Task: ' || description || CASE type WHEN 'classification' THEN chr(10) || 'Labels: ' || {LABEL_LIST} WHEN 'scoring' THEN chr(10) || 'Score range: 0 to 5'
  WHEN 'sequence-labeling' THEN chr(10) || 'Entity types: ' || {LABEL_LIST} || chr(10) || 'Tag scheme: BIO' ELSE '' END AS header FROM tasks""")
def _(spark, sf):
    return tasks(spark, sf).select("name", task_header().alias("header"))


@query("few_shot_eval", with_views(EXAMPLES, PREDS) + """
SELECT model AS strategy, count(*) AS total, count(*) FILTER (actual = label) AS correct, round(count(*) FILTER (actual = label) / count(*)::double, 6) AS accuracy
FROM preds GROUP BY model""")
def _(spark, sf):
    said = preds(spark, sf).select(F.col("model").alias("strategy"), R.answer_correct(
        "classification", F.concat(F.lit(" "), F.upper("label"), F.lit(" ")), label=F.col("actual")).alias("correct"))
    return R.rank_strategies(said).withColumn("accuracy", F.round("accuracy", 6))


@query("few_shot_eval_scores", with_views(SCORES) + """
SELECT event_type AS strategy, count(*) AS total, count(*) FILTER (abs(round(score, 3) - value) < 0.5) AS correct FROM scores GROUP BY 1""")
def _(spark, sf):
    said = scores(spark, sf).select(F.col("event_type").alias("strategy"), R.answer_correct(
        "scoring", F.round("score", 3).cast("string"), value=F.col("value")).alias("correct"))
    return R.rank_strategies(said).select("strategy", "total", "correct")


@query("few_shot_eval_tags", with_views(SEQUENCES) + """
, t AS (SELECT id, list(DISTINCT gold) FILTER (gold <> 'O') AS g, list(DISTINCT pred) FILTER (pred <> 'O') AS p FROM sequences GROUP BY id)
SELECT id, CASE WHEN len(coalesce(g, [])) > 0 THEN len(list_intersect(coalesce(g, []), coalesce(p, []))) / len(g)::double >= 0.5 ELSE len(coalesce(p, [])) = 0 END AS correct FROM t""")
def _(spark, sf):
    return sequences(spark, sf).select("id", R.answer_correct("sequence-labeling", F.to_json("pred"), tags=F.col("gold")).alias("correct"))

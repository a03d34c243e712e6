"""Queries on loading, checking, counting, de-duplicating, splitting and augmenting examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from datamill.functions.fixed_values import FILLERS, SYNONYMS
from datamill.functions.text import gram_codes, ngrams, tokenize, trim_ws
from datamill.operators import augment as A, dedup as D, profile as P, semantic as S, sequences as Q, split as W, validate as V
from datamill.queries.views import (
    EXAMPLES, LABELS, SCORES, SEQUENCES, examples, scores, sequences, table, u, with_views,
)
from datamill.session import spread
from datamill.sources.jsonl import merge_sources, normalise_real

QUERIES, SQL = {}, {}
EX = with_views(EXAMPLES)
LABEL_ROWS = "(VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) v(label)"
TRIM = r"trim(text, E' \t\n\x0b\f\r')"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


@query("merge_sources", EX + """
SELECT id, text, label, _source FROM examples WHERE _source <> 'real'
UNION ALL SELECT id, text, label, 'real' FROM examples WHERE _source = 'real'""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    synthetic = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))
    real = normalise_real(docs.where("doc_id % 3 = 0"), "text", "lang", id="doc_id")
    return merge_sources(synthetic, real).select("id", "text", "label", "_source")


@query("dataset_stats", EX + """
SELECT CASE WHEN grouping(_source) = 0 THEN 'source' WHEN grouping(label) = 0 THEN 'label' ELSE 'total' END AS kind,
       coalesce(_source, label, 'all') AS name, count(*) AS n
FROM examples GROUP BY GROUPING SETS ((), (_source), (label))""")
def _(spark, sf):
    return P.dataset_stats(examples(spark, sf))


@query("label_counts", EX + "SELECT label, count(*) AS n FROM examples GROUP BY label")
def _(spark, sf):
    return P.label_counts(examples(spark, sf))


@query("label_deficit", EX + f"""
, c AS (SELECT label, count(*) AS n FROM examples GROUP BY label),
w AS (SELECT v.label, coalesce(c.n, 0) AS n, (SELECT count(*) FROM examples) / 5.0::double AS expected
      FROM {LABEL_ROWS} LEFT JOIN c USING (label))
SELECT label, n, expected, cast(ceil(expected - n) AS bigint) AS deficit FROM w WHERE n < expected * 0.8""")
def _(spark, sf):
    return P.label_deficit(examples(spark, sf), [*LABELS, "it"])


@query("label_composition", EX + """
SELECT label, count(*) AS n, round(count(*) * 100.0::double / (SELECT count(*) FROM examples), 6) AS percent
FROM examples GROUP BY label""")
def _(spark, sf):
    return P.label_composition(examples(spark, sf)).withColumn("percent", F.round("percent", 6))


@query("distinct_labels", EX + "SELECT DISTINCT label FROM examples")
def _(spark, sf):
    return P.distinct_labels(examples(spark, sf))


@query("provider_counts", EX + "SELECT _provider AS provider, count(*) AS n FROM examples GROUP BY 1")
def _(spark, sf):
    return P.provider_counts(examples(spark, sf))


@query("fingerprint", EX + """
SELECT count(*) AS n, lpad(lower(to_hex(cast(sum(cast(concat('0x', substr(md5(concat(coalesce(text, ''), chr(31), coalesce(label, ''))), 1, 15)) AS bigint)) % 1152921504606846976 AS bigint))), 15, '0') AS data_hash
FROM examples""")
def _(spark, sf):
    return P.dataset_fingerprint(examples(spark, sf))


@query("shared_corpus", EX + f"""
, parts AS (SELECT _source AS task, CASE WHEN {u('id', 'split')} < 0.8 THEN 'train' ELSE 'val' END AS part, text FROM examples)
SELECT task, part, count(*) AS rows, count(text) AS texts, (SELECT count(DISTINCT task) FROM parts) AS tasks
FROM parts GROUP BY 1, 2""")
def _(spark, sf):
    rows = W.hash_split(examples(spark, sf))
    tables = {
        t: (rows.where((F.col("_source") == t) & F.col("is_train")), rows.where((F.col("_source") == t) & ~F.col("is_train")))
        for t in ("real", "synthetic")
    }
    corpus = P.shared_corpus(tables)
    tasks = P.corpus_summary(corpus).select("tasks").scalar()
    return corpus.groupBy("task", "part").agg(F.count("*").alias("rows"), F.count("text").alias("texts")).withColumn("tasks", tasks)


@query("valid_examples", EX + r"""
SELECT id, CASE WHEN text IS NULL OR NOT regexp_matches(text, '\S') THEN 'text' WHEN label IS NULL THEN 'label'
                WHEN label NOT IN ('en', 'fr') THEN 'unknown_label' END AS reason,
       coalesce(text IS NOT NULL AND regexp_matches(text, '\S') AND label IN ('en', 'fr'), false) AS valid
FROM examples""")
def _(spark, sf):
    return V.check(examples(spark, sf), V.classification_reason(labels=["en", "fr"])).select("id", "reason", "valid")


@query("valid_extractions", r"""
SELECT event_id AS id, CASE WHEN NOT regexp_matches(event_type, '\S') THEN 'text' WHEN try_cast(props AS json) IS NULL THEN 'fields' END AS reason
FROM events""")
def _(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("text"), F.from_json("props", "map<string,string>").alias("fields")
    )
    return V.check(rows, V.extraction_reason()).select("id", "reason")


@query("valid_scores", """
SELECT event_id AS id, value, CASE WHEN value IS NULL OR isnan(value) THEN 'value' WHEN NOT value BETWEEN 1 AND 50 THEN 'range' END AS reason
FROM events""")
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("text"), "value")
    return V.check(rows, V.scoring_reason(lo=1, hi=50)).select("id", "value", "reason")


@query("valid_sequences", with_views(SEQUENCES) + """
SELECT id, CASE WHEN count(*) FILTER (gold NOT IN ('O', 'B-CAP')) > 0 THEN 'unknown_tag' END AS reason,
       count(*) AS tokens
FROM (SELECT id, CASE gold WHEN 'I-CAP' THEN 'I-LOC' ELSE gold END AS gold FROM sequences) GROUP BY id""")
def _(spark, sf):
    rows = sequences(spark, sf).withColumn("tags", F.transform("gold", lambda t: F.when(t == "I-CAP", "I-LOC").otherwise(t)))
    return V.check(rows, V.sequence_reason(["CAP"])).select("id", "reason", F.size("tokens").cast("bigint").alias("tokens"))


@query("tag_errors", with_views(SEQUENCES) + """
, n AS (SELECT *, coalesce(lag(pred) OVER (PARTITION BY id ORDER BY pos), 'O') AS prev FROM sequences)
SELECT id, cast(pos AS bigint) AS pos, pred AS tag, concat(pred, ' follows ', prev) AS message FROM n
WHERE pred = 'I-CAP' AND prev NOT IN ('B-CAP', 'I-CAP')""")
def _(spark, sf):
    return Q.tag_errors(sequences(spark, sf), tags="pred").withColumn("pos", F.col("pos").cast("bigint"))


@query("tag_sets", """
SELECT source AS task, array_to_string(['O'] || flatten(list_transform(labels, lambda x: ['B-' || x, 'I-' || x])), ' ') AS tags
FROM (SELECT source, list_sort(list(DISTINCT lang)) AS labels FROM documents GROUP BY source)""")
def _(spark, sf):
    labels = table(spark, sf, "documents").groupBy(F.col("source").alias("task")).agg(F.sort_array(F.collect_set("lang")).alias("labels"))
    return labels.select("task", F.array_join(V.tag_set_column("labels"), " ").alias("tags"))


@query("quality_filter", """
SELECT d.doc_id AS id, coalesce(l.quality, 0) AS quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, 0) >= 0.7""")
def _(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    kept = V.quality_filter(rows.withColumn("_quality", F.col("quality").cast("double")))
    return kept.select(F.col("doc_id").alias("id"), F.coalesce("quality", F.lit(0)).alias("quality"))


@query("quality_bands", """
SELECT count(*) FILTER (q >= 0.8) AS high, count(*) FILTER (q >= 0.5 AND q < 0.8) AS middle, count(*) FILTER (q < 0.5) AS low,
       count(*) FILTER (q >= 0.7) AS kept, count(*) FILTER (q < 0.7) AS removed
FROM (SELECT coalesce(l.quality, 0) AS q FROM documents d LEFT JOIN labels l USING (doc_id))""")
def _(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    rows = rows.withColumn("_quality", F.col("quality").cast("double"))
    removed = V.quality_removed(rows)
    return P.quality_bands(rows).select("*", removed.select("kept").scalar().alias("kept"), removed.select("removed").scalar().alias("removed"))


# --- duplicates ---------------------------------------------------------------------------------

@query("dedup_exact", f"""
SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY {TRIM}) AS first_id FROM documents WHERE text IS NOT NULL""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return D.exact_duplicates(docs).select(F.col("ord").alias("id"), F.col("first").alias("first_id"))


GRAMS = f"""firsts AS (SELECT min(doc_id) AS id, lower({TRIM}) AS t FROM documents WHERE text IS NOT NULL GROUP BY {TRIM}),
grams AS MATERIALIZED (SELECT DISTINCT id, substr(t, cast(i AS bigint), 3) AS g FROM (SELECT id, t, unnest(range(1, length(t) - 1)) AS i FROM firsts)),
sizes AS MATERIALIZED (SELECT id, count(*) AS n FROM grams GROUP BY id)"""
PAIRS = """shared AS (
  SELECT a.id AS lo, b.id AS hi, count(*) AS s FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
pairs AS MATERIALIZED (
  SELECT lo, hi, s / (x.n + y.n - s)::double AS similarity FROM shared JOIN sizes x ON x.id = lo JOIN sizes y ON y.id = hi
  WHERE s / (x.n + y.n - s)::double >= 0.85)"""


@query("trigram_stats", with_views(GRAMS) + """
SELECT f.id, coalesce(n, 0) AS grams FROM firsts f LEFT JOIN sizes USING (id)""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").where(F.col("text").isNotNull())
    return spread(D.drop_exact(docs)).select("id", F.size(gram_codes("text")).cast("bigint").alias("grams"))


@query("fuzzy_pairs", with_views(GRAMS, PAIRS) + """
, sets AS (SELECT id, md5(string_agg(g, '|' ORDER BY g)) AS h FROM grams GROUP BY id),
leads AS (SELECT min(id) AS id FROM sets GROUP BY h)
SELECT lo, hi, round(similarity, 6) AS similarity FROM pairs
WHERE lo IN (SELECT id FROM leads) AND hi IN (SELECT id FROM leads)""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return D.similar_pairs(docs).withColumn("similarity", F.round("similarity", 6))


# Greedy pass in SQL: nodes with earlier partners are visited in order; a node is dropped if any of
# its earlier partners is not dropped. Texts without grams are all equal, so the first one stays.
GREEDY = """short AS (SELECT id FROM firsts WHERE id NOT IN (SELECT id FROM sizes)),
later AS MATERIALIZED (SELECT hi, list(lo) AS los, row_number() OVER (ORDER BY hi) AS r FROM pairs GROUP BY hi),
walk(r, dropped) AS (
  SELECT 0::bigint, []::bigint[]
  UNION ALL
  SELECT l.r, CASE WHEN len(list_filter(l.los, lambda z: NOT list_contains(w.dropped, z))) > 0
                   THEN list_append(w.dropped, l.hi) ELSE w.dropped END
  FROM walk w JOIN later l ON l.r = w.r + 1),
gone AS (SELECT unnest(dropped) AS id FROM walk WHERE r = (SELECT max(r) FROM walk)
         UNION ALL SELECT id FROM short WHERE id > (SELECT min(id) FROM short))"""


@query("dedup_greedy", with_views(GRAMS, PAIRS, GREEDY, recursive=True) + """
SELECT f.id, d.lang AS label FROM firsts f JOIN documents d ON d.doc_id = f.id WHERE f.id NOT IN (SELECT id FROM gone)
UNION ALL SELECT doc_id, lang FROM documents WHERE text IS NULL""")
def _(spark, sf):
    return D.deduplicate(examples(spark, sf)).select("id", "label")


UNITS = """dims AS (SELECT vec_id AS id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
norms AS (SELECT id, sqrt(sum(x * x)) AS s FROM dims GROUP BY id),
pairs AS MATERIALIZED (
  SELECT a.id AS lo, b.id AS hi, sum(a.x * b.x) / (any_value(p.s) * any_value(q.s)) AS similarity
  FROM dims a JOIN dims b ON a.i = b.i AND a.id < b.id JOIN norms p ON p.id = a.id JOIN norms q ON q.id = b.id
  GROUP BY a.id, b.id HAVING sum(a.x * b.x) / (any_value(p.s) * any_value(q.s)) >= 0.35)"""


@query("cosine_pairs", with_views(UNITS) + "SELECT lo, hi, round(similarity, 6) AS similarity FROM pairs")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return S.cosine_pairs(rows, 0.35).withColumn("similarity", F.round("similarity", 6))


@query("semantic_dedup", with_views(UNITS, """later AS MATERIALIZED (SELECT hi, list(lo) AS los, row_number() OVER (ORDER BY hi) AS r FROM pairs GROUP BY hi),
walk(r, dropped) AS (
  SELECT 0::bigint, []::bigint[]
  UNION ALL
  SELECT l.r, CASE WHEN len(list_filter(l.los, lambda z: NOT list_contains(w.dropped, z))) > 0
                   THEN list_append(w.dropped, l.hi) ELSE w.dropped END
  FROM walk w JOIN later l ON l.r = w.r + 1)""", recursive=True) + """
SELECT vec_id AS id, label FROM embeddings
WHERE NOT list_contains((SELECT dropped FROM walk WHERE r = (SELECT max(r) FROM walk)), vec_id)""")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return S.semantic_deduplicate(rows, 0.35).select("id", "label")


# --- splits -------------------------------------------------------------------------------------

@query("split", EX + f"""
SELECT id, row_number() OVER (ORDER BY {u('id', 'split')}, id) <= floor(count(*) OVER () * 0.8) AS is_train FROM examples""")
def _(spark, sf):
    return W.split(examples(spark, sf)).select("id", "is_train")


@query("ordered_split", EX + """
SELECT id, row_number() OVER (ORDER BY id) <= floor(count(*) OVER () * 0.8) AS is_train FROM examples""")
def _(spark, sf):
    return W.ordered_split(examples(spark, sf)).select("id", "is_train")


@query("stratified_split", EX + f"""
SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {u('id', 'split')}, id)
           <= floor(count(*) OVER (PARTITION BY label) * 0.8) AS is_train FROM examples""")
def _(spark, sf):
    return W.stratified_split(examples(spark, sf)).select("id", "label", "is_train")


@query("hash_split", EX + f"SELECT {u('id', 'split')} < 0.8 AS is_train, count(*) AS n FROM examples GROUP BY 1")
def _(spark, sf):
    return W.hash_split(examples(spark, sf)).groupBy("is_train").agg(F.count("*").alias("n"))


@query("kfold", EX + f"""
SELECT id, cast(least(floor((row_number() OVER (ORDER BY {u('id', 'fold')}, id) - 1) / floor(count(*) OVER () / 5.0)), 4) AS integer) AS fold
FROM examples""")
def _(spark, sf):
    return W.kfold(examples(spark, sf), 5).select("id", "fold")


@query("fold_sizes", EX + f"""
, f AS (SELECT id, cast(least(floor((row_number() OVER (ORDER BY {u('id', 'fold')}, id) - 1) / floor(count(*) OVER () / 5.0)), 4) AS integer) AS fold FROM examples)
SELECT v.fold, count(*) FILTER (f.fold <> v.fold) AS train, count(*) FILTER (f.fold = v.fold) AS val
FROM f, (SELECT unnest(range(5))::integer AS fold) v GROUP BY v.fold""")
def _(spark, sf):
    folds = W.kfold(examples(spark, sf), 5).groupBy("fold").agg(F.count("*").alias("val"))
    total = folds.agg(F.sum("val")).scalar()
    return folds.select("fold", (total - F.col("val")).alias("train"), "val")


# --- augmentation ---------------------------------------------------------------------------------

def _augment_sql() -> str:
    keys = ", ".join(f"'{w}'" for w in SYNONYMS)
    values = ", ".join("[" + ", ".join(f"'{o}'" for o in others) + "]" for others in SYNONYMS.values())
    fillers = ", ".join(f"'{w}'" for w in FILLERS)

    def swap(src: str, salt: str) -> str:
        at = f"concat(key, ':', i - 1)"
        bare = "regexp_replace(lower(w), '[^a-z]', '', 'g')"
        other = f"map_extract(syn, {bare})[1][cast(floor({u(at, salt + '_word')} * 5.0) as integer) + 1]"
        cased = f"CASE WHEN substr(w, 1, 1) = upper(substr(w, 1, 1)) THEN concat(upper(substr({other}, 1, 1)), substr({other}, 2)) ELSE {other} END"
        pos = f"strpos(lower(w), {bare})"
        put = f"CASE WHEN {pos} > 0 THEN concat(substr(w, 1, {pos} - 1), {cased}, substr(w, {pos} + length({bare}))) ELSE w END"
        return (
            f"array_to_string(list_transform(string_split_regex({src}, '\\s+'), lambda w, i: "
            f"CASE WHEN list_contains(known, {bare}) AND {u(at, salt)} < 0.3 THEN {put} ELSE w END), ' ')"
        )

    at = "concat(key, ':', i - 1)"
    fill = (
        "array_to_string(list_transform(string_split_regex(swapped, '\\s+'), lambda w, i: "
        f"CASE WHEN {u(at, 'fill_at')} < 0.15 THEN concat(fillers[cast(floor({u(at, 'fill_at_word')} * 10.0) as integer) + 1], ' ', w) ELSE w END), ' ')"
    )
    return with_views(
        EXAMPLES,
        f"""k AS (SELECT id, label, text, copy, concat(id, ':', copy) AS key, map([{keys}], [{values}]) AS syn, [{keys}] AS known, [{fillers}] AS fillers
  FROM examples, (SELECT unnest([0, 1, 2])::integer AS copy))""",
        f"a AS (SELECT *, CASE WHEN {u('key', 'swap')} < 0.6 THEN {swap('text', 'swap_at')} ELSE text END AS swapped FROM k WHERE copy > 0)",
        f"b AS (SELECT *, CASE WHEN {u('key', 'fill')} < 0.4 THEN {fill} ELSE swapped END AS filled FROM a)",
        f"c AS (SELECT *, CASE WHEN filled = text THEN {swap('text', 'again_at')} ELSE filled END AS changed FROM b)",
    ) + """SELECT id, label, text, 0::integer AS copy, NULL::boolean AS _augmented FROM examples
UNION ALL SELECT id, label, changed, copy, true FROM c WHERE changed <> text"""


@query("augment", _augment_sql())
def _(spark, sf):
    rows = A.augment(examples(spark, sf), multiplier=3)
    return rows.select("id", "label", "text", "copy", "_augmented")


@query("token_ngrams", EX + r"""
, t AS (SELECT id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM examples)
SELECT id, len(w) AS tokens, len(list_distinct(w)) AS words,
       len(list_distinct(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) AS pairs
FROM t""")
def _(spark, sf):
    rows = spread(examples(spark, sf)).select("id", tokenize("text").alias("t"))
    return rows.select(
        "id", F.size("t").cast("bigint").alias("tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("words"),
        F.size(ngrams("t", 2)).cast("bigint").alias("pairs"),
    )

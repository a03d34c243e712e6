"""Queries on text similarity and on choosing examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from datamill.functions.text import example_features, text_similarity, tokenize
from datamill.operators import select as S
from datamill.queries.views import EXAMPLES, SEQUENCES, examples, sequences, table, u, with_views
from datamill.session import spread

QUERIES, SQL = {}, {}
EX = with_views(EXAMPLES)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def words_sql(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '\\s+'), lambda x: x <> '')"


def pairs_sql(w: str) -> str:
    return f"list_distinct(list_transform(range(1, len({w})), lambda i: concat({w}[i], ' ', {w}[i + 1])))"


@query("text_similarity", f"""
WITH t AS (SELECT conv_id, turn, {words_sql('text')} AS w FROM conversations),
s AS (SELECT *, list_distinct(w) AS u1, {pairs_sql('w')} AS b1 FROM t),
n AS (SELECT a.conv_id, a.turn, a.u1, a.b1, b.u1 AS u2, b.b1 AS b2 FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
j AS (SELECT *, len(list_intersect(u1, u2)) AS su, len(list_intersect(b1, b2)) AS sb FROM n),
x AS (SELECT *, CASE WHEN len(u1) + len(u2) - su = 0 THEN 1 ELSE su::double / (len(u1) + len(u2) - su) END AS uni FROM j)
SELECT conv_id, turn, round(0.6 * uni + 0.4 * CASE WHEN len(b1) = 0 AND len(b2) = 0 THEN uni ELSE sb::double / (len(b1) + len(b2) - sb) END, 6) AS similarity FROM x""")
def _(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text_similarity("text", "reply"), 6).alias("similarity"))


@query("similar_topk", f"""
WITH d AS (SELECT doc_id AS id, {words_sql("coalesce(text, '')")} AS w FROM documents),
q AS (SELECT item_id AS query_id, {words_sql("coalesce(text, '')")} AS w FROM benchmark),
ds AS (SELECT id, list_distinct(w) AS u1, {pairs_sql('w')} AS b1 FROM d), qs AS (SELECT query_id, list_distinct(w) AS u2, {pairs_sql('w')} AS b2 FROM q),
j AS (SELECT query_id, id, len(u1) AS n1, len(u2) AS n2, len(b1) AS m1, len(b2) AS m2, len(list_intersect(u1, u2)) AS su, len(list_intersect(b1, b2)) AS sb FROM ds, qs),
x AS (SELECT *, CASE WHEN n1 + n2 - su = 0 THEN 1 ELSE su::double / (n1 + n2 - su) END AS uni FROM j),
s AS (SELECT query_id, id, 0.6 * uni + 0.4 * CASE WHEN m1 = 0 AND m2 = 0 THEN uni ELSE sb::double / (m1 + m2 - sb) END AS similarity FROM x),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, id) AS integer) AS rank FROM s)
SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 5""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return S.similar_for_queries(docs, queries, 5).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query("random_pick", EX + f"SELECT id, label FROM examples ORDER BY {u('id', 'random')}, id LIMIT 10")
def _(spark, sf):
    return S.select_examples("random", examples(spark, sf), k=10).select("id", "label")


@query("balanced_pick", EX + f"""
, t AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {u('id', 'balanced')}, id) AS turn, min(id) OVER (PARTITION BY label) AS first FROM examples)
SELECT id, label FROM t ORDER BY turn, first LIMIT 10""")
def _(spark, sf):
    return S.select_examples("balanced", examples(spark, sf), k=10).select("id", "label")


@query("balanced_scores", f"""
WITH b AS (SELECT event_id AS id, value, cast(cast(floor(value + 0.5) AS bigint) AS varchar) AS bucket FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {u('id', 'balanced')}, id) AS turn, min(id) OVER (PARTITION BY bucket) AS first FROM b)
SELECT id, value FROM t ORDER BY turn, first LIMIT 10""")
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("id"), "value")
    return S.select_balanced(rows, "scoring", 10).select("id", "value")


@query("balanced_tags", with_views(SEQUENCES) + f"""
, b AS (SELECT id, coalesce(string_agg(DISTINCT gold, ',' ORDER BY gold) FILTER (gold <> 'O'), 'O-only') AS bucket FROM sequences GROUP BY id),
t AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {u('id', 'balanced')}, id) AS turn, min(id) OVER (PARTITION BY bucket) AS first FROM b)
SELECT id, bucket FROM t ORDER BY turn, first LIMIT 10""")
def _(spark, sf):
    rows = sequences(spark, sf).select("id", "tokens", F.col("gold").alias("tags"))
    picked = S.select_balanced(rows, "sequence-labeling", 10)
    return picked.select("id", S.balance_bucket("sequence-labeling").alias("bucket"))


FEATURES = f"""w AS (SELECT id, label, {words_sql('text')} AS w FROM examples),
f AS MATERIALIZED (SELECT DISTINCT id, unnest(list_concat(list_transform(w, lambda x: 'w=' || x), ['label=' || label, 'len=' || (len(w) // 5 * 5)])) AS feature FROM w)"""


def _diverse_sql(k: int) -> str:
    parts = [EXAMPLES, FEATURES]
    chosen = "SELECT NULL::bigint AS id WHERE false"
    for i in range(1, k + 1):
        parts.append(
            f"p{i} AS MATERIALIZED (SELECT id, {i} AS pick FROM f WHERE id NOT IN ({chosen}) AND feature NOT IN "
            f"(SELECT feature FROM f WHERE id IN ({chosen})) GROUP BY id ORDER BY count(*) DESC, id LIMIT 1)"
        )
        chosen = " UNION ALL ".join(f"SELECT id FROM p{j}" for j in range(1, i + 1))
    return with_views(*parts) + " UNION ALL ".join(f"SELECT id, pick FROM p{i}" for i in range(1, k + 1))


@query("diverse_pick", _diverse_sql(5))
def _(spark, sf):
    return S.select_examples("diverse", examples(spark, sf), k=5).select("id", "pick")


@query("example_features", with_views(EXAMPLES, FEATURES) + "SELECT id, count(*) AS features FROM f GROUP BY id")
def _(spark, sf):
    return S.feature_rows(examples(spark, sf)).groupBy("id").agg(F.count("*").alias("features"))


@query("similar_pick", f"""
WITH d AS (SELECT doc_id AS id, {words_sql("coalesce(text, '')")} AS w FROM documents),
q AS (SELECT ['the', 'for', 'and', 'with'] AS u2, ['the for', 'for and', 'and with'] AS b2),
ds AS (SELECT id, list_distinct(w) AS u1, {pairs_sql('w')} AS b1 FROM d),
j AS (SELECT *, len(list_intersect(u1, u2)) AS su, len(list_intersect(b1, b2)) AS sb FROM ds, q)
SELECT id, round(0.6 * su / (len(u1) + 4 - su)::double + 0.4 * sb / (len(b1) + 3 - sb)::double, 6) AS similarity FROM j
ORDER BY 0.6 * (su / (len(u1) + 4 - su)::double) + 0.4 * (sb / (len(b1) + 3 - sb)::double) DESC, id LIMIT 5""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return S.select_examples("similar", docs, k=5, query="the for and with").select("id", F.round("similarity", 6).alias("similarity"))

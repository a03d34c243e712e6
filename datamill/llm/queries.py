"""Registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from datamill.llm import (
    inner_product, line_dedup, mixing, near_dup, packing, periodic, pieces, projected_nn, quality, sharding, spelling, toxicity, warc,
)
from datamill.llm.common import held_out
from datamill.queries.views import table

QUERIES, SQL = {}, {}


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


LINE_DEDUP_SQL = r"""
WITH pages AS (SELECT DISTINCT coalesce('=' || source, '-') AS site, coalesce(text, '') AS text FROM documents),
totals AS (SELECT site, count(*) AS pages FROM pages GROUP BY 1),
held AS (
  SELECT site, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \t\n\x0b\f\r')))) AS line FROM pages),
often AS (
  SELECT site, line FROM held JOIN totals USING (site) WHERE line <> '' GROUP BY site, line, pages
  HAVING count(*) >= 2 AND count(*) > pages * 0.1::double),
lists AS (SELECT site, list(line) AS often FROM often GROUP BY 1),
marked AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines,
         list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(often, []), trim(x, E' \t\n\x0b\f\r'))) AS good
  FROM documents LEFT JOIN lists ON coalesce('=' || source, '-') = site)
SELECT doc_id, array_to_string(good, chr(10)) AS text, coalesce(len(lines), 0)::int AS n_lines, coalesce(len(lines) - len(good), 0)::int AS n_dropped
FROM marked"""


@query("op4_line_dedup", LINE_DEDUP_SQL)
def _(spark, sf):
    return line_dedup.drop_boilerplate(table(spark, sf, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


@query("op7_sharding")
def _(spark, sf):
    return sharding.assign(table(spark, sf, "documents"), [1.0] * 24, [1.0] * 25)


MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size,
         cast(concat('0x', substr(md5(concat(cast(doc_id AS varchar), ':mix')), 1, 8)) AS bigint) / 4294967296.0::double AS u FROM documents),
s AS (
  SELECT source, sum(size)::bigint AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM d GROUP BY 1),
c AS (
  SELECT *, coalesce(sum(source_size) OVER before, 0) AS full_size, coalesce(sum(weight) OVER before, 0) AS full_weight,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
  FROM s WINDOW before AS (ORDER BY source_size / weight::double, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT *, (1.5::double * total - 2.0::double * full_size) / (weights - full_weight) AS level FROM c),
w AS (
  SELECT level FROM l WHERE 2.0::double * source_size >= level * weight ORDER BY source_size / weight::double, source NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size, round(least(2.0::double * source_size, level * weight), 6) AS target FROM s, w),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::bigint AS rounds FROM t),
x AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.rounds, round(target - rounds * source_size)::bigint AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (rounds * size + greatest(0, least(size, rest - before)))::bigint AS taken FROM x"""


@query("op10_mixing", MIXING_SQL)
def _(spark, sf):
    return mixing.mixed_words(table(spark, sf, "documents"))


@query("op8_pieces")
def _(spark, sf):
    model = tokenizer_path("piece_bpe_32k.model")
    return pieces.piece_digests(pieces.encode(table(spark, sf, "documents"), model), model)


@query("op6_minhash")
def _(spark, sf):
    return near_dup.near_duplicates(table(spark, sf, "documents"))


@query("op1_toxicity")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    scored = toxicity.score(docs, model).withColumn("held_out", held_out("doc_id"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_quality")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    weights = quality.train(docs, table(spark, sf, "labels"))
    scored = quality.score(docs, weights).withColumn("held_out", held_out("doc_id"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op2_projected_nn")
def _(spark, sf):
    return projected_nn.nearest(table(spark, sf, "embeddings"))


INNER_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::bigint AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::int AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


@query("op5_inner_product", INNER_SQL)
def _(spark, sf):
    return inner_product.largest_products(table(spark, sf, "embeddings"))


WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::bigint AS payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM r"""


@query("op9_warc", WARC_SQL)
def _(spark, sf):
    found = warc.archive_and_read(table(spark, sf, "pages")).where("kind = 'record'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_periodic_runs")
def _(spark, sf):
    return periodic.run_digests(periodic.repeated_words(periodic.repeat_tails(table(spark, sf, "documents"))))


@query("op12_spelling_variants")
def _(spark, sf):
    found = spelling.variants(spelling.misspelled_words(table(spark, sf, "documents")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_best_fit_packing")
def _(spark, sf):
    return packing.pack(packing.token_pieces(table(spark, sf, "documents"), tokenizer_path("word_bpe_49k.json")))

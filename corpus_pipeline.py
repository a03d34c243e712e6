"""From raw documents to an encoded training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. The result of a stage is
written as Parquet to the shared folder and reread as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from datamill.llm import line_dedup, mixing, near_dup, pieces, toxicity
from datamill.llm.common import written
from datamill.llm.queries import tokenizer_path
from datamill.queries.views import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned model takes for toxic go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; n_chars follows the text."""
    return line_dedup.drop_boilerplate(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return near_dup.first_of_each(docs).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, kept once or left out, so that sources meet their target weights."""
    return mixing.mix(docs).select(*COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the pieces of every text of the mix."""
    return pieces.token_digests(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity_stage), ("line dedup", line_stage), ("near duplicates", near_duplicate_stage),
    ("mixing", mixing_stage), ("pieces", pieces_stage),
]
#: SQL can't express the stages that learn or encode; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""What several operators share: written steps, word boundaries, keys and held-out rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from datamill.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\f\r"


def shared_folder(df_or_spark, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the copy: short lineage, known sizes."""
    path = shared_folder(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(c: Column | str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def packed(docs: DataFrame, **own: Column) -> DataFrame:
    """The whole row as the struct ``row`` beside the columns in ``own``, so that no name of ``docs`` can clash."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in own.items()])


def unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of the packed rows, with those in ``new`` in their place or behind them."""
    kept = [new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in columns]
    return rows.select(*kept, *[c.alias(name) for name, c in new.items() if name not in columns])


def null_key(c: Column | str) -> Column:
    """A string key under which null is a value of its own, so that joins and groups agree on it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), c.cast("string")))


def held_out(doc_id: Column | str) -> Column:
    """Rows that no model learns from: crc32 of the id as text divides by five. A null id is held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents of each class, chosen by the hash of their id.

    Held-out ids and null labels take no part; an id with several labels counts with its largest.
    Only ids are ordered, and the bounded table of chosen ids meets the texts.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key)).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    picked = None
    for value in (0, 1):
        part = marks.where(F.col("_label") == value).orderBy(F.xxhash64(key), key).limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    ids = written(picked.withColumnRenamed(key, "_id"), "labelled")
    texts = docs.select(docs[key].alias("_key"), text_of(docs[text]).alias("text"))
    return texts.join(ids, texts["_key"] == ids["_id"]).select("text", F.col("_label").alias("label"))

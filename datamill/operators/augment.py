"""Augmentation: every row, plus changed copies of its text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from datamill.functions.fixed_values import INSERT_PASS, INSERT_WORD, SYNONYM_PASS, SYNONYM_WORD
from datamill.functions.hashing import draw
from datamill.functions.wording import insert_fillers, replace_synonyms
from datamill.session import spread


def augment(
    df: DataFrame,
    multiplier: int = 2,
    synonym_chance: float = SYNONYM_WORD,
    insert_chance: float = INSERT_WORD,
    id: str = "id",
    text: str = "text",
) -> DataFrame:
    """Originals (``copy`` 0) and up to multiplier - 1 changed copies, marked ``_augmented``.

    Rows are multiplied in place, so there is no union and no shuffle.
    """
    copies = F.explode(F.sequence(F.lit(0), F.lit(max(multiplier, 1) - 1)))
    rows = spread(df).select("*", copies.alias("copy"))
    rows = rows.withColumn("_key", F.concat_ws(":", F.col(id).cast("string"), F.col("copy").cast("string")))
    key, original = F.col("_key"), F.col(text)
    rows = rows.withColumn("_swapped", F.when(
        F.col("copy") > 0,
        F.when(draw(key, "swap") < SYNONYM_PASS, replace_synonyms(original, key, "swap_at", synonym_chance)).otherwise(original),
    ))
    rows = rows.withColumn("_filled", F.when(
        draw(key, "fill") < INSERT_PASS, insert_fillers("_swapped", key, "fill_at", insert_chance)
    ).otherwise(F.col("_swapped")))
    rows = rows.withColumn("_new", F.when(
        F.col("_filled") == original, replace_synonyms(original, key, "again_at", synonym_chance)
    ).otherwise(F.col("_filled")))
    # Through a generator: a condition on the plain column would have every step made again, several times, to test it.
    rows = rows.withColumn("_new", F.explode_outer(F.array("_new")))
    changed = F.col("_new") != original
    return (
        rows.where((F.col("copy") == 0) | changed)
        .withColumn(text, F.when(F.col("copy") == 0, original).otherwise(F.col("_new")))
        .withColumn("_augmented", F.when(F.col("copy") > 0, F.lit(True)))
        .drop("_key", "_swapped", "_filled", "_new")
    )

"""Word replacement and insertion for augmentation, driven by hashes of row, copy and position."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from datamill.functions.fixed_values import FILLERS, INSERT_WORD, SYNONYM_WORD, SYNONYMS
from datamill.functions.hashing import _col, draw, pick


def _literal_map(words: dict[str, list[str]]) -> Column:
    pairs: list[Column] = []
    for word, others in words.items():
        pairs += [F.lit(word), F.array(*[F.lit(o) for o in others])]
    return F.create_map(*pairs)


def replace_synonyms(text: Column | str, key: Column, salt: str, chance: float = SYNONYM_WORD) -> Column:
    """Words of the synonym list are swapped with probability ``chance``.

    Punctuation around the word and an initial capital are kept. ``key`` identifies the row.
    """
    table = _literal_map(SYNONYMS)
    known = F.array(*[F.lit(w) for w in SYNONYMS])

    def swap(word: Column, pos: Column) -> Column:
        bare = F.regexp_replace(F.lower(word), "[^a-z]", "")
        here = F.concat(key.cast("string"), F.lit(":"), pos.cast("string"))
        choices = F.element_at(table, bare)
        other = F.element_at(choices, pick(here, f"{salt}_word", 5) + 1)
        first = F.substring(word, 1, 1)
        cased = F.when(
            first == F.upper(first),
            F.concat(F.upper(F.substring(other, 1, 1)), F.substring(other, 2, 99)),
        ).otherwise(other)
        at = F.position(bare, F.lower(word))
        swapped = F.when(at > 0, F.overlay(word, cased, at, F.length(bare))).otherwise(word)
        return F.when(
            F.array_contains(known, bare) & (draw(here, salt) < chance), swapped
        ).otherwise(word)

    return F.array_join(F.transform(F.split(_col(text), r"\s+"), swap), " ")


def insert_fillers(text: Column | str, key: Column, salt: str, chance: float = INSERT_WORD) -> Column:
    """A filler word goes before a word with probability ``chance``."""
    fillers = F.array(*[F.lit(w) for w in FILLERS])

    def extend(word: Column, pos: Column) -> Column:
        here = F.concat(key.cast("string"), F.lit(":"), pos.cast("string"))
        filler = F.element_at(fillers, pick(here, f"{salt}_word", len(FILLERS)) + 1)
        return F.when(
            draw(here, salt) < chance, F.concat(filler, F.lit(" "), word)
        ).otherwise(word)

    return F.array_join(F.transform(F.split(_col(text), r"\s+"), extend), " ")

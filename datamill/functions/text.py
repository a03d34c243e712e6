"""Text expressions: all run inside the JVM except character pieces, which are Arrow-batched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from datamill.functions.hashing import _col


SPACES = " \t\n\x0b\f\r"


def trim_ws(text: Column | str) -> Column:
    """Text without leading and trailing white space (all of it, not only blanks)."""
    return F.btrim(_col(text), F.lit(SPACES))


def not_blank(text: Column | str) -> Column:
    return F.coalesce(_col(text).rlike(r"\S"), F.lit(False))


def tokenize(text: Column | str) -> Column:
    """Lower-case words between white space; an absent text has none."""
    words = F.split(F.lower(F.coalesce(_col(text), F.lit(""))), r"\s+")
    return F.array_remove(words, "")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often the body names it: functions of arrays don't share what they are given."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(tokens: Column | str, n: int) -> Column:
    """Distinct runs of ``n`` tokens joined by a blank, in order of first appearance.

    Built by zipping shifted copies, so the cost is linear in the number of tokens.
    """
    def joined(tokens: Column) -> Column:
        runs = tokens
        for step in range(1, n):
            shifted = F.slice(tokens, step + 1, F.greatest(F.size(tokens), F.lit(1)))
            runs = F.zip_with(runs, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_distinct(F.array_compact(runs))

    return _once(_col(tokens), joined)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Shared members over all members of two sets; two empty sets are equal, so 1."""
    return _set_jaccard(F.array_distinct(_col(a)), F.array_distinct(_col(b)))


def _set_jaccard(a: Column, b: Column) -> Column:
    sizes = F.struct(F.size(F.array_intersect(a, b)).alias("shared"), F.size(a).alias("a"), F.size(b).alias("b"))
    return _once(sizes, lambda n: jaccard_from_sizes(n["shared"], n["a"], n["b"]))


def jaccard_from_sizes(shared: Column, size_a: Column, size_b: Column) -> Column:
    union = size_a + size_b - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def similarity_from_jaccards(uni: Column, bi: Column) -> Column:
    return F.lit(0.6) * uni + F.lit(0.4) * bi


def text_similarity(a: Column | str, b: Column | str) -> Column:
    """0.6 x word Jaccard + 0.4 x word-pair Jaccard; without word pairs the words count for both."""
    def sets(tokens: Column) -> Column:
        return _once(tokens, lambda t: F.struct(F.array_distinct(t).alias("words"), ngrams(t, 2).alias("pairs")))

    def similarity(x: Column, y: Column) -> Column:
        return _once(_set_jaccard(x["words"], y["words"]), lambda uni: similarity_from_jaccards(uni, F.when(
            (F.size(x["pairs"]) == 0) & (F.size(y["pairs"]) == 0), uni).otherwise(_set_jaccard(x["pairs"], y["pairs"]))))

    return _once(sets(tokenize(a)), lambda x: _once(sets(tokenize(b)), lambda y: similarity(x, y)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _trigrams_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else list(dict.fromkeys(t[i:i + 3] for i in range(len(t) - 2))))


def trigrams(text: Column | str) -> Column:
    """Distinct three-character pieces of the trimmed lower-case text, as strings."""
    return _trigrams_udf(F.lower(trim_ws(text)))


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def pack_grams(text: str) -> np.ndarray:
    """Distinct three-character pieces of one prepared text, each packed into one integer.

    A code point needs 21 bits, so three of them fit a signed 64-bit number without loss.
    """
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    if len(points) < 3:
        return np.empty(0, dtype=np.int64)
    return np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _pack_grams_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: None if t is None else pack_grams(t))


def gram_codes(text: Column | str) -> Column:
    """The set of :func:`trigrams` as sorted integers.

    Same sets as :func:`trigrams` without a string per character.
    """
    return _pack_grams_udf(F.lower(trim_ws(text)))


def example_features(
    tokens: Column | str,
    label: Column | str | None = None,
    value: Column | str | None = None,
    tags: Column | str | None = None,
) -> Column:
    """Distinct features used to judge how different examples are."""
    tokens = _col(tokens)
    parts = [F.transform(tokens, lambda w: F.concat(F.lit("w="), w))]
    if label is not None:
        parts.append(F.array_compact(F.array(F.concat(F.lit("label="), F.nullif(_col(label), F.lit(""))))))
    if value is not None:
        bucket = F.floor(_col(value) + 0.5).cast("string")
        parts.append(F.array_compact(F.array(F.concat(F.lit("bucket="), bucket))))
    if tags is not None:
        parts.append(F.transform(F.coalesce(_col(tags), F.array().cast("array<string>")), lambda t: F.concat(F.lit("tag="), t)))
    length = (F.floor(F.size(tokens) / 5) * 5).cast("string")
    parts.append(F.array(F.concat(F.lit("len="), length)))
    return F.array_distinct(F.concat(*parts))


def text_features(text: Column | str) -> Column:
    """Features of the linear scorer, repeats included (they count twice)."""
    text = F.coalesce(_col(text), F.lit(""))
    lower = F.lower(text)
    # Caps of the length features and the reach of the character features.
    chars = F.regexp_extract_all(F.substring(lower, 1, 200), F.lit("(?s)(?=(.{3}))"), F.lit(1))
    length = F.char_length(text)
    caps = F.regexp_count(text, F.lit("[A-Z]"))
    share = F.when(length > 0, F.floor(caps / length * 10 + 0.5)).otherwise(F.lit(0))

    def tagged(name: str, number: Column) -> Column:
        return F.concat(F.lit(f"{name}="), number.cast("string"))

    flags = [
        F.when(text.rlike("[0-9]"), F.lit("has_digit")),
        F.when(F.contains(text, F.lit("!")), F.lit("has_excl")),
        F.when(F.contains(text, F.lit("?")), F.lit("has_q")),
    ]
    def features(words: Column) -> Column:
        next_words = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
        return F.concat(
            F.transform(words, lambda w: F.concat(F.lit("w="), w)),
            F.array_compact(F.zip_with(words, next_words, lambda a, b: F.concat(F.lit("bi="), a, F.lit("|"), b))),
            F.transform(chars, lambda c: F.concat(F.lit("c3="), c)),
            F.array(
                tagged("wc", F.least(F.size(words), F.lit(50))),
                tagged("cc", F.least(length, F.lit(500))),
                tagged("punct", F.least(F.regexp_count(text, F.lit("[!?.,:;]")), F.lit(20))),
                tagged("capr", share),
            ),
            F.array_compact(F.array(*flags)),
        )

    return _once(tokenize(text), features)


def word_shape(word: Column | str) -> Column:
    """X for A-Z, x for a-z, d for a digit; runs of one character collapse to one."""
    shape = F.translate(
        _col(word),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
        "X" * 26 + "x" * 26 + "d" * 10,
    )
    return F.regexp_replace(shape, r"(.)\1+", "$1")

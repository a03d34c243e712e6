import numpy as np
import pytest
from conftest import values
from pyspark.sql import functions as F

from datamill.functions import hashing as H, numbers as N, text as X, wording as W
from datamill.functions.fixed_values import FILLERS, SYNONYMS


def one(spark, col, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], names) if names else spark.range(1)
    return df.select(col).first()[0]


def test_trigrams(rows):
    df = rows([("hello",), ("ABC",), ("ab",), ("  aaaa\n",)], "t string")
    assert [r[0] for r in df.select(X.trigrams("t")).collect()] == [["hel", "ell", "llo"], ["abc"], [], ["aaa"]]


def test_packed_grams_are_the_same_sets(rows):
    texts = ["hello world", "ñandú ñandú", "a\nb\tc d", "", "ab", "😀😀😀😀x"]
    df = rows([(t,) for t in texts], "t string")
    for r in df.select(X.trigrams("t").alias("s"), X.gram_codes("t").alias("c")).collect():
        packed = {(ord(g[0]) << 42) | (ord(g[1]) << 21) | ord(g[2]) for g in r["s"]}
        assert packed == set(r["c"])


def test_trigram_similarity(rows):
    df = rows([("great product love it", "great product loved it"), ("aaaa", "zzzz"), ("a", "b")], "a string, b string")
    near, far, short = [r[0] for r in df.select(X.trigram_similarity("a", "b")).collect()]
    assert near > 0.7 and far < 0.1 and short == 1.0


def test_text_similarity(rows):
    df = rows([("The cat", "the CAT"), ("a b", "c d"), ("", ""), ("a", "a b")], "a string, b string")
    assert [round(r[0], 6) for r in df.select(X.text_similarity("a", "b")).collect()] == [1.0, 0.0, 1.0, 0.3]


def test_example_features(rows):
    words = " ".join(f"w{i}" for i in range(11))
    df = rows([(words, "pos", 4.3, ["O", "B-X"])], "t string, label string, value double, tags array<string>")
    got = set(df.select(X.example_features(X.tokenize("t"), "label", "value", "tags")).first()[0])
    assert {"w=w0", "label=pos", "bucket=4", "len=10", "tag=O", "tag=B-X"} <= got


def test_rounding_of_negative_halves(rows):
    df = rows([("x", -2.5)], "t string, value double")
    assert "bucket=-2" in df.select(X.example_features(X.tokenize("t"), value="value")).first()[0]


def test_text_features(rows):
    got = rows([("Good day, 12!",)], "t string").select(X.text_features("t")).first()[0]
    assert {"w=good", "bi=good|day,", "c3=goo", "wc=3", "cc=13", "punct=2", "capr=1", "has_digit", "has_excl"} <= set(got)
    assert "has_q" not in got


def test_word_shape(rows):
    df = rows([("McDonald's",), ("AB-123x",)], "w string")
    assert [r[0] for r in df.select(X.word_shape("w")).collect()] == ["XxXx'x", "X-dx"]


def test_entropy(rows):
    df = rows([([1.0, 0.0, 0.0],), ([0.5, 0.5],), ([],)], "p array<double>")
    assert [r[0] for r in df.select(N.entropy("p")).collect()] == [0.0, 1.0, 0.0]


def test_cosine(rows):
    df = rows([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(N.cosine("a", "b")).collect()] == [1.0, 0.0, 0.0]


def test_draw_is_stable_and_even(spark):
    df = spark.range(20000).select(H.draw("id", "x").alias("u"))
    r = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= r[0] < 0.01 and 0.99 < r[1] < 1 and abs(r[2] - 0.5) < 0.01
    assert df.limit(5).collect() == df.limit(5).collect()


def test_fingerprint_ignores_order_and_counts_copies(rows):
    a = rows([("x", "1"), ("y", "2")], "t string, l string")
    b = rows([("y", "2"), ("x", "1")], "t string, l string")
    c = rows([("y", "2"), ("x", "1"), ("x", "1")], "t string, l string")
    f = lambda d: d.agg(H.fingerprint("t", "l")).first()[0]
    assert f(a) == f(b) != f(c) and len(f(a)) == 15


def test_synonyms_keep_case_and_punctuation(rows):
    df = rows([(1, "Good, (bad) x")], "id long, t string")
    words = df.select(W.replace_synonyms("t", F.col("id"), "s", 1.0)).first()[0].split(" ")
    assert words[0][:-1].lower() in SYNONYMS["good"] and words[0][0].isupper() and words[0].endswith(",")
    # The first character is a bracket, which equals its upper case.
    assert words[1][1:-1].lower() in SYNONYMS["bad"] and words[2] == "x"


def test_insert(rows):
    df = rows([(1, "a b c")], "id long, t string")
    words = df.select(W.insert_fillers("t", F.col("id"), "s", 1.0)).first()[0].split(" ")
    assert words[1::2] == ["a", "b", "c"] and set(words[0::2]) <= set(FILLERS)


def test_words_are_cut_once(rows):
    """However often features and similarities use the words of a text, they are cut out of it once."""
    from datamill.functions import text as X

    df = rows([(1, "One two, two three", "two three")], "id long, a string, b string")
    for column, texts in ((X.text_features("a"), 1), (X.text_similarity("a", "b"), 2), (X.ngrams(X.tokenize("a"), 2), 1)):
        assert df.select(column.alias("x"))._jdf.queryExecution().analyzed().toString().split("LogicalRDD")[0].count("split(") == texts

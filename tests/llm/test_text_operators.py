"""Line dedup, mixing, sharding, toxicity, quality and near duplicates on odd tables and against brute force."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from datamill.llm import line_dedup, mixing, near_dup, quality, sharding, toxicity
from datamill.llm.common import held_out

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
#: Nulls everywhere, an empty and a very long text, equal rows and ties, and columns with names the operators use inside.
ODD = [
    (1, "a b c d e f g", "x", 1, "s"), (1, "a b c d e f g", "x", 1, "s"), (2, "", "x", None, None), (3, None, None, 3, "t"),
    (None, "a b c", None, 4, "u"), (None, None, None, None, None), (4, LONG, "y", 5, "v"), (5, "a b c d e f g", "y", 6, "w"),
    (6, " \n\t ", "x", 7, "z"),
]
SCHEMA = "doc_id long, text string, source string, _n long, row string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (1, 1, 0), (4, 1, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- line dedup --------------------------------------------------------------------------------


def test_lines_of_a_site(spark):
    texts = [f"own {i} line with its words\nAll rights reserved\n\nother {i} text of this page" for i in range(20)]
    data = [(i, t, "a") for i, t in enumerate(texts)] + [(100 + i, "All rights reserved\nmuch more text of the page %d" % i, "b") for i in range(9)]
    data += [(200, "the only page\nof a site", "c"), (201, "All rights reserved", "b")]
    got = dict(rows(line_dedup.drop_boilerplate(spark.createDataFrame(data, "doc_id long, text string, source string")), "doc_id", "text"))
    assert got[3] == "own 3 line with its words\n\nother 3 text of this page"
    assert got[101] == "much more text of the page 1" and got[201] == ""  # small sites too
    assert got[200] == "the only page\nof a site"


def test_pages_that_are_mostly_boilerplate(spark):
    data = [(i, f"a long common line at the head of each page\nanother common line at its foot\n{i}", "https://u@Site.org:80/%d?x" % i) for i in range(40)]
    pages = spark.createDataFrame(data, "page_id long, text string, url string")
    got = line_dedup.drop_boilerplate(pages, site=line_dedup.host(pages["url"]))
    assert got.columns == ["page_id", "text", "url", "n_lines", "n_dropped"]
    assert rows(got, "page_id", "text", "n_dropped") == sorted(((i, str(i), 2) for i in range(40)), key=repr)


def test_lines_against_brute_force(spark):
    rng = random.Random(8)
    data = [(i, "\n".join(rng.choices([f"line {j}" for j in range(30)] + ["", " line 1\t"], weights=[9 - min(8, j // 2) for j in range(30)] + [4, 2], k=rng.randint(0, 6))), rng.choice(["a", "a", "b", None])) for i in range(60)]
    data += [(100, None, "a"), (101, "", "b"), (102, data[0][1], data[0][2])]
    pages = {s: {t or "" for _, t, other in data if other == s} for s in ("a", "b", None)}
    held = lambda line, s: sum(line in {x.strip() for x in t.split("\n")} for t in pages[s])
    bad = lambda x, s: x.strip() != "" and held(x.strip(), s) >= 2 and held(x.strip(), s) > 0.1 * len(pages[s])
    expected = [(i, None if t is None else "\n".join(x for x in t.split("\n") if not bad(x, s))) for i, t, s in data]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(data, "doc_id long, text string, source string"))
    assert rows(got, "doc_id", "text") == sorted(expected, key=repr)


@pytest.mark.parametrize("url,expected", [("http://a.org", "a.org"), ("HTTPS://me:pw@A.Org:8080/x@y", "a.org"), ("a.org/x", None), ("", None), (None, None)])
def test_host(spark, url, expected):
    assert spark.createDataFrame([(url,)], "url string").select(line_dedup.host(F.col("url"))).first()[0] == expected


def test_copies_are_no_boilerplate(spark):
    data = [(i, "one line\nand another", "a") for i in range(50)] + [(100 + i, f"text {i}", "a") for i in range(5)]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(data, "doc_id long, text string, source string"))
    assert got.where("n_dropped > 0").count() == 0 and got.count() == 55


def test_near_copies_can_be_left_alone(spark):
    data = [(i, f"head\nthe long common body of a page copied often\ntail {i}", "a") for i in range(30)]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(data, "doc_id long, text string, source string"), whole=0.5)
    assert got.where("n_dropped > 0").count() == 0


def test_lines_odd(odd, none):
    got = line_dedup.drop_boilerplate(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"]
    assert rows(got, *odd.columns) == sorted(map(tuple, ODD), key=repr)
    assert line_dedup.drop_boilerplate(none).count() == 0


# --- mixing --------------------------------------------------------------------------------------


def brute_targets(sizes, share=1.5, epochs=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = budget - sum(epochs * sizes[s] for s in full)
        level = left / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if level * weight[s] > epochs * sizes[s]}
        if not above:
            return {s: epochs * sizes[s] if s in full else level * weight[s] for s in names}
        full |= above


def test_mix_targets(spark):
    rng = random.Random(3)
    data = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "b", "c", "d", None])) for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mixed_words(docs).toPandas().merge(docs.select("doc_id", F.coalesce("source", F.lit("-")).alias("s")).toPandas())
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes)
    for s, part in got.groupby("s"):
        assert part["target"].iloc[0] == pytest.approx(want[None if s == "-" else s], abs=1e-5)
        assert part["taken"].sum() == round(part["target"].iloc[0])
    assert (got["taken"] <= 2 * got["size"]).all()
    again = mixing.mixed_words(docs).toPandas()
    assert dict(zip(again.doc_id, again.taken)) == dict(zip(got.doc_id, got.taken))


def test_mix_rows(spark):
    data = [(i, "w " * (i % 7 + 1), "ab"[i % 5 == 0]) for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = mixing.mix(docs)
    words = out.select("source", mixing.words_in("text").alias("n")).groupBy("source").agg(F.sum("n").alias("n")).collect()
    targets = {r["source"]: r["target"] for r in mixing.plan(mixing.sizes_of(docs)).collect()}
    assert all(abs(r["n"] - targets[r["source"]]) <= 4 for r in words)
    assert set(rows(out, "doc_id", "text", "source")) <= set(map(tuple, data))


def test_mix_odd(odd, none, spark):
    got = mixing.mixed_words(odd).toPandas()
    assert len(got) == len(ODD) and (got["taken"] <= 2 * got["size"]).all()
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(odd).where("text = ''").count() == 1
    assert mixing.mixed_words(none).count() == 0 and mixing.mix(none).count() == 0
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {r["taken"] for r in mixing.mixed_words(empty).collect()} == {0}


# --- sharding ------------------------------------------------------------------------------------


def brute_shard(doc_id, n):
    key = "-" if doc_id is None else f"={doc_id}"
    node = 0
    for level, weights, width in sharding.levels([1.0] * n):
        best = None
        for i in range(width):
            child = node * width + i
            if child < len(weights):
                bits = xxhash.xxh64(f"shard/{level}/{child}/{key}".encode(), seed=42).intdigest() >> 11
                best = min(filter(None, (best, (-math.log((bits + 0.5) / 2.0**53) / weights[child], child))))
        node = best[1]
    return node


def test_shards_against_brute_force(spark):
    data = [(i, f"text {i % 50} é") for i in range(3000)]
    got = sharding.assign(spark.createDataFrame(data, "doc_id long, text string"), [1.0] * 24, [1.0] * 25).toPandas()
    for r in got.itertuples():
        t = data[r.doc_id][1].encode()
        assert (r.size, r.text_crc32, r.law) == (len(t) + 8, zlib.crc32(t), "key")
        assert r.shard == brute_shard(r.doc_id, 24)
        assert r.grown_shard in (r.shard, 24)
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert got["shard"].nunique() == 24 and 60 < (got["grown_shard"] == 24).sum() < 180


def test_movement_stays_in_the_subtree(spark):
    docs = spark.createDataFrame([(i, "") for i in range(2000)], "doc_id long, text string")
    heavier = [1.0] * 9 + [3.0] + [1.0] * 14  # shard 9: region 1, rack 2
    before = sharding.assign(docs, [1.0] * 24).select("doc_id", "shard")
    after = sharding.assign(docs, heavier).select("doc_id", F.col("shard").alias("new"))
    moved = before.join(after, "doc_id").where("shard <> new").toPandas()
    assert len(moved) and moved["new"].between(8, 15).all()


def test_shards_odd(odd, none):
    got = sharding.assign(odd, [1.0] * 24, [1.0] * 25).toPandas()
    assert len(got) == len(ODD)
    assert sharding.assign(none, [1.0]).count() == 0
    assert set(got.loc[got["doc_id"].isna(), "shard"]) == {brute_shard(None, 24)}
    with pytest.raises(ValueError):
        sharding.levels([1.0, 0.0])


# --- toxicity ------------------------------------------------------------------------------------


def distance(a, b):
    """Edits with swapped neighbours, the restricted kind."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i, j in itertools.product(range(len(a)), range(len(b))):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
        if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_against_edit_distance():
    terms = ["idiot", "trash", "scum", "worthless", "disgusting"]
    matcher, rng = toxicity.Matcher(terms), random.Random(1)
    for _ in range(4000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(word) + 1)
            word[i:i + rng.randint(0, 1)] = rng.choice(["", "a", "t", "s", "ti"])
        word = "".join(word) or "a"
        best = min((distance(word, t), t) for t in terms if distance(word, t) <= toxicity.edits(t)) if any(distance(word, t) <= toxicity.edits(t) for t in terms) else None
        assert matcher[word] == ((best[1], best[0]) if best else None), word


def test_quotation_is_milder_than_abuse():
    model = toxicity.Model(("idiot", "moron"), (), (), (), tuple(toxicity.PRIOR))
    matcher = model.matcher()
    p = lambda t: toxicity.probability(t, model, matcher)
    assert p("you are an idiot") > 0.5 and p("you are an idoit and a moron") > 0.5
    assert p('he said the word "idiot" was used in the report') < 0.5
    assert p("nothing of the kind") < 0.1 and p("") == p(None) < 0.1
    # An apostrophe is no quotation mark.
    plain = p("I do not like you idiot and you can not change")
    assert plain > 0.5 and p("I don’t like you idiot and you can’t change") == p("I don't like you idiot and you can't change") == plain


@pytest.mark.parametrize("text,expected", [
    ('"x"', True), ("“a x b”", True), ("„x“", True), ("«x»", True), ("»x«", True), ("‘x’", True), ("'x'", True), ("’x’", True), ("the dogs’ x", False),
    ("don’t x can’t", False), ("x", False), ('"x', False), ('x"', False), ('"a" x "b"', False), ("“a” x “b”", False), ("“x»", False), ("” x “", False),
    ('"a" b "x"', True), ("“x " + "w " * 8 + "”", False), ("“ " + "w " * 8 + "x”", False), ("“don’t x”", True), ("l’x d’y", False),
])
def test_quotation_marks_are_paired(text, expected):
    tokens = toxicity.TOKEN.findall(text)
    assert toxicity.quoted(tokens, tokens.index("x")) == expected


def test_automaton_forgets(monkeypatch):
    terms = ["scoundrel", "idiot"]
    words = ["idoit", "scoundrl", "idiots", "scuondrel", "plain", "idiot", "sconudrels"]
    whole = toxicity.Matcher(terms)
    expected = [whole[w] for w in words]
    monkeypatch.setattr(toxicity, "MEMORY", 5)
    short = toxicity.Matcher(terms)
    assert [short[w] for w in words] == expected and len(short.steps) < len(whole.steps)


def test_toxicity_learns(spark):
    rng = random.Random(5)
    plain = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{i}" for i in range(300)]
    data = []
    for i in range(600):
        words = rng.choices(plain, k=60)
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(["foulword", "nastyname", "badterm"]))
        data.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([d[:2] for d in data], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int"))
    assert set(model.terms) == {"foulword", "nastyname", "badterm"}
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((scores[i] >= 0.5) == bool(y) for i, _, y in data)
    assert toxicity.drop_toxic(docs, model).count() == 450


def test_toxicity_odd(odd, none, labels):
    model = toxicity.train(odd, labels)
    got = toxicity.score(odd, model)
    assert got.columns == [*odd.columns, "score"] and got.count() == len(ODD) and got.where("score IS NULL").count() == 0
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    assert toxicity.score(none, toxicity.train(none, labels.limit(0))).count() == 0


def test_held_out_rule(spark):
    got = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


# --- quality -------------------------------------------------------------------------------------


def test_quality_learns(spark):
    rng = random.Random(2)
    data = []
    for i in range(300):
        good = i % 3 > 0
        words = [rng.choice(["calm", "river", "stone", "walks", "under"]) if good else rng.choice(["zxq$$", "##q", "kk%%"]) for _ in range(40)]
        data.append((i, " ".join(words), int(good)))
    docs = spark.createDataFrame([d[:2] for d in data], "doc_id long, text string")
    weights = quality.train(docs, spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, weights).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, _, y in data)


def test_quality_score_is_the_softmax():
    weights = quality.start(seed=4)
    scorer, text = quality.Scorer(weights), "the the cat sat on thé mat mat"
    ids, counts = quality.features(text, {})
    mean = (counts / counts.sum()) @ weights["table"][ids]
    z = mean @ weights["out"] + weights["bias"]
    assert scorer(text) == pytest.approx(np.exp(z[1]) / np.exp(z).sum(), abs=1e-9)
    assert scorer("") == scorer(None) == pytest.approx(0.5)


def test_quality_odd(odd, none, labels):
    got = quality.score(odd, quality.train(odd, labels))
    assert got.columns == [*odd.columns, "score"] and got.where("score BETWEEN 0 AND 1").count() == len(ODD)
    assert quality.score(none, quality.train(none, labels.limit(0))).count() == 0


# --- near duplicates -------------------------------------------------------------------------------


def jaccard(a, b):
    def cut(t):
        w = (t or "").split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def brute_classes(data):
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(data)), 2):
        if (data[i][1] or "") == (data[j][1] or "") or jaccard(data[i][1], data[j][1]) >= 0.8:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    out = {}
    for i in range(len(data)):
        out.setdefault(find(i), []).append(data[i][0])
    return sorted(sorted(ids) for ids in out.values())


def classes_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["class_id"], []).append(r["doc_id"])
    return sorted(sorted(ids) for ids in out.values())


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(9)
    data = []
    for family in range(6):
        base = [f"f{family}w{rng.randrange(200)}" for _ in range(120)]
        for _ in range(40):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
            data.append((len(data), " ".join(words)))
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    assert classes_of(near_dup.near_duplicates(docs)) == brute_classes(data)
    kept = near_dup.first_of_each(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(c[0] for c in brute_classes(data))


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(80):
        items = rng.integers(0, 2**63, 80).astype(np.uint64)
        a, b = rng.uniform(0.1, 6, 80), rng.uniform(0.1, 6, 80)
        same = (near_dup.signature(items, a) == near_dup.signature(items, b)).mean()
        errors.append(same - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02
    assert near_dup.signature(items, np.zeros(80)) is None


def test_near_duplicates_odd(odd, none):
    got = near_dup.near_duplicates(odd)
    assert got.count() == len(ODD)
    ids = {r["doc_id"]: r["class_id"] for r in got.collect() if r["doc_id"] is not None}
    assert ids == {1: 1, 5: 1, 2: 2, 3: 2, 4: 4, 6: 6}
    kept = near_dup.first_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect()) == [-1, 1, 2, 4, 6]
    assert near_dup.near_duplicates(none).count() == 0 and near_dup.first_of_each(none).count() == 0

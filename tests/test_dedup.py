import numpy as np
import pytest
from conftest import values
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from datamill.operators import dedup as D, first_wins as FW, semantic as S
from datamill.functions.text import pack_grams

SCHEMA = "id long, text string, label string"


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def greedy(texts, t):
    """Reference result by brute force: exact on trimmed text, then compared with kept rows only."""
    seen, kept, sets = set(), [], []
    for i, text in enumerate(texts):
        text = text.strip(" \t\n\x0b\f\r")
        if text in seen:
            continue
        seen.add(text)
        g = set(pack_grams(text.lower()).tolist())
        if any((len(g & s) / len(g | s) if g | s else 1.0) >= t for s in sets):
            continue
        kept.append(i)
        sets.append(g)
    return kept


def test_exact(rows):
    df = rows([(1, "hello", "a"), (2, " hello\n", "a"), (3, "world", "b")], SCHEMA)
    assert ids(D.drop_exact(df)) == [1, 3]
    assert sorted(values(D.exact_duplicates(df), "ord", "first")) == [(1, 1), (2, 1), (3, 3)]


def test_fuzzy(rows):
    df = rows([(1, "this is a great product", "a"), (2, "this is a great products", "a"), (3, "something else", "b")], SCHEMA)
    assert ids(D.deduplicate(df, 0.8)) == [1, 3]
    assert ids(D.deduplicate(df, 1.0)) == [1, 2, 3]


def test_rows_without_text_stay_and_tokens_count(rows):
    df = rows([(1, None, ["a", "b"]), (2, None, ["a", "b"]), (3, None, None), (4, None, None)], "id long, text string, tokens array<string>")
    assert ids(D.drop_exact(df, tokens="tokens")) == [1, 3, 4]
    assert ids(D.deduplicate(df, 0.9, tokens="tokens")) == [1, 3, 4]


def test_short_texts_are_all_similar(rows):
    df = rows([(1, "a", ""), (2, "b", ""), (3, "cd", ""), (4, "long enough", "")], SCHEMA)
    assert ids(D.deduplicate(df, 0.85)) == [1, 4]


def _family(n, seed, length=60, alphabet="abcdef "):
    rng = np.random.default_rng(seed)
    base = list(rng.choice(list(alphabet), length))
    out = []
    for _ in range(n):
        t = base.copy()
        for at in rng.integers(0, length, rng.integers(0, 9)):
            t[at] = rng.choice(list(alphabet))
        out.append("".join(t))
    return out


@pytest.mark.parametrize("t", [0.5, 0.85])
def test_against_brute_force(rows, t):
    texts = [x for s in range(6) for x in _family(25, s)] + ["x", "yy", "", "zzzz", "zzzz"]
    rng = np.random.default_rng(1)
    texts = [texts[i] for i in rng.permutation(len(texts))]
    df = rows([(i, x, "") for i, x in enumerate(texts)], SCHEMA)
    assert ids(D.deduplicate(df, t)) == greedy(texts, t)


def test_leader_rounds_give_the_same_rows(rows, monkeypatch):
    """Hot groups of near copies: force leader rounds and compare with brute force."""
    texts = [x for s in range(3) for x in _family(60, s, 90)]
    rng = np.random.default_rng(2)
    texts = [texts[i] for i in rng.permutation(len(texts))]
    df = rows([(i, x, "") for i, x in enumerate(texts)], SCHEMA)
    gone = D.GramSets(D._first_texts(df, "id", "text", None), 0.8)
    left = FW.first_wins(gone.index(), gone.verify, gone.pairs, crowded=1).unionByName(gone.same)
    exact = D.drop_exact(df).join(left.selectExpr("ord AS id"), "id", "left_anti")
    assert ids(exact) == greedy(texts, 0.8)


def test_pairs_against_brute_force(rows):
    texts = list(dict.fromkeys(x.strip() for s in range(4) for x in _family(20, s)))
    df = rows([(i, x, "") for i, x in enumerate(texts)], SCHEMA)
    sets = [frozenset(pack_grams(x).tolist()) for x in texts]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    lead = sorted(first.values())
    want = {(a, b) for a in lead for b in lead if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    assert set(values(D.similar_pairs(df, 0.7), "lo", "hi")) == want


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=80), st.sets(st.integers(0, 400), max_size=25), st.sampled_from([0.5, 0.7, 0.85, 0.92]))
def test_similar_sets_share_enough_keys(a, flips, t):
    b = a ^ flips
    if not b or len(a & b) / len(a | b) < t:
        return
    ends = D.size_classes(t)
    entries = []
    for s in (a, b):
        grams = np.array(sorted(s), dtype=np.int64)
        found = [(D.part_keys(grams, t, ends, up), up) for up in (False, True)]
        entries.append({(int(k), up): need for (keys, need), up in found for k in keys})
    x, y = entries
    shared = [(p, q) for p in x for q in y if p[0] == q[0] and not (p[1] and q[1])]
    assert shared
    assert len(shared) >= max(max(x[p], y[q]) for p, q in shared)


def _spread_texts(n, seed):
    """Texts of a small alphabet: unlike as wholes, but with common pieces, so many of their parts are the same."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    return [" ".join(rng.choice(words, rng.integers(30, 90))) for _ in range(n)]


def test_unlike_rows_leave_no_keys(rows):
    """Texts that only share common parts are ruled out by their bits: no key and no candidate is made of them."""
    texts = _spread_texts(150, 6)
    texts += [texts[0] + "x", texts[1] + "yy"]
    df = rows([(i, x, "") for i, x in enumerate(texts)], SCHEMA)
    sets = D.GramSets(D._first_texts(df, "id", "text", None), 0.85)
    grams = [set(pack_grams(x).tolist()) for x in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.85}
    linked = {r.ord for r in sets.index().select("ord").distinct().collect()}
    assert want >= {(0, 150), (1, 151)} and {x for p in want for x in p} <= linked and len(linked) < 30
    assert set(values(sets.pairs(), "lo", "hi")) == want


@pytest.mark.parametrize("kind, t", [("long", 0.85), ("string", 0.5)])
def test_cells_blocks_and_tasks(rows, monkeypatch, kind, t):
    """Cells of a few rows, passed by in several tasks, and sets in many blocks give each pair once."""
    for name, value in (("BLOCK", 10), ("STREAM", 25), ("SETS", 7), ("SLICE", 4)):
        monkeypatch.setattr(D, name, value)
    texts = list(dict.fromkeys(x.strip() for s in range(3) for x in _family(30, s)))
    name = (lambda i: f"r{i:04d}") if kind == "string" else int
    df = rows([(name(i), x, "") for i, x in enumerate(texts)], f"id {kind}, text string, label string")
    sets = [frozenset(pack_grams(x).tolist()) for x in texts]
    lead = sorted({s: i for i, s in reversed(list(enumerate(sets)))}.values())
    want = sorted((name(a), name(b)) for a in lead for b in lead if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t)
    assert sorted(values(D.similar_pairs(df, t), "lo", "hi")) == want
    assert ids(D.deduplicate(df, t)) == [name(i) for i in greedy(texts, t)]


def test_chain_keeps_the_third(rows):
    edges = rows([(1, 2), (2, 3)], "lo long, hi long")
    assert sorted(values(FW.resolve_edges(edges), "ord", "by")) == [(2, 1)]


def test_long_chain(rows):
    edges = rows([(i, i + 1) for i in range(6)], "lo long, hi long")
    assert sorted(r[0] for r in values(FW.resolve_edges(edges), "ord")) == [1, 3, 5]


def test_semantic_fixture(rows):
    df = rows([(1, [0.9, 0.1, 0.0]), (2, [0.89, 0.11, 0.01]), (3, [-0.9, 0.1, 0.0]), (4, [0.0, 0.0, 0.0]), (5, [0.0, 0.0, 0.0])], "id long, embedding array<double>")
    assert ids(S.semantic_deduplicate(df, 0.99)) == [1, 3, 4, 5]


def planted(n, seed, groups=12, scale=0.35, dims=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, dims))
    return np.array([base[rng.integers(groups)] + rng.normal(scale=scale, size=dims) for _ in range(n)])


def similarities(vectors):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return unit @ unit.T


@pytest.mark.parametrize("leaf, fan, block", [(1000, 256, 2000), (20, 256, 16), (10, 4, 16)])
def test_semantic_against_brute_force(rows, monkeypatch, leaf, fan, block):
    """One cell, one level and several levels of the tree give the pairs and rows of the plain search."""
    vectors = planted(180, 3)
    vectors[50] = vectors[10]
    vectors[60] = 2 * vectors[11]
    df = rows([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    scores = similarities(vectors)
    kept = []
    for i in range(len(vectors)):
        if not kept or scores[i, kept].max() < 0.92:
            kept.append(i)
    for name, value in (("LEAF", leaf), ("FAN", fan), ("BLOCK", block), ("STREAM", 70)):
        monkeypatch.setattr(S, name, value)
    assert ids(S.semantic_deduplicate(df, 0.92)) == kept
    first = [i for i in range(180) if i != 50]
    for t in (0.92, 0.3, -0.2) if leaf == 10 else (0.92,):
        want = {(a, b) for a in first for b in first if a < b and scores[a, b] >= t}
        found = values(S.cosine_pairs(df, t), "lo", "hi")
        assert len(found) == len(set(found)) and set(found) == want


def test_cells_of_near_copies(rows, monkeypatch):
    """Planted near copies: a vector is in a small share of the cells, whose number grows with the table."""
    monkeypatch.setattr(S, "LEAF", 20)
    cells = {}
    for n in (500, 2000):
        vectors = planted(n, 5, groups=n // 25, scale=0.02, dims=64)
        df = rows([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")
        tree = S.Cells(S.distinct_units(df)[0], 0.92)
        report = tree.visits(tree.placed()).first()
        assert report.vectors == n and report.cells_per_vector < 0.1 * report.cells
        cells[n] = report.cells
    assert cells[2000] > 3 * cells[500]


def test_spread_vectors_stay_in_one_cell(rows, monkeypatch):
    """Vectors spread evenly: no split spares comparisons, so none is made, and pairs and rows are those of the plain search."""
    vectors = np.random.default_rng(4).normal(size=(400, 24))
    df = rows([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    for name, value in (("LEAF", 10), ("BLOCK", 50), ("STREAM", 90), ("EARLY", 60), ("TABLE", 300)):
        monkeypatch.setattr(S, name, value)
    tree = S.Cells(S.distinct_units(df)[0], 0.35)
    placed = tree.placed()
    assert placed.count() == 400 and tree.whole
    scores = similarities(vectors)
    found = values(S.cosine_pairs(df, 0.35), "lo", "hi")
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a in range(400) for b in range(a + 1, 400) if scores[a, b] >= 0.35}
    kept, by = [], {}
    for i in range(400):
        near = [j for j in kept if scores[i, j] >= 0.35]
        if near:
            by[i] = near
        else:
            kept.append(i)
    assert ids(S.semantic_deduplicate(df, 0.35)) == kept
    gone = dict(values(S.semantic_duplicates(df, 0.35), "ord", "by"))
    assert set(gone) == set(by) and all(b in by[i] for i, b in gone.items())


def test_order_of_equal_and_missing_ids(rows, monkeypatch):
    """Vectors of one id are not compared with each other, and a row without an id drops none."""
    df = rows([(1, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0]), (None, [0.1, 0.9]), (3, [0.1, 1.0])], "id long, embedding array<double>")
    for limit in (1, 100):
        monkeypatch.setattr(S, "EARLY", limit)
        assert sorted(values(S.semantic_duplicates(df, 0.9), "ord", "by")) == [(3, 2)]
        assert sorted(values(S.semantic_duplicates(df.where("id > 1 OR id IS NULL"), 0.9), "ord", "by")) == [(3, 2)]


def test_sign_index_finds_nearly_all(rows):
    vectors = planted(600, 8, groups=60, scale=0.3, dims=16)
    df = rows([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    scores = similarities(vectors)
    want = {(a, b) for a in range(600) for b in range(a + 1, 600) if scores[a, b] >= 0.92}
    found = set(values(S.cosine_pairs(df, 0.92, approximate=True), "lo", "hi"))
    assert found <= want and len(found) >= 0.97 * len(want) and len(want) > 100
    kept = ids(S.semantic_deduplicate(df, 0.92, approximate=True))
    assert len(kept) <= 1.05 * len(ids(S.semantic_deduplicate(df, 0.92)))


# --- resolver ------------------------------------------------------------------------------------


def first_wins_of(edges):
    by = {}
    for lo, hi in sorted(edges, key=lambda e: (e[1], e[0])):
        if lo not in by and hi not in by:
            by[hi] = lo
    return by


def test_chain_of_ten_thousand_links_is_one_task(rows, monkeypatch):
    calls = []
    monkeypatch.setattr(FW, "cut_lineage", lambda df: calls.append(1) or df.checkpoint())
    edges = rows([(i, i + 1) for i in range(10_000)], "lo long, hi long")
    assert sorted(r[0] for r in values(FW.resolve_edges(edges), "ord")) == list(range(1, 10_001, 2))
    assert len(calls) < 5


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_larger_than_a_task(rows, monkeypatch, kind):
    """A long chain, a clique, a hub and small groups, with parts of 60 pairs."""
    monkeypatch.setattr(FW, "TASK_PAIRS", 60)
    monkeypatch.setattr(FW, "SAMPLE", 50)
    rng = np.random.default_rng(4)
    edges = {(i, i + 1) for i in range(150)} | {(a, b) for a in range(400, 420) for b in range(a + 1, 420)} | {(500, i) for i in range(501, 580)}
    for _ in range(200):
        a, b = sorted(rng.integers(700, 900, 2).tolist())
        edges |= {(a, b)} if a < b else set()
    name = (lambda x: f"r{x:04d}") if kind == "string" else int
    df = rows([(name(a), name(b)) for a, b in edges], f"lo {kind}, hi {kind}")
    got = {r.ord: r.by for r in FW.resolve_edges(df).collect()}
    want = first_wins_of(edges)
    assert got.keys() == {name(x) for x in want}
    assert all(by not in got and by < row for row, by in got.items())


def test_components(rows):
    edges = [(i, i + 1) for i in range(200)] + [(300, 400), (350, 400), (401, 500)]
    got = dict(values(FW.components(rows(edges, "lo long, hi long")), "node", "component"))
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 350: 300, 400: 300, 401: 401, 500: 401}


def test_rows_of_one_size_are_copied_once_while_they_fit_a_task(spark):
    """What is shuffled for the comparison grows with the copies of a row."""
    sets = object.__new__(D.GramSets)
    sets.threshold = 0.85
    rows, tasks = sets._passing(spark.range(40_000).selectExpr("id AS ord", "100 AS n", "array(0L) AS bits"))
    assert tasks == 1 and {r["home"]: r["count"] for r in rows.groupBy("home").count().collect()} == {True: 40_000, False: 40_000}

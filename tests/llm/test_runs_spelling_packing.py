"""Periodic runs, spelling variants and packing on odd tables and against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from datamill.llm import packing, periodic, spelling
from datamill.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
LONG = "one two three four five six seven " * 4000
#: Nulls everywhere, an empty and a very long text, equal rows, and columns with names the operators use inside.
ODD = [
    (1, "a b c d e f g", "x", 1, "s"), (1, "a b c d e f g", "x", 1, "s"), (2, "", "x", None, None), (3, None, None, 3, "t"),
    (None, "a b a b a b a b a b a b", None, 4, "u"), (None, None, None, None, None), (4, LONG, "y", 5, "v"), (6, " \n\t ", "x", 7, "z"),
]
SCHEMA = "doc_id long, text string, runs string, seat long, word string"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- runs ----------------------------------------------------------------------------------------


def brute_runs(words, at_least=12):
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            part = words[i:j + q]
            if len(part) >= max(at_least, 2 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, text):
    words, h = words_of(text), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@pytest.mark.parametrize("tree_words", [8, 1 << 14])
@pytest.mark.parametrize("at_least", [2, 5, 12])
def test_runs_of_random_words(monkeypatch, tree_words, at_least):
    monkeypatch.setattr(periodic, "TREE_WORDS", tree_words)
    rng = random.Random(tree_words + at_least)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 4)):
            n, letters = rng.choice([0, 1, 12, 30, 70]), rng.choice([1, 2, 3, 9])
            words = [rng.randrange(letters) for _ in range(n)]
            if n and rng.random() < 0.5:
                a, p = rng.randrange(n), rng.randint(1, 9)
                words = [words[i] if i < a else words[min(a + (i - a) % p, n - 1)] for i in range(n)]
            docs.append(words)
        sizes = [len(d) for d in docs]
        got = periodic.find_runs(np.array(sum(docs, []), np.int64), np.repeat(np.arange(len(docs)), sizes), at_least)
        heads = np.cumsum([0, *sizes])
        want = [(int(head) + s, n, p) for head, d in zip(heads, docs) for s, n, p in brute_runs(d, at_least)]
        assert sorted(map(tuple, got.tolist())) == sorted(want)


def test_lowest_common_ancestors():
    rng = random.Random(5)
    text = [rng.randrange(3) + 1 for _ in range(200)] + [0]
    tree = periodic.SuffixTree(np.array(text), 4, 1)
    tree.tour()
    suffixes = sorted(range(201), key=lambda i: text[i:])
    assert [int(tree.rank[i]) for i in suffixes] == list(range(201))
    a, b = np.array([(i, j) for i in range(0, 201, 3) for j in range(201) if i != j]).T
    want = [next(k for k in range(202) if i + k >= 201 or j + k >= 201 or text[i + k] != text[j + k]) for i, j in zip(a, b)]
    assert tree.common(a, b).tolist() == want


def test_run_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, FOLDER).collect()}
    assert got.keys() == texts.keys()
    found = 0
    for doc_id, text in texts.items():
        words = planted(doc_id, text)
        numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
        if len(words) > 3000:  # the plain search grows with the square
            continue
        runs = brute_runs([numbers[w] for w in words])
        found += len(runs)
        r = got[doc_id]
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert found > 10


def test_runs_of_odd_tables(spark, odd, none):
    got = sorted((tuple(r) for r in periodic.repeated_words(odd).collect()), key=repr)
    by = defaultdict(list)
    for key, n, runs, collapsed in got:
        by[key].append((n, [tuple(r) for r in runs], collapsed))
    assert by[1] == [(7, [], "a b c d e f g")] * 2
    assert by[2] == by[3] == by[6] == [(0, [], "")]
    assert by[4] == [(28000, [(0, 28000, 7)], "one two three four five six seven")]
    assert sorted(by[None]) == [(0, [], ""), (12, [(0, 12, 2)], "a b")]
    assert periodic.run_digests(periodic.repeated_words(periodic.repeat_tails(none))).collect() == []
    digests = periodic.run_digests(periodic.repeated_words(periodic.repeat_tails(odd))).collect()
    assert len(digests) == len(ODD) and all(r.collapsed_sha256 for r in digests)


def test_white_space_is_ascii(spark):
    df = spark.createDataFrame([(1, "a b c\x1cd\x85 e\x0b\x0cf")], "doc_id long, text string")
    assert periodic.repeated_words(df).first().n_words == 3


# --- spelling ------------------------------------------------------------------------------------


def brute_words(rows):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            total[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def brute_near(words):
    """Words that share a pattern with one place wild, or from which one letter less gives the other."""
    near, wild = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            wild[w[:i], w[i + 1:]].add(w)
            if w[:i] + w[i + 1:] in words:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for group in wild.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute_variants(words, ratio=5):
    near, form = brute_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= ratio * n:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def by_word(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = by_word(QUERIES["op12_spelling_variants"](spark, FOLDER))
    assert got == brute_variants(brute_words(rows)) and any(r[0] for r in got.values())


@pytest.mark.parametrize("block_rows, cells", [(2, 3), (7, 1 << 22), (2048, 1 << 22)])
def test_near_words_in_small_blocks(spark, monkeypatch, block_rows, cells):
    """Blocks cut small, with many words of one profile, give the same pairs."""
    monkeypatch.setattr(spelling, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(spelling, "CELLS", cells)
    rng = random.Random(3)
    words = {"".join(rng.choice("aàiy") for _ in range(rng.choice([6, 6, 7]))): rng.choice([5, 30, 200, 5000]) for _ in range(250)}
    words |= {"x" * 3000: 9, "x" * 2999: 99, "x" * 1500 + "y" + "x" * 1499: 999}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    near = defaultdict(set)
    for r in spelling.near_words(df).collect():
        assert r.near not in near[r.word] and (r.n, r.near_n) == (words[r.word], words[r.near])
        near[r.word].add(r.near)
    assert {w: x for w, x in near.items() if x} == {w: x for w, x in brute_near(words).items() if x}
    assert by_word(spelling.variants(df)) == brute_variants(words)


def test_long_chains_of_forms(spark):
    words = {("a" * i + "b" * (30 - i)): 5 ** (i + 1) for i in range(22)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert by_word(spelling.variants(df)) == brute_variants(words)
    assert {r[1] for r in by_word(spelling.variants(df)).values()} == {"a" * 21 + "b" * 9}


def test_one_edit():
    assert spelling.one_edit("abcdef", "abxdef") and spelling.one_edit("abcdef", "abcdefg") and spelling.one_edit("bcdef", "abcdef")
    assert not spelling.one_edit("abcdef", "abcdef") and not spelling.one_edit("abcdef", "badcef") and not spelling.one_edit("abc", "abcde")


def test_words_of_odd_tables(spark, odd, none):
    assert spelling.variants(spelling.misspelled_words(none)).collect() == []
    assert spelling.variants(spelling.misspelled_words(odd)).collect() == []
    text = "Wörter Wörter ÉCOLES ÉCOLES hello_worldly x1abcdef×÷gh " * 3
    rows = [(None, text), (None, text), (7, text), (8, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: r.n for r in spelling.misspelled_words(df).collect()}
    assert got == brute_words(rows) and got["wörter"] == 18


# --- packing -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check_packing(rows, texts, tokenizer, capacity=packing.CAPACITY):
    """All pieces are there, hold the tokenizer's ids, and lie gapless in sequences of the capacity at most."""
    want = Counter()
    for key, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), capacity):
            part = ids[k:k + capacity]
            want[key, k // capacity, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r[0], r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist()
        assert sum(n for _, n in parts) <= capacity
    return len(sequences)


def test_packing_query(spark, tokenizer):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    df = QUERIES["op13_best_fit_packing"](spark, FOLDER)
    made = check_packing(df.collect(), texts, tokenizer)
    assert packing.certificate(df) == (made, made)


@pytest.mark.parametrize("group_rows", [3, 20, 1000])
def test_packing_in_rounds(spark, tokenizer, group_rows):
    rng = random.Random(group_rows)
    texts = [(i if i % 7 else None, "word " * rng.choice([0, 3, 9, 20, 21, 40, 61, 150])) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    df = packing.pack(packing.token_pieces(docs, PATH, capacity=64), capacity=64, group_rows=group_rows)
    made = check_packing(df.collect(), texts, tokenizer, 64)
    n, bound = packing.certificate(df, 64)
    assert made == n and bound <= n <= bound * 1.1 + 1


def test_packing_odd_tables(spark, odd, none, tokenizer):
    assert packing.pack(packing.token_pieces(none, PATH)).collect() == []
    check_packing(packing.pack(packing.token_pieces(odd, PATH)).collect(), [(r[0], r[1]) for r in ODD], tokenizer)
    ids = packing.token_pieces(odd, PATH, with_ids=True).where("doc_id = 1").first().ids
    assert ids == [*tokenizer.encode("a b c d e f g", add_special_tokens=False).ids, 1]


def test_word_ids_are_the_tokenizers(tokenizer, monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    parts = list("ab'sSİΣσßK \t\n\x0b\x0c\x1c\x85\xa0é1２,.<|>") + [
        "é", "̈", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'ll", "'s", " (the", "of,", "of.\"", "word;)", "THE!", "é.", "x't,", "中", "😀", "Å"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", None]
    monkeypatch.setattr(packing, "MEMORY", 500)
    words = packing.WordIds(PATH, 1)
    for low in range(0, len(texts), 700):
        part = texts[low:low + 700]
        ids, bounds = words.encode(pa.array(part, pa.string()))
        for i, text in enumerate(part):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def fewest(lengths, capacity):
    """The least number of sequences, by trying all ways."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= lengths[k] and room not in rooms[:i]:
                place(k + 1, rooms[:i] + [room - lengths[k]] + rooms[i + 1:])
        place(k + 1, rooms + [capacity - lengths[k]])

    place(0, [])
    return best


def test_bounds_are_never_above_the_least(spark):
    rng = random.Random(9)
    for _ in range(300):
        capacity = rng.choice([10, 24, 60])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        made = int(packing.best_fit(np.array(lengths), capacity).max()) + 1
        least = fewest(lengths, capacity)
        assert packing.bound_of(np.bincount(lengths, minlength=capacity + 1), capacity) <= least <= made

"""Toxicity by a learned lexicon, matched with misspellings and weighed by context.

The lexicon is learned from a bounded sample of labelled texts, one of each group of near copies: words whose
share among toxic texts is many times that among the others. Its trie is intersected with a Levenshtein
automaton (swapped neighbours are one edit). Subsets of the states are built on demand, which gives a
deterministic automaton that reads most words no further than a few letters. Terms whose neighbourhood is full
of ordinary words, as the clean texts of the sample show, are matched exactly. Stems of which one word says little
but several mark a text as toxic stand in the trie as well and match every word they begin.

Each match is weighed by a window of words around it: standing between an opening and a closing mark of one kind and
words of reporting speak for a quotation, further matches and direct address for abuse. A logistic model on the sums of the
windows' weights, fitted on the same sample, gives the score of the whole text.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from datamill.llm import near_dup
from datamill.llm.common import packed, text_of, training_sample, unpacked, written

SAMPLE = 5000  # labelled texts of each class that are learned from
STEMS = range(3, 9)  # lengths of stems
SUPPORT = 0.02  # share of the toxic texts that must hold a term
LIFT = 20  # times that a term's share among toxic texts exceeds that among the others
WINDOW = 8  # words on each side of a match
MEMORY = 300_000  # words, and steps of the automaton, that a worker remembers
#: A mark between two letters is an apostrophe and part of no quotation.
TOKEN = re.compile(r"\w+|[\"“”„«»]|(?<!\w)[‘’‚']|[‘’'](?!\w)")
#: Opening marks with the marks that close them.
CLOSING = {'"': '"', "'": "'", "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‚": "‘’", "”": "”", "’": "’"}
#: Words of reporting and of direct address in the four languages of the tables.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes term word slur reported reads "
                      "sagte sagt schrieb nannte zitat wort dit disait écrit appelé citation mot "
                      "dijo dice escribió llamó cita palabra".split())
ADDRESS = frozenset("you your youre yourself du dich dein euch tu toi vous votre te usted tú vosotros".split())
FEATURES = ("abuse", "quoted", "misspelt", "misspelt_quoted", "density", "stems")
#: Expected weights before any row is seen; they stay where the sample says nothing.
PRIOR = np.array([-3.0, 5.0, 1.0, 2.5, 0.5, 0.5, 3.0])


def edits(term: str) -> int:
    """Misspellings allowed in a term: none below five letters, two from ten."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


@dataclass
class Trie:
    """Nodes as numbers: children by letter, the term that ends at a node, most edits allowed below it."""

    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    term: list[str | None] = field(default_factory=lambda: [None])
    most: list[int] = field(default_factory=lambda: [0])

    def add(self, word: str, allowed: int) -> None:
        node = 0
        self.most[0] = max(self.most[0], allowed)
        for c in word:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.term.append(None)
                self.most.append(0)
            node = self.children[node][c]
            self.most[node] = max(self.most[node], allowed)
        self.term[node] = word


class Matcher(dict):
    """word -> (term, edits) or None, for all words within the allowed edits of a term; edits are -1 for a stem.

    A state of the automaton is a set of (trie node, edits so far, letter owed by a swap).
    """

    def __init__(self, terms: list[str], strict: set[str] = frozenset(), ordinary: set[str] = frozenset(), stems: list[str] = ()):
        super().__init__()
        self.trie, self.ordinary, self.stems = Trie(), ordinary, frozenset(stems)
        self.allowed = {t: 0 if t in strict else edits(t) for t in terms}
        for t in terms:
            self.trie.add(t, self.allowed[t])
        for t in self.stems.difference(terms):
            self.trie.add(t, 0)
        self._begin()

    def _state(self, items: set) -> int:
        """Close under letters left out of the word, and number the set."""
        todo = list(items)
        while todo:
            node, e, owed = todo.pop()
            if not owed:
                for child in self.trie.children[node].values():
                    if e < self.trie.most[child] and (new := (child, e + 1, "")) not in items:
                        items.add(new)
                        todo.append(new)
        key = frozenset(items)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            whole = [self.trie.term[n] for n, e, owed in key if not e and not owed and self.trie.term[n] in self.stems]
            if whole:
                self.begun[self.number[key]] = whole[0]
        return self.number[key]

    def _begin(self) -> None:
        """Forget all steps and states."""
        self.steps: dict[tuple[int, str], int] = {}
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.begun: dict[int, str] = {}
        self.first = self._state({(0, 0, "")})

    def _step(self, state: int, c: str) -> int:
        children, most, out = self.trie.children, self.trie.most, set()
        for node, e, owed in self.states[state]:
            if owed:
                if owed == c:
                    out.add((node, e, ""))
                continue
            if c in children[node]:
                out.add((children[node][c], e, ""))
            if e < most[node]:
                out.add((node, e + 1, ""))
                for other, child in children[node].items():
                    if other != c and e < most[child]:
                        out.add((child, e + 1, ""))
                        if c in children[child]:
                            out.add((children[child][c], e + 1, other))
        found = self.steps[state, c] = self._state(out) if out else -1
        return found

    def __missing__(self, word: str) -> tuple[str, int] | None:
        if len(self.steps) >= MEMORY:
            self._begin()
        state, steps, found = self.first, self.steps, None
        for c in word:
            state = steps[state, c] if (state, c) in steps else self._step(state, c)
            if state < 0:
                break
            if state in self.begun:
                found = self.begun[state], -1
        if state >= 0:
            ends = [(e, self.trie.term[n]) for n, e, owed in self.states[state] if not owed and e <= self.allowed.get(self.trie.term[n], -1)]
            if ends:
                e, term = min(ends)
                if not e or not (found or word in self.ordinary):
                    found = term, e
        if len(self) >= MEMORY:
            self.clear()
        self[word] = found
        return found


@dataclass(frozen=True)
class Model:
    """Terms, those matched exactly, words near terms that are ordinary, stems, and the logistic weights (first the constant)."""

    terms: tuple[str, ...]
    strict: tuple[str, ...]
    ordinary: tuple[str, ...]
    stems: tuple[str, ...]
    weights: tuple[float, ...]

    def matcher(self) -> Matcher:
        return Matcher(list(self.terms), set(self.strict), set(self.ordinary), list(self.stems))


def quoted(tokens: list[str], i: int) -> bool:
    """Whether token ``i`` stands between an opening and a closing mark of one kind, each within WINDOW tokens.

    Of the marks before it, those that close each other go first; the last one left open counts.
    """
    still: list[str] = []
    for t in tokens[max(0, i - WINDOW):i]:
        if still and t in CLOSING.get(still[-1], ""):
            still.pop()
        elif t in CLOSING:
            still.append(t)
    return bool(still) and any(t in CLOSING[still[-1]] for t in tokens[i + 1:i + 1 + WINDOW])


def matches(text: str, matcher: Matcher) -> list[dict]:
    """The matches of a text with their window's evidence: term, edits, word, quoted (0 to 1), others, addressed."""
    tokens = TOKEN.findall(text.lower())
    at = [i for i, m in enumerate(map(matcher.__getitem__, tokens)) if m is not None]
    out = []
    for i in at:
        before, after = tokens[max(0, i - WINDOW):i], tokens[i + 1:i + 1 + WINDOW]
        marks = quoted(tokens, i)
        reported = not REPORTING.isdisjoint(before) or not REPORTING.isdisjoint(after)
        near = before + after
        term, e = matcher[tokens[i]]
        out.append({
            "word": tokens[i], "term": term, "edits": e, "quoted": 0.8 * marks + 0.2 * (marks and reported),
            "others": sum([matcher[t] is not None for t in near]), "addressed": not ADDRESS.isdisjoint(near),
        })
    return out


def evidence(text: str, matcher: Matcher) -> np.ndarray:
    """The text's features: windows' weights of abuse and quotation, for exact and misspelt terms, and their density."""
    x = np.zeros(len(FEATURES))
    found = matches(text, matcher)
    begun = 0.0
    for m in found:
        if m["edits"] < 0:
            begun += 1 - m["quoted"]
            continue
        own = 2 * (m["edits"] > 0)
        weight = 1.0 + 0.5 * (m["others"] > 0) + 0.5 * m["addressed"]
        x[own] += (1 - m["quoted"]) * weight
        x[own + 1] += m["quoted"]
    x[-2] = 0.5 * sum(m["others"] > 0 for m in found if m["edits"] >= 0)
    # One word of a stem says nothing, and long texts hold some by chance.
    x[-1] = max(0.0, begun / (1 + len(text.split()) / 1000) - 1) if begun else 0.0
    # Every match counts, the later ones of a long text less and less.
    return 3.0 * -np.expm1(-x / 3.0)


def fit(x: np.ndarray, y: np.ndarray, spread: float = 2.0, steps: int = 50) -> np.ndarray:
    """Logistic weights around PRIOR by Newton steps; classes count alike, a feature that never occurs keeps its prior."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = PRIOR.copy()
    if not len(x):
        return w
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * min(len(y), 400)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (share * (p - y)) + (w - PRIOR) / spread**2
        bend = (a * (share * p * (1 - p))[:, None]).T @ a + np.eye(len(w)) / spread**2
        step = np.linalg.solve(bend, slope)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    # More abuse never lowers a score.
    return np.concatenate([w[:1], np.maximum(w[1:], 0.0)])


def without_near_copies(sample: DataFrame) -> DataFrame:
    """The sample's texts that hold the smallest digest of each of their three min-hashes of word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for t in batch.column(0):
                items = near_dup.shingles(t.as_py())[0]
                keys.append([int(near_dup.mixed(items ^ np.uint64(seed)).min()) >> 1 for seed in (1, 2, 3)] if len(items) else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], ["text", "label", "doc", "keys"])

    rows = sample.distinct().withColumn("doc", F.md5("text")).mapInArrow(run, "text string, label int, doc string, keys array<long>")
    rows = written(rows, "sketched")
    firsts = rows.select("doc", F.posexplode("keys").alias("i", "key")).groupBy("i", "key").agg(F.min("doc").alias("doc"))
    kept = firsts.groupBy("doc").count().where("count = 3").select("doc")
    return written(rows.join(kept, "doc", "left_semi").select("text", "label", "doc"), "distinct")


def choose_terms(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Terms and stems. At least SUPPORT of the toxic texts hold them, LIFT times their share among the others.

    All that do are kept. Their shares add up to no more than the distinct words of a toxic text on average, so there are at
    most that number over SUPPORT, whatever the sample; the driver gets no more (of stems, as many for each length).
    A stem must begin two words of a text to count, and beginning one must not be enough; of stems that begin each other
    the best stays. Words of such a stem are no terms.
    """
    rows = without_near_copies(sample)
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return [], []
    least = max(3, math.ceil(SUPPORT * toxic))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
    held = rows.select("doc", "label", F.explode(words).alias("word")).where(F.length("word") >= 3)
    held = written(held.groupBy("doc", "label", "word").agg(F.count("*").alias("times")), "held")

    def counted(grouped: DataFrame, name: str, twice: bool = False) -> DataFrame:
        counts = grouped.groupBy(name).agg(F.sum("label").alias("t"), F.count("*").alias("n"), F.sum(F.when(F.col("times") > 1, F.col("label"))).alias("t2"), F.count(F.when(F.col("times") > 1, 1)).alias("n2"))
        lift = lambda t, n: F.coalesce(F.col(t), F.lit(0)) / toxic - LIFT * (F.col(n) - F.coalesce(F.col(t), F.lit(0)) + 0.5) / max(1, clean)
        counts = counts.withColumn("once", lift("t", "n")).withColumn("twice", lift("t2", "n2"))
        if twice:
            return counts.where((F.col("t2") >= least) & (F.col("twice") > 0) & (F.col("once") <= 0)).orderBy(F.desc("twice"), F.desc(F.length(name)), name)
        return counts.where((F.col("t") >= least) & (F.col("once") > 0)).orderBy(F.desc("once"), name)

    begins = F.explode(F.array(*[F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in STEMS]))
    begun = held.select("doc", "label", "times", begins.alias("stem")).where("stem IS NOT NULL")
    begun = begun.groupBy("doc", "label", "stem").agg(F.count("*").alias("times"))
    stems: list[str] = []
    for r in counted(begun, "stem", twice=True).collect():
        if not any(r["stem"].startswith(s) or s.startswith(r["stem"]) for s in stems):
            stems.append(r["stem"])
    terms = [r["word"] for r in counted(held, "word").collect()]
    return [t for t in terms if not t.startswith(tuple(stems))], stems


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE) -> Model:
    """A model of at most ``rows`` labelled texts of each class; held-out ids are never read.

    The driver gets the candidate words, the ordinary words near them and the features of each sampled text. Without labels the lexicon is empty.
    """
    sample = written(training_sample(docs, labels, label, rows), "sample")
    terms, stems = choose_terms(sample)
    plain = Matcher(terms, stems=stems)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(m["term"], m["word"], y) for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in matches(text, plain) if m["edits"] > 0]
            columns = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.int32()))], ["term", "word", "label"])

    seen = sample.mapInArrow(near, "term string, word string, label int")
    seen = written(seen.groupBy("term", "word").agg(F.sum("label").alias("t"), F.count("*").alias("n")), "misspelt")
    by_term = seen.groupBy("term").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    strict = {r["term"] for r in by_term.where("(n - t) * 5 > n").collect()}
    # Words near the other terms that stand in clean texts at least as often as in toxic ones are words of their own.
    plainly = seen.where((F.col("t") * 2 <= F.col("n")) & ~F.col("term").isin(list(strict)))
    ordinary = [r["word"] for r in plainly.select("word").distinct().collect()]
    matcher = Matcher(terms, strict, set(ordinary), stems)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [evidence(t, matcher).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    found = sample.mapInArrow(features, "x array<double>, label int").toPandas()
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    return Model(tuple(terms), tuple(sorted(strict)), tuple(sorted(ordinary)), tuple(stems), tuple(map(float, fit(x, found["label"].to_numpy()))))


_MATCHERS: dict[str, Matcher] = {}


def _kept_matcher(model: Model) -> Matcher:
    """The worker's matcher of this model; it stays between the tasks of a worker."""
    name = json.dumps([model.terms, model.strict, model.ordinary, model.stems])
    if name not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[name] = model.matcher()
    return _MATCHERS[name]


def probability(text: str | None, model: Model, matcher: Matcher) -> float:
    """Score of a text. A null or empty text, or one without matches, has the model's constant alone."""
    z = model.weights[0] + float(np.dot(model.weights[1:], evidence(text, matcher))) if text else model.weights[0]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns plus the double ``out`` (in place of a column of this name): how likely the whole text is toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _kept_matcher(model)
        for batch in batches:
            values = [probability(t.as_py(), model, matcher) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["row", "score"])

    rows = packed(docs, text=text_of(docs[text]))
    scored = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
    return unpacked(scored, docs.columns, **{out: F.col("score")})


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores below ``threshold``, with their own columns."""
    place = docs.columns.index(docs.select(docs[text]).columns[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _kept_matcher(model)
        for batch in batches:
            clean = [probability(t.as_py(), model, matcher) < threshold for t in batch.column(0).field(place)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(clean, pa.bool_()))], ["row"])

    # The texts travel once, as part of their rows, and only those of clean rows come back.
    rows = packed(docs)
    return unpacked(rows.mapInArrow(run, rows.schema), docs.columns)

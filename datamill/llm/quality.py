"""Quality classifier with supervised subword embeddings.

A text is the mean of the learned vectors of its words, their character n-grams and its word pairs, all hashed
into one table of buckets; a softmax over the classes reads that mean. The table is trained by stochastic
gradient descent in numpy: every epoch the shards of a bounded sample train in parallel from the same weights,
which are then averaged.

For scoring, table and softmax are multiplied out to one number a bucket. Each worker remembers the sum of a
word's own buckets, so a text costs one look-up a word and a few array operations.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from datamill.llm.common import packed, text_of, training_sample, unpacked, written

SAMPLE = 3000  # labelled texts of each class that are learned from
BUCKETS, SIZE = 1 << 16, 8
NGRAMS = (3, 4)
EPOCHS, RATE, SHARDS = 5, 0.5, 6
MEMORY = 300_000  # words that a worker remembers
PAIR = np.uint64(0x9E3779B97F4A7C15)
SAME = 0  # bucket of all pairs of equal words


def word_buckets(word: bytes, buckets: int = BUCKETS) -> list[int]:
    """Buckets of a word and of its character n-grams; the word's ends count as characters."""
    framed = b"<" + word + b">"
    found = [zlib.crc32(word) % buckets]
    for n in NGRAMS:
        found.extend([zlib.crc32(framed[i:i + n], n) % buckets for i in range(len(framed) - n + 1)])
    return found


def pair_buckets(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of neighbouring words, from the words' hashes. A word next to itself has a bucket for all words."""
    with np.errstate(over="ignore"):
        mixed = (hashes[:-1] * PAIR) ^ hashes[1:]
        found = ((mixed * PAIR) >> np.uint64(40)).astype(np.int64) % buckets
    return np.where(hashes[:-1] == hashes[1:], SAME, found)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def features(text: str | None, memory: dict[bytes, list[int]], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    words = words_of(text)
    if len(memory) > MEMORY:
        memory.clear()
    found: list[int] = []
    for w in words:
        own = memory.get(w)
        if own is None:
            own = memory[w] = word_buckets(w, buckets)
        found.extend(own)
    hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    return np.unique(np.concatenate([np.array(found, np.int64), pair_buckets(hashes, buckets)]) if words else np.empty(0, np.int64), return_counts=True)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def descend(weights: dict, rows: list[tuple[np.ndarray, np.ndarray, int]], rate: float, order: np.ndarray) -> dict:
    """One pass of stochastic gradient descent over (buckets, counts, label)."""
    table, out, bias = (weights[k].copy() for k in ("table", "out", "bias"))
    for i in order:
        ids, counts, label = rows[i]
        if not len(ids):
            continue
        share = counts / counts.sum()
        mean = share @ table[ids]
        error = _softmax(mean @ out + bias)
        error[label] -= 1.0
        back = out @ error
        out -= rate * np.outer(mean, error)
        bias -= rate * 0.1 * error
        table[ids] -= rate * len(ids) ** 0.5 * np.outer(share, back)
    return {"table": table, "out": out, "bias": bias}


def start(buckets: int = BUCKETS, size: int = SIZE, seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    return {"table": rng.uniform(-1 / size, 1 / size, (buckets, size)), "out": rng.uniform(-0.5, 0.5, (size, 2)), "bias": np.zeros(2)}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE, epochs: int = EPOCHS) -> dict:
    """Weights learned from at most ``rows`` labelled texts of each class; held-out ids are never read.

    The driver averages SHARDS tables of fixed size each epoch. Without labels the first weights stay.
    """
    sample = written(training_sample(docs, labels, label, rows), "quality_sample").repartition(SHARDS)
    context = docs.sparkSession.sparkContext
    weights = start()
    for epoch in range(epochs):
        sent = context.broadcast(pickle.dumps(weights))
        rate = RATE * (1 - epoch / epochs)

        def one_pass(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            memory: dict[bytes, list[int]] = {}
            # At most 2 * rows / SHARDS texts.
            own = [(*features(t, memory), int(y)) for part in parts for t, y in zip(part["text"], part["label"])]
            if own:
                order = np.random.default_rng(epoch).permutation(len(own))
                found = descend(pickle.loads(sent.value), own, rate, order)
                yield pd.DataFrame({"n": [len(own)], "weights": [pickle.dumps({k: v.astype(np.float32) for k, v in found.items()})]})

        parts = [(r["n"], pickle.loads(r["weights"])) for r in sample.mapInPandas(one_pass, "n long, weights binary").collect()]
        sent.destroy()
        if parts:
            total = sum(n for n, _ in parts)
            weights = {k: sum(n * p[k].astype(np.float64) for n, p in parts) / total for k in weights}
    return weights


class Scorer:
    """Scores with one number a bucket; words that were seen stay remembered by number."""

    def __init__(self, weights: dict):
        self.value = weights["table"] @ (weights["out"][:, 1] - weights["out"][:, 0])
        self.bias = float(weights["bias"][1] - weights["bias"][0])
        self.plain = self.value.tolist()
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.sums, self.counts, self.hashes = np.zeros(MEMORY), np.zeros(MEMORY, np.int64), np.zeros(MEMORY, np.uint64)

    def _add(self, words: list[bytes]) -> None:
        """Remember the new words of a text, or of a part of at most MEMORY words."""
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if len(self.number) + len(new) > MEMORY:
            self.clear()
            new = list(dict.fromkeys(words))
        for i, w in enumerate(new, len(self.number)):
            ids = word_buckets(w)
            self.number[w] = i
            self.sums[i] = sum([self.plain[b] for b in ids])
            self.counts[i], self.hashes[i] = len(ids), zlib.crc32(w)

    def __call__(self, text: str | None) -> float:
        """Probability of class 1; a text without words has that of the constant."""
        words = words_of(text)
        total, n = 0.0, 0
        last = np.empty(0, np.uint64)
        for at in range(0, len(words), MEMORY // 2):
            part = words[at:at + MEMORY // 2]
            try:
                ids = np.fromiter(map(self.number.__getitem__, part), np.int64, len(part))
            except KeyError:
                self._add(part)
                ids = np.fromiter(map(self.number.__getitem__, part), np.int64, len(part))
            hashes = np.concatenate([last, self.hashes[ids]])
            pairs = pair_buckets(hashes)
            total += float(self.sums[ids].sum() + self.value[pairs].sum())
            n += int(self.counts[ids].sum()) + len(pairs)
            last = hashes[-1:]
        z = self.bias + (total / n if n else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, weights: dict, text: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns plus the double ``out`` (in place of a column of this name): how likely the whole text is of class 1. Null counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps({k: v.astype(np.float32) for k, v in weights.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(sent.value))
        for batch in batches:
            values = [scorer(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["row", "score"])

    rows = packed(docs, text=text_of(docs[text]))
    scored = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
    return unpacked(scored, docs.columns, **{out: F.col("score")})

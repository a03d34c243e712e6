"""Linear-chain tagger trained by averaged perceptrons with iterative parameter mixing.

Spark shards the sequences and computes and hashes the features of their words, once for each word of some hundred thousand
tokens. In every epoch each shard runs one perceptron pass from the same broadcast weights; Spark averages what the shards return.
Weights change with every wrong sequence. A shard looks ahead at a block of sequences, which grows while they are right: those whose
gold tags are surely the best path need no decoding, the others are decoded one by one. A finished tagger decodes many side by side.
The weights have a fixed size (hash slots x tags), independent of the number of sequences.
Method: McDonald, Hall, Mann, "Distributed Training Strategies for the Structured Perceptron" (2010).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from datamill.functions.hashing import draw, hash_texts
from datamill.operators.active import margin_uncertainty
from datamill.operators.sequences import lower_features
from datamill.session import spread

SLOTS, EPOCHS = 1 << 18, 10
#: Tokens of sequences packed and decoded side by side, and packed to be learned, where the executors' memory also holds two workers for a task.
TOKENS, LEARNED = 1 << 19, 1 << 17
#: Pairs of words hashed at once, and tags up to which plain numbers are faster than arrays.
GATHERED, FEW_TAGS = 1 << 14, 6
#: A word's own features, and most sequences that a shard looks ahead.
OWN, AHEAD = 11, 512
#: Tokens that a better path is followed along, tokens around a doubt that are decoded, and tokens of a sequence from which this is faster.
CARRIED, AROUND, LONG = 32, 8, 400
#: Columns of the stored sequences, and how they are compressed.
STORED, CODEC = ("own", "near", "codes", "pairs", "rows", "gold"), "zstd"


def word_slots(words: str, lower: str, slots: int = SLOTS) -> Column:
    """Per word, given also in lower case, the hashed features of a token that has the word for itself and for all its neighbours.

    These are the features of the word itself, then those of the word as previous one, of the pair, and of the word as next, second
    previous and second next one. An absent word has only some of its own, and what says that there is no previous and no next one.
    """
    def hashed(x: Column) -> Column:
        low = x[lower]
        return F.transform(lower_features(x[words], low, low, low, low, low), lambda f: F.pmod(F.xxhash64(f), F.lit(slots)).cast("int"))

    return F.transform(F.arrays_zip(words, lower), hashed)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``tokens`` and other columns as one row each: the distinct words, with an absent one at the end, and what numbers them."""
    for batch in batches:
        most = TOKENS
        if "gold" in batch.schema.names:
            most = LEARNED
            # Only sequences with tokens, and a tag for each.
            sizes = [batch.column(c).value_lengths().fill_null(0) for c in ("tokens", "gold")]
            batch = batch.filter(pc.and_(pc.equal(*sizes), pc.greater(sizes[0], 0)))
        low, n = 0, batch.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(n, dtype=np.int64)
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, side="right")))
            part = batch.slice(low, high - low)
            tokens = part.column("tokens")
            found = tokens.flatten().dictionary_encode()
            words = pa.concat_arrays([found.dictionary, pa.nulls(1, found.dictionary.type)])
            codes = found.indices.fill_null(len(found.dictionary)).to_numpy(zero_copy_only=False)
            row = {"words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "codes": _blob(codes, np.int32), "sizes": _blob(n[low:high], np.int32)}
            for name in set(batch.schema.names) - {"tokens"}:
                if name == "gold":
                    # A tag without a number is one that is not known.
                    row["gold"] = _blob(part.column("gold").flatten().fill_null(-1).to_numpy(zero_copy_only=False), np.int16)
                else:
                    row[name] = pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), part.column(name))
            if "id" in row:
                row["absent"] = _blob(tokens.is_null().to_numpy(zero_copy_only=False), np.int8)
            yield pa.RecordBatch.from_pydict(row)
            low = high


def _blob(values: np.ndarray, kind: type) -> pa.Array:
    return pa.array([np.ascontiguousarray(values, kind).tobytes()], pa.binary())


def _packed(rows: DataFrame, slots: int) -> DataFrame:
    """The rows of a partition in their order, by :func:`_pack`, and the features of the words: they are made once for a word, not for each token."""
    kinds = dict(rows.dtypes)
    kind = "words array<string>, codes binary, sizes binary" + (", gold binary" if "gold" in kinds else "") + (f", id array<{kinds['id']}>, absent binary" if "id" in kinds else "")
    found = rows.mapInArrow(_pack, kind)
    return found.select("*", F.transform("words", F.lower).alias("lower")).withColumn("feats", word_slots("words", "lower", slots))


@dataclass
class Lists:
    """Sequences as numbers: features of their words, the words and pairs of all tokens, and where each sequence's tokens begin.

    ``own`` and ``near`` have a line for each word: its own features, and those it gives to its neighbours. The feature ``slots`` is none.
    """

    own: np.ndarray
    near: np.ndarray
    codes: np.ndarray
    pairs: np.ndarray
    rows: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch, at: int, slots: int) -> "Lists":
        """The sequences of one packed row."""
        codes, sizes = (np.frombuffer(batch.column(c)[at].as_buffer(), np.int32) for c in ("codes", "sizes"))
        feats, lower = batch.column("feats")[at].values, batch.column("lower")[at].values
        begin, count = feats.offsets.to_numpy().astype(np.int64), feats.value_lengths().to_numpy(zero_copy_only=False)
        flat, none = feats.values.to_numpy(zero_copy_only=False), len(feats) - 1
        own, near = np.full((none + 1, OWN), slots, np.int32), np.full((none + 1, 4), slots, np.int32)
        if none:
            lines = flat[begin[0]:begin[none]].reshape(none, OWN + 5)
            own[:none], near[:none] = lines[:, :OWN], lines[:, [OWN, *range(OWN + 2, OWN + 5)]]
        rest = flat[begin[none]:begin[none] + count[none]]
        own[none, :len(rest) - 2], near[none, :2] = rest[:-2], rest[-2:]
        rows = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        lists = Lists(own, near, codes, np.full(len(codes), slots, np.int32), rows)
        before, now = lists.beside(-1, 0, len(codes)), codes
        some = np.flatnonzero((before != none) & (now != none))
        lower = lower.cast(pa.binary())
        for low in range(0, len(some), GATHERED):
            few = some[low:low + GATHERED]
            joined = pc.binary_join_element_wise(lower.take(pa.array(before[few])), lower.take(pa.array(now[few])), b"|")
            joined = pc.binary_join_element_wise(pa.scalar(b"bigram="), joined, b"")
            lists.pairs[few] = hash_texts(joined) % slots
        return lists

    def beside(self, step: int, begin: int, end: int) -> np.ndarray:
        """The words ``step`` places from tokens that make whole sequences; past the ends of a sequence there is the absent word."""
        out = np.full(end - begin, len(self.own) - 1, self.codes.dtype)
        if step < 0:
            out[-step:] = self.codes[begin:end + step] if end - begin > -step else out[-step:]
        else:
            out[:-step] = self.codes[begin + step:end]
        low, high = np.searchsorted(self.rows, [begin, end])
        inner = self.rows[low:high + 1]
        for k in range(abs(step)):
            # The first or last tokens of every sequence, as far as it has so many.
            at = inner[:-1] + k if step < 0 else inner[1:] - 1 - k
            out[at[np.diff(inner) > k] - begin] = len(self.own) - 1
        return out

    def features(self, begin: int, end: int) -> np.ndarray:
        """The features of tokens that make whole sequences, a line each."""
        now = self.codes[begin:end]
        p1, p2, n1, n2 = (self.beside(step, begin, end) for step in (-1, -2, 1, 2))
        return np.column_stack([self.own[now], self.near[p1, 0], self.pairs[begin:end], self.near[n1, 1], self.near[p2, 2], self.near[n2, 3]])

    def emissions(self, weights: np.ndarray, low: int, high: int, feats: np.ndarray | None = None) -> np.ndarray:
        """Score of every tag at every token of some sequences; ``weights`` ends in a line of zeros."""
        begin, end = self.rows[low], self.rows[high]
        if feats is None and end - begin > 2 * len(self.own):
            # What a word has by itself is added up once.
            first, own = _own_sums(weights, self.own)
            now = self.codes[begin:end]
            first, total = first[now], own[now]
            p1, p2, n1, n2 = (self.beside(step, begin, end) for step in (-1, -2, 1, 2))
            rest = (self.near[p1, 0], self.pairs[begin:end], self.near[n1, 1], self.near[p2, 2], self.near[n2, 3])
        else:
            feats = self.features(begin, end) if feats is None else feats
            first, total = _own_sums(weights, feats)
            rest = feats[:, OWN:].T
        for at in rest:
            total += weights.take(at, axis=0)
        return first + total


def _own_sums(weights: np.ndarray, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of the first feature, and the sum of those of the other own ones, which is always made in this order."""
    a = lambda i: weights.take(feats[:, i], axis=0)
    total = ((a(1) + a(2)) + (a(3) + a(4))) + ((a(5) + a(6)) + (a(7) + a(8)))
    for i in range(9, OWN):
        total += a(i)
    return a(0), total


def doubts(emit: np.ndarray, cuts: np.ndarray, moves: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Tokens at which another path may be as good as ``path``: all of the first sequence with any, some of the others; no step along the tokens is needed.

    A sequence without them has ``path`` as its best one, by more than sums in another order can differ. A better path would
    leave the given one somewhere and come back. What leaving has gained at a token is first taken as if it left there; where it is
    better to have left before, that is carried on, token by token, until nothing changes. Where this takes long there is doubt.
    """
    tags, sizes = emit.shape[1], np.diff(cuts)
    if not len(emit) or tags < 2:
        return np.empty(0, np.int64)
    every, some = np.arange(len(emit)), np.flatnonzero(sizes)
    starts, ends = cuts[some], cuts[some + 1] - 1
    before = np.concatenate([[tags], path[:-1]])
    before[starts] = tags
    steps = moves[before]
    given = steps[every, path][:, None]
    gained = emit - emit[every, path][:, None]
    steps -= given
    left = gained + steps
    left[every, path] = -np.inf
    longest = int(sizes.max())
    slack = 8 * longest * longest * np.finfo(float).eps * (np.abs(emit).max() + np.abs(moves).max() + 1)
    first = np.zeros(len(emit), bool)
    first[starts] = True
    owner, doubtful = np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(sizes), bool)
    at, found = np.flatnonzero(~first), []
    for _ in range(CARRIED):
        was = left[at - 1]
        through = was[:, :1] + moves[0]
        for t in range(1, tags):
            np.maximum(through, was[:, t:t + 1] + moves[t], out=through)
        through -= given[at]
        # Back on the path with a gain.
        back = at[through[np.arange(len(at)), path[at]] >= -slack]
        if len(back):
            found.append(back)
            doubtful[owner[back]] = True
        new = gained[at] + through
        new[np.arange(len(at)), path[at]] = -np.inf
        more = (new > left[at]).any(axis=1)
        changed = at[more]
        left[changed] = np.maximum(left[changed], new[more])
        at = changed[changed + 1 < len(emit)] + 1
        at = at[~first[at]]
        at = at[~doubtful[owner[at]] | (owner[at] == doubtful.argmax())]
        if not len(at):
            break
    return np.unique(np.concatenate([*found, at, ends[(left[ends] >= -slack).any(axis=1)]]))


def _path_near(emit: np.ndarray, moves: np.ndarray, path: np.ndarray, places: np.ndarray) -> np.ndarray | None:
    """The best path of one sequence, if it differs from ``path`` only around some places and leaves no doubt."""
    stretches = np.split(places, np.flatnonzero(np.diff(places) > 2 * AROUND) + 1)
    if len(places) * 8 > len(emit):
        return None
    out = path.copy()
    for some in stretches:
        low, high = max(0, some[0] - AROUND), min(len(emit), some[-1] + AROUND + 1)
        part = emit[low:high].copy()
        start = moves[out[low - 1]] if low else moves[-1]
        if high < len(emit):
            part[-1] += moves[:-1, out[high]]
        out[low:high] = best_path(part, np.concatenate([moves[:-1], start[None]]))[0]
    return None if len(doubts(emit, np.array([0, len(emit)]), moves, out)) else out


def best_path(emit: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tag path and the final scores; the last row of ``moves`` starts a sequence."""
    if emit.shape[1] <= FEW_TAGS:
        return _best_path_of_few(emit, moves)
    score = emit[0] + moves[-1]
    back = np.zeros(emit.shape, dtype=np.int64)
    for i in range(1, len(emit)):
        ways = score[:, None] + moves[:-1]
        back[i] = ways.argmax(axis=0)
        score = ways.max(axis=0) + emit[i]
    path = np.empty(len(emit), dtype=np.int64)
    path[-1] = score.argmax()
    for i in range(len(emit) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path, score


def _best_path_of_few(emit: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same sums and choices on plain numbers."""
    score, into, back = (emit[0] + moves[-1]).tolist(), moves[:-1].T.tolist(), []
    for line in emit[1:].tolist():
        new, came = [], []
        for way, gain in zip(into, line):
            best, at, tag = None, 0, 0
            for have, step in zip(score, way):
                total = have + step
                if best is None or total > best:
                    best, at = total, tag
                tag += 1
            new.append(best + gain)
            came.append(at)
        back.append(came)
        score = new
    tag = int(np.argmax(score))
    path = [tag]
    for came in reversed(back):
        tag = came[tag]
        path.append(tag)
    return np.array(path[::-1], np.int64), np.array(score)


def best_paths(emit: np.ndarray, cuts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`best_path` of many sequences side by side, with the same sums: their tags in a row, and a line of final scores each.

    ``cuts``: where the sequences begin, and the end. A sequence without tokens has scores of zero.
    """
    sizes = np.diff(cuts)
    order = np.argsort(-sizes, kind="stable")
    order = order[:np.count_nonzero(sizes)]
    first, longest = cuts[order], int(sizes.max(initial=0))
    going = len(order) - np.searchsorted(sizes[order][::-1], np.arange(longest), side="right")
    score = emit[first] + moves[-1]
    back = np.zeros(emit.shape, np.int32)
    for i in range(1, longest):
        m = going[i]
        at = first[:m] + i
        ways = score[:m, :, None] + moves[:-1]
        back[at] = ways.argmax(axis=1)
        score[:m] = ways.max(axis=1) + emit[at]
    path, tag = np.empty(len(emit), np.int64), score.argmax(axis=1)
    for i in range(longest - 1, -1, -1):
        m = going[i]
        at = first[:m] + i
        path[at] = tag[:m]
        tag[:m] = back[at, tag[:m]]
    scores = np.zeros((len(sizes), emit.shape[1]))
    scores[order] = score
    return path, scores


@dataclass
class Tagger:
    """Weights per (slot, tag) and per (previous tag, tag)."""

    tags: list[str]
    weights: np.ndarray
    moves: np.ndarray

    @property
    def slots(self) -> int:
        return len(self.weights)

    def _score(self, df: DataFrame, name: str, kind: str, result) -> DataFrame:
        """(id, tokens) and what ``result`` makes of the tags and final scores of the sequences of a batch."""
        shared = df.sparkSession.sparkContext.broadcast((self.weights, self.moves))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, moves = shared.value
            weights = np.concatenate([weights, np.zeros((1, weights.shape[1]))])
            for batch in batches:
                for at in range(batch.num_rows):
                    lists = Lists.of(batch, at, len(weights) - 1)
                    n = len(lists.rows) - 1
                    path, scores = best_paths(lists.emissions(weights, 0, n), lists.rows, moves)
                    none = pa.array(np.frombuffer(batch.column("absent")[at].as_buffer(), np.int8) != 0)
                    tokens = batch.column("words")[at].values.take(pa.array(lists.codes))
                    tokens = pa.ListArray.from_arrays(pa.array(lists.rows, pa.int32()), tokens, mask=none)
                    yield pa.RecordBatch.from_arrays([batch.column("id")[at].values, tokens, result(path, scores, lists.rows)], ["id", "tokens", name])

        return _packed(spread(df.select("id", "tokens")), self.slots).mapInArrow(run, f"id {dict(df.dtypes)['id']}, tokens array<string>, {name} {kind}")

    def predict(self, df: DataFrame) -> DataFrame:
        """(id, tokens) with predicted ``tags``."""
        names = self.tags

        def result(path, scores, cuts):
            return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(names, pa.string()).take(pa.array(path)))

        return self._score(df, "tags", "array<string>", result)

    def margins(self, df: DataFrame) -> DataFrame:
        """(id, tokens) with ``margin`` between the two best final scores, and ``uncertainty``."""
        def result(path, scores, cuts):
            top = np.sort(scores, axis=1)
            margin = top[:, -1] - top[:, -2] if top.shape[1] > 1 else np.full(len(top), np.inf)
            return pa.array(np.where(np.diff(cuts) > 0, margin, 0.0))

        return self._score(df, "margin", "double", result).withColumn("uncertainty", margin_uncertainty("margin"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Nonzero weights as a table (kind, i, j, weight), and the tag names."""
        rows = [("w", int(i), int(j), float(self.weights[i, j])) for i, j in zip(*np.nonzero(self.weights))]
        rows += [("m", int(i), int(j), float(self.moves[i, j])) for i, j in np.ndindex(*self.moves.shape)]
        rows.append(("slots", self.slots, len(self.tags), 0.0))
        spark.createDataFrame(rows, "kind string, i int, j int, weight double").write.mode("overwrite").parquet(f"{path}/weights")
        spark.createDataFrame(list(enumerate(self.tags)), "i int, tag string").write.mode("overwrite").parquet(f"{path}/tags")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Tagger":
        tags = [r["tag"] for r in spark.read.parquet(f"{path}/tags").orderBy("i").collect()]
        rows = spark.read.parquet(f"{path}/weights").toPandas()
        slots = int(rows.loc[rows["kind"] == "slots", "i"].iloc[0])
        model = Tagger(tags, np.zeros((slots, len(tags))), np.zeros((len(tags) + 1, len(tags))))
        for kind, target in (("w", model.weights), ("m", model.moves)):
            part = rows[rows["kind"] == kind]
            target[part["i"], part["j"]] = part["weight"]
        return model


class _Pass:
    """One pass of a shard over its sequences: the weights as they change, and what the mean of all steps lacks of them."""

    def __init__(self, flat: np.ndarray, slots: int, n: int):
        # The line after the slots belongs to absent features and stays zero.
        self.slots, self.n, self.seen, self.ahead = slots, n, 0, 1
        self.weights = np.concatenate([flat[:slots * n], np.zeros(n)]).reshape(slots + 1, n)
        self.moves = flat[slots * n:].reshape(n + 1, n).copy()
        self.lag_w, self.lag_m = np.zeros_like(self.weights), np.zeros_like(self.moves)

    def learn(self, lists: Lists, tagged: np.ndarray) -> None:
        """Sequences in their order; those ahead of the next wrong one are looked at together."""
        low, last = 0, len(lists.rows) - 1
        while low < last:
            high = min(low + self.ahead, last)
            begin, end = lists.rows[low], lists.rows[high]
            emit = lists.emissions(self.weights, low, high)
            places, doubtful = None, [low]
            if self.ahead > 1:
                places = begin + doubts(emit, lists.rows[low:high + 1] - begin, self.moves, tagged[begin:end])
                doubtful = np.unique(np.searchsorted(lists.rows, places, side="right") - 1)
            for at in doubtful:
                b, e = lists.rows[at:at + 2]
                path = None
                if places is not None and e - b > LONG:
                    path = _path_near(emit[b - begin:e - begin], self.moves, tagged[b:e], places[(places >= b) & (places < e)] - b)
                if path is None:
                    path, _ = best_path(emit[b - begin:e - begin], self.moves)
                if (path != tagged[b:e]).any():
                    self.seen += at - low
                    self.correct(lists, b, e, tagged[b:e], path)
                    self.seen += 1
                    self.ahead = max(1, min(self.ahead, 2 * (at - low)) // 2)
                    low = at + 1
                    break
            else:
                self.seen += high - low
                self.ahead = min(2 * self.ahead, AHEAD)
                low = high

    def correct(self, lists: Lists, begin: int, end: int, gold: np.ndarray, path: np.ndarray) -> None:
        """Adds the features of the gold tags and takes away those of the path."""
        wrong = np.flatnonzero(path != gold)
        feats = np.repeat(lists.features(begin, end)[wrong], 2, axis=0)
        there = feats < self.slots
        each = there.sum(axis=1)
        signs = np.repeat(np.tile([1.0, -1.0], len(wrong)), each)
        at = (feats[there], np.repeat(np.column_stack([gold[wrong], path[wrong]]).ravel(), each))
        np.add.at(self.weights, at, signs)
        np.add.at(self.lag_w, at, signs * self.seen)
        for tags_of, sign in ((gold, 1.0), (path, -1.0)):
            step = (np.concatenate([[self.n], tags_of[:-1]]), tags_of)
            np.add.at(self.moves, step, sign)
            np.add.at(self.lag_m, step, sign * self.seen)

    def change(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the pass changed of the weights, and of their mean over its steps."""
        now, lagged = (np.concatenate([w[:-1].ravel(), m.ravel()]) for w, m in ((self.weights, self.moves), (self.lag_w, self.lag_m)))
        return now - flat, now - lagged / self.seen - flat


def train_tagger(df: DataFrame, tags: list[str], epochs: int = EPOCHS, slots: int = SLOTS, shards: int | None = None) -> Tagger:
    """A tagger from (id, tokens, tags); sequences without tokens do not count, an unknown tag is an error."""
    spark = df.sparkSession
    n = len(tags)
    known = F.array(*[F.lit(t) for t in tags])
    gold = F.transform("tags", lambda t: (F.array_position(known, t) - 1).cast("int"))
    shards = shards or spark.sparkContext.defaultParallelism
    dealt = df.select("id", "tokens", gold.alias("gold")).repartition(shards, "id").sortWithinPartitions(draw("id", "order"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                lists, tagged = Lists.of(batch, at, slots), batch.column("gold")[at].as_py()
                parts = [*(np.ascontiguousarray(x).tobytes() for x in (lists.own, lists.near, lists.codes, lists.pairs, lists.rows)), tagged]
                row = [pa.array([pa.compress(x, CODEC, asbytes=True)], pa.binary()) for x in parts]
                odd = pa.array([bool((np.frombuffer(tagged, np.int16) < 0).any())])
                yield pa.RecordBatch.from_arrays([*row, pa.array([[len(x) for x in parts]], pa.list_(pa.int64())), odd], [*STORED, "bytes", "odd"])

    data = _packed(dealt.select("tokens", "gold"), slots).mapInArrow(read, ", ".join(f"{x} binary" for x in STORED) + ", bytes array<bigint>, odd boolean").persist()
    if data.agg(F.max("odd")).first()[0]:
        data.unpersist()
        rows = df.where((F.size("tokens") > 0) & (F.size("tokens") == F.size("tags")))
        other = rows.where(F.size(F.array_except("tags", known)) > 0).select(F.array_except("tags", known).alias("t")).first()
        raise ValueError(f"tags that the tagger does not know: {other['t']}")
    # One flat vector: slot weights first, then moves.
    now, total = np.zeros((slots + n + 1) * n), np.zeros((slots + n + 1) * n)
    passes = 0
    for _ in range(epochs):
        shared = spark.sparkContext.broadcast(now)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard = _Pass(shared.value, slots, n)
            for batch in batches:
                for at in range(batch.num_rows):
                    plain = [pa.decompress(batch.column(c)[at].as_buffer(), size.as_py(), CODEC) for c, size in zip(STORED, batch.column("bytes")[at])]
                    own, near, codes, pairs = (np.frombuffer(x, np.int32) for x in plain[:4])
                    lists = Lists(own.reshape(-1, OWN), near.reshape(-1, 4), codes, pairs, np.frombuffer(plain[4], np.int64))
                    shard.learn(lists, np.frombuffer(plain[5], np.int16).astype(np.int64))
            if shard.seen:
                change, mean = shard.change(shared.value)
                at = np.flatnonzero((change != 0) | (mean != 0))
                for x in ({"slot": at, "change": change[at], "mean": mean[at]}, {"slot": [-1], "change": [1.0], "mean": [1.0]}):
                    yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in x.items()})

        parts = data.drop("odd").mapInArrow(run, "slot bigint, change double, mean double")
        mixed = parts.groupBy("slot").agg(F.sum("change").alias("change"), F.sum("mean").alias("mean")).toPandas().set_index("slot")
        if mixed.empty:
            break
        used = float(mixed.loc[-1, "change"])
        mixed = mixed.drop(index=-1)
        passes += 1
        total[:] += now
        total[mixed.index] += mixed["mean"].to_numpy() / used
        now = now.copy()
        now[mixed.index] += mixed["change"].to_numpy() / used
        shared.unpersist()
        if mixed.empty:
            break
    data.unpersist()
    mean = total / max(passes, 1)  # training may end before the last epoch
    return Tagger(tags, mean[:slots * n].reshape(slots, n), mean[slots * n:].reshape(n + 1, n))

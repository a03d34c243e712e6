"""Periodic runs of words: suffix trees answer how far two places agree, Lyndon roots say where to ask.

A run is a stretch of consecutive words with smallest period q, at least ``at_least`` words and at least 2q words,
that no neighbouring word extends. Every run holds a Lyndon root: for the order of the words or its reverse, the
longest Lyndon word that starts somewhere in the run is as long as its period. So each place gives one candidate
period for each order, and the candidate is extended both ways: forwards by the tree of the words, backwards by
the tree of the reversed words. The tree (Ukkonen) is toured once; the depths passed between neighbouring leaves
and their minima over powers of two give the depth of any lowest common ancestor in constant time.

Only stretches that can hold a run get a tree. Each word of a run lies in a group of ``at_least / 2`` words that
comes again within the run, so words outside any group that is repeated in their stretch are cut away, and what is
left is cut again until nothing changes. No run is lost, shortened or joined by that.

Rows are independent: nothing is shuffled and a lost task is done again from its input. Memory is that of the
words of one batch of rows, or of one document where that is longer.

Null and empty texts have no words: no runs and an empty collapsed text. Repeated rows give repeated results, a
null key is kept, other columns of the table take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from datamill.llm.common import WORD, text_of

AT_LEAST = 12
#: Words that are handled together in a task, and words that share a tree.
BATCH_WORDS, TREE_WORDS = 1 << 20, 1 << 14
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


# --- stretches that can hold a run ---------------------------------------------------------------


def stretches(words: np.ndarray, part: np.ndarray, at_least: int = AT_LEAST) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one places of the stretches that hold all runs.

    ``words``: word numbers; ``part``: ascending number of the document of each word.
    Groups are compared by a 64-bit hash; equal hashes of different groups only leave a stretch longer.
    """
    size = (at_least + 1) // 2
    place, rng = np.arange(len(words)), np.random.default_rng(1)
    factors = rng.integers(1, 2**63, size + 1, dtype=np.uint64) | np.uint64(1)
    while len(place) >= at_least:
        values, own = words[place].astype(np.uint64), part
        n = len(place) - size + 1
        whole = own[:n] == own[size - 1:]
        mixed = own[:n].astype(np.uint64) * factors[size]
        for k in range(size):
            mixed = mixed + values[k:n + k] * factors[k]
        first = np.flatnonzero(whole)
        mixed = mixed[first]
        order = np.argsort(mixed, kind="stable")
        same = mixed[order][1:] == mixed[order][:-1]
        again = np.zeros(len(first), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        edge = np.zeros(len(place) + 1, np.int64)
        edge[first[again]] += 1
        np.subtract.at(edge, first[again] + size, 1)
        keep = np.cumsum(edge[:-1]) > 0
        # A new stretch begins where a kept word follows a cut one or a word of another stretch.
        begin = keep & np.r_[True, ~keep[:-1] | (own[1:] != own[:-1])]
        number = np.cumsum(begin) - 1
        long = np.bincount(number[keep], minlength=1) >= at_least if keep.any() else np.zeros(1, bool)
        keep &= long[np.maximum(number, 0)]
        if keep.all():
            break
        place, part = place[keep], number[keep]
    else:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return place[starts], place[np.r_[starts[1:], len(place)] - 1] + 1


# --- suffix tree and lowest common ancestors ----------------------------------------------------


class SuffixTree:
    """Ukkonen's tree of ``text``: numbers below ``letters``, of which those below ``marks`` occur once and end a part."""

    def __init__(self, text: np.ndarray, letters: int, marks: int):
        self.n, self.letters, self.marks = len(text), letters, marks
        self._build(text.tolist())

    def _build(self, s: list[int]) -> None:
        n, width = self.n, self.letters
        start, end, link, to = [0], [0], [0], {}
        node = at = length = open_ = 0
        for i, c in enumerate(s):
            open_ += 1
            waits = 0
            while open_:
                if not length:
                    at = i
                key = node * width + s[at]
                child = to.get(key)
                if child is None:
                    to[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if waits:
                        link[waits] = node
                        waits = 0
                else:
                    first = start[child]
                    size = end[child] - first
                    if length >= size:
                        node, at, length = child, at + size, length - size
                        continue
                    if s[first + length] == c:
                        if waits:
                            link[waits] = node
                        length += 1
                        break
                    middle = len(start)
                    to[key] = middle
                    to[middle * width + s[first + length]] = child
                    to[middle * width + c] = middle + 1
                    start += (first, i)
                    end += (first + length, n)
                    link += (0, 0)
                    start[child] = first + length
                    if waits:
                        link[waits] = middle
                    waits = middle
                open_ -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - open_ + 1
        self.start, self.end = start, end
        count = len(start)
        keys = np.fromiter(to.keys(), np.int64, len(to))
        self.child = np.fromiter(to.values(), np.int64, len(to))
        self.parent, self.letter = keys // width, keys % width
        self.bounds = np.searchsorted(np.sort(self.parent), np.arange(count + 1)).tolist()

    def _children(self, descending: bool) -> list[int]:
        """Children of each node, last in order first; marks come before all letters in both orders."""
        letter = self.letter
        if descending:
            letter = np.where(letter < self.marks, letter, self.letters + self.marks - letter)
        return self.child[np.lexsort((-letter, self.parent))].tolist()

    def tour(self) -> None:
        """Suffixes in order, and for each the depth at which the tour turned since the one before."""
        n, start, end, bounds, children = self.n, self.start, self.end, self.bounds, self._children(False)
        above, last = [0] * len(start), {children[b - 1] for b in set(bounds) if b}
        suffixes, turns, stack, turn = [], [], [0], 0
        while stack:
            node = stack.pop()
            depth = above[node]
            if node and node not in last:
                turn = depth
            if end[node] == n:
                suffixes.append(start[node] - depth)
                turns.append(turn)
                continue
            depth += end[node] - start[node]
            below = children[bounds[node]:bounds[node + 1]]
            for child in below:
                above[child] = depth
            stack += below
        self.above = above
        self.rank = np.empty(n, np.int64)
        self.rank[suffixes] = np.arange(n)
        low = np.array(turns, np.int32)
        self.lowest = [low]
        step = 1
        while 2 * step <= n:
            low = np.minimum(low[:-step], low[step:])
            self.lowest.append(low)
            step *= 2

    def reversed_rank(self) -> np.ndarray:
        """Place of every suffix under the reversed order of the letters."""
        n, start, end, bounds, above, children = self.n, self.start, self.end, self.bounds, self.above, self._children(True)
        suffixes, stack = [], [0]
        while stack:
            node = stack.pop()
            if end[node] == n:
                suffixes.append(start[node] - above[node])
            else:
                stack += children[bounds[node]:bounds[node + 1]]
        rank = np.empty(n, np.int64)
        rank[suffixes] = np.arange(n)
        return rank

    def forget_nodes(self) -> None:
        del self.start, self.end, self.child, self.parent, self.letter, self.bounds, self.above

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at ``a`` and ``b``, pairwise different places."""
        a, b = self.rank[a], self.rank[b]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        power = np.frexp(high - low)[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(power):
            here = power == k
            table = self.lowest[k]
            out[here] = np.minimum(table[low[here]], table[high[here] - (1 << int(k))])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next place with a smaller rank, or the length: where the longest Lyndon word of each place ends."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank.tolist()):
        while stack and stack[-1][0] > r:
            out[stack.pop()[1]] = i
        stack.append((r, i))
    return np.array(out, np.int64)


def tree_runs(parts: list[np.ndarray], at_least: int = AT_LEAST) -> np.ndarray:
    """Rows (part, start, length, period) of all runs of the given word numbers."""
    marks, sizes = len(parts), np.array([len(p) for p in parts])
    values, joined = np.unique(np.concatenate(parts), return_inverse=True)
    letters = marks + len(values)
    heads = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(marks), sizes + 1)
    text = np.empty(len(joined) + marks, np.int64)
    inside = np.ones(len(text), bool)
    inside[heads + sizes] = False
    text[inside], text[~inside] = joined + marks, np.arange(marks)
    n = len(text)

    tree = SuffixTree(text, letters, marks)
    tree.tour()
    ends = [next_smaller(tree.rank), next_smaller(tree.reversed_rank())]
    tree.forget_nodes()
    starts = np.flatnonzero(inside)
    begin, next_ = np.r_[starts, starts], np.r_[ends[0][starts], ends[1][starts]]
    stop = next_ + tree.common(begin, next_)
    del tree

    # The text backwards, each part with its mark behind it: place i of a part is at its head + size - 1 - i.
    mirror = heads[owner] + sizes[owner] - 1 - (np.arange(n) - heads[owner])
    back = np.empty_like(text)
    back[mirror[inside]], back[~inside] = text[inside], np.arange(marks)
    tree = SuffixTree(back, letters, marks)
    tree.tour()
    tree.forget_nodes()
    first = heads[owner[begin]]
    inner = begin > first
    ahead = np.zeros(len(begin), np.int64)
    ahead[inner] = tree.common(mirror[begin[inner] - 1], mirror[next_[inner] - 1])
    start, period = begin - ahead, next_ - begin
    found = (stop - start >= 2 * period) & (stop - start >= at_least)
    rows = np.stack([owner[begin], start - first, stop - start, period], axis=1)[found]
    return np.unique(rows, axis=0) if len(rows) else rows


def find_runs(words: np.ndarray, document: np.ndarray, at_least: int = AT_LEAST) -> np.ndarray:
    """Rows (place of the run's first word, length, period) in order, for documents laid one behind another."""
    low, high = stretches(words, document, at_least)
    out, at = [np.empty((0, 3), np.int64)], 0
    while at < len(low):
        until = int(np.searchsorted(np.cumsum(high[at:] - low[at:]), TREE_WORDS)) + at + 1
        found = tree_runs([words[a:b] for a, b in zip(low[at:until], high[at:until])], at_least)
        if len(found):
            out.append(np.stack([found[:, 1] + low[at:until][found[:, 0]], found[:, 2], found[:, 3]], axis=1))
        at = until
    rows = np.concatenate(out)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


# --- on tables -----------------------------------------------------------------------------------


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Word numbers of all texts, number of words of each, and the words by number."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat, row = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(real).dictionary_encode()
    counts = np.bincount(row.filter(real).to_numpy(zero_copy_only=False), minlength=len(texts))
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts, coded.dictionary


def _repeated(texts: pa.Array, at_least: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Word counts, lists of runs and collapsed texts."""
    words, counts, names = _split(texts)
    begins = np.cumsum(counts) - counts
    document = np.repeat(np.arange(len(counts)), counts)
    found = find_runs(words, document, at_least)
    place, length, period = found.T
    holder = document[place]
    per_row = np.bincount(holder, minlength=len(counts))
    runs = pa.ListArray.from_arrays(
        pa.array(np.r_[0, np.cumsum(per_row)], pa.int32()),
        pa.StructArray.from_arrays([pa.array(place - begins[holder]), pa.array(length), pa.array(period)], fields=list(RUN_TYPE)))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, place + period, 1)
    np.subtract.at(edge, place + length, 1)
    keep = np.cumsum(edge[:-1]) == 0
    left = np.r_[0, np.cumsum(np.bincount(document[keep], minlength=len(counts)))]
    kept = names.cast(pa.string()).take(pa.array(words[keep]))
    return counts, runs, pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), kept), " ")


def repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text", at_least: int = AT_LEAST) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row.

    ``runs``: array of (start, length, period) in words from 0, by start, then period. ``collapsed``: the words
    outside the repeated part of any run (all but its first ``period`` words), joined by one space.
    """
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # About six bytes to a word; a longer text makes a part of its own.
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // (6 * BATCH_WORDS)
            cuts = np.r_[0, np.flatnonzero(np.diff(size)) + 1, batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(low, high - low)
                if part.num_rows:
                    counts, runs, texts = _repeated(part.column(1), at_least)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), runs, texts], ["key", "n_words", "runs", "collapsed"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_words bigint, runs {RUNS}, collapsed string").withColumnRenamed("key", key)


def repeat_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with a periodic tail in about a tenth of the texts, placed by the CRC-32 of the key.

    With h that checksum and g = h div 10: where h is divisible by ten, word i >= a becomes word a + (i - a) mod p,
    a = g mod n, p = 1 + (n - a) div (3 + g mod 8). Other texts, and those without words, stay. A null key has no checksum.
    """
    checksum = F.crc32(docs[key].cast("string").cast("binary"))
    rows = docs.select(docs[key].alias("key"), text_of(docs[text]).alias("text"), checksum.alias("h"), F.floor(checksum / 10).alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("words", words).withColumn("n", F.coalesce(F.size("words"), F.lit(0)))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select(F.col("key").alias(key), F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias(text))


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per row of ``repeated_words``: number of runs, its longest run, and digests of runs and collapsed text."""
    best = F.reduce(
        "runs", F.lit(None).cast(RUNS[6:-1]),
        lambda a, b: F.when(a.isNull() | (b["length"] > a["length"]), b).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"], )), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.select(
        key, F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        key, "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

"""Spelling variants: blocked Gram matrices of letter counts, then exact edits.

Two words are near if they differ by exactly one inserted, deleted or replaced letter. Then the squared distance of
their letter counts is 1 (lengths differ by one) or 2 (equal lengths), so products of count matrices leave few pairs
to verify. A block holds words of one length that also agree in how many of their letters fall in each of
``GROUPS`` groups of the alphabet: one edit moves a word to its own block or to one of few others of its own or
the next length, and only such blocks meet. Both are known from counts per block, so a word travels only to blocks that exist.

A block of more than ``BLOCK_ROWS`` words is dealt over several; tasks hold one block and stream the visitors past
it. No pair is left out. Links, forms and roots stay distributed; a step that is read twice is a written table.

Null and empty texts have no words. A null key counts as an empty one in the checksum of ``misspelled_words``;
repeated rows count again; an empty table gives no words. Other columns take no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from datamill.llm.common import written

RUN = r"[A-Za-zÀ-ÿ]"
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
LEAST_LETTERS, LEAST_COUNT, RATIO, EVERY = 6, 5, 5, 199
GROUPS, BLOCK_ROWS = 8, 2048
#: Entries of a distance matrix that a task holds at once.
CELLS = 1 << 22
#: Distinct words that a task counts before it hands them on.
TASK_WORDS = 1 << 19


# --- words ---------------------------------------------------------------------------------------


def misspelled(run: str, checksum: int, every: int = EVERY) -> str:
    """The run, or without one letter where ``every`` divides its checksum."""
    at = checksum % len(run)
    return run if checksum % every else run[:at] + run[at + 1:]


def misspelled_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough after planting misspellings.

    A to Z are lower-cased; the checksum of a run is the CRC-32 of ``<key>:<run>``. Counts are combined in the tasks.
    """
    rows = docs.select(F.coalesce(docs[key].cast("string"), F.lit("")).alias("key"), docs[text].alias("text")).where("text IS NOT NULL")
    runs_of = re.compile(f"{RUN}{{{least_letters},}}")

    def counts(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # Lower-casing bytes changes A to Z only.
                runs = Counter(runs_of.findall(body.encode().lower().decode()))
                start = zlib.crc32(f"{name}:".encode())
                for word in list(runs):
                    checksum = zlib.crc32(word.encode(), start)
                    if checksum % EVERY == 0:
                        n, word = runs.pop(word), misspelled(word, checksum)
                        if len(word) >= least_letters:
                            total[word] += n
                total.update(runs)
            if len(total) >= TASK_WORDS:
                yield counts(total)
                total = Counter()
        yield counts(total)

    found = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= least_count)


# --- near words ----------------------------------------------------------------------------------


def _profile(word: Column) -> Column:
    """Letters of the word in each group."""
    size = F.char_length(word)
    groups = ["".join(c for c in LETTERS if ord(c) % GROUPS == g) for g in range(GROUPS)]
    return F.array(*[(size - F.char_length(F.translate(word, letters, ""))).cast("smallint") for letters in groups])


def _moves() -> Column:
    """Profiles' differences from a word to a longer near word, or to one with a letter replaced by one of a later group."""
    moves = [[int(g == j) for g in range(GROUPS)] for j in range(GROUPS)]
    moves += [[int(g == j) - int(g == i) for g in range(GROUPS)] for i in range(GROUPS) for j in range(i + 1, GROUPS)]
    return F.array(*[F.array(*[F.lit(x).cast("smallint") for x in move]) for move in moves])


def _tiles(words: DataFrame) -> DataFrame:
    """(home, block, visit, word, n): each block's own words, and the words of other blocks that may be near one of them."""
    words = written(words.select("word", "n", _profile(F.col("word")).alias("home")), "words")
    blocks = words.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    blocks = written(blocks, "blocks")
    # Tables of blocks grow with the words and are larger than their files: never broadcast.
    own = words.join(blocks.hint("merge"), "home").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    homes = own.select("home", "block", F.lit(False).alias("visit"), "word", "n")
    # Words of one profile in several blocks: a word also visits the later blocks.
    split = own.where("block + 1 < blocks").select(
        "home", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"), F.lit(True).alias("visit"), "word", "n")
    moved = blocks.select(F.col("home").alias("profile"), F.explode(_moves()).alias("move"))
    moved = moved.select("profile", F.zip_with("profile", "move", lambda a, b: (a + b).cast("smallint")).alias("home"))
    ways = moved.join(blocks.hint("merge"), "home").select("profile", "home", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    visits = words.withColumnRenamed("home", "profile").join(ways.hint("merge"), "profile")
    return homes.unionByName(split).unionByName(visits.select("home", "block", F.lit(True).alias("visit"), "word", "n"))


def letter_counts(words: list[str]) -> np.ndarray:
    """One row of letter counts per word, in a type that is exact for products of such rows."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    place = np.zeros(256, np.int64)
    place[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
    sizes = [len(w) for w in words]
    row = np.repeat(np.arange(len(words)), sizes)
    exact = np.float32 if max(sizes, default=0) < 2000 else np.float64
    return np.bincount(row * len(LETTERS) + place[codes], minlength=len(words) * len(LETTERS)).reshape(len(words), -1).astype(exact)


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def close_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose squared distance is 1 or 2, from one matrix product in slices of bounded size."""
    squares, found, step = (b * b).sum(1), [], max(1, CELLS // max(len(b), 1))
    for low in range(0, len(a), step):
        part = a[low:low + step]
        distance = (part * part).sum(1)[:, None] + squares - 2 * (part @ b.T)
        i, j = np.nonzero((distance > 0.5) & (distance < 2.5))
        found.append((i + low, j))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int))


class _Block:
    """The words of the block that the task has reached, and the near pairs found since the last batch."""

    def __init__(self):
        self.key, self.found = None, []

    def add(self, key: str, visit: np.ndarray, words: list[str], n: list[int], counts: np.ndarray) -> None:
        if key != self.key:
            self.key, self.words, self.n, self.counts = key, [], [], np.empty((0, len(LETTERS)), np.float32)
        own = int(np.searchsorted(visit, True))
        if own:
            old = len(self.words)
            self.words, self.n = self.words + words[:own], self.n + n[:own]
            self.counts = np.concatenate([self.counts, counts[:own]])
            i, j = close_pairs(counts[:own], self.counts)
            earlier = j < i + old
            self._verify(words, n, i[earlier], j[earlier])
        if own < len(words) and self.words:
            i, j = close_pairs(counts[own:], self.counts)
            self._verify(words, n, i + own, j)

    def _verify(self, words: list[str], n: list[int], i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist()):
            if one_edit(words[a], self.words[b]):
                self.found += ((words[a], n[a], self.words[b], self.n[b]), (self.words[b], self.n[b], words[a], n[a]))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both directions of every near pair of the distinct words in (word, n)."""
    tiles = _tiles(words).withColumn("tile", F.concat_ws(",", F.col("home").cast("array<string>"), "block")).drop("home", "block")
    tiles = tiles.repartition("tile").sortWithinPartitions("tile", "visit").select("tile", "visit", "word", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            visit, word, n = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            counts = letter_counts(word)
            cuts = np.r_[0, np.flatnonzero(np.diff(code)) + 1, len(code)].tolist()
            for low, high in zip(cuts[:-1], cuts[1:]):
                if high > low:
                    block.add(names[code[low]], visit[low:high], word[low:high], n[low:high], counts[low:high])
            a, an, b, bn = zip(*block.found) if block.found else ((), (), (), ())
            block.found = []
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(an, pa.int64()), pa.array(b, pa.string()), pa.array(bn, pa.int64())], ["word", "n", "near", "near_n"])

    return tiles.mapInArrow(run, "word string, n long, near string, near_n long")


# --- forms and roots -----------------------------------------------------------------------------


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of the words with a form in (word, form): the end of their chain.

    Chains have no cycles, as a form is more frequent than its word. Each round doubles the steps that a row has gone.
    """
    links = written(links.select("word", F.col("form").alias("root")), "links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        gone = links.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        gone = written(gone, "roots")
        links = gone.select("word", "root")
        if gone.where("moved").isEmpty():
            return links


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word in (word, n).

    ``form``: the near word of largest n (ties: smallest in code-point order), if that n is at least ``ratio``
    times the word's; ``root``: the end of the chain of forms, the word itself if it has none.
    """
    words = written(words.select("word", "n"), "vocabulary")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("best"))
    rows = words.join(best, "word", "left")
    formed = -F.col("best.minus") >= ratio * F.col("n")
    rows = written(rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best.form")).alias("form"), F.when(formed, -F.col("best.minus")).alias("form_n")), "forms")
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))

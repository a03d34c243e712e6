"""Best-fit packing of token sequences, certified by dual feasible functions.

Documents become ids, longer ones are cut into pieces of the capacity, and pieces are dealt over groups of bounded
size. A task packs its group by best fit decreasing and bounds the number of sequences from below: a dual feasible
function gives every length a share of a sequence such that no sequence can hold more than one in total, so the sum of the shares,
for the best function of several families, is a bound. What a sequence lacks to one is its loss; a group without loss is
certified. Groups with a gap release the sequences that cause it, and the released ones, whole, are dealt to new, fewer
groups and packed again, until one group is left or a round saves nothing. A group keeps its old sequences where the new ones are not fewer.

Each round is a written table, so a lost executor repeats one task of one round. The driver sees counts only.
Only lengths and checksums travel, no ids.

A null or empty text has the end id alone. Repeated rows are packed each, null keys stay, an empty table gives an
empty result; other columns of the table take no part.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, functions as F

from datamill.llm.common import written

CAPACITY, END = 4096, 1
#: Rows of a group that one task packs; share of a group's loss that its released sequences hold; rounds at most.
GROUP_ROWS, RELEASED, ROUNDS = 1 << 16, 0.95, 8
#: Words whose ids a task remembers, and words whose ids it lays out at once.
MEMORY, BATCH_WORDS = 3 << 18, 1 << 20


# --- ids -----------------------------------------------------------------------------------------


class WordIds:
    """Ids of texts by those of their words.

    For tokenizers in lower case that give no ids to white space and never join across it, nor letters with the
    marks beside them, as ``word_bpe`` models do. Words of letters go straight to the tokenizer's model.
    """

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        # How the model sees a letter; letters that the tokenizer changes or cuts are left out.
        self.seen = {}
        for c in map(chr, [*range(ord("a"), ord("z") + 1), *range(0xDF, 0x100)]):
            units = self.tokenizer.pre_tokenizer.pre_tokenize_str(c)
            if c.isalpha() and self.tokenizer.normalizer.normalize_str(c) == c and len(units) == 1:
                self.seen[ord(c)] = units[0][0]
        marks = re.escape("".join(sorted(set(string.punctuation) - set("'<>|"))))
        self.units = re.compile(f"([{marks}]*)([{''.join(map(chr, self.seen))}]+)([{marks}]*)")
        self._forget()

    def _forget(self) -> None:
        """Nothing known but the end mark, which is word 0."""
        self.known, self.parts, self.sizes, self.ids = {}, {}, [1], [np.array([self.end], "<u4")]

    def _other(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = self.parts[part] = array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        return found

    def _ids(self, word: str) -> bytes:
        match = self.units.fullmatch(word)
        if not match:
            return self._other(word)
        before, letters, behind = match.groups()
        found = self.parts.get(letters)
        if found is None:
            seen = letters if letters.isascii() else letters.translate(self.seen)
            found = self.parts[letters] = array("I", [t.id for t in self.tokenizer.model.tokenize(seen)]).tobytes()
        return (self._other(before) if before else b"") + found + (self._other(behind) if behind else b"")

    def _numbers(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > MEMORY and known:
            self._forget()
            known, new = self.known, words
        if new:
            found = list(map(self._ids, new))
            known.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
            self.sizes += [len(ids) // 4 for ids in found]
            self.ids = [np.concatenate([*self.ids, np.frombuffer(b"".join(found), "<u4")])]
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, an end mark behind each text, and the bounds of the texts in them."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat, row = lists.flatten(), pc.list_parent_indices(lists)
        real = pc.greater(pc.binary_length(flat), 0)
        # Lower case first, which the tokenizer does anyway, leaves fewer words; special marks are read as written.
        flat = pc.if_else(pc.match_substring(flat, "<|"), flat, pc.ascii_lower(flat))
        coded = flat.filter(real).dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        counts = np.bincount(row.filter(real).to_numpy(zero_copy_only=False), minlength=len(texts))
        words = np.insert(numbers, np.cumsum(counts), 0)
        sizes, ids = np.array(self.sizes), self.ids[0]
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[words]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts[words], lengths)
        return ids[at], np.r_[0, ends[np.cumsum(counts + 1) - 1]] if len(texts) else np.zeros(1, np.int64)


@lru_cache(maxsize=2)
def _word_ids(name: str, end: int) -> WordIds:
    return WordIds(SparkFiles.get(name), end)


def token_pieces(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, seat) of every text's ids, ``end`` behind them, cut every ``capacity`` ids.

    ``seat`` numbers the rows of a task and is the same when the task is done again. ``with_ids`` adds the ids.
    """
    docs.sparkSession.sparkContext.addFile(tokenizer_path)
    name = os.path.basename(tokenizer_path)
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))

    def pieces(keys: pa.Array, texts: pa.Array, seat: int) -> pa.RecordBatch:
        ids, bounds = _word_ids(name, end).encode(texts)
        sizes = np.diff(bounds)
        each = -(-sizes // capacity)
        row = np.repeat(np.arange(len(sizes)), each)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        start = piece * capacity
        length = np.minimum(sizes[row] - start, capacity)
        first = bounds[row] + start
        data = memoryview(ids).cast("B")
        sums = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
        columns = [keys.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(seat + np.arange(len(row)))]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.r_[first, bounds[-1:]], pa.int32()), pa.array(ids.astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, ["key", "piece", "start", "length", "ids_crc32", "seat", "ids"][:len(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seat = TaskContext.get().partitionId() << 40
        for batch in batches:
            # About six bytes to a word; a longer text makes a part of its own.
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // (6 * BATCH_WORDS)
            cuts = np.r_[0, np.flatnonzero(np.diff(size)) + 1, batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if high > low:
                    out = pieces(batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), seat)
                    seat += out.num_rows
                    yield out

    kind = rows.schema["key"].dataType.simpleString()
    extra = ", ids array<int>" if with_ids else ""
    return rows.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long, seat long{extra}").withColumnRenamed("key", key)


# --- bounds and best fit -------------------------------------------------------------------------


def best_shares(counts: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The largest bound that a dual feasible function gives, and its share of a sequence for every length.

    ``counts``: number of pieces of each length from 0 to ``capacity``. Families: the length itself; it rounded
    to steps of 1/k; short lengths nothing and their complements all; lengths above a half by what fits beside them.
    """
    x = np.arange(capacity + 1)
    best, shares = counts @ x / capacity, x / capacity

    def consider(f: np.ndarray) -> None:
        nonlocal best, shares
        bound = counts @ f
        if bound > best * (1 + 1e-12):
            best, shares = bound, f

    for k in range(1, 65):
        scaled = (k + 1) * x
        consider(np.where(scaled % capacity == 0, x / capacity, (scaled // capacity) / k))
    present = np.flatnonzero(counts[:capacity // 2 + 1])
    # The second family for all its parameters at once: rows of length at least e, those above capacity - e in full.
    rows, sums = np.r_[np.cumsum(counts[::-1])[::-1], 0], np.r_[0, np.cumsum(counts * x)]
    for e in {*present[present > 0].tolist()}:
        if rows[capacity - e + 1] + (sums[capacity - e + 1] - sums[e]) / capacity > best * (1 + 1e-12):
            consider(np.where(x > capacity - e, 1.0, np.where(x >= e, x / capacity, 0.0)))
        whole = capacity // e
        consider(np.where(2 * x > capacity, 1 - (capacity - x) // e / whole, np.where(x >= e, 1 / whole, 0.0)))
    return float(best), shares


def bound_of(counts: np.ndarray, capacity: int) -> int:
    """A number of sequences that no packing can go below."""
    return int(np.ceil(best_shares(counts, capacity)[0] - 1e-6))


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Sequence of each of the lengths, given in descending order: the fullest one that has room, or a new one."""
    room = [[] for _ in range(capacity + 1)]
    mask, made, out = 0, 0, []
    for size in lengths.tolist():
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
        else:
            free, number, made = capacity, made, made + 1
        left = free - size
        if left:
            room[left].append(number)
            mask |= 1 << left
        out.append(number)
    return np.array(out, np.int64)


def pack_group(length: np.ndarray, seat: np.ndarray, old: np.ndarray, base: int, capacity: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, offset and whether it is released, for each row of a group; new sequences are numbered from ``base``.

    The rows stay in their ``old`` sequences, if they have any (from 0), where best fit doesn't need fewer.
    """
    order = np.lexsort((seat, -length))
    number = np.empty(len(length), np.int64)
    number[order] = best_fit(length[order], capacity)
    ids, kept = np.unique(old, return_inverse=True)
    if ids[0] >= 0 and number.max() + 1 >= len(ids):
        number = kept
    else:
        ids = base + np.arange(number.max() + 1)
    order = np.lexsort((seat, -length, number))
    before = np.cumsum(length[order]) - length[order]
    starts = np.flatnonzero(np.r_[True, np.diff(number[order]) > 0])
    offset = np.empty(len(length), np.int64)
    offset[order] = before - np.repeat(before[starts], np.diff(np.r_[starts, len(length)]))
    free = np.zeros(len(ids), bool)
    if not last:
        _, shares = best_shares(np.bincount(length, minlength=capacity + 1), capacity)
        loss = np.maximum(1 - np.bincount(number, shares[length]), 0)
        if loss.sum() > 1e-6:
            worst = np.argsort(-loss, kind="stable")
            free[worst[:int(np.searchsorted(np.cumsum(loss[worst]), RELEASED * loss.sum())) + 1]] = True
    return ids[number], offset, free[number]


# --- rounds --------------------------------------------------------------------------------------


def _packer(columns: list[str], number: int, capacity: int, last: bool):
    """Packs one group, a table with ``columns``, ``sequence_id`` and ``_group``."""

    def run(part: pa.Table) -> pa.Table:
        length, seat, old = (part.column(c).to_numpy() for c in ("length", "seat", "sequence_id"))
        base = (number << 56) + (part.column("_group")[0].as_py() << 20)
        new = pack_group(length, seat, old, base, capacity, last)
        out = part.select(columns)
        for name, values in zip(("sequence_id", "offset", "released"), new):
            out = out.append_column(name, pa.array(values))
        return out

    return run


def pack(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The rows of ``token_pieces`` with ``sequence_id`` and ``offset``."""
    columns = [key, "piece", "start", "length", "ids_crc32"]
    rows = pieces.select(*columns, "seat", F.lit(-1).cast("long").alias("sequence_id"), F.col("seat").alias("unit"))
    rows = written(rows, "pieces")
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, seat long, sequence_id long, offset long, released boolean"
    settled, before, number = [], None, 0
    n = rows.count()
    while n:
        groups = -(-n // group_rows)
        last = groups == 1 or number + 1 == ROUNDS
        dealt = rows.withColumn("_group", F.pmod(F.xxhash64("unit", F.lit(number)), F.lit(groups)))

        done = written(dealt.groupBy("_group").applyInArrow(_packer([*columns, "seat"], number, capacity, last), schema), "packed")
        free = done.where("released")
        made, n = free.agg(F.count_distinct("sequence_id"), F.count(F.lit(1))).first()
        if before is not None and _sequences(done) >= before:
            n = 0  # the exchange saved nothing: this round's rows stay
        if not n:
            settled.append(done)
            break
        settled.append(done.where("NOT released"))
        rows = free.select(*columns, "seat", "sequence_id", F.col("sequence_id").alias("unit"))
        before, number = made, number + 1
    if not settled:
        return rows.select(*columns, "sequence_id", F.lit(0).cast("long").alias("offset"))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select(*columns, "sequence_id", "offset")


def _sequences(packed: DataFrame) -> int:
    return packed.agg(F.count_distinct("sequence_id")).first()[0]


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Number of sequences of a packing, and the number that none can go below; only counts by length reach the driver."""
    counts = np.zeros(capacity + 1)
    for length, n in packed.groupBy("length").count().collect():
        counts[length] = n
    return _sequences(packed), bound_of(counts, capacity)

"""Cosine joins on embeddings, exact or by a hash index, and first-wins duplicate removal built on them.

The exact join uses a tree of centres. A node with more than ``LEAF`` rows is split among centres taken from its own
rows, as many as it has leaves' worth of rows but at most ``FAN``, and its children are split again, so the number of
cells grows with the table. Each vector has one home cell, that of its nearest centre, and also visits every cell that can
hold a partner: a partner lies within the angle of the threshold, so by the triangle inequality its angle to the cell's
centre, and its side of the border between two centres, cannot differ by more. The home cell of a vector thus
sees all its partners. The rows of a leaf stream past blocks of its home rows of bounded size.

A node is only split where that spares comparisons: what a split would copy is first measured on a bounded sample of
the node's rows, and all cells together hold at most ``VISITS`` copies of the vectors. A node that stays whole is
compared in full, so the result is the same, and its rows travel once for each ``BLOCK`` of its home rows. If no node
is split at all, first-wins removal goes by the order of the rows and lists no pairs.

Centres travel as rows of the node they belong to, in front of the vectors that stream past them; nothing is
collected or broadcast, and a large node is dealt over many tasks.

Where no two vectors are far enough apart for the threshold (a low one, or vectors spread evenly in
many dimensions) no exact method prunes. The ``approximate`` mode compares only vectors with equal signs on random
directions, in as many bands as the wanted recall needs, and verifies them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from datamill.functions.hashing import draw
from datamill.functions.numbers import norm, unit
from datamill.operators.first_wins import first_wins
from datamill.session import cut_lineage, spread

#: Rows of a cell that is not split; centres of a node; rows of a node that stream past one copy of its centres.
LEAF, FAN, STREAM = 1_000, 256, 100_000
#: Home rows that a task holds while others stream past; copies of the vectors in all cells; rows that measure a split.
BLOCK, VISITS, MEASURED = 32_768, 8, 4_096
#: Earliest rows that one task decides in order; entries of a table of similarities.
EARLY, TABLE = 32_768, 1 << 22
SLACK = 1e-6
#: Signs in a band of the hash index, and the share of pairs at the threshold that it finds.
SIGNS, RECALL = 18, 0.99


def distinct_units(df: DataFrame, order: str = "id", embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Unit vectors ``(ord, v)`` of the distinct embeddings, and repeats as ``(ord, by)``.

    Equal embeddings have cosine 1, so only the earliest of them needs comparing. Zero vectors
    have cosine 0 with everything and stay out.
    """
    rows = df.select(F.col(order).alias("ord"), F.col(embedding).alias("e")).where(norm("e") > 0)
    firsts = rows.groupBy("e").agg(F.min("ord").alias("by"))
    same = rows.join(firsts, "e").where("by < ord").select("ord", "by")
    return firsts.select(F.col("by").alias("ord"), unit("e").alias("v")), same


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _visited(vectors: np.ndarray, c: np.ndarray, least: np.ndarray, most: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """For vectors and centres whether a partner may be at home there, and the nearest centre of every vector."""
    dots = vectors @ c.T
    found = np.arccos(np.clip(dots, -1.0, 1.0))
    nearest = found.argmin(axis=1)
    visit = (found >= least - angle) & (found <= most + angle)
    if angle < math.pi / 2:
        # Beyond the border with the nearest centre by more than the angle; the border is a plane through 0.
        gaps = np.sqrt(np.maximum(0.0, 2 - 2 * c @ c.T))[nearest]
        visit &= dots[np.arange(len(nearest)), nearest][:, None] - dots <= math.sin(angle) * gaps + SLACK
    return visit, nearest


def _segments(batches: Iterator[pa.RecordBatch]):
    """Batches cut by node, each with the matrix of the node's centres and their angles."""
    held, key = None, None
    for batch in batches:
        keys = batch.column("key").to_numpy()
        parts = batch.column("part").to_numpy()
        cuts = np.r_[0, np.flatnonzero((np.diff(keys) != 0) | (np.diff(parts) != 0)) + 1, len(keys)].tolist()
        for low, high in zip(cuts[:-1], cuts[1:]):
            if high == low:
                continue
            if (keys[low], parts[low]) != key:
                key, held = (keys[low], parts[low]), None
            piece = batch.slice(low, high - low)
            slots = piece.column("slot")
            n = len(slots) - slots.null_count
            if n:
                new = [_matrix(piece.column("v").slice(0, n)), *[piece.column(c).slice(0, n).to_numpy(zero_copy_only=False) for c in ("least", "most") if c in batch.schema.names]]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if n < len(slots):
                yield int(key[0]), held, piece.slice(n)


def _past_blocks(batches: Iterator[pa.RecordBatch], names: list[str]):
    """Rows that stream past the block in front of them, cut so that a table of similarities stays small.

    Rows are sorted by ``names`` and blocks come first (``held``); gives the block's ``ord`` and matrix, and a piece of rows.
    """
    block, key = [], None
    for batch in batches:
        at = [batch.column(c).to_numpy() for c in names]
        cuts = np.flatnonzero(np.any([np.diff(a) != 0 for a in at], axis=0)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if high == low:
                continue
            if tuple(a[low] for a in at) != key:
                key, block, whole = tuple(a[low] for a in at), [], None
            piece = batch.slice(low, high - low)
            n = pc.sum(piece.column("held")).as_py() or 0
            if n:
                block.append((piece.column("ord").slice(0, n), _matrix(piece.column("v").slice(0, n))))
            if n == piece.num_rows:
                continue
            if whole is None:
                whole = (pa.concat_arrays([o for o, _ in block]), np.concatenate([v for _, v in block])) if block else (None, None)
            step = max(1, TABLE // max(1, len(whole[0]) if block else 1))
            for start in range(n, piece.num_rows, step):
                yield *whole, piece.slice(start, step)


class Cells:
    """Unit vectors placed into the cells of a tree of centres, for one cosine threshold."""

    def __init__(self, units: DataFrame, threshold: float, leaf: int | None = None, fan: int | None = None):
        self.threshold, self.leaf, self.fan = threshold, leaf or LEAF, fan or FAN
        self.angle = math.acos(min(1.0, max(-1.0, threshold))) + SLACK
        self.units = cut_lineage(spread(units))
        self.whole = False

    def placed(self) -> DataFrame:
        """``(key, ord, home, v)``: each vector in its home cell and in all cells that may hold partners.

        ``whole`` says afterwards whether all vectors are in one cell.
        """
        rows = self.units.select(F.lit(0).cast("bigint").alias("key"), "ord", F.lit(True).alias("home"), "v")
        done = None
        while True:
            sizes = rows.groupBy("key").agg(F.count_if("home").alias("homes"), F.count("*").alias("n"))
            large = cut_lineage(sizes.where(F.col("homes") > self.leaf))
            if not large.isEmpty():
                centres = self._ranged(rows.join(large, "key"), large)
                large = self._worth(rows.join(large, "key"), centres, large)
            if large.isEmpty():
                self.whole = done is None
                return rows if done is None else done.unionByName(rows)
            small = rows.join(large, "key", "left_anti")
            done = small if done is None else done.unionByName(small)
            rows = cut_lineage(self._split(rows.join(large, "key"), centres.join(large, "key", "left_semi"), large))

    def _centres(self, rows: DataFrame) -> DataFrame:
        """(key, slot, v): centres of each node, its home rows with the smallest hashes."""
        wanted = F.least(F.lit(self.fan), F.ceil(F.col("homes") / self.leaf) + 1)
        by_hash = Window.partitionBy("key").orderBy(draw("ord", "centre"), "ord")
        ranked = rows.where("home").withColumn("slot", F.row_number().over(by_hash)).where(F.col("slot") <= self.fan)
        return ranked.where(F.col("slot") <= wanted).select("key", "slot", "v")

    def _stream(self, rows: DataFrame, centres: DataFrame, large: DataFrame) -> DataFrame:
        """Rows of each node behind the node's centres, dealt over tasks by (key, part)."""
        parts = F.ceil(F.col("n") / STREAM)
        heads = centres.join(large, "key").select(
            "key", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"), "slot", F.lit(None).cast(rows.schema["ord"].dataType).alias("ord"),
            F.lit(True).alias("home"), "v", *[c for c in ("least", "most") if c in centres.columns])
        body = rows.select("key", F.pmod(F.xxhash64("ord"), parts).alias("part"), F.lit(None).cast("int").alias("slot"), "ord", "home", "v")
        both = heads.unionByName(body, allowMissingColumns=True)
        return both.repartition("key", "part").sortWithinPartitions("key", "part", F.col("slot").asc_nulls_last())

    def _ranged(self, rows: DataFrame, large: DataFrame) -> DataFrame:
        """(key, slot, v, least, most): centres with the least and greatest angle of the rows at home with them."""
        centres = cut_lineage(self._centres(rows))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, (c, *_), piece in _segments(batches):
                own = piece.filter(piece.column("home"))
                if own.num_rows:
                    found = _angles(_matrix(own.column("v")), c)
                    nearest = found.argmin(axis=1)
                    near = found[np.arange(len(nearest)), nearest]
                    slots, at = np.unique(nearest, return_inverse=True)
                    least, most = np.full(len(slots), np.inf), np.full(len(slots), -np.inf)
                    np.minimum.at(least, at, near)
                    np.maximum.at(most, at, near)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), key)), pa.array(slots + 1, pa.int32()), pa.array(least), pa.array(most)], ["key", "slot", "least", "most"])

        ranges = self._stream(rows.where("home"), centres, large).mapInArrow(measure, "key bigint, slot int, least double, most double")
        ranges = ranges.groupBy("key", "slot").agg(F.min("least").alias("least"), F.max("most").alias("most"))
        # A centre that no row is nearest to (it equals an earlier one) has an empty range.
        return cut_lineage(centres.join(ranges, ["key", "slot"], "left").select(
            "key", "slot", "v", F.coalesce("least", F.lit(9.0)).alias("least"), F.coalesce("most", F.lit(-9.0)).alias("most")))

    def _worth(self, rows: DataFrame, centres: DataFrame, large: DataFrame) -> DataFrame:
        """The large nodes whose split copies few enough rows, measured on some rows of each."""
        angle = self.angle

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, held, piece in _segments(batches):
                visit, _ = _visited(_matrix(piece.column("v")), *held, angle)
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([len(visit)]), pa.array([int(visit.sum())])], ["key", "looked", "visits"])

        few = large.withColumn("n", F.least("n", F.lit(MEASURED).cast("bigint")))
        some = rows.where(F.pmod(F.xxhash64("ord", F.lit("worth")), "n") < MEASURED).withColumn("n", F.least("n", F.lit(MEASURED).cast("bigint")))
        seen = self._stream(some, centres, few).mapInArrow(count, "key bigint, looked bigint, visits bigint")
        seen = seen.groupBy("key").agg((F.sum("visits") / F.sum("looked")).alias("each"))
        return cut_lineage(large.join(seen, "key").where(F.col("each") * F.col("n") <= VISITS * F.col("homes")).select("key", "homes", "n"))

    def _split(self, rows: DataFrame, centres: DataFrame, large: DataFrame) -> DataFrame:
        """The rows of large nodes in the nodes' children."""
        angle, fan = self.angle, self.fan

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, held, piece in _segments(batches):
                visit, nearest = _visited(_matrix(piece.column("v")), *held, angle)
                home = piece.column("home").to_numpy(zero_copy_only=False)
                visit[np.flatnonzero(home), nearest[home]] = True
                row, slot = np.nonzero(visit)
                taken = piece.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key * (fan + 1) + slot + 1), taken.column("ord"), pa.array(home[row] & (slot == nearest[row])), taken.column("v")], ["key", "ord", "home", "v"])

        kind = rows.schema["ord"].dataType.simpleString()
        return self._stream(rows, centres, large).mapInArrow(place, f"key bigint, ord {kind}, home boolean, v array<double>")

    def visits(self, placed: DataFrame) -> DataFrame:
        """One row: vectors, cells, and the mean number of cells a vector is in."""
        total = placed.agg(F.count_if("home").alias("vectors"), F.count_distinct("key").alias("cells"), F.count("*").alias("n"))
        return total.select("vectors", "cells", (F.col("n") / F.col("vectors")).alias("cells_per_vector"))

    def verify(self, cands: DataFrame) -> DataFrame:
        lo = self.units.select(F.col("ord").alias("lo"), F.col("v").alias("a"))
        hi = self.units.select(F.col("ord").alias("hi"), F.col("v").alias("b"))
        score = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return cands.join(lo, "lo").join(hi, "hi").where(score >= self.threshold).select("lo", "hi")

    def pairs(self, placed: DataFrame) -> DataFrame:
        """Similar pairs ``(lo, hi, similarity)``; every pair is found in the home cell of ``lo``."""
        sizes = placed.groupBy("key").agg(F.ceil(F.count_if("home") / BLOCK).alias("blocks"), F.ceil(F.count("*") / STREAM).alias("parts"))
        rows = placed.join(sizes.where("blocks > 0"), "key")
        block, part = F.xxhash64("ord"), F.xxhash64("ord", F.lit("part"))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
        left = rows.where("home").select("key", F.pmod(block, "blocks").alias("i"), every("parts").alias("j"), F.lit(True).alias("held"), "ord", "v")
        right = rows.select("key", every("blocks").alias("i"), F.pmod(part, "parts").alias("j"), F.lit(False).alias("held"), "ord", "v")
        both = left.unionByName(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", F.desc("held"))
        threshold = self.threshold

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for names, vectors, piece in _past_blocks(batches, ["key", "i", "j"]):
                if names is None:
                    continue
                scores = _matrix(piece.column("v")) @ vectors.T
                row, col = np.nonzero(scores >= threshold)
                found = pa.RecordBatch.from_arrays([names.take(pa.array(col)), piece.column("ord").take(pa.array(row)), pa.array(scores[row, col])], ["lo", "hi", "similarity"])
                yield found.filter(pc.less(found.column("lo"), found.column("hi")))

        kind = self.units.schema["ord"].dataType.simpleString()
        return both.mapInArrow(compare, f"lo {kind}, hi {kind}, similarity double")


class SignIndex:
    """Unit vectors by their signs on random directions: an index in which similar vectors share keys, most of them.

    Two vectors at the threshold agree in a sign with probability 1 - angle / pi, so in a band of ``signs`` with that
    to the power of ``signs``; bands are added until the wanted recall is reached. Nearer pairs are found more often.
    """

    def __init__(self, units: DataFrame, threshold: float, recall: float = RECALL, signs: int = SIGNS):
        self.threshold, self.signs = threshold, signs
        self.units = cut_lineage(spread(units))
        equal = (1 - math.acos(min(1.0, threshold)) / math.pi) ** signs
        self.bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-equal))) if equal < 1 else 1

    def index(self) -> DataFrame:
        """``(key, ord)``, one row per band."""
        bands, signs = self.bands, self.signs

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = _matrix(batch.column("v"))
                directions = np.random.default_rng(7).normal(size=(vectors.shape[1], bands * signs))
                bits = (vectors @ directions > 0).reshape(len(vectors), bands, signs)
                codes = bits @ (1 << np.arange(signs, dtype=np.int64)) * bands + np.arange(bands)
                yield pa.RecordBatch.from_arrays([pa.array(codes.ravel()), batch.column("ord").take(pa.array(np.repeat(np.arange(len(vectors)), bands)))], ["key", "ord"])

        return self.units.mapInArrow(keys, f"key bigint, ord {self.units.schema['ord'].dataType.simpleString()}")

    def verify(self, cands: DataFrame, keep_similarity: bool = False) -> DataFrame:
        lo = self.units.select(F.col("ord").alias("lo"), F.col("v").alias("a"))
        hi = self.units.select(F.col("ord").alias("hi"), F.col("v").alias("b"))
        score = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("similarity")
        found = cands.join(lo, "lo").join(hi, "hi").select("lo", "hi", score).where(F.col("similarity") >= self.threshold)
        return found if keep_similarity else found.select("lo", "hi")

    def pairs(self, index: DataFrame, keep_similarity: bool = False) -> DataFrame:
        both = index.withColumnRenamed("ord", "lo").join(index.withColumnRenamed("ord", "hi"), "key").where("lo < hi")
        return self.verify(both.select("lo", "hi").distinct(), keep_similarity)


def cosine_pairs(df: DataFrame, threshold: float = 0.92, order: str = "id", embedding: str = "embedding", approximate: bool = False) -> DataFrame:
    """``(lo, hi, similarity)`` of all distinct embeddings with at least this cosine; ``approximate``: of nearly all."""
    units, _ = distinct_units(df, order, embedding)
    if approximate:
        signs = SignIndex(units, threshold)
        return signs.pairs(cut_lineage(signs.index()), keep_similarity=True)
    cells = Cells(units, threshold)
    return cells.pairs(cut_lineage(cells.placed()))


def _decide(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows in order, each with the earliest kept row (``by``) that it is similar to, or none if it is kept."""
    kept, names = [], []
    for batch in batches:
        for start in range(0, batch.num_rows, LEAF):
            piece = batch.slice(start, LEAF)
            vectors, ords = _matrix(piece.column("v")), piece.column("ord").to_pylist()
            by = [None] * len(ords)
            first = 0
            for block in kept:
                hit = vectors @ block.T >= threshold
                for i in np.flatnonzero(hit.any(axis=1)).tolist():
                    by[i] = names[first + int(hit[i].argmax())] if by[i] is None else by[i]
                first += len(block)
            left = [i for i, b in enumerate(by) if b is None]
            near = vectors[left] @ vectors[left].T >= threshold
            for a, i in enumerate(left):
                if by[i] is None:
                    for b in np.flatnonzero(near[a, a + 1:]).tolist():
                        j = left[a + 1 + b]
                        by[j] = ords[i] if by[j] is None else by[j]
            stays = [i for i in left if by[i] is None]
            if stays:
                kept.append(vectors[stays])
                names += [ords[i] for i in stays]
            yield pa.RecordBatch.from_arrays([piece.column("ord"), pa.array(by, piece.column("ord").type), piece.column("v")], ["ord", "by", "v"])


def first_wins_in_order(units: DataFrame, threshold: float) -> DataFrame:
    """Dropped rows ``(ord, by)`` of unit vectors with different ``ord``, without listing pairs.

    The earliest rows, as many as a task holds, are decided there in order; those it keeps drop their later partners while
    these stream past, and the rest goes on in the same way.
    """
    kind = units.schema["ord"].dataType.simpleString()
    form = f"ord {kind}, by {kind}, v array<double>"
    rest = units.select("ord", F.lit(None).cast(kind).alias("by"), "v").where(F.col("ord").isNotNull())
    dropped = rest.where("false").select("ord", "by")
    while (n := rest.count()):
        early, late = rest, rest.where("false")
        if n > EARLY:
            some = rest.where(F.pmod(F.xxhash64("ord", F.lit("early")), F.lit(n)) < MEASURED).agg(F.sort_array(F.collect_list("ord")).alias("ords"))
            end = some.select(F.get("ords", F.floor(F.size("ords") * F.lit(EARLY / n)).cast("int"))).first()[0]
            if end is not None:
                early, late = rest.where(F.col("ord") <= F.lit(end)), rest.where(F.col("ord") > F.lit(end))
        solved = cut_lineage(early.select("ord", "v").repartition(1).sortWithinPartitions("ord").mapInArrow(lambda b: _decide(b, threshold), form))
        parts = -(-n // STREAM)
        heads = solved.where("by IS NULL").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"), F.lit(True).alias("held"), "ord", "v")
        body = late.select(F.pmod(F.xxhash64("ord"), F.lit(parts).cast("bigint")).alias("part"), F.lit(False).alias("held"), "ord", "v")

        def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for names, vectors, piece in _past_blocks(batches, ["part"]):
                near = _matrix(piece.column("v")) @ vectors.T >= threshold
                first = pa.array(near.argmax(axis=1), mask=~near.any(axis=1))
                yield pa.RecordBatch.from_arrays([piece.column("ord"), names.take(first), piece.column("v")], ["ord", "by", "v"])

        both = heads.unionByName(body).repartition("part").sortWithinPartitions("part", F.desc("held"), "ord")
        seen = cut_lineage(both.mapInArrow(pass_by, form))
        gone = "by IS NOT NULL"
        dropped = dropped.unionByName(solved.where(gone).select("ord", "by")).unionByName(seen.where(gone).select("ord", "by"))
        rest = seen.where("by IS NULL")
    return dropped


def semantic_duplicates(df: DataFrame, threshold: float = 0.92, order: str = "id", embedding: str = "embedding", approximate: bool = False) -> DataFrame:
    """``(ord, by)`` of rows whose embedding is close to that of an earlier kept row."""
    units, same = distinct_units(df, order, embedding)
    if approximate:
        signs = SignIndex(units, threshold)
        return first_wins(cut_lineage(signs.index()), signs.verify, signs.pairs).unionByName(same)
    cells = Cells(units, threshold)

    def pairs(rest: DataFrame) -> DataFrame:
        return cells.pairs(rest).select("lo", "hi")

    placed = cells.placed()
    if cells.whole and cells.units.groupBy("ord").count().where("count > 1").isEmpty():
        return first_wins_in_order(cells.units, threshold).unionByName(same)
    # Pairs of a cell are found in matrix products, so a cell is crowded later than other keys.
    return first_wins(cut_lineage(placed), cells.verify, pairs, crowded=BLOCK // 4).unionByName(same)


def semantic_deduplicate(df: DataFrame, threshold: float = 0.92, order: str = "id", embedding: str = "embedding", approximate: bool = False) -> DataFrame:
    """Kept rows under the first-wins rule on cosine; rows without an embedding are kept."""
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    gone = semantic_duplicates(df, threshold, order, embedding, approximate)
    return df.join(gone.select(F.col("ord").alias(order)), order, "left_anti")

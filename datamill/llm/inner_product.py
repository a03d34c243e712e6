"""Exact top-k inner products with norm buckets.

Vectors are dealt into buckets of similar length: the lengths of a bucket differ by a factor of ``RATIO`` at most. A
bucket is cut into blocks by direction (a kd-tree over a bounded sample of directions; blocks that stay crowded are cut by
hash), and each block has a ball that holds its vectors. A query first searches the block whose centre has the largest
product with it, which gives a lower bound t for its k-th score. A block of greatest length l, centre c and radius r can
matter only if |q| * l >= t and q * c + |q| * r >= t, and within it only vectors whose cosine with the query is at least the
local threshold t / (|q| * l). The threshold chooses the pruning: a low one leaves the length test alone; a high one tests
coordinates, the query's largest first: what the tested ones give and the most that the others can add
(by the lengths of what is left of both directions) must reach the threshold. What remains is verified by its product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from datamill.llm.common import written
from datamill.llm.projected_nn import Tree
from datamill.llm.vectors import best, in_chunks, matrix, one_of_each, sample_of, search, top, usable

K, SCALE = 5, 256
RATIO = 0.9  # shortest to longest length of a bucket
BLOCK = 4096  # rows of a block, about
SAMPLE, LEAF = 8192, 8  # directions that the tree's planes are chosen from, and how many of them a leaf has
STEEP, FOCUS = 0.1, 0.9  # local cosine from which coordinates are tested, and what share of the query's square they hold
GROUP, ROWS = 4096, 256  # balls of a task, queries held against a matrix at once
EXACT = 2.0**53
SMALLEST, LARGEST = -(2**63), 2**63 - 1


def products(v: np.ndarray, q: np.ndarray, longest: float, length: float) -> np.ndarray:
    """Integer inner products. Beyond what doubles hold exactly they are made of Python integers, cut to a long."""
    if longest * length < EXACT:
        return (v @ q).astype(np.int64)
    whole = [int(x) for x in q]
    return np.array([max(SMALLEST, min(LARGEST, sum(int(a) * b for a, b in zip(row, whole)))) for row in v], np.int64)


class Block:
    """The vectors of a block, with their directions by coordinate."""

    def __init__(self, v: np.ndarray, lengths: np.ndarray):
        self.v, self.lengths, self.longest = v, lengths, lengths.max(initial=0.0)
        self.axes = np.ascontiguousarray((v / np.where(lengths > 0, lengths, 1.0)[:, None]).T)
        self.squares = self.axes**2

    def candidates(self, q: np.ndarray, norm: np.ndarray, bound: np.ndarray) -> Iterator[np.ndarray]:
        """For each query the places of the vectors that may score its ``bound`` or more."""
        for start in range(0, len(q), ROWS):
            some = slice(start, start + ROWS)
            yield from self._some(q[some], norm[some], bound[some])

    def _some(self, q: np.ndarray, norm: np.ndarray, bound: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(all="ignore"):
            least = bound - 1e-9 * (np.abs(bound) + 1)
            local = least / (norm * self.longest)
            direction = q / norm[:, None]
        steep = np.nonzero(np.isfinite(local) & (local >= STEEP) & (local <= 1) & np.isfinite(norm * self.longest))[0]
        stay = np.empty((0, 0))
        if len(steep):
            # The query's largest coordinates, until they hold FOCUS of its square.
            own = direction[steep]
            order = np.argsort(-np.abs(own), axis=1, kind="stable")
            held = np.cumsum(np.take_along_axis(own, order, 1) ** 2, 1)
            tested = np.zeros(own.shape)
            np.put_along_axis(tested, order, (held - np.take_along_axis(own, order, 1) ** 2 < FOCUS).astype(float), 1)
            left = np.maximum(0.0, 1 - (own**2 * tested).sum(1))[:, None] * np.maximum(0.0, 1 - tested @ self.squares)
            stay = (own * tested) @ self.axes + np.sqrt(left) + 1e-7 >= local[steep, None]
        place = {at: i for i, at in enumerate(steep)}
        for i in range(len(q)):
            if bound[i] == -np.inf or not norm[i]:
                yield np.arange(len(self.lengths))
            elif i in place:
                yield np.nonzero(stay[place[i]] & (self.lengths * norm[i] >= least[i]))[0]
            else:
                yield np.nonzero(self.lengths * norm[i] >= least[i])[0]


def _kernel(k: int):
    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> Iterator[tuple]:
        ids, block = rows["id"].to_numpy(), Block(matrix(rows["v"]), rows["length"].to_numpy())
        queries, norms = matrix(asked["v"]), asked["length"].to_numpy()
        for qid, q, norm, places in zip(asked["id"].to_numpy(), queries, norms, block.candidates(queries, norms, asked["bound"].to_numpy())):
            places = places[ids[places] != qid]
            if len(places):
                scores = products(block.v[places], q, block.longest, norm)
                keep = top(scores, ids[places], k, largest=True)
                yield qid, ids[places[keep]], scores[keep]

    return run


def ball(rows: pd.DataFrame) -> pd.DataFrame:
    """Centre, radius and greatest length of a block; a radius that doubles can't hold is infinite."""
    v = matrix(rows["v"])
    with np.errstate(over="ignore", invalid="ignore"):
        centre = v.mean(0)
        if not np.isfinite(centre).all():
            centre = np.zeros(v.shape[1])
        radius = np.sqrt(((v - centre) ** 2).sum(1)).max() * (1 + 1e-9)
    return pd.DataFrame({"cell": rows["cell"].iloc[:1], "chunk": rows["chunk"].iloc[0], "centre": [centre], "radius": radius, "longest": rows["length"].max()})


def _reaches(balls: pd.DataFrame, asked: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For some queries at a time: their products with the centres, and the most that a vector of a ball can score."""
    centre, radius, longest = matrix(balls["centre"]), balls["radius"].to_numpy(), balls["longest"].to_numpy()
    q, norm = matrix(asked["v"]), asked["length"].to_numpy()
    for start in range(0, len(q), ROWS):
        some = slice(start, start + ROWS)
        with np.errstate(over="ignore", invalid="ignore"):
            near = np.nan_to_num(q[some] @ centre.T, nan=0.0)
            most = np.minimum(near + norm[some, None] * radius, norm[some, None] * longest)
            most = most + 1e-9 * norm[some, None] * longest + 1e-6
        # The slack covers rounding of both terms; what has no value may hold anything.
        yield some, near, np.where(np.isnan(most), np.inf, most)


def _first(balls: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """For each query the ball of this group whose centre has the largest product with it."""
    cell, chunk, out = balls["cell"].to_numpy(), balls["chunk"].to_numpy(), []
    for some, near, _ in _reaches(balls, asked) if len(balls) and len(asked) else ():
        at = near.argmax(1)
        out.append(pd.DataFrame({"id": asked["id"].to_numpy()[some], "cell": cell[at], "chunk": chunk[at], "near": near.max(1)}))
    return pd.concat(out) if out else pd.DataFrame({"id": [], "cell": [], "chunk": [], "near": []}).astype({"id": "int64", "cell": "int64", "chunk": "int32"})


def _others(balls: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """All balls of this group, but the one searched first, that may hold a score of a query's bound."""
    cell, chunk, out = balls["cell"].to_numpy(), balls["chunk"].to_numpy(), []
    for some, _, most in _reaches(balls, asked) if len(balls) and len(asked) else ():
        part = asked.iloc[some]
        been = (part["cell"].to_numpy()[:, None] == cell) & (part["chunk"].to_numpy()[:, None] == chunk)
        row, at = np.nonzero((most >= part["bound"].to_numpy()[:, None]) & ~been)
        out.append(pd.DataFrame({"id": part["id"].to_numpy()[row], "cell": cell[at], "chunk": chunk[at], "bound": part["bound"].to_numpy()[row]}))
    return pd.concat(out) if out else pd.DataFrame({"id": [], "cell": [], "chunk": [], "bound": []}).astype({"id": "int64", "cell": "int64", "chunk": "int32"})


def _by_group(balls: DataFrame, groups: int, asked: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on every group of balls and every part of the queries: a group has about ``GROUP`` balls."""
    size = F.lit(GROUP)
    parts = max(1, math.ceil(asked.count() / GROUP))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = balls.toDF(*balls.columns).withColumn("group", F.pmod(F.xxhash64("cell", "chunk"), F.lit(groups)).cast("int")).withColumn("part", each(parts))
    right = asked.toDF(*asked.columns).withColumn("part", F.pmod(F.xxhash64("id", size), F.lit(parts)).cast("int")).withColumn("group", each(groups))
    return left.groupBy("group", "part").cogroup(right.groupBy("group", "part")).applyInPandas(work, schema)


def placed_rows(rows: DataFrame) -> DataFrame:
    """Add cell (norm bucket and direction) and chunk to rows (id, v, length)."""
    bucket = "CASE WHEN length = 0 THEN 2000000 WHEN length = double('infinity') THEN -2000000 ELSE int(-floor(ln(length) / -ln(%r))) END" % RATIO
    rows = rows.withColumn("bucket", F.expr(bucket))
    # As many rows as lengths of doubles differ by RATIO: some thousands at most.
    counts = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}
    depths = {b: max(0, math.ceil(math.log2(n / BLOCK))) for b, n in counts.items()}
    sided = rows.where((F.col("length") > 0) & (F.col("length") < float("inf")))
    sample = sample_of(sided.select("id", "v", "length"), sum(counts.values()), SAMPLE)
    unit = matrix(sample["v"]) / sample["length"].to_numpy()[:, None] if len(sample) else np.zeros((0, 1))
    depth = min(max(depths.values(), default=0), int(math.log2(max(1, len(unit) // LEAF))))
    tree = Tree(unit, depth)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            length = part["length"].to_numpy()
            leaf = tree.cell(matrix(part["v"]) / np.where(length > 0, length, 1.0)[:, None])
            # A small bucket uses the upper planes only.
            up = np.array([max(0, depth - depths[b]) for b in part["bucket"]])
            yield part.assign(cell=part["bucket"].to_numpy().astype(np.int64) * (1 << 20) + (leaf >> up)).drop(columns="bucket")

    return in_chunks(rows.mapInPandas(place, "id long, v array<double>, length double, cell long"), "cell", BLOCK)


def largest_products(vectors: DataFrame, every: int = 50, k: int = K, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest products of each row whose id is divisible by ``every``.

    Components x count as floor(scale * x). A query meets all rows but those of its own id, and gets all of them if
    there are fewer than k; ties go to the smaller id. Null and non-finite vectors take no part, zero vectors do.
    Of a repeated id the smallest vector asks. Sums beyond a long are cut to its range. Without any row there is no result.
    """
    # floor as a double: exact for any finite component.
    rows = usable(vectors, key, vector, zero=True)

    def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            v = np.floor(scale * matrix(part["v"])) if len(part) else np.empty((0, 1))
            with np.errstate(over="ignore"):
                yield pd.DataFrame({"id": part["id"], "v": list(v), "length": np.sqrt((v**2).sum(1)) * (1 + 1e-12)})

    rows = written(rows.mapInPandas(whole, "id long, v array<double>, length double"), "whole")
    placed = written(placed_rows(rows), "norms")
    asked = written(one_of_each(placed.where(F.col("id") % every == 0)).select("id", "v", "length"), "asked")
    balls = written(placed.groupBy("cell", "chunk").applyInPandas(ball, "cell long, chunk int, centre array<double>, radius double, longest double"), "balls")
    groups = max(1, math.ceil(balls.count() / GROUP))
    first = _by_group(balls, groups, asked, _first, "id long, cell long, chunk int, near double")
    first = first.groupBy("id").agg(F.max(F.struct("near", "cell", "chunk")).alias("at")).select("id", "at.cell", "at.chunk", F.lit(float("-inf")).alias("bound"))
    first = written(first, "first")
    kernel = _kernel(k)
    found = written(search(placed, asked, first, kernel, "long"), "head")
    bounds = found.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("low"), F.count("*").alias("n"))
    bounds = bounds.select("id", F.when(F.col("n") >= k, F.col("low").cast("double")).otherwise(float("-inf")).alias("bound"))
    todo = asked.join(first.drop("bound"), "id").join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    visits = written(_by_group(balls, groups, todo, _others, "id long, cell long, chunk int, bound double"), "visits")
    rest = search(placed, asked, visits, kernel, "long")
    return best(found.unionByName(rest), k, largest=True)

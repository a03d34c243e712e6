"""Approximate nearest neighbours by stable projections and a kd-tree.

Vectors are projected onto a few directions drawn from the normal (2-stable) distribution: for a pair at distance
d the squared projected distance is d² times a chi-square value with as many degrees as directions. A kd-tree
over the projections, whose upper levels come from a bounded sample, deals all vectors into cells.

A query first searches its home cell, which bounds its k-th distance d. Other cells can hold a nearer vector with
probability above 1 - CERTAINTY only within the projected radius d * sqrt(chi-square quantile), so the query
visits the cells whose box reaches into that radius, nearest vectors in projection first, and stops in each as
soon as the chi-square test holds for the nearest d by then. Found vectors are measured exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from datamill.llm.common import written
from datamill.llm.vectors import BLOCK, best, in_chunks, matrix, one_of_each, sample_of, search, top, usable

K, DIRECTIONS, CERTAINTY, SEED = 10, 8, 0.98, 11
SAMPLE, CELLS = 20_000, 4096  # rows that the tree's planes are chosen from, most cells
STEP = 256  # vectors verified between two tests


def chi_square_below(x: float, m: int) -> float:
    """P(chi-square with an even number m of degrees <= x)."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, m // 2):
        term *= half / i
        total += term
    return 1.0 - math.exp(-half) * total


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_below(mid, m) < p else (low, mid)
    return high


def directions(size: int, m: int = DIRECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, m))


class Tree:
    """Planes of the upper levels, as arrays by heap position: axis and place; leaves are the cells."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.m = depth, sample.shape[1]
        self.axis, self.place = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        self._split(1, sample)

    def _split(self, node: int, rows: np.ndarray) -> None:
        if node >= 1 << self.depth:
            return
        if len(rows):
            self.axis[node] = int(np.argmax(rows.max(0) - rows.min(0)))
            self.place[node] = float(np.median(rows[:, self.axis[node]]))
        right = rows[:, self.axis[node]] > self.place[node]
        self._split(2 * node, rows[~right])
        self._split(2 * node + 1, rows[right])

    def cell(self, rows: np.ndarray) -> np.ndarray:
        node = np.ones(len(rows), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (rows[np.arange(len(rows)), self.axis[node]] > self.place[node])
        return node - (1 << self.depth)

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper corners of the cells."""
        low, high = np.full((2 << self.depth, self.m), -np.inf), np.full((2 << self.depth, self.m), np.inf)
        for node in range(1, 1 << self.depth):
            for side in (0, 1):
                low[2 * node + side], high[2 * node + side] = low[node], high[node]
                (low if side else high)[2 * node + side, self.axis[node]] = self.place[node]
        return low[1 << self.depth:], high[1 << self.depth:]


def near_cells(tree: Tree, q: np.ndarray, reach: np.ndarray) -> list[np.ndarray]:
    """For each projected query the cells whose box is within its squared reach."""
    low, high = tree.boxes()
    out = []
    for row, r in zip(q, reach):
        gap = np.maximum(np.maximum(low - row, row - high), 0.0)
        out.append(np.nonzero((gap**2).sum(1) <= r)[0])
    return out


def distances(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances; where squares leave the range of doubles, differences are scaled first."""
    difference = v - q
    with np.errstate(over="ignore"):
        found = np.sqrt((difference**2).sum(1))
    for i in np.nonzero(np.isinf(found))[0]:
        most = np.abs(difference[i]).max()
        found[i] = most * np.sqrt(((difference[i] / most) ** 2).sum()) if np.isfinite(most) else np.inf
    return found


def _kernel(k: int, certainty: float, m: int):
    quantile = chi_square_quantile(certainty, m)

    def run(block: pd.DataFrame, asked: pd.DataFrame) -> Iterator[tuple]:
        ids, v, p = block["id"].to_numpy(), matrix(block["v"]), matrix(block["p"])
        for qid, qv, qp, bound in zip(asked["id"].to_numpy(), matrix(asked["v"]), matrix(asked["p"]), asked["bound"].to_numpy()):
            with np.errstate(over="ignore"):
                away = ((p - qp) ** 2).sum(1)
            order = np.nonzero(ids != qid)[0]
            order = order[np.argsort(away[order], kind="stable")]
            found, scores = np.empty(0, np.int64), np.empty(0)
            for start in range(0, len(order), STEP):
                # The test: what is still unseen is nearer than the bound with a probability below 1 - certainty.
                if away[order[start]] > quantile * bound**2:
                    break
                take = order[start:start + STEP]
                distance = distances(v[take], qv)
                found, scores = np.concatenate([found, take]), np.concatenate([scores, distance])
                keep = top(scores, ids[found], k, largest=False)
                found, scores = found[keep], scores[keep]
                if len(scores) == k:
                    bound = min(bound, scores[-1])
            if len(found):
                yield qid, ids[found], scores

    return run


def nearest(vectors: DataFrame, every: int = 100, k: int = K, key: str = "vec_id", vector: str = "embedding", certainty: float = CERTAINTY, m: int = DIRECTIONS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``.

    The score is the Euclidean distance of the original vectors; ties go to the smaller id. A query meets all
    rows but those of its own id, and all of them are returned if there are fewer than k. Null, zero and
    non-finite vectors take no part; without any row there is no result.
    """
    rows = usable(vectors, key, vector, zero=False)
    first = rows.select(F.size("v").alias("n")).first()
    axes = directions(first["n"] if first else 1, m)

    def project(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(p=list(matrix(part["v"]) @ axes) if len(part) else [])

    rows = written(rows.mapInPandas(project, "id long, v array<double>, p array<double>"), "projected")
    total = rows.count()
    depth = max(0, min(int(math.log2(CELLS)), math.ceil(math.log2(max(1, total / BLOCK)))))
    sample = matrix(sample_of(rows.select("id", "p"), total, SAMPLE)["p"]).reshape(-1, m)
    tree = Tree(sample, depth)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(cell=tree.cell(matrix(part["p"]).reshape(-1, m)).astype(np.int32))

    placed = rows.mapInPandas(place, "id long, v array<double>, p array<double>, cell int")
    placed = written(in_chunks(placed, "cell"), "cells")
    asked = written(one_of_each(placed.where(F.col("id") % every == 0)).select("id", "v", "p", "cell"), "asked")
    queries = asked.drop("cell")
    chunks = written(placed.select("cell", "chunk").distinct(), "chunks")
    homes = chunks.groupBy(F.col("cell").alias("c")).agg(F.min("chunk").alias("chunk"))
    home = asked.join(homes, F.col("cell") == F.col("c")).select("id", "p", "cell", "chunk", F.lit(float("inf")).alias("bound"))
    kernel = _kernel(k, certainty, m)
    first_found = written(search(placed, queries, home, kernel, "double"), "home")
    bounds = first_found.groupBy(F.col("query_id").alias("q")).agg(F.max("score").alias("far"), F.count("*").alias("n"))
    bounds = bounds.select("q", F.when(F.col("n") >= k, F.col("far")).otherwise(float("inf")).alias("bound"))
    todo = home.drop("bound").join(bounds, home["id"] == bounds["q"], "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))).drop("q")
    quantile = chi_square_quantile(certainty, m)

    def visit(parts_in: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts_in:
            cells = near_cells(tree, matrix(part["p"]).reshape(-1, m), quantile * part["bound"].to_numpy() ** 2)
            yield pd.DataFrame({"id": part["id"], "home": part["cell"], "home_chunk": part["chunk"], "bound": part["bound"], "cell": [c.astype(np.int32) for c in cells]})

    visits = todo.mapInPandas(visit, "id long, home int, home_chunk int, bound double, cell array<int>")
    visits = visits.withColumn("cell", F.explode("cell")).join(chunks, "cell").where((F.col("cell") != F.col("home")) | (F.col("chunk") != F.col("home_chunk")))
    rest = search(placed, queries, written(visits.select("id", "cell", "chunk", "bound"), "visits"), kernel, "double")
    return best(first_found.unionByName(rest), k, largest=False)

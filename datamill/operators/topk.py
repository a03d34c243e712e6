"""The k most similar rows of many queries, by an inverted index of the queries past which the rows stream.

A block of queries of bounded size is sent to all tasks; larger query tables take several passes. A task knows the
k-th best similarity of every query so far. A term is worth what sharing it can add to the similarity at most, so a query skips
its commonest terms while their worth adds up to less than its k-th best: a row that shares nothing else
cannot come in. The rarer terms find rows; the number of shared ones, the sizes of both sets and the number of skipped
terms bound the similarity from above, and the skipped terms are looked up only for rows whose bound reaches the
k-th best. Every task hands on k rows per query, so the shuffle doesn't grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Terms of queries that are sent to the tasks at once; entries of a table of rows by queries; room for rounding.
BLOCK_TERMS, CELLS, SLACK = 2_000_000, 1 << 21, 1e-9


class QueryIndex:
    """Queries as lists of distinct terms; words and word pairs are told apart by the first letter of a term."""

    def __init__(self, words: list[int], pairs: list[int], terms: list[list[str]], k: int):
        self.k, self.words, self.pairs = k, np.array(words, np.int64), np.array(pairs, np.int64)
        self.vocabulary = pa.array(sorted({t for ts in terms for t in ts}), pa.string())
        number = {t: i for i, t in enumerate(self.vocabulary.to_pylist())}
        self.query = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        self.term = np.array([number[t] for ts in terms for t in ts], np.int64)
        self.is_word = np.array([t.startswith("u ") for t in number], bool)
        word = self.is_word[self.term]
        own_words, own_pairs = self.words[self.query], self.pairs[self.query]
        self.worth = np.where(word, np.where(own_pairs == 0, 1.0, 0.6) / np.maximum(own_words, 1), 0.4 / np.maximum(own_pairs, 1))


class Search:
    """What one task has found: the best rows of every query, and how many pairs it looked at in full."""

    def __init__(self, index: QueryIndex):
        self.index, n = index, len(index.words)
        self.kth, self.scored = np.zeros(n), 0
        self.found = (np.empty(0, np.int64), np.empty(0), None)
        self.seen = np.zeros(len(index.is_word), np.int64)

    def _similarity(self, row: np.ndarray, query: np.ndarray, su: np.ndarray, sb: np.ndarray, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        n, m, qn, qm = words[row], pairs[row], self.index.words[query], self.index.pairs[query]
        su, sb = np.minimum(su, np.minimum(n, qn)), np.minimum(sb, np.minimum(m, qm))
        uni = su / np.maximum(n + qn - su, 1)
        none = (m == 0) & (qm == 0)
        return 0.6 * uni + 0.4 * np.where(none, uni, sb / np.maximum(m + qm - sb, 1))

    def _skipped(self) -> np.ndarray:
        """For every term of every query whether it is among the commonest that are not worth the k-th best."""
        index = self.index
        order = np.lexsort((index.term, -self.seen[index.term], index.query))
        total = np.cumsum(index.worth[order])
        query = index.query[order]
        before = np.r_[0.0, total][np.searchsorted(query, np.arange(len(index.words)))]
        skipped = np.empty(len(order), bool)
        skipped[order] = total - before[query] < self.kth[query] - SLACK
        return skipped

    def add(self, ids: np.ndarray, words: np.ndarray, pairs: np.ndarray, lists: pa.ListArray) -> None:
        """Look at rows with their numbers of words and pairs and their lists of terms."""
        index, n = self.index, len(self.kth)
        code = pc.index_in(lists.flatten(), value_set=index.vocabulary)
        known = code.is_valid()
        row = pc.list_parent_indices(lists).filter(known).to_numpy().astype(np.int64)
        code = code.filter(known).to_numpy().astype(np.int64)
        self.seen += np.bincount(code, minlength=len(index.is_word))
        skipped = self._skipped()

        # The rarer terms: all (row, query) pairs that share one, with the numbers of shared words and pairs.
        term, query = index.term[~skipped], index.query[~skipped]
        order = np.argsort(term, kind="stable")
        term, query = term[order], query[order]
        first = np.searchsorted(term, code)
        hits = np.searchsorted(term, code, side="right") - first
        at = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits - first, hits)
        pair = np.repeat(row, hits) * n + query[at]
        word = np.repeat(index.is_word[code], hits)
        pair, inverse = np.unique(pair, return_inverse=True)
        su, sb = (np.bincount(inverse[w], minlength=len(pair)) for w in (word, ~word))
        row_of, query_of = pair // n, pair % n

        # Pairs that the skipped terms could still lift to the k-th best.
        is_word = index.is_word[index.term]
        rest_u, rest_b = (np.bincount(index.query[skipped & w], minlength=n) for w in (is_word, ~is_word))
        most = self._similarity(row_of, query_of, su + rest_u[query_of], sb + rest_b[query_of], words, pairs)
        near = most >= self.kth[query_of] - SLACK
        row_of, query_of, su, sb = row_of[near], query_of[near], su[near], sb[near]
        self.scored += len(row_of)
        held = np.sort(row * len(index.is_word) + code)
        order = np.argsort(index.query[skipped], kind="stable")
        term = index.term[skipped][order]
        each = np.bincount(index.query[skipped], minlength=n)
        begin = np.cumsum(each) - each
        asked = each[query_of]
        owner = np.repeat(np.arange(len(row_of)), asked)
        term = term[np.arange(asked.sum()) - np.repeat(np.cumsum(asked) - asked - begin[query_of], asked)]
        wanted = row_of[owner] * len(index.is_word) + term
        place = np.searchsorted(held, wanted)
        shared = np.zeros(len(wanted), bool)
        inside = place < len(held)
        shared[inside] = held[place[inside]] == wanted[inside]
        word = index.is_word[term]
        su = su + np.bincount(owner[shared & word], minlength=len(su))
        sb = sb + np.bincount(owner[shared & ~word], minlength=len(sb))
        self._keep(query_of, self._similarity(row_of, query_of, su, sb, words, pairs), ids[row_of])

    def _keep(self, query: np.ndarray, similarity: np.ndarray, ids: np.ndarray) -> None:
        old = self.found
        if old[2] is not None:
            query, similarity, ids = (np.concatenate(x) for x in zip(old, (query, similarity, ids)))
        rank = np.unique(ids, return_inverse=True)[1]
        order = np.lexsort((rank, -similarity, query))
        query, similarity, ids = query[order], similarity[order], ids[order]
        begin = np.searchsorted(query, np.arange(len(self.kth)))
        place = np.arange(len(query)) - begin[query]
        keep = place < self.index.k
        last = place == self.index.k - 1
        self.kth[query[last]] = similarity[last]
        self.found = (query[keep], similarity[keep], ids[keep])


def best_rows(rows: DataFrame, queries: DataFrame, k: int, id: str, query_id: str) -> DataFrame:
    """``(query_id, id, similarity)``: at least the k best rows of every query among those that share a term with it.

    ``rows``: (id, words, pairs, terms); ``queries``: (query_id, q_words, q_pairs, terms). The ids of a row are not null.
    """
    sizes = queries.select(F.count("*").alias("n"), F.sum(F.size("terms")).alias("terms")).first()
    blocks = max(1, -(-(sizes["terms"] or 0) // BLOCK_TERMS))
    kinds = f"`{query_id}` {queries.schema[query_id].dataType.simpleString()}, `{id}` {rows.schema[id].dataType.simpleString()}, similarity double"
    out = None
    for block in range(blocks):
        # A block holds about BLOCK_TERMS terms, whatever the number of queries.
        part = queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == block).toArrow()
        names, terms = part.column(query_id).combine_chunks(), part.column("terms").to_pylist()
        index = rows.sparkSession.sparkContext.broadcast(
            (names, QueryIndex(part.column("q_words").to_pylist(), part.column("q_pairs").to_pylist(), terms, k)))
        found = rows.select(id, "words", "pairs", "terms").mapInArrow(_searcher(index, id, query_id), kinds)
        out = found if out is None else out.unionByName(found)
    return out


def _searcher(shared, id: str, query_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, index = shared.value
        search, kind, step = Search(index), None, 16
        most = max(16, CELLS // max(len(index.words), 1))
        for batch in batches:
            kind, low = batch.schema.field(id).type, 0
            while low < batch.num_rows:
                # Few rows at first, so that the k-th best is known early.
                piece = batch.slice(low, step)
                ids, words, pairs = (piece.column(c).to_numpy(zero_copy_only=False) for c in (id, "words", "pairs"))
                search.add(ids, words.astype(np.int64), pairs.astype(np.int64), piece.column("terms"))
                low, step = low + step, min(2 * step, most)
        query, similarity, ids = search.found
        if kind is not None and ids is not None:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), pa.array(ids, kind), pa.array(similarity)], [query_id, id, "similarity"])

    return run

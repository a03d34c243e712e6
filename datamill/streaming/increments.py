"""Incremental jobs: appends that may be repeated, as steps of a Structured Streaming query.

There are no windows or event times here: rows arrive, and each is labelled or embedded once. A
batch that is run again after a failure adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from datamill.sources import embedding_cache as cache
from datamill.sources.tables import append_new, tag_labelled


def append_labelled_batch(path: str, schema, keys: list[str] | None = None, source: str = "active_loop") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step that adds newly labelled rows to the training table."""
    def step(batch: DataFrame, _: int) -> None:
        append_new(tag_labelled(batch, source), path, keys or ["id"], schema)

    return step


def embed_batch(path: str, model: str, call: Callable[[list[str]], list[list[float]]], text: str = "text") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step that embeds texts the cache does not know."""
    def step(batch: DataFrame, _: int) -> None:
        known = cache.read_cache(batch.sparkSession, path)
        cache.put(cache.embed(cache.misses(batch, known, model, text), model, call, text), path)

    return step


def run_once(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Processes everything that has arrived and stops; the checkpoint remembers how far it got."""
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query

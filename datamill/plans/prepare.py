"""Prepare: merge sources, drop duplicates, profile, split and write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from datamill.operators import dedup, profile, split
from datamill.session import cut_lineage
from datamill.sources.jsonl import merge_sources, write_jsonl


@dataclass
class Prepared:
    rows: DataFrame
    stats: DataFrame
    deficit: DataFrame
    train: DataFrame
    val: DataFrame

    def write(self, folder: str) -> None:
        """The train and the validation rows as JSON lines, and the statistics, below a folder."""
        for name in ("train", "val"):
            write_jsonl(getattr(self, name), f"{folder}/{name}")
        for name in ("stats", "deficit"):
            getattr(self, name).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def prepare(synthetic: DataFrame, real: DataFrame | None = None, labels: list[str] | None = None,
            threshold: float = 0.85, ratio: float = split.DEFAULT_SPLIT_RATIO, order: str = "id", folder: str | None = None) -> Prepared:
    """Merged, de-duplicated rows with their statistics and an exact split, written below ``folder`` if there is one.

    The kept rows are written to the checkpoint folder once, since four results start there.
    """
    kept = cut_lineage(dedup.deduplicate(merge_sources(synthetic, real), threshold, order))
    wanted = labels if labels else profile.distinct_labels(kept)
    parts = split.split(kept, ratio, order)
    out = Prepared(
        kept, profile.dataset_stats(kept), profile.label_deficit(kept, wanted),
        parts.where("is_train").drop("is_train"), parts.where("NOT is_train").drop("is_train"),
    )
    if folder:
        out.write(folder)
    return out


def deficit_after_dedup(rows: DataFrame, threshold: float = 0.85, order: str = "id") -> DataFrame:
    """Rows per label after de-duplication, with what is missing to an even share."""
    kept = cut_lineage(dedup.deduplicate(rows, threshold, order))
    counts = profile.label_counts(kept)
    missing = profile.label_deficit(kept, profile.distinct_labels(kept)).select("label", "deficit")
    return counts.join(missing, "label", "left")

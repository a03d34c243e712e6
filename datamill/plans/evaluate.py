"""Evaluate: all report tables of a set of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from datamill.operators import metrics, profile


def report(gold: DataFrame, preds: DataFrame, labels: list[str], id: str = "id") -> dict[str, DataFrame]:
    """Report tables by name. The joined rows are computed once."""
    matched = metrics.match(gold, preds.select(id, "label", "confidence"), id).persist()
    cells = metrics.confusion(matched, labels)
    bins = metrics.calibration(matched)
    return {
        "confusion": cells,
        "per_label": metrics.per_label(cells),
        "summary": metrics.class_report(matched, labels),
        "composition": profile.label_composition(gold),
        "errors": metrics.error_taxonomy(matched),
        "top_confusions": metrics.top_confusions(matched),
        "samples": metrics.error_samples(matched, id=id),
        "calibration": bins,
        "calibration_error": metrics.expected_calibration_error(bins),
    }

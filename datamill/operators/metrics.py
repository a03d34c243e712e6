"""Evaluation of predictions: everything is a conditional aggregate over gold joined with predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from datamill.functions.numbers import f1, ratio
from datamill.operators.profile import label_list


def match(gold: DataFrame, preds: DataFrame, id: str = "id", label: str = "label") -> DataFrame:
    """Gold rows with their prediction; a missing prediction leaves null (and counts as wrong)."""
    return gold.withColumnRenamed(label, "actual").join(preds, id, "left")


def pair_counts(matched: DataFrame, actual: str = "actual", predicted: str = "label") -> DataFrame:
    return matched.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def confusion(matched: DataFrame, labels: list[str], actual: str = "actual", predicted: str = "label") -> DataFrame:
    """All cells of the confusion matrix over the given labels, zero cells included."""
    inner = F.explode(F.array(*[F.lit(x) for x in labels]))
    cells = label_list(matched, labels).select(F.col("label").alias("actual"), inner.alias("predicted"))
    counts = pair_counts(matched, actual, predicted)
    return cells.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_wide(cells: DataFrame, labels: list[str]) -> DataFrame:
    return cells.groupBy("actual").pivot("predicted", labels).agg(F.sum("n"))


def per_label(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every label, from confusion cells."""
    sides = cells.select("n", F.inline(F.array(
        F.struct(F.col("actual").alias("label"), F.lit(True).alias("gold"), (F.col("actual") == F.col("predicted")).alias("hit")),
        F.struct(F.col("predicted").alias("label"), F.lit(False).alias("gold"), F.lit(False).alias("hit")),
    )))
    sums = sides.groupBy("label").agg(
        F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("gold"), F.col("n")).otherwise(0)).alias("predicted_n"),
        F.sum(F.when(F.col("gold"), F.col("n")).otherwise(0)).alias("support"),
    )
    scored = sums.select(
        "label", ratio(F.col("tp"), F.col("predicted_n")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"), "support",
    )
    return scored.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def accuracy(matched: DataFrame, actual: str = "actual", predicted: str = "label") -> Column:
    """Aggregate: share of rows whose prediction equals the gold label."""
    return F.avg(F.col(actual).eqNullSafe(F.col(predicted)).cast("double"))


def class_report(matched: DataFrame, labels: list[str], actual: str = "actual", predicted: str = "label") -> DataFrame:
    """One row: accuracy, macro and support-weighted averages over the labels."""
    acc = matched.agg(accuracy(matched, actual, predicted)).scalar()
    scores = per_label(confusion(matched, labels, actual, predicted))
    measures = ["precision", "recall", "f1"]
    macro = [F.avg(m).alias(f"macro_{m}") for m in measures]
    weighted = [ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in measures]
    return scores.agg(*macro, *weighted, F.sum("support").alias("support")).withColumn("accuracy", acc)


def wrong(matched: DataFrame, actual: str = "actual", predicted: str = "label") -> DataFrame:
    return matched.where(~F.col(actual).eqNullSafe(F.col(predicted)))


def length_band(text: Column | str) -> Column:
    """Texts below 50 characters are short, below 150 medium."""
    n = F.char_length(text)
    return F.when(n < 50, F.lit("short")).when(n < 150, F.lit("medium")).otherwise(F.lit("long"))


def error_taxonomy(matched: DataFrame, actual: str = "actual", predicted: str = "label", text: str = "text") -> DataFrame:
    """``(kind, name, n)`` of errors: total, by label pair, by text length and by provider, in one pass."""
    origin = F.coalesce(*[F.col(c) for c in ("_provider", "_source") if c in matched.columns], F.lit("unknown"))
    rows = wrong(matched, actual, predicted).select(
        F.concat_ws(" -> ", F.col(actual), F.coalesce(F.col(predicted), F.lit("none"))).alias("pair"),
        length_band(text).alias("length"), origin.alias("provider"),
    )
    names = ["pair", "length", "provider"]
    sets = rows.groupingSets([[], *[[n] for n in names]], *names).agg(
        *[F.grouping(n).alias(f"g_{n}") for n in names], F.count("*").alias("n")
    )
    kind = F.lit("total")
    for n in names:
        kind = F.when(F.col(f"g_{n}") == 0, F.lit(n)).otherwise(kind)
    return sets.select(kind.alias("kind"), F.coalesce(*names, F.lit("all")).alias("name"), "n")


def top_confusions(matched: DataFrame, k: int = 10, actual: str = "actual", predicted: str = "label") -> DataFrame:
    pairs = pair_counts(wrong(matched, actual, predicted), actual, predicted)
    return pairs.orderBy(F.desc("n"), "actual", "predicted").limit(k)


def error_samples(matched: DataFrame, per_pair: int = 3, id: str = "id", actual: str = "actual", predicted: str = "label") -> DataFrame:
    """The first errors of every label pair. Each map task keeps only that many per pair."""
    rank = F.row_number().over(Window.partitionBy(actual, predicted).orderBy(id))
    return wrong(matched, actual, predicted).withColumn("rank", rank).where(F.col("rank") <= per_pair)


def calibration(matched: DataFrame, n_bins: int = 10, actual: str = "actual", predicted: str = "label") -> DataFrame:
    """All confidence bins with count, accuracy, bin middle, true mean confidence and ECE share."""
    rows = matched.where(F.col("confidence").isNotNull()).select(
        F.least(F.floor(F.col("confidence") * n_bins), F.lit(n_bins - 1)).cast("int").alias("bin"),
        F.col(actual).eqNullSafe(F.col(predicted)).cast("double").alias("hit"), "confidence",
    )
    found = rows.groupBy("bin").agg(
        F.count("*").alias("n"), F.avg("hit").alias("acc"), F.avg("confidence").alias("mean_confidence")
    )
    total = rows.agg(F.count("*")).scalar()
    bins = matched.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    middle = (F.col("bin") + 0.5) / n_bins
    return bins.join(found, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("acc", F.lit(0.0)).alias("accuracy"),
        middle.alias("avg_confidence"), "mean_confidence",
        F.coalesce(F.col("n") / total * F.abs(F.col("acc") - middle), F.lit(0.0)).alias("ece_part"),
    )


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum("n") > 0).alias("has_confidence"), F.sum("ece_part").alias("ece"))


def regression_metrics(df: DataFrame, value: str = "value", score: str = "score") -> DataFrame:
    """One row: n, mse, mae, rmse, Pearson correlation and R2, from one aggregation."""
    err = F.col(score) - F.col(value)
    sums = df.agg(
        F.count("*").alias("n"), F.avg(err * err).alias("mse0"), F.avg(F.abs(err)).alias("mae0"),
        F.covar_pop(value, score).alias("cov0"), F.var_pop(value).alias("var0"), F.var_pop(score).alias("var1"),
    )
    zero = F.lit(0.0)
    usable = (F.col("var0") > 0) & (F.col("var1") > 0)
    return sums.select(
        "n", F.coalesce("mse0", zero).alias("mse"), F.coalesce("mae0", zero).alias("mae"),
        F.coalesce(F.sqrt("mse0"), zero).alias("rmse"),
        F.when(usable, F.col("cov0") / F.sqrt(F.col("var0") * F.col("var1"))).otherwise(zero).alias("correlation"),
        F.when(F.col("n") > 0, F.when(F.col("var0") > 0, 1 - F.col("mse0") / F.col("var0")).otherwise(zero)).alias("r2"),
    )


def error_buckets(df: DataFrame, value: str = "value", score: str = "score") -> DataFrame:
    """Rows and share by absolute error: below 0.5, below 1, the rest."""
    err = F.abs(F.col(score) - F.col(value))
    bucket = F.when(err < 0.5, F.lit("below_0.5")).when(err < 1.0, F.lit("below_1")).otherwise(F.lit("from_1"))
    total = df.agg(F.count("*")).scalar()
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).withColumn("percent", F.col("n") * 100.0 / total)


def worst_scores(df: DataFrame, k: int = 5, id: str = "id", value: str = "value", score: str = "score") -> DataFrame:
    err = F.abs(F.col(score) - F.col(value))
    return df.withColumn("abs_error", err).orderBy(F.desc("abs_error"), id).limit(k)


def fold_summary(scores: DataFrame, accuracy: str = "accuracy") -> DataFrame:
    """Mean and population standard deviation over folds."""
    return scores.agg(F.avg(accuracy).alias("mean"), F.stddev_pop(accuracy).alias("std"))


def field_summary(matched: DataFrame, gold: str = "fields", predicted: str = "predicted_fields") -> DataFrame:
    """Accuracy per extraction field: presence of a value against the predicted presence."""
    entry = F.explode(F.map_entries(gold)).alias("e")
    rows = matched.select(entry, predicted).select(
        F.col("e.key").alias("field"),
        (F.col("e.value").isNotNull() == F.coalesce(F.element_at(predicted, F.col("e.key")), F.lit(False))).alias("hit"),
    )
    return rows.groupBy("field").agg(F.avg(F.col("hit").cast("double")).alias("accuracy"), F.count("*").alias("n"))


def mean_field_accuracy(fields: DataFrame) -> DataFrame:
    return fields.agg(F.avg("accuracy").alias("accuracy"), F.count("*").alias("fields"))

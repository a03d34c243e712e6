"""Training and batch scoring with Spark ML: text and vector classifiers, field models, a scorer."""

from __future__ import annotations

import itertools
import json
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, LogisticRegressionModel, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import (
    IDF, PCA, CountVectorizerModel, HashingTF, IndexToString, NGram, Normalizer, RegexTokenizer, SQLTransformer, StandardScaler, StringIndexer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from datamill.functions.hashing import hash_texts
from datamill.functions.numbers import clamp
from datamill.functions.text import text_features
from datamill.operators.metrics import accuracy
from datamill.session import cut_lineage, spread

ALGORITHMS = ["logistic_regression", "svm", "random_forest"]
# Default sizes of the feature tables and default search grids.
MAX_FEATURES, FIELD_FEATURES, HASH_SIZE, COMPONENTS = 10_000, 5_000, 1 << 16, 50
GRIDS = {
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0], "max_iter": [500, 1000]},
    "svm": {"C": [0.01, 0.1, 1.0, 10.0], "max_iter": [500, 1000]},
    "random_forest": {"n_estimators": [50, 100, 200], "max_depth": [0, 10, 20]},
}
#: Rows of a partition that forests are grown on: a forest holds a number per row and feature. Models fitted at the same time.
FOREST_ROWS, AT_ONCE = 8192, 8
#: Hashes by which pairs of words are first counted: what is shuffled and broadcast for them is bounded by this.
PAIR_HASHES = 1 << 20
#: Most terms whose document frequencies are broadcast. Counted terms that a task hands on together.
COMMON_TERMS, TERMS_AT_ONCE = 500_000, 1 << 17
# Trees of unlimited depth are not offered by Spark ML; depth 0 means this depth, the deepest Spark allows.
DEEPEST = 30


@dataclass
class Trained:
    """A fitted model, its validation accuracy and what the registry stores about it."""

    model: Model
    accuracy: float
    meta: dict = field(default_factory=dict)


# --- features -------------------------------------------------------------------------------------------

def _term_stages(text: str) -> list:
    """Words of two or more characters and their pairs, as ``_terms``."""
    return [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"(?U)\b\w\w+\b", gaps=False),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
    ]


def fit_text(df: DataFrame, keep: list[str], max_features: int = MAX_FEATURES, text: str = "text", output: str = "features") -> tuple[PipelineModel, DataFrame]:
    """TF-IDF over words of two or more characters and their pairs, scaled to length 1: the stages, and the rows of ``df`` with it.

    Of terms that occur equally often the smaller one comes first. The texts are read for the terms, and for the counts, which
    are kept and serve the frequencies and the rows. The caller releases the rows.
    """
    words = _term_stages(text)
    termed = PipelineModel(stages=words).transform(df)
    vocabulary = commonest_terms(words[0].transform(df).select("_words"), max_features)
    if not vocabulary:
        raise ValueError("the texts hold no words")
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_terms", outputCol="_counts")
    counts = counter.transform(termed).select(*keep, "_counts").persist()
    idf = IDF(inputCol="_counts", outputCol="_idf").fit(counts)
    norm = Normalizer(p=2.0, inputCol="_idf", outputCol=output)
    rows = norm.transform(idf.transform(counts)).select(*keep, output).persist()
    rows.count()
    counts.unpersist()
    return PipelineModel(stages=[*words, counter, idf, norm]), rows


def commonest_terms(df: DataFrame, most: int, words: str = "_words") -> list[str]:
    """The ``most`` commonest words and pairs of neighbouring words, the commonest first.

    Most pairs of a large table come once or twice, so they are not shuffled: words are counted first, and pairs by a hash. A
    pair is no commoner than all pairs of its hash together, and can be left out if the words alone have enough commoner terms.
    """
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """The distinct words of some texts, which ones the texts hold, the places of all but the last of a text, and the hashes of the pairs that begin there."""
        for batch in batches:
            found = batch.column(0).flatten().dictionary_encode()
            codes = found.indices.to_numpy(zero_copy_only=False)
            ends = np.cumsum(batch.column(0).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) - 1
            inner = np.ones(len(codes), bool)
            inner[ends[ends >= 0]] = False
            at = np.flatnonzero(inner)
            own = hash_texts(found.dictionary.cast(pa.binary())).view(np.uint64)
            with np.errstate(over="ignore"):
                both = (own[codes[at]] * np.uint64(0x9E3779B97F4A7C15) + own[codes[at + 1]]) * np.uint64(0xC2B2AE3D27D4EB4F)
            yield found.dictionary, codes, at, (both >> np.uint64(32)) % np.uint64(PAIR_HASHES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(PAIR_HASHES, np.int64)
        for names, codes, _, both in parts(batches):
            totals += np.bincount(both.astype(np.int64), minlength=PAIR_HASHES)
            yield pa.RecordBatch.from_arrays([names, pa.nulls(len(names), pa.int32()), pa.array(np.bincount(codes, minlength=len(names)))], ["word", "hash", "n"])
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.string()), pa.array(some, pa.int32()), pa.array(totals[some])], ["word", "hash", "n"])

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, codes, at, both in parts(batches):
            at = at[shared.value[both]]
            pairs, n = np.unique(codes[at].astype(np.int64) * len(names) + codes[at + 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(x)) for x in np.divmod(pairs, max(len(names), 1))] + [pa.array(n, pa.int64())], ["a", "b", "n"])

    rows = df.select(words)
    counted = rows.mapInArrow(count, "word string, hash int, n bigint").groupBy("word", "hash").agg(F.sum("n").alias("n")).persist()
    top = counted.where("word IS NOT NULL").orderBy(F.desc("n"), "word").limit(most).select("n", "word")
    found = [(r["n"], r["word"]) for r in top.collect()]
    least = found[-1][0] if len(found) == most else 1
    common = np.zeros(PAIR_HASHES, bool)
    common[counted.where(F.col("hash").isNotNull() & (F.col("n") >= least)).select("hash").toPandas()["hash"].to_numpy(np.int64)] = True
    counted.unpersist()
    shared = df.sparkSession.sparkContext.broadcast(common)
    pairs = rows.mapInArrow(count_pairs, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    pairs = pairs.select("n", F.concat_ws(" ", "a", "b").alias("term")).orderBy(F.desc("n"), "term").limit(most)
    found += [(r["n"], r["term"]) for r in pairs.collect()]
    # In the order that Spark gives texts.
    return [term for _, term in sorted(found, key=lambda f: (-f[0], f[1].encode()))[:most]]


def with_vector(df: DataFrame, embedding: str = "embedding", output: str = "_vector") -> DataFrame:
    return df.withColumn(output, array_to_vector(F.col(embedding).cast("array<double>")))


def product_sums(rows: DataFrame, input: str = "_vector") -> np.ndarray:
    """The sum of ``[1, x] [1, x]^T`` over all vectors: their number, their sum, and their matrix of products.

    One pass: a task adds the products of its blocks, the tasks' matrices are added line by line on the executors, and
    only the sum, with a row and a column per dimension, reaches the driver.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            x = np.c_[np.ones(batch.num_rows), flat.reshape(batch.num_rows, -1)] if batch.num_rows else None
            if x is not None:
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["line", "sums"])

    def add(part: pa.Table) -> pa.Table:
        sums = np.array(part.column("sums").to_pylist()).sum(axis=0)
        return pa.table({"line": part.column("line").slice(0, 1), "sums": pa.array([sums], pa.list_(pa.float64()))})

    kind = "line int, sums array<double>"
    lines = rows.select(vector_to_array(input).alias("v")).mapInArrow(partial, kind).groupBy("line").applyInArrow(add, kind)
    return np.array([r["sums"] for r in lines.orderBy("line").collect()])


def fit_reduction(rows: DataFrame, method: str, components: int, input: str = "_vector", output: str = "features") -> PipelineModel:
    """Leading directions of the data; ``pca`` removes the mean first, ``svd`` does not.

    Both come from one sum of products. Spark's estimators are then fitted on tables with the same mean and the same
    products, which have a few rows per dimension. There are at most as many directions as dimensions and rows.
    """
    if method not in ("pca", "svd"):
        raise ValueError(f"unknown reduction: {method}")
    sums = product_sums(rows, input)
    if not len(sums):
        raise ValueError("nothing to reduce")
    n, mean = sums[0, 0], sums[0, 1:] / sums[0, 0]
    products = sums[1:, 1:] / n - (np.outer(mean, mean) if method == "pca" else 0.0)
    sizes, directions = np.linalg.eigh(products)
    root = np.sqrt(np.maximum(sizes, 0.0))[:, None] * directions.T
    table = lambda x, name: rows.sparkSession.createDataFrame([(Vectors.dense(v),) for v in x], [name])
    scale = StandardScaler(withMean=method == "pca", withStd=False, inputCol=input, outputCol="_centred").fit(table([mean], input))
    # Every line of the root also with the other sign: the mean is zero and the products are those of the data.
    k = max(1, min(components, len(mean), int(n)))
    return PipelineModel(stages=[scale, PCA(k=k, inputCol="_centred", outputCol=output).fit(table([*root, *-root], "_centred"))])


def classifier(algorithm: str, params: dict | None = None, rows: int = 1, features: str = "features", label: str = "_label") -> Estimator:
    """The estimator of an algorithm name; C is the inverse of the summed penalty, as usual."""
    params = params or {}
    cols = {"featuresCol": features, "labelCol": label}
    penalty = 1.0 / (float(params.get("C", 1.0)) * max(rows, 1))
    steps = int(params.get("max_iter", 1000))
    if algorithm == "logistic_regression":
        return LogisticRegression(maxIter=steps, regParam=penalty, standardization=False, **cols)
    if algorithm == "svm":
        svm = LinearSVC(maxIter=steps, regParam=penalty, standardization=False)
        return OneVsRest(classifier=svm, parallelism=4, **cols)
    if algorithm == "random_forest":
        depth = int(params.get("max_depth", 0)) or DEEPEST
        if depth > DEEPEST:
            raise ValueError(f"Spark ML grows trees to depth {DEEPEST} at most")
        # More room for the counts of nodes: fewer passes over the rows.
        return RandomForestClassifier(numTrees=int(params.get("n_estimators", 100)), maxDepth=depth, seed=42, maxMemoryInMB=1024, cacheNodeIds=True, **cols)
    raise ValueError(f"unknown algorithm: {algorithm}")


def predictions(model: Model, df: DataFrame) -> DataFrame:
    """Adds ``label`` (the predicted one) and ``confidence``; null for models without probabilities."""
    rows = df.withColumnRenamed("label", "actual")
    out = model.transform(rows)
    sure = F.array_max(vector_to_array("probability")) if "probability" in out.columns else F.lit(None).cast("double")
    return out.select(*rows.columns, F.col("_predicted_label").alias("label"), sure.alias("confidence"))


# --- classifiers ------------------------------------------------------------------------------------------

class Features:
    """Feature tables of a train and a validation set, fitted once and shared by all models."""

    def __init__(self, train: DataFrame, val: DataFrame, embedding: str | None = None, dim_reduce: str | None = None,
                 components: int = COMPONENTS, max_features: int = MAX_FEATURES, label: str = "label"):
        self.label, self.mode = label, "embeddings" if embedding else "tfidf"
        keep = ["id", label, embedding or "text"]
        # A missing label is the label 'unknown'; no other label is added.
        named = F.coalesce(F.nullif(F.col(label), F.lit("")), F.lit("unknown"))
        train, val = (spread(df.select(*keep)).withColumn(label, named) for df in (train, val))
        if embedding:
            train, val = with_vector(train, embedding), with_vector(val, embedding)
            same = SQLTransformer(statement="SELECT *, _vector AS features FROM __THIS__")
            self.stages = fit_reduction(train, dim_reduce, components) if dim_reduce else PipelineModel(stages=[same])
            self.ready = self.stages.transform(train).select("id", label, "features").persist()
        else:
            self.stages, self.ready = fit_text(train, ["id", label], max_features)
        self.labels = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="error").fit(self.ready)
        self.train = self.labels.transform(self.ready)
        self.val = self.stages.transform(val).select("id", label, "features").persist()
        self.rows = self.ready.count()

    def fit(self, estimator: Estimator) -> PipelineModel:
        """A model over features, ending in the predicted label."""
        names = IndexToString(inputCol="prediction", outputCol="_predicted_label", labels=self.labels.labels)
        train = self.train
        parts = -(-self.rows // FOREST_ROWS)
        if isinstance(estimator, RandomForestClassifier) and train.rdd.getNumPartitions() < parts:
            train = train.repartition(parts, "id")
        return PipelineModel(stages=[estimator.fit(train), names])

    def score(self, model: PipelineModel) -> float:
        out = predictions(model, self.val)
        return out.agg(accuracy(out)).first()[0] or 0.0

    def release(self) -> None:
        self.ready.unpersist()
        self.val.unpersist()


def train_classifier(
    train: DataFrame, val: DataFrame, algorithm: str = "logistic_regression", params: dict | None = None,
    embedding: str | None = None, dim_reduce: str | None = None, components: int = COMPONENTS,
    estimator: Estimator | None = None, features: Features | None = None,
) -> Trained:
    """Fits and scores one classifier. ``estimator`` puts any Spark ML estimator in its place."""
    shared = features or Features(train, val, embedding, dim_reduce, components, int((params or {}).get("max_features", MAX_FEATURES)))
    fitted = shared.fit(estimator or classifier(algorithm, params, shared.rows))
    acc = shared.score(fitted)
    meta = {
        "task_type": "classification", "algorithm": algorithm if estimator is None else type(estimator).__name__,
        "feature_mode": shared.mode, "accuracy": acc, "train_size": shared.rows, "val_size": shared.val.count(),
        "params": json.dumps(params) if params else None, "dim_reduce": dim_reduce, "n_components": components if dim_reduce else None,
    }
    model = PipelineModel(stages=[*shared.stages.stages, *fitted.stages])
    if features is None:
        shared.release()
    return Trained(model, acc, meta)


def _ended_before(found: Trained | Exception, steps: int | None) -> bool:
    """Whether a model was finished in fewer steps than these, so that a fit with that limit takes the same steps."""
    if isinstance(found, Exception) or steps is None:
        return False
    last = found.model.stages[-2]
    if isinstance(last, LogisticRegressionModel):
        return last.hasSummary and last.summary.totalIterations < int(steps)
    return False


def _tried(
    shared: Features, train: DataFrame, val: DataFrame, runs: list[tuple[str, dict | None]], threads: int, keep: bool = False,
) -> list[Trained | Exception]:
    """The models of several runs on the same features, fitted at the same time; a run that fails gives its error."""
    def run(one: tuple[str, dict | None]) -> Trained | Exception:
        try:
            return train_classifier(train, val, *one, features=shared)
        except Exception as err:
            return err

    try:
        with ThreadPoolExecutor(threads) as pool:
            return list(pool.map(run, runs))
    finally:
        if not keep:
            shared.release()


def _result(found: Trained | Exception) -> dict:
    if isinstance(found, Exception):
        return {"accuracy": 0.0, "model": None, "error": str(found)}
    return {"accuracy": found.accuracy, "model": found.model, "error": None}


def compare_classifiers(train: DataFrame, val: DataFrame, algorithms: list[str] | None = None, params: dict | None = None, threads: int = AT_ONCE) -> list[dict]:
    """Accuracy of several algorithms on the same features, best first; one that fails scores 0."""
    names = algorithms or ALGORITHMS
    found = _tried(Features(train, val), train, val, [(name, (params or {}).get(name)) for name in names], threads)
    return sorted(({"algorithm": name} | _result(f) for name, f in zip(names, found)), key=lambda r: -r["accuracy"])


def grid_search(train: DataFrame, val: DataFrame, algorithm: str = "logistic_regression", grid: dict | None = None, threads: int = AT_ONCE) -> list[dict]:
    """All combinations of a grid on one fixed validation set, best first; one that fails scores 0 with its error."""
    grid = grid or GRIDS[algorithm]
    combos = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    shared = Features(train, val)
    # Of runs that differ in the most steps alone, those with more are fitted first.
    alike = [json.dumps({k: v for k, v in c.items() if k != "max_iter"}, sort_keys=True) for c in combos]
    order = sorted(range(len(combos)), key=lambda i: -int(combos[i].get("max_iter", 0)))
    first = [i for n, i in enumerate(order) if alike[i] not in [alike[j] for j in order[:n]]]
    rest = [i for i in order if i not in first]
    try:
        made = dict(zip(first, _tried(shared, train, val, [(algorithm, combos[i]) for i in first], threads, keep=True)))
        by = {alike[i]: made[i] for i in first}
        for i in rest:
            if _ended_before(by[alike[i]], combos[i].get("max_iter")):
                made[i] = replace(by[alike[i]], meta=by[alike[i]].meta | {"params": json.dumps(combos[i])})
        rest = [i for i in rest if i not in made]
        made |= dict(zip(rest, _tried(shared, train, val, [(algorithm, combos[i]) for i in rest], threads, keep=True)))
    finally:
        shared.release()
    found = [made[i] for i in range(len(combos))]
    return sorted(({"params": c} | _result(f) for c, f in zip(combos, found)), key=lambda r: -r["accuracy"])


def results_table(df: DataFrame, results: list[dict]) -> DataFrame:
    """Results of a comparison or a search as a table."""
    rows = [(r.get("algorithm"), json.dumps(r["params"]) if r.get("params") else None, float(r["accuracy"]), r.get("error")) for r in results]
    return df.sparkSession.createDataFrame(rows, "algorithm string, params string, accuracy double, error string")


def cross_validate(folds: DataFrame, k: int, algorithm: str = "logistic_regression", params: dict | None = None, threads: int = AT_ONCE) -> DataFrame:
    """``(fold, accuracy)`` of training on all other folds, from a table with a ``fold`` column; folds are trained at the same time."""
    folds = cut_lineage(folds.select("id", "text", "label", "fold"))

    def run(fold: int) -> tuple[int, float]:
        return fold, train_classifier(folds.where(F.col("fold") != fold), folds.where(F.col("fold") == fold), algorithm, params).accuracy

    with ThreadPoolExecutor(threads) as pool:
        rows = list(pool.map(run, range(k)))
    return folds.sparkSession.createDataFrame(rows, "fold int, accuracy double")


def train_ensemble(train: DataFrame, val: DataFrame, algorithms: list[str] | None = None, params: dict | None = None, threads: int = AT_ONCE) -> dict[str, Trained]:
    """One model per algorithm on shared features."""
    names = algorithms or ALGORITHMS
    found = _tried(Features(train, val), train, val, [(name, (params or {}).get(name)) for name in names], threads)
    for f in found:
        if isinstance(f, Exception):
            raise f
    return dict(zip(names, found))


def ensemble_predictions(models: dict[str, Trained], df: DataFrame) -> DataFrame:
    """``(id, model, model_order, weight, label, confidence)`` of all members; weight = accuracy."""
    parts = [
        predictions(t.model, df).select(
            "id", F.lit(name).alias("model"), F.lit(i).alias("model_order"), F.lit(float(t.accuracy)).alias("weight"), "label", "confidence"
        )
        for i, (name, t) in enumerate(models.items(), 1)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def feature_importance(model: PipelineModel, df: DataFrame, top: int = 10) -> DataFrame:
    """``(label, feature, weight, rank)``: strongest features per label, or 'global' for a forest."""
    vocabulary = next(s.vocabulary for s in model.stages if hasattr(s, "vocabulary"))
    labels = next(s for s in model.stages if isinstance(s, IndexToString)).getLabels()
    last = model.stages[-2]
    if hasattr(last, "coefficientMatrix"):
        rows = list(last.coefficientMatrix.toArray())
        if len(rows) == 1 and len(labels) == 2:
            # Two labels share one row, which speaks for the second.
            rows = [-rows[0], rows[0]]
    elif hasattr(last, "models"):
        rows = [m.coefficients.toArray() for m in last.models]
    elif hasattr(last, "featureImportances"):
        rows, labels = [last.featureImportances.toArray()], ["global"]
    else:
        raise ValueError("this model has no feature weights")
    spark = df.sparkSession
    weights = spark.createDataFrame([(lbl, [float(x) for x in row]) for lbl, row in zip(labels, rows)], "label string, w array<double>")
    flat = weights.select("label", F.posexplode("w").alias("_i", "weight"))
    names = spark.createDataFrame(list(enumerate(vocabulary)), "_i int, feature string")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("weight"), "_i"))
    return flat.withColumn("rank", rank).where(F.col("rank") <= top).join(names, "_i").select("label", "feature", "weight", "rank")


def term_counts(df: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """``(id, term, tf)`` of the lower-case words between white space; rows with one id are one document.

    Only the texts are shuffled, by their ids: words are counted where the rows of a document meet, not shuffled one by one.
    """
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Counter]]:
        key, counts = None, Counter()
        for batch in batches:
            keys, starts, texts = batch.columns
            for i, (start, words) in enumerate(zip(starts.to_pylist(), texts.to_pylist())):
                if start:
                    yield key, counts
                    key, counts = keys.slice(i, 1), Counter()
                # Bytes are split at the white space that ``tokenize`` splits at, no other.
                counts.update(words.split())
        yield key, counts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table() -> pa.RecordBatch:
            repeated = pa.concat_arrays(keys).take(pa.array(np.repeat(np.arange(len(keys)), sizes)))
            return pa.RecordBatch.from_arrays([repeated, pa.array(terms, pa.binary()), pa.array(tf, pa.int64())], ["id", "term", "tf"])

        keys, sizes, terms, tf = [], [], [], []
        for key, counts in documents(batches):
            if counts:
                keys.append(key)
                sizes.append(len(counts))
                terms.extend(counts)
                tf.extend(counts.values())
            if len(terms) >= TERMS_AT_ONCE:
                yield table()
                keys, sizes, terms, tf = [], [], [], []
        if terms:
            yield table()

    # Numbered by Spark, so that it says which ids are equal; the rows of one id then follow each other.
    number = F.row_number().over(Window.partitionBy("id").orderBy("id"))
    rows = df.select(F.col(id).alias("id"), F.lower(text).cast("binary").alias("words")).where("words IS NOT NULL")
    rows = rows.withColumn("n", number).select("id", (F.col("n") == 1).alias("starts"), "words")
    kind = T.StructType([rows.schema["id"], T.StructField("term", T.BinaryType()), T.StructField("tf", T.LongType())])
    found = rows.mapInArrow(count, kind).select(F.col("id").alias(id), F.col("term").cast("string").alias("term"), "tf")
    # Never null: joins add this filter, and a shuffle of terms is shared only by plans that all have it.
    return found.where("term IS NOT NULL")


def tfidf(df: DataFrame, id: str = "id", text: str = "text", smooth: bool = False) -> DataFrame:
    """``(id, term, tf, weight)`` relationally; ``smooth`` adds 1 to every inverse frequency.

    Terms with at least one of ``COMMON_TERMS`` equal shares of all rows, so at most that many, get their document
    frequency by a broadcast where they were counted; only rows of rarer terms are shuffled, and no term crowds a task.
    """
    tf = term_counts(df, id, text)
    found = tf.groupBy("term").agg(F.count("*").alias("df"))
    common = found.where(F.col("df") * COMMON_TERMS >= found.agg(F.sum("df")).scalar())
    often = tf.join(F.broadcast(common), "term").select(id, "term", "tf", "df")
    seldom = tf.join(F.broadcast(common), "term", "left_anti")
    seldom = seldom.select(id, "term", "tf", F.count("*").over(Window.partitionBy("term")).alias("df"))
    docs = df.agg(F.count("*")).scalar()
    idf = F.log((docs + 1.0) / (F.col("df") + 1.0)) + (1.0 if smooth else 0.0)
    return often.unionByName(seldom).select(id, "term", "tf", (F.col("tf") * idf).alias("weight"))


# --- extraction -----------------------------------------------------------------------------------------------

def train_fields(train: DataFrame, fields: list[str], max_features: int = FIELD_FEATURES, steps: int = 200) -> tuple[PipelineModel, dict]:
    """Shared text features and, per field, a presence model, or a constant if presence never varies."""
    known = [F.coalesce(F.element_at("fields", f).isNotNull(), F.lit(False)).cast("double").alias(f"y_{i}") for i, f in enumerate(fields)]
    stages, rows = fit_text(spread(train.select("text", *known)), [f"y_{i}" for i in range(len(fields))], max_features)
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(f"y_{i}").alias(f"s_{i}") for i in range(len(fields))]).first()
    models: dict = {}
    for i, name in enumerate(fields):
        if sums[f"s_{i}"] in (0.0, float(sums["n"])):
            models[name] = bool(sums[f"s_{i}"])
        else:
            models[name] = classifier("logistic_regression", {"max_iter": steps}, sums["n"], label=f"y_{i}").fit(rows)
    rows.unpersist()
    return stages, models


def predict_fields(stages: PipelineModel, models: dict, df: DataFrame) -> DataFrame:
    """Adds ``predicted_fields``, a map from field to predicted presence."""
    out = stages.transform(spread(df)).select(*df.columns, "features")
    pairs = []
    for i, (name, model) in enumerate(models.items()):
        if isinstance(model, bool):
            hit = F.lit(model)
        else:
            out = model.transform(out).withColumnRenamed("prediction", f"_p{i}").drop("rawPrediction", "probability")
            hit = F.col(f"_p{i}") > 0.5
        pairs += [F.lit(name), hit]
    return out.withColumn("predicted_fields", F.create_map(*pairs)).select(*df.columns, "predicted_fields")


# --- scores -----------------------------------------------------------------------------------------------------

@dataclass
class Scorer:
    """A linear model on hashed text features, clamped to a range."""

    model: PipelineModel
    lo: float | None
    hi: float | None

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(_hash_input(df))
        return out.withColumn("score", clamp("prediction", self.lo, self.hi)).select(*df.columns, "score")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        ends = SparkSession.active().createDataFrame([(self.lo, self.hi)], "lo double, hi double")
        ends.write.mode("overwrite").parquet(f"{path}/range")

    @staticmethod
    def load(path: str) -> "Scorer":
        row = SparkSession.active().read.parquet(f"{path}/range").first()
        return Scorer(PipelineModel.load(f"{path}/model"), row["lo"], row["hi"])


def _hash_input(df: DataFrame, text: str = "text") -> DataFrame:
    return spread(df).withColumn("_feats", text_features(text))


def train_scorer(train: DataFrame, lo: float | None = None, hi: float | None = None, penalty: float = 0.001, hash_size: int = HASH_SIZE, steps: int = 50) -> Scorer:
    """Least squares with an L2 penalty; without a given range the observed one limits scores."""
    ends = train.agg(F.min("value"), F.max("value")).first()
    stages = [
        HashingTF(numFeatures=hash_size, inputCol="_feats", outputCol="features"),
        LinearRegression(featuresCol="features", labelCol="value", regParam=penalty, elasticNetParam=0.0, solver="l-bfgs", standardization=False, maxIter=steps),
    ]
    model = Pipeline(stages=stages).fit(_hash_input(train))
    return Scorer(model, ends[0] if lo is None else lo, ends[1] if hi is None else hi)


def scorer_weights(scorer: Scorer, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, feature, occurrence) and (feature, weight) of a scorer, for feature dropout; features are slots.

    The table of weights has at most as many rows as the scorer has slots, so it is broadcast and no feature is shuffled. The
    model's constant is :func:`scorer_offset`.
    """
    hashing, regression = scorer.model.stages
    weights = df.sparkSession.createDataFrame(
        [(i, float(w)) for i, w in enumerate(regression.coefficients.toArray())], "feature int, weight double"
    )
    counts = hashing.transform(_hash_input(df)).select("id", F.unwrap_udt("features").alias("f"))
    rows = counts.select("id", F.inline(F.arrays_zip("f.indices", "f.values")))
    repeats = F.explode(F.sequence(F.lit(1), F.col("values").cast("int")))
    return rows.select("id", F.col("indices").alias("feature"), repeats.alias("occurrence")), F.broadcast(weights)


def scorer_offset(scorer: Scorer) -> float:
    """The constant of a scorer, which no dropout removes."""
    return float(scorer.model.stages[-1].intercept)


# --- maps -------------------------------------------------------------------------------------------------------

def map_2d(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Adds ``x`` and ``y``: the two leading components of the centred embeddings."""
    rows = with_vector(df.where(F.col(embedding).isNotNull()), embedding)
    out = fit_reduction(rows, "pca", 2, output="_map").transform(rows)
    point = vector_to_array("_map")
    return out.withColumn("x", point[0]).withColumn("y", F.coalesce(F.get(point, 1), F.lit(0.0))).select(*df.columns, "x", "y")

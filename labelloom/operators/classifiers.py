"""Algorithm registry: training and scoring on vector tables.

Built-in estimators do the distributed work; nearest neighbours and Gaussian
naive Bayes are the library's own. Every trained model adds `predicted_label`
and `probability` (array in the order of `classes`).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import asdict, dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom import vocab
from labelloom.functions.names import algorithm_name
from labelloom.functions.vectors import softmax
from labelloom.operators import bayes, neighbours
from labelloom.operators.arrow_scores import blocks, with_scores
from labelloom.operators.scaling import scale_parameters, scaled
from labelloom.session import materialize

VECTOR, LABEL = "vector_inline", "gesture_label"
PARAMETERS = "label string, offset double, first array<double>, second array<double>"


@dataclass(frozen=True)
class FourierKernel:
    """Random Fourier features approximating the RBF kernel exp(-gamma |x - y|^2)."""

    gamma: float
    dim: int
    width: int = 512
    seed: int = 42

    def features(self, x: np.ndarray) -> np.ndarray:
        """Features of the rows of *x*, the same for the same seed."""
        rng = np.random.default_rng(self.seed)
        weights = rng.normal(0.0, np.sqrt(2.0 * self.gamma), (self.dim, self.width))
        shift = rng.uniform(0.0, 2.0 * np.pi, self.width)
        out = x @ weights
        out += shift
        np.cos(out, out=out)
        out *= np.sqrt(2.0 / self.width)
        return out

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Labels and features of batches of labels and vectors, put out in blocks of few rows."""
        for batch in batches:
            for block in blocks(batch):
                x = block.column(1).flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, -1)
                offsets = pa.array(np.arange(len(x) + 1) * self.width, pa.int32())
                features = pa.ListArray.from_arrays(offsets, pa.array(self.features(x).ravel()))
                yield pa.RecordBatch.from_arrays([block.column(0), features], names=["label", "features"])


@dataclass(frozen=True)
class LinearScores:
    """One linear score per class, on the vector or on its kernel features."""

    classes: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    kernel: FourierKernel | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of the rows of *x*."""
        inputs = self.kernel.features(x) if self.kernel else x
        return inputs @ self.weights.T + self.bias

    def transform(self, df: DataFrame, vector: str = VECTOR) -> DataFrame:
        """Add predicted_label and probability (in class order)."""
        return with_scores(df, vector, self.classes, self.scores)


@dataclass
class Trained:
    """A trained model: Spark stages, or the library's own scoring function."""

    algorithm: str
    classes: list[str]
    hyperparameters: dict[str, Any]
    stages: PipelineModel | None = None
    own: Any = None
    scaler: tuple[list[float], list[float]] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        """Score every row; needs sample_id for nearest neighbours."""
        columns = df.columns
        if self.algorithm == "knn":
            return self._knn(df).select(*columns, "predicted_label", "probability")
        vector = F.col(VECTOR).cast("array<double>")
        if self.scaler:
            vector = scaled(vector, *self.scaler)
        if self.own is not None:
            scored = self.own.transform(df.withColumn("_x", vector), "_x")
            return scored.select(*columns, "predicted_label", "probability")
        rows = self.stages.transform(df.withColumn("features", array_to_vector(vector)))
        names = F.array(*[F.lit(c) for c in self.classes])
        position = F.col("prediction").cast("int") + 1
        scored = rows.withColumn("predicted_label", F.element_at(names, position))
        if "probability" in rows.columns:
            scored = scored.withColumn("probability", vector_to_array("probability"))
        else:
            scored = scored.withColumn("probability", softmax(vector_to_array("rawPrediction")))
        return scored.select(*columns, "predicted_label", "probability")

    def _knn(self, df: DataFrame) -> DataFrame:
        vector = F.col(VECTOR).cast("array<double>")
        if self.scaler:
            vector = scaled(vector, *self.scaler)
        k = int(self.hyperparameters.get("n_neighbors", 5))
        found = neighbours.knn_predict(df.select("sample_id", vector.alias("vector")), self.own, k)
        shares = F.array(*[F.coalesce(F.try_element_at("votes", F.lit(c)), F.lit(0.0)) for c in self.classes])
        return df.join(found.withColumn("probability", shares).drop("votes", "confidence"), "sample_id")

    # A model is a folder: meta.json (as a one-row table) next to its parts.

    def save(self, spark: SparkSession, path: str, metadata: Mapping[str, Any] | None = None) -> None:
        """Write model and metadata below *path*."""
        meta = {
            "algorithm": self.algorithm,
            "classes": self.classes,
            "hyperparameters": self.hyperparameters,
            "scaler": self.scaler,
            "kernel": asdict(self.own.kernel) if self.algorithm == "svm" and self.own.kernel else None,
            "metadata": dict(metadata or {}),
        }
        row = spark.createDataFrame([(json.dumps(meta, default=str),)], "meta string")
        if self.stages is not None:
            self.stages.write().overwrite().save(f"{path}/stages")
        elif self.algorithm == "knn":
            self.own.write.mode("overwrite").parquet(f"{path}/train")
        else:
            m = self.own
            numbers = (m.bias, m.weights, m.weights) if self.algorithm == "svm" else (m.log_prior, m.mean, m.var)
            rows = [
                (c, float(p), list(map(float, a)), list(map(float, b)))
                for c, p, a, b in zip(m.classes, *numbers)
            ]
            spark.createDataFrame(rows, PARAMETERS).write.mode("overwrite").parquet(f"{path}/parameters")
        row.write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[Trained, dict[str, Any]]:
    """Model and metadata written by `Trained.save`."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    trained = Trained(
        meta["algorithm"],
        meta["classes"],
        meta["hyperparameters"],
        scaler=tuple(meta["scaler"]) if meta["scaler"] else None,
    )
    if trained.algorithm in ("naive_bayes", "svm"):
        rows = sorted(spark.read.parquet(f"{path}/parameters").collect(), key=lambda r: r["label"])
        names = tuple(r["label"] for r in rows)
        first, second, third = (np.array([r[c] for r in rows]) for c in ("offset", "first", "second"))
        if trained.algorithm == "svm":
            kernel = FourierKernel(**meta["kernel"]) if meta["kernel"] else None
            trained.own = LinearScores(names, second, first, kernel)
        else:
            trained.own = bayes.GaussianBayes(names, first, second, third)
    elif trained.algorithm == "knn":
        trained.own = spark.read.parquet(f"{path}/train")
    else:
        trained.stages = PipelineModel.load(f"{path}/stages")
    return trained, meta["metadata"]


def model_path(folder: str, experiment_id: str, algorithm: str, family: str) -> str:
    """Where the model of (experiment, algorithm, family) lives."""
    return f"{folder.rstrip('/')}/{experiment_id}_{algorithm_name(algorithm)}_{family}"


# --- factories ---------------------------------------------------------------


def _tree(hp: Mapping[str, Any], seed: int, n_train: int) -> Estimator:
    return DecisionTreeClassifier(
        impurity="gini", maxBins=32, seed=seed, maxDepth=_depth(hp),
        minInstancesPerNode=int(hp.get("min_samples_leaf", 1)),
    )


def _depth(hp: Mapping[str, Any]) -> int:
    """Unlimited depth becomes the deepest tree Spark builds."""
    depth = hp.get("max_depth", 10)
    return 30 if depth is None else int(depth)


def _forest(hp: Mapping[str, Any], seed: int, n_train: int) -> Estimator:
    return RandomForestClassifier(
        numTrees=int(hp.get("n_estimators", 100)), maxDepth=_depth(hp), seed=seed,
        featureSubsetStrategy=str(hp.get("max_features", "sqrt")),
        minInstancesPerNode=int(hp.get("min_samples_leaf", 1)),
    )


def _strength(hp: Mapping[str, Any], n_train: int) -> float:
    """Spark weighs the mean of the losses; the C of vector machines their sum, so it is spread over the rows."""
    return 1.0 / max(float(hp.get("C", 1.0)) * n_train, 1e-8)


def _logistic(hp: Mapping[str, Any], seed: int, n_train: int) -> Estimator:
    return LogisticRegression(
        family="multinomial", regParam=1.0 / max(float(hp.get("C", 1.0)), 1e-8), maxIter=int(hp.get("max_iter", 500)), standardization=False,
    )


def _svm(hp: Mapping[str, Any], seed: int, n_train: int) -> Estimator:
    binary = LinearSVC(
        regParam=_strength(hp, n_train), maxIter=int(hp.get("max_iter", 100)), tol=float(hp.get("tol", 1e-3)), standardization=False,
    )
    return OneVsRest(classifier=binary, parallelism=8)


def _perceptron(hp: Mapping[str, Any], seed: int, n_train: int) -> Estimator:
    return MultilayerPerceptronClassifier(
        layers=[int(x) for x in hp["layers"]], maxIter=int(hp.get("epochs", 100)), seed=seed,
    )


FACTORIES: dict[str, Callable[[Mapping[str, Any], int, int], Estimator]] = {
    "decision_tree": _tree,
    "random_forest": _forest,
    "logistic_regression": _logistic,
    "svm": _svm,
    "mlp": _perceptron,
}


# What each algorithm takes; anything else is refused rather than ignored.
KNOWN = {
    "knn": {"n_neighbors"},
    "naive_bayes": {"var_smoothing"},
    "decision_tree": {"max_depth", "min_samples_leaf"},
    "random_forest": {"n_estimators", "max_depth", "max_features", "min_samples_leaf"},
    "logistic_regression": {"C", "max_iter"},
    "svm": {"C", "kernel", "gamma", "max_iter", "tol", "num_features"},
    "mlp": {"hidden_dims", "epochs", "layers"},
}


def algorithms() -> list[str]:
    """Names `train` accepts."""
    return sorted([*FACTORIES, "knn", "naive_bayes"])


def build_estimator(name: str, hyperparameters: Mapping[str, Any] | None = None, seed: int = 42, n_train: int = 1) -> Estimator:
    """Spark estimator of an algorithm (label column `label`, input `inputs`) for *n_train* rows."""
    key = algorithm_name(name)
    if key not in FACTORIES:
        raise KeyError(f"unknown algorithm '{name}', known: {sorted(FACTORIES)}")
    estimator = FACTORIES[key](hyperparameters or {}, seed, n_train)
    return estimator.setFeaturesCol("inputs").setLabelCol("label")


def _kernel_width(rows: DataFrame, gamma: Any, dim: int) -> float:
    """Kernel width: a number, 1/dim (`auto`) or 1/(dim * variance of all values) (`scale`)."""
    if gamma == "auto":
        return 1.0 / dim
    if gamma != "scale":
        return float(gamma)
    s = rows.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("features")).alias("s")).first()["s"]
    means = np.asarray(s["mean"])
    variances = np.asarray(s["variance"]) * (s["count"] - 1) / s["count"]
    return float(1.0 / (dim * max(variances.mean() + means.var(), 1e-12)))


def train(
    rows: DataFrame,
    algorithm: str,
    hyperparameters: Mapping[str, Any] | None = None,
    *,
    scale: bool | None = None,
    seed: int = 42,
) -> Trained:
    """Train on rows with sample_id, gesture_label and vector_inline.

    The usual algorithms scale their input by the training rows' statistics. The
    rows are read twice, for the statistics and to write the (scaled) training table
    that all passes of the estimator read. An unknown hyper-parameter is an error.
    """
    name = algorithm_name(algorithm)
    if name not in algorithms():
        raise KeyError(f"unknown algorithm '{algorithm}', known: {algorithms()}")
    hp = {**vocab.DEFAULT_HYPERPARAMETERS.get(name, {}), **(hyperparameters or {})}
    if odd := set(hp) - KNOWN[name]:
        raise ValueError(f"{name} has no hyper-parameter {sorted(odd)}")
    scale = name in vocab.SCALED_ALGORITHMS if scale is None else scale
    table = rows.select(
        "sample_id", F.col(LABEL).cast("string").alias(LABEL), F.col(VECTOR).cast("array<double>").alias(VECTOR)
    )
    params = None
    if scale:
        params = scale_parameters(table, VECTOR)
        table = table.withColumn(VECTOR, scaled(F.col(VECTOR), *params))

    if name == "naive_bayes":
        own: Any = bayes.fit(table, VECTOR, LABEL, float(hp.get("var_smoothing", 1e-9)))
        return Trained(name, list(own.classes), hp, own=own, scaler=params)
    table = materialize(table, "training-rows")
    facts = table.groupBy(LABEL).agg(F.count("*").alias("n"), F.max(F.size(VECTOR)).alias("dim")).collect()
    classes = sorted(r[LABEL] for r in facts)
    if name == "knn":
        own = table.select("sample_id", F.col(LABEL).alias("label"), F.col(VECTOR).alias("vector"))
        return Trained(name, classes, hp, own=own, scaler=params)

    indexed = _indexed(table, classes)
    dim, n_train = max(r["dim"] for r in facts), sum(r["n"] for r in facts)
    if name == "svm":
        return _train_svm(indexed, classes, hp, dim, params, seed, n_train)
    if name == "mlp":
        hp = {**hp, "layers": [dim, *hp.get("hidden_dims", [128, 64]), len(classes)]}
    estimator = build_estimator(name, hp, seed, n_train).setFeaturesCol("features")
    model = Pipeline(stages=[estimator]).fit(indexed)
    return Trained(name, classes, hp, stages=model, scaler=params)


def _indexed(table: DataFrame, classes: list[str]) -> DataFrame:
    """Rows with vector and label as the estimators read them; the classes are known already."""
    indexer = StringIndexerModel.from_labels(classes, inputCol=LABEL, outputCol="label")
    return indexer.transform(table.withColumn("features", array_to_vector(F.col(VECTOR))))


def _train_svm(
    indexed: DataFrame, classes: list[str], hp: Mapping[str, Any], dim: int, scaler: Any, seed: int, n_train: int
) -> Trained:
    """One linear machine per class; scored by one matrix product for all of them."""
    kernel = None
    if str(hp.get("kernel", "rbf")) == "rbf":
        gamma = _kernel_width(indexed, hp.get("gamma", "scale"), dim)
        kernel = FourierKernel(gamma, dim, int(hp.get("num_features", 512)), seed)
        indexed = indexed.select("label", VECTOR).mapInArrow(kernel.batches, "label double, features array<double>")
        indexed = indexed.withColumn("features", array_to_vector("features"))
    # The optimizer passes over the rows many times per class.
    rows = indexed.select("features", "label").persist()
    fitted = build_estimator("svm", hp, seed, n_train).setFeaturesCol("features").fit(rows)
    rows.unpersist()
    weights = np.array([m.coefficients.toArray() for m in fitted.models])
    bias = np.array([m.intercept for m in fitted.models])
    own = LinearScores(tuple(classes), weights, bias, kernel)
    return Trained("svm", classes, dict(hp), own=own, scaler=scaler)

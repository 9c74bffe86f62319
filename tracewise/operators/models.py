"""Classifiers of prefixes: MLlib estimators by name, a guard for small buckets, and calibration."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.operators.auc import auc
from tracewise.operators.bucket import BUCKET

FEATURES, LABEL, SCORE = "features", "y", "predicted"
# Depth of single and forest trees, which the original library leaves unlimited: the most MLlib allows.
TREE_DEPTH = 30
# Random features of an RBF machine, unless the parameter ``fourier_features`` says otherwise.
FOURIER_FEATURES = 256
# Landmarks of an RBF machine, unless the parameter ``landmarks`` says otherwise; ``fourier_features`` asks for random features in their place.
KERNEL_FEATURES = 256
# Rows whose kernel with all landmarks is made at a time.
BLOCK = 512
# Over more than TREE_ROWS rows, forests of trees deeper than this are those of ``forest``, and single trees are fitted on partitions of TREE_ROWS rows or
# more: at each level a partition adds up statistics of all nodes of the level.
DEEP = 10
TREE_ROWS = 50_000


def _integer(value) -> int:
    return int(float(value))


def _forest(p: Mapping, seed: int, n: int):
    return RandomForestClassifier(
        featuresCol=FEATURES, labelCol=LABEL, seed=seed, numTrees=_integer(p["n_estimators"]), cacheNodeIds=True,
        featureSubsetStrategy=str(float(p["max_features"])), maxDepth=_integer(p.get("max_depth", TREE_DEPTH)))


class _Boosted:
    """One model of ``batched.fit_boosted``, over rows of any bucket."""

    def __init__(self, params: Mapping, seed: int):
        self.params, self.seed, self.model = params, seed, None

    def fit(self, train: DataFrame) -> _Boosted:
        from tracewise.operators.batched import fit_boosted

        self.model = fit_boosted(train.withColumn(BUCKET, F.lit(0).cast("long")), [("", self.params)], seed=self.seed)
        return self

    def _alone(self, df: DataFrame, scored) -> DataFrame:
        own = "__bucket of the rows"
        out = scored((df.withColumnRenamed(BUCKET, own) if BUCKET in df.columns else df).withColumn(BUCKET, F.lit(0).cast("long"))).drop(BUCKET, "params", "run")
        return out.withColumnRenamed(own, BUCKET)

    def score(self, df: DataFrame) -> DataFrame:
        return self._alone(df, self.model.score)

    def staged(self, df: DataFrame) -> DataFrame:
        """The margins after each tree as an array, in one pass."""
        return self._alone(df, self.model.staged)


class _Forest:
    """The only model of ``forest.fit_forests``."""

    def __init__(self, model):
        self.model = model

    def score(self, df: DataFrame) -> DataFrame:
        return self.model.score(df, "__scores").withColumn(SCORE, F.col("__scores")[0]).drop("__scores")


def _boosted(p: Mapping, seed: int, n: int):
    return _Boosted(p, seed)


def _gradient_boosting(p: Mapping, seed: int, n: int):
    return GBTClassifier(
        featuresCol=FEATURES, labelCol=LABEL, seed=seed, maxIter=_integer(p["n_estimators"]), maxDepth=3,
        stepSize=float(p["learning_rate"]), featureSubsetStrategy=str(float(p["max_features"])))


def _tree(p: Mapping, seed: int, n: int):
    return DecisionTreeClassifier(featuresCol=FEATURES, labelCol=LABEL, seed=seed, cacheNodeIds=True,
                                  maxDepth=_integer(p.get("max_depth", TREE_DEPTH)))


def _penalty(p: Mapping, n: int) -> float:
    """The weight of the penalty per row that equals cost 2^C over the sum of losses."""
    return 1.0 / (2.0 ** float(p["C"]) * max(n, 1))


def _logit(p: Mapping, seed: int, n: int):
    return LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, regParam=_penalty(p, n), standardization=False)


def _svm(p: Mapping, seed: int, n: int):
    return LinearSVC(featuresCol=FEATURES, labelCol=LABEL, regParam=_penalty(p, n), standardization=False)


def _perceptron(p: Mapping, seed: int, n: int):
    return MultilayerPerceptronClassifier(
        featuresCol=FEATURES, labelCol=LABEL, seed=seed, maxIter=_integer(p.get("nb_epoch", 50)),
        stepSize=float(p.get("learning_rate", 0.03)),
        layers=[_integer(p["inputs"]), *[_integer(p.get("lstmsize", 16))] * _integer(p.get("n_layers", 1)), 2])


_CLASSIFIERS: dict[str, Callable] = {"rf": _forest, "xgboost": _boosted, "gbm": _gradient_boosting, "dt": _tree,
                                     "logit": _logit, "svm": _svm, "sequence": _perceptron}
NEEDS_SCALING = ("svm", "logit")


def estimator(name: str, params: Mapping, seed: int = 22, rows: int = 1):
    """The MLlib estimator for a classifier name; ``rows`` is the number of training rows."""
    if name not in _CLASSIFIERS:
        raise KeyError(f"unknown classifier {name!r}; known: {', '.join(_CLASSIFIERS)}")
    return _CLASSIFIERS[name](params, seed, rows)


class FourierFeatures:
    """Random features whose inner products approximate the RBF kernel exp(-gamma |x - z|^2).

    After Rahimi and Recht, "Random Features for Large-Scale Kernel Machines" (2007): a linear machine
    over cos(Wx + b) stands in for a kernel machine, whose cost grows with the square of the rows.
    """

    def __init__(self, gamma: float, inputs: int, count: int = FOURIER_FEATURES, seed: int = 22):
        draw = np.random.default_rng(seed)
        self.weights = draw.normal(0.0, math.sqrt(2.0 * gamma), (inputs, count))
        self.shift = draw.uniform(0.0, 2.0 * math.pi, count)

    def transform(self, df: DataFrame) -> DataFrame:
        weights, shift = self.weights, self.shift
        scale = math.sqrt(2.0 / len(shift))

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def project(x: pd.Series) -> pd.Series:
            if len(x) == 0:
                return pd.Series([], dtype=object)
            return pd.Series(list(scale * np.cos(np.stack(x.to_numpy()) @ weights + shift)))

        return df.withColumn(FEATURES, array_to_vector(project(vector_to_array(FEATURES))))


class NystroemFeatures:
    """Features whose inner products approximate the RBF kernel exp(-gamma |x - z|^2), made from the data.

    Landmark rows stand for all: a row's features are its kernel with the landmarks, turned so that inner products are right between
    landmarks and the best there is between others. A uniform pilot sample tells how much of each row its own landmarks would miss
    (its leverage), and landmarks are drawn by that, so rows that are unlike all others are not overlooked. Both samples are bounded by ``count``;
    scores of leverage and the features themselves cover all rows. After Musco and Musco, "Recursive Sampling for the Nystroem Method" (2017).
    """

    def __init__(self, gamma: float, count: int = KERNEL_FEATURES, seed: int = 22):
        self.gamma, self.count, self.seed = gamma, count, seed
        self.landmarks = self.turn = None

    def _drawn(self, known: DataFrame, weight: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """``count`` distinct rows; one of twice the weight is drawn twice as readily.

        The least of a number that a row and its weight decide are drawn. Each task hands on its own least ``count`` alone: the others can't be among the least of all.
        """
        count = self.count

        def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, worst = {}, math.inf
            for batch in batches:
                rows = _rows(batch.column("__x"))
                if not len(rows):
                    continue
                key = np.nan_to_num(batch.column("__l").to_numpy(zero_copy_only=False) / np.concatenate([weight(rows[i:i + BLOCK]) for i in range(0, len(rows), BLOCK)]), nan=math.inf, posinf=math.inf)
                for i in np.flatnonzero(key <= worst).tolist():
                    row = tuple(rows[i].tolist())
                    best[row] = min(best.get(row, math.inf), key[i])
                if len(best) >= count:
                    best = dict(sorted(best.items(), key=lambda x: (x[1], x[0]))[:count])
                    worst = max(best.values())
            yield pa.RecordBatch.from_arrays([pa.array(map(list, best), pa.list_(pa.float64())), pa.array(best.values(), pa.float64())], ["__x", "__k"])

        u = (F.abs(F.xxhash64(F.lit(self.seed), "__x")) % (1 << 52) + 1).cast("double") / float(1 << 52)
        rows = known.select("__x", (-F.log(u)).alias("__l")).mapInArrow(least, "__x array<double>, __k double")
        drawn = rows.groupBy("__x").agg(F.min("__k").alias("__k")).orderBy("__k", "__x").limit(count)
        return np.array([r["__x"] for r in drawn.collect()], float)

    def fit(self, df: DataFrame) -> NystroemFeatures:
        known = df.select(vector_to_array(FEATURES).alias("__x"))
        self._solve(self._drawn(known, lambda rows: np.ones(len(rows))))
        project = self._project()
        self._solve(self._drawn(known, lambda rows: np.maximum(_lost(project(rows)), 1e-3)))
        return self

    def _solve(self, landmarks: np.ndarray) -> None:
        self.landmarks = landmarks
        values, vectors = np.linalg.eigh(rbf(landmarks, landmarks, self.gamma))
        some = values > max(values.max(), 0.0) * 1e-10
        self.turn = vectors[:, some] / np.sqrt(values[some])

    def _project(self) -> Callable[[np.ndarray], np.ndarray]:
        landmarks, turn, gamma = self.landmarks, self.turn, self.gamma

        def project(rows: np.ndarray) -> np.ndarray:
            return rbf(rows, landmarks, gamma) @ turn
        return project

    def _missed(self, x: Column) -> Column:
        """How much of a row's own kernel (1) its features lack: 0 if the landmarks say all of it."""
        project = self._project()

        @F.arrow_udf(T.DoubleType())
        def missed(x: pa.Array) -> pa.Array:
            rows = _rows(x)
            return pa.array(np.concatenate([np.zeros(0), *(_lost(project(rows[i:i + BLOCK])) for i in range(0, len(rows), BLOCK))]))

        return missed(x)

    def error_bound(self, df: DataFrame) -> tuple[float, float]:
        """The largest error of the kernel between any two rows, at most, and the mean of the errors' diagonal.

        What is missed is a kernel itself, so its value between two rows is at most the geometric mean of their own.
        """
        row = df.select(self._missed(vector_to_array(FEATURES)).alias("r")).agg(F.max("r").alias("most"), F.avg("r").alias("mean")).first()
        return float(row["most"] or 0.0), float(row["mean"] or 0.0)

    def transform(self, df: DataFrame) -> DataFrame:
        project, width = self._project(), self.turn.shape[1]

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def projected(x: pa.Array) -> pa.Array:
            rows = _rows(x)
            features = np.concatenate([np.zeros((0, width)), *(project(rows[i:i + BLOCK]) for i in range(0, len(rows), BLOCK))])
            return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(features.ravel()))

        return df.withColumn(FEATURES, array_to_vector(projected(vector_to_array(FEATURES))))


def _rows(x: pa.Array) -> np.ndarray:
    """Arrow lists of one length as a matrix; minus zero is zero."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) + 0.0 if len(x) else np.zeros((0, 0))


def _lost(features: np.ndarray) -> np.ndarray:
    return np.clip(1 - (features ** 2).sum(1), 0, 1)


def rbf(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    gaps = (x ** 2).sum(1)[:, None] + (z ** 2).sum(1)[None, :] - 2 * x @ z.T
    return np.exp(-gamma * np.maximum(gaps, 0.0))


class GuardedClassifier:
    """A classifier that falls back to a constant where it cannot be trained.

    Fewer than ``min_cases`` rows give the mean label; rows of one class give that class; no rows give
    ``fallback`` (the class ratio of the whole training log).
    """

    def __init__(self, name: str, params: Mapping, seed: int = 22, min_cases: int = 30, fallback: float = 0.5):
        self.name, self.params, self.seed = name, dict(params), seed
        self.min_cases, self.fallback = min_cases, fallback
        self.model = self.scaler = self.kernel = None
        self.constant: float | None = None

    def fit(self, train: DataFrame) -> GuardedClassifier:
        row = train.agg(F.count(F.lit(1)).alias("n"), F.avg(LABEL).alias("mean"), F.min(LABEL).alias("low"),
                        F.max(LABEL).alias("high")).first()
        self.constant = None
        if row["n"] == 0:
            self.constant = float(self.fallback)
        elif row["n"] < self.min_cases:
            self.constant = float(row["mean"])
        elif row["low"] == row["high"]:
            self.constant = float(row["low"])
        if self.constant is not None:
            return self
        if self.name in NEEDS_SCALING:
            self.scaler = _population_scaler(row["n"], train)
            train = self._scaled(train)
        if self.name == "svm" and "gamma" in self.params:
            gamma = 2.0 ** float(self.params["gamma"])
            if "fourier_features" in self.params:
                width = train.select(F.size(vector_to_array(FEATURES))).first()[0]
                self.kernel = FourierFeatures(gamma, width, _integer(self.params["fourier_features"]), self.seed)
            else:
                self.kernel = NystroemFeatures(gamma, _integer(self.params.get("landmarks", KERNEL_FEATURES)), self.seed).fit(train)
            train = self.kernel.transform(train)
        if self.name == "rf" and is_deep(self.params, row["n"]):
            from tracewise.operators.forest import fit_forests

            self.model = _Forest(fit_forests(few_partitions(train, row["n"]), [(self.params, self.seed)]))
            return self
        if self.name == "dt" and _integer(self.params.get("max_depth", TREE_DEPTH)) > DEEP:
            train = few_partitions(train, row["n"])
        params = self.params
        if self.name == "sequence" and "inputs" not in params:
            params = {**params, "inputs": train.select(F.size(vector_to_array(FEATURES))).first()[0]}
        self.model = estimator(self.name, params, self.seed, row["n"]).fit(train)
        return self

    def _scaled(self, df: DataFrame) -> DataFrame:
        return self.scaler.transform(df).drop(FEATURES, "__standard").withColumnRenamed("__scaled", FEATURES)

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``predicted``: the probability of the positive class, or the margin of an SVM."""
        if self.constant is not None:
            return df.withColumn(SCORE, F.lit(self.constant)).drop(FEATURES)
        if self.scaler is not None:
            df = self._scaled(df)
        if self.kernel is not None:
            df = self.kernel.transform(df)
        if isinstance(self.model, (_Boosted, _Forest)):
            return self.model.score(df)
        out = self.model.transform(df)
        raw = "rawPrediction" if self.name == "svm" else "probability"
        extra = [n for n in ("rawPrediction", "probability", "prediction", FEATURES) if n in out.columns]
        return out.withColumn(SCORE, vector_to_array(F.col(raw))[1]).drop(*extra)


def is_deep(params: Mapping, rows: int) -> bool:
    """Whether a forest is fitted by ``forest.fit_forests``, as its trees may get too many nodes for a fit level by level."""
    return rows > TREE_ROWS and _integer(params.get("max_depth", TREE_DEPTH)) > DEEP


def few_partitions(train: DataFrame, rows: int) -> DataFrame:
    """As many partitions as there are cores, or more where they would have more than ``TREE_ROWS`` rows; small tables stay as they are."""
    if rows <= TREE_ROWS:
        return train
    return train.coalesce(max(train.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TREE_ROWS)))


def _population_scaler(n: int, train: DataFrame):
    """Zero mean and unit population deviation: MLlib's sample deviation, corrected by a constant factor."""
    standard = StandardScaler(inputCol=FEATURES, outputCol="__standard", withMean=True, withStd=True)
    width = train.select(F.size(vector_to_array(FEATURES))).first()[0]
    factor = math.sqrt(n / max(n - 1, 1))
    correct = ElementwiseProduct(inputCol="__standard", outputCol="__scaled",
                                 scalingVec=Vectors.dense([factor] * width))
    return Pipeline(stages=[standard, correct]).fit(train)


class Platt:
    """Sigmoid calibration of scores on held-out prefixes.

    Labels are replaced by the smoothed targets (n+ + 1) / (n+ + 2) and 1 / (n- + 2). A row with target t
    enters the regression twice, as a positive of weight t and a negative of weight 1 - t.
    """

    def __init__(self):
        self.slope, self.offset = None, None

    def fit(self, scored: DataFrame) -> Platt:
        # equal scores with equal labels are one weighted row; they are held, as each look at ``scored`` would score all rows anew
        counted = scored.groupBy(SCORE, LABEL).agg(F.count(F.lit(1)).alias("__n")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._fit(counted)
        finally:
            counted.unpersist()

    def _fit(self, counted: DataFrame) -> Platt:
        row = counted.agg(F.sum(F.col(LABEL) * F.col("__n")).alias("pos"), F.sum("__n").alias("n")).first()
        if not row["n"]:
            return self  # nothing to calibrate on: scores stay as they are
        pos, neg = float(row["pos"]), float(row["n"] - row["pos"])
        target = F.when(F.col(LABEL) == 1, (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2))
        counted = counted.withColumn("__n", F.col("__n").cast("double"))
        pairs = F.explode(F.array(
            F.struct(F.lit(1.0).alias("__y"), (target * F.col("__n")).alias("__w")),
            F.struct(F.lit(0.0).alias("__y"), ((1 - target) * F.col("__n")).alias("__w")))).alias("x")
        rows = counted.select(SCORE, pairs).select(SCORE, "x.*")
        rows = VectorAssembler(inputCols=[SCORE], outputCol="__x").transform(rows)
        fitted = LogisticRegression(featuresCol="__x", labelCol="__y", weightCol="__w", regParam=0.0, maxIter=200,
                                    tol=1e-12).fit(rows)
        self.slope, self.offset = float(fitted.coefficients[0]), float(fitted.intercept)
        return self

    def apply(self, score: Column) -> Column:
        if self.slope is None:
            return score
        return 1 / (1 + F.exp(-(score * self.slope + self.offset)))

    def transform(self, scored: DataFrame) -> DataFrame:
        return scored.withColumn(SCORE, self.apply(F.col(SCORE)))


def learning_curve(params: Mapping, train: DataFrame, val: DataFrame, seed: int = 22,
                   params_text: str = "") -> DataFrame:
    """Per boosting round: training loss, validation loss and validation AUC; losses are the mean negative log likelihood.

    The score after round t is the sum of the first t trees, so all rounds come from one model and one pass over the rows of
    either side.
    """
    model = _Boosted(params, seed).fit(train)

    def rounds(df: DataFrame) -> DataFrame:
        return model.staged(df).select(F.col(LABEL).alias("actual"), F.posexplode("predicted").alias("epoch", "predicted"))

    def losses(scores: DataFrame, name: str) -> DataFrame:
        # log(1 + exp(-m)) of the margin m towards the label, without overflow
        margin = F.when(F.col("actual") == 1, F.col("predicted")).otherwise(-F.col("predicted"))
        return scores.groupBy("epoch").agg(F.avg(F.log1p(F.exp(-F.abs(margin))) + F.greatest(-margin, F.lit(0.0))).alias(name))

    scores = rounds(val)
    aucs = auc(scores, ["epoch"]).select("epoch", F.col("auc").alias("val_auc"))
    curve = losses(rounds(train), "train_loss").join(losses(scores, "val_loss"), "epoch", "left").join(aucs, "epoch", "left")
    return curve.withColumn("params", F.lit(params_text))

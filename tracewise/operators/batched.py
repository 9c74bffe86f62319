"""Many models in one job: logistic regressions and boosted trees of every bucket, parameter set and run at once.

A search fits sets x runs x buckets models to the same encoded prefixes. Fitted one by one, each is a chain of small jobs. Here each
iteration is one job for all of them: tasks read the rows of a bucket once, add up what every model of the bucket needs (gradient
and Hessian, or a histogram of first and second derivatives for each node and feature), the sums are merged by model in a
sorted stream, and the merging task takes the step (solves for it, or finds the split). The driver gets a step or a split for each model.
So the number of jobs grows with iterations alone.

Boosting is of second order: a tree is grown by the gain of -G / (H + lambda) leaves, with the least Hessian sum of a leaf, columns drawn for
each tree, rows drawn for each tree, and a shrinking factor. Features are cut at quantiles, 255 cuts each at most, or between all their
values if there are no more.

Sums are added up in the order of the partitions, so the same rows in the same partitions give the same models.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.functions.columns import c
from tracewise.operators.bucket import BUCKET
from tracewise.operators.models import FEATURES, LABEL, SCORE
from tracewise.session import forget, keep

FLUSH = 64 << 20  # bytes of sums that a task holds before it hands them on
SHIPPED = 64 << 20  # bytes of models that go to the tasks at once; more go in several passes
BINS = 256
REFRESH = 8  # trees between two versions of the table of margins
NODES = 8  # parted nodes of a small tree, at most: their answers are the bits of a byte
PENALTY = 1.0  # lambda: weight of the squares of leaf weights
LEAST_GAIN = 1e-6
ROUNDS = 100  # Newton steps
TOLERANCE = 1e-10

Key = tuple[int, str, int]  # bucket, parameter text, run


@dataclass
class Guards:
    """What a bucket without a model answers: too few rows their mean, one class that class, no rows the fallback."""

    constants: dict[int, float]
    rows: dict[int, int]
    fallback: float

    @classmethod
    def of(cls, rows: DataFrame, min_cases: int, fallback: float) -> Guards:
        found = rows.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n"), F.avg(LABEL).alias("mean"), F.min(LABEL).alias("low"), F.max(LABEL).alias("high")).collect()
        constants = {r[BUCKET]: float(r["mean"] if r["n"] < min_cases else r["low"]) for r in found if r["n"] < min_cases or r["low"] == r["high"]}
        return cls(constants, {r[BUCKET]: r["n"] for r in found}, float(fallback))

    @property
    def buckets(self) -> list[int]:
        return sorted(set(self.rows) - set(self.constants))


def by_bucket(rows: DataFrame, buckets: Sequence[int]) -> DataFrame:
    """(bucket, y, key, x) of the rows of the given buckets, each spread over tasks and sorted, so that a task sees few buckets; as a table.

    ``key`` depends on the row alone; it decides which trees see it.
    """
    known = [n for n in rows.columns if n != FEATURES]
    x = vector_to_array(FEATURES)
    some = rows.where(F.col(BUCKET).isin(list(buckets))).select(
        F.col(BUCKET).cast("long").alias("bucket"), F.col(LABEL).cast("double").alias("y"), F.xxhash64(*[c(n) for n in known], x).alias("key"), x.alias("x"))
    spread = F.pmod(F.col("key"), F.lit(64))
    return keep(some.repartition("bucket", spread).sortWithinPartitions("bucket", "key"), "by-bucket")


def matrix(values: pa.Array) -> np.ndarray:
    n = len(values)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def runs_of(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values."""
    edges = np.flatnonzero(np.diff(values)) + 1
    for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(values)], strict=True):
        if end > start:
            yield int(values[start]), start, end


# ------------------------------------------------------------------ sums by model

_SUMS = "bucket long, model int, slot int, part long, sums binary"
_SUM_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]


def _record(names: Sequence[str], types: Sequence[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(columns, types, strict=True)], list(names))


def _summed(table: DataFrame, add, finish, schema: str) -> DataFrame:
    """``finish(bucket, model, slot, sums)`` as a row for each sum; ``add(bucket, batch)`` gives (model, slot, array) of a part of the rows."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        size, part = 0, TaskContext.get().partitionId() << 32

        def handed() -> pa.RecordBatch:
            return _record(("bucket", "model", "slot", "part", "sums"), _SUM_TYPES, [(*k, part, v.tobytes()) for k, v in held.items()])

        for batch in batches:
            for bucket, start, end in runs_of(batch.column("bucket").to_numpy()):
                for model, slot, sums in add(bucket, batch.slice(start, end - start)):
                    own = held.get((bucket, model, slot))
                    if own is None:
                        held[bucket, model, slot] = np.array(sums, np.float64)
                        size += sums.nbytes
                    else:
                        own += sums
            if size > FLUSH:
                yield handed()
                held, size, part = {}, 0, part + 1
        yield handed()

    fields = [n.split(" ")[0] for n in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}[n.split(" ")[1]] for n in schema.split(", ")]

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            done = []
            for bucket, model, slot, sums in zip(*(batch.column(n).to_pylist() for n in ("bucket", "model", "slot", "sums")), strict=True):
                if (bucket, model, slot) != key:
                    if key is not None:
                        done.append((*key, *finish(*key, own)))
                    key, own = (bucket, model, slot), np.frombuffer(sums, np.float64).copy()
                else:
                    own += np.frombuffer(sums, np.float64)
            yield _record(fields, kinds, done)
        if key is not None:
            yield _record(fields, kinds, [(*key, *finish(*key, own))])

    parts = table.mapInArrow(partial, _SUMS)
    return parts.repartition("bucket", "model", "slot").sortWithinPartitions("bucket", "model", "slot", "part").mapInArrow(merged, schema)


# ------------------------------------------------------------------ logistic regression

@dataclass
class Linear:
    """``weights`` and ``intercept`` over the features as they are, of each (bucket, parameter text, run)."""

    guards: Guards
    models: dict[Key, tuple[float, np.ndarray]]
    keys: list[tuple[str, int]]

    def table(self, spark) -> DataFrame:
        """(bucket, params, run, intercept, weights): the models as rows."""
        rows = [(*k, float(b), [float(v) for v in w]) for k, (b, w) in self.models.items()]
        return spark.createDataFrame(rows, "bucket long, params string, run int, intercept double, weights array<double>")

    def score(self, rows: DataFrame) -> DataFrame:
        """The rows with ``params``, ``run`` and ``predicted`` of each model of their bucket, by one join."""
        spark = rows.sparkSession
        named = spark.createDataFrame(self.keys, "params string, run int")
        models = self._shared(spark).withColumnsRenamed({"bucket": BUCKET, "params": "__params", "runs": "__runs"})
        known = rows.withColumn("__x", vector_to_array(FEATURES)).drop(FEATURES).join(F.broadcast(models) if self._bytes() <= SHIPPED else models, BUCKET)
        margin = F.col("intercept") + F.aggregate(F.zip_with("__x", "weights", lambda x, w: x * w), F.lit(0.0), lambda a, v: a + v)
        known = known.withColumn(SCORE, 1 / (1 + F.exp(-margin))).withColumnRenamed("__params", "params").withColumn("run", F.explode("__runs"))
        others = _without_model(rows, self.guards, {b for b, _, _ in self.models}).crossJoin(F.broadcast(named))  # a row for each set and run
        names = [*[n for n in rows.columns if n != FEATURES], "params", "run", SCORE]
        return known.select(*[c(n) for n in names]).unionByName(others.select(*[c(n) for n in names]))

    def _shared(self, spark) -> DataFrame:
        """(bucket, params, runs, intercept, weights): runs of equal weights are one row, so that a row is scored once for all of them."""
        alike: dict[tuple, tuple[np.ndarray, list[int]]] = {}
        for (bucket, text, run), (b, w) in self.models.items():
            alike.setdefault((bucket, text, float(b), w.tobytes()), (w, []))[1].append(run)
        rows = [(bucket, text, runs, b, [float(v) for v in w]) for (bucket, text, b, _), (w, runs) in alike.items()]
        return spark.createDataFrame(rows, "bucket long, params string, runs array<int>, intercept double, weights array<double>")

    def _bytes(self) -> int:
        return sum(w.nbytes for _, w in self.models.values())


def _without_model(rows: DataFrame, guards: Guards, modelled: set[int]) -> DataFrame:
    """Rows of buckets that have no model, with their constant."""
    constant = F.coalesce(*[F.when(F.col(BUCKET) == b, F.lit(v)) for b, v in guards.constants.items()], F.lit(guards.fallback))
    return rows.where(~F.col(BUCKET).isin(sorted(modelled)) if modelled else F.lit(True)).withColumn(SCORE, constant)


def fit_logit(rows: DataFrame, configs: Sequence[tuple[str, Mapping]], runs: int = 1, min_cases: int = 1, fallback: float = 0.5) -> Linear:
    """Logistic regressions with an L2 penalty over scaled features, of every bucket and parameter set (text, {"C": ...}), by Newton steps.

    Features are scaled by the mean and the deviation of their bucket; a constant one has weight 0. The penalty is that of
    ``models.estimator("logit")``. There is nothing random in it, so runs share a model. The Hessian has the square of the
    features as its size, so this is for some hundreds of them.
    """
    guards = Guards.of(rows, min_cases, fallback)
    keys = [(text, run) for text, _ in configs for run in range(runs)]
    if not guards.buckets:
        return Linear(guards, {}, keys)
    table = by_bucket(rows, guards.buckets)
    moments = rows.where(F.col(BUCKET).isin(guards.buckets)).groupBy(BUCKET).agg(Summarizer.metrics("mean", "variance").summary(F.col(FEATURES)).alias("m")).collect()
    scales: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in moments:
        n = guards.rows[r[BUCKET]]
        deviation = np.sqrt(np.maximum(r["m"]["variance"].toArray() * (n - 1) / n, 0.0))
        scales[r[BUCKET]] = (r["m"]["mean"].toArray(), np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0))
    penalties = {(b, j): 1.0 / (2.0 ** float(p["C"]) * guards.rows[b]) for b in guards.buckets for j, (_, p) in enumerate(configs)}
    state = {k: _Newton(len(scales[k[0]][0]) + 1) for k in penalties}
    for _ in range(ROUNDS):
        steps = {k: s.weights for k, s in state.items() if not s.done}
        if not steps:
            break
        found = _newton_sums(table, scales, steps, penalties, guards.rows).collect()
        for r in found:
            state[r["bucket"], r["model"]].take(r["loss"], np.array(r["step"]), r["slope"])
    forget(table)
    models = {}
    for (b, j), s in state.items():
        mean, inverse = scales[b]
        w = s.weights[1:] * inverse
        for run in range(runs):
            models[b, configs[j][0], run] = (float(s.weights[0] - w @ mean), w)
    return Linear(guards, models, keys)


class _Newton:
    """A damped descent: a step that does not lower the loss is halved."""

    def __init__(self, width: int):
        self.weights, self.step, self.loss, self.done = np.zeros(width), None, math.inf, False
        self.before = self.weights

    def take(self, loss: float, step: np.ndarray, slope: float) -> None:
        """``loss`` at the weights, the Newton step from there, and how fast the loss falls along it."""
        if loss > self.loss * (1 + 1e-14) + 1e-300 and self.step is not None and np.abs(self.step).max() > TOLERANCE:
            self.step = self.step / 2
            self.weights = self.before + self.step
            return
        self.before, self.loss, self.step = self.weights, loss, step
        self.done = bool(np.abs(step).max() <= TOLERANCE * (1 + np.abs(self.weights).max()) or slope <= 0)
        self.weights = self.weights + step


def _newton_sums(table: DataFrame, scales, steps, penalties, sizes) -> DataFrame:
    models: dict[int, list[tuple[int, np.ndarray]]] = {}
    for (b, j), w in steps.items():
        models.setdefault(b, []).append((j, w))

    def add(bucket: int, batch: pa.RecordBatch):
        if bucket not in models:
            return
        mean, inverse = scales[bucket]
        x = (matrix(batch.column("x")) - mean) * inverse
        x = np.concatenate((np.ones((len(x), 1)), x), axis=1)
        y = batch.column("y").to_numpy()
        for j, w in models[bucket]:
            margin = x @ w
            p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
            loss = np.logaddexp(0, margin).sum() - margin @ y
            yield j, 0, np.concatenate(([loss], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()))

    def finish(bucket: int, model: int, slot: int, sums: np.ndarray):
        w = steps[bucket, model]
        d, n, penalty = len(w), sizes[bucket], penalties[bucket, model]
        own = np.full(d, penalty)
        own[0] = 0.0  # the intercept has none
        gradient = sums[1:d + 1] / n + own * w
        hessian = sums[d + 1:].reshape(d, d) / n + np.diag(own)
        hessian[0, 0] += 1e-300
        step = -np.linalg.lstsq(hessian, gradient, rcond=None)[0] if np.linalg.cond(hessian) > 1e14 else -np.linalg.solve(hessian, gradient)
        return sums[0] / n + 0.5 * (own * w * w).sum(), step.tolist(), float(-gradient @ step)

    return _summed(table, add, finish, "bucket long, model int, slot int, loss double, step array<double>, slope double")


# ------------------------------------------------------------------ boosted trees

@dataclass
class Tree:
    """Nodes by number: the feature and the cut that part them (-1: a leaf), their children, and the weight of a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    weight: list[float] = field(default_factory=lambda: [0.0])

    def part(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        self.feature[node], self.cut[node] = feature, cut
        for side in (self.left, self.right):
            side[node] = len(self.feature)
            for values, value in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.weight, 0.0)):
                values.append(value)
        return self.left[node], self.right[node]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.feature, np.int64), np.array(self.cut), np.array(self.left, np.int64), np.array(self.right, np.int64), np.array(self.weight))


def routed(feature, limit, left, right, columns: np.ndarray) -> np.ndarray:
    """The node that each row ends at; rows below the limit of their node go left."""
    node = np.zeros(columns.shape[1], np.int64)
    while True:
        open_rows = np.flatnonzero(feature[node] >= 0)
        if not len(open_rows):
            return node
        at = node[open_rows]
        node[open_rows] = np.where(columns[feature[at], open_rows] < limit[at], left[at], right[at])


class Routes:
    """Where rows end in a tree; rows come as an array for each feature, of codes or of values.

    Each parted node of a small tree compares a whole column with its limit, and the answers of all nodes together, a bit each, look up
    the end. In larger trees each row goes its way.
    """

    def __init__(self, feature: np.ndarray, limit: np.ndarray, left: np.ndarray, right: np.ndarray, weight: np.ndarray):
        self.tree, self.weight = (feature, limit, left, right), weight
        parted = np.flatnonzero(feature >= 0).tolist()
        self.small, self.ends = [(int(feature[i]), limit[i].item()) for i in parted], None  # plain numbers, so a column of bytes is compared as bytes
        if len(parted) <= NODES:
            answers = np.arange(1 << len(parted))
            self.ends = np.zeros(len(answers), np.int64)
            for bit, i in enumerate(parted):  # children come after their node
                self.ends = np.where(self.ends == i, np.where(answers >> bit & 1, left[i], right[i]), self.ends)

    @classmethod
    def by_code(cls, tree: Tree) -> Routes:
        feature, cut, left, right, weight = tree.arrays()
        return cls(feature, cut + 1, left, right, weight)  # a code up to the cut is left

    def _found(self, columns: np.ndarray, by_node: np.ndarray) -> np.ndarray:
        if self.ends is None:
            return by_node[routed(*self.tree, columns)]
        answers = np.zeros(columns.shape[1], np.uint8)
        for bit, (f, limit) in enumerate(self.small):
            answers |= (columns[f] < limit).view(np.uint8) << np.uint8(bit)
        return by_node[self.ends][answers]

    def nodes(self, columns: np.ndarray) -> np.ndarray:
        return self._found(columns, np.arange(len(self.weight)))

    def weights(self, columns: np.ndarray) -> np.ndarray:
        return self._found(columns, self.weight)


def draws(seed: int, tree: int, n: int, share: float) -> np.ndarray:
    """The columns that a tree may use: a share of them, one at least, the same for a seed and tree."""
    if share >= 1:
        return np.arange(n)
    ranks = sorted(range(n), key=lambda i: hashlib.md5(f"{seed}_{tree}_{i}".encode()).digest())
    return np.array(sorted(ranks[:max(1, int(share * n))]))


def sampled(keys: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Which rows a tree sees."""
    if share >= 1:
        return np.ones(len(keys), bool)
    x = keys.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xBF58476D1CE4E5B9) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(11) < np.uint64(int(share * (1 << 53)))


def learn_cuts(table: DataFrame, bins: int = BINS) -> list[np.ndarray]:
    """Thresholds of each feature: halfway between neighbours of its values, or of their quantiles."""
    shares = [i / (bins - 1) for i in range(bins)]
    found = table.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.percentile_approx("v", shares, 10_000).alias("q")).collect()
    cuts = {}
    for r in found:
        values = np.unique(np.array(r["q"], np.float64))
        cuts[r["f"]] = (values[1:] + values[:-1]) / 2
    return [cuts[i] for i in range(len(cuts))]


@dataclass
class Boosted:
    """Boosted trees of each (bucket, parameter text, run), with the learning rate in the leaves."""

    guards: Guards
    trees: dict[Key, list[Tree]]
    keys: list[tuple[str, int]]
    cuts: list[np.ndarray]

    def table(self, spark) -> DataFrame:
        """(bucket, params, run, tree, node, feature, threshold, left, right, weight): a row for each node, features -1 at leaves."""
        rows = []
        for key, trees in self.trees.items():
            for t, tree in enumerate(trees):
                for i, f in enumerate(tree.feature):
                    rows.append((*key, t, i, f, float(self.cuts[f][tree.cut[i]]) if f >= 0 else None, tree.left[i], tree.right[i], float(tree.weight[i])))
        return spark.createDataFrame(rows, "bucket long, params string, run int, tree int, node int, feature int, threshold double, left int, right int, weight double")

    def _compiled(self) -> dict[Key, list[tuple[np.ndarray, ...]]]:
        out = {}
        for key, trees in self.trees.items():
            out[key] = []
            for tree in trees:
                feature, cut, left, right, weight = tree.arrays()
                threshold = np.array([self.cuts[f][k] if f >= 0 else 0.0 for f, k in zip(feature.tolist(), cut.tolist(), strict=True)])
                out[key].append((feature, threshold, left, right, weight))
        return out

    def _scored(self, rows: DataFrame, staged: bool) -> DataFrame:
        compiled = self._compiled()
        passes, size = [{}], 0
        for key, trees in compiled.items():
            own = sum(x.nbytes for t in trees for x in t)
            if size and size + own > SHIPPED:
                passes.append({})
                size = 0
            passes[-1][key] = trees
            size += own
        names = [n for n in rows.columns if n != FEATURES]
        modelled = sorted({b for b, _, _ in self.trees})
        flat = rows.where(F.col(BUCKET).isin(modelled)).withColumn("__x", vector_to_array(FEATURES)).drop(FEATURES)
        made = T.StructType([*[flat.schema[n] for n in names], T.StructField("params", T.StringType()), T.StructField("run", T.IntegerType()),
                             T.StructField(SCORE, T.ArrayType(T.DoubleType()) if staged else T.DoubleType())])
        out = None
        for models in passes:
            one = flat.mapInArrow(_scoring(models, names, staged), made)
            out = one if out is None else out.unionByName(one)
        return out

    def score(self, rows: DataFrame) -> DataFrame:
        """The rows with ``params``, ``run`` and ``predicted`` of each model of their bucket."""
        named = rows.sparkSession.createDataFrame(self.keys, "params string, run int")
        others = _without_model(rows, self.guards, {b for b, _, _ in self.trees}).drop(FEATURES).crossJoin(F.broadcast(named))  # a row for each set and run
        if not self.trees:
            return others
        return self._scored(rows, False).unionByName(others)

    def staged(self, rows: DataFrame) -> DataFrame:
        """The rows with ``params``, ``run`` and the margins after each tree, in one pass however many trees there are."""
        return self._scored(rows, True)


def _scoring(models: dict[Key, list], names: list[str], staged: bool):
    per_bucket: dict[int, list[tuple[str, int, list]]] = {}
    for (bucket, text, run), trees in models.items():
        per_bucket.setdefault(bucket, []).append((text, run, [Routes(*tree) for tree in trees]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, x = batch.column(BUCKET).to_numpy(), matrix(batch.column("__x"))
            for bucket in np.unique(buckets).tolist():
                at = np.flatnonzero(buckets == bucket)
                some, own = batch.select(names).take(pa.array(at)), np.ascontiguousarray(x[at].T)
                for text, run, trees in per_bucket.get(bucket, ()):
                    margins = np.zeros((len(at), len(trees))) if staged else np.zeros(len(at))
                    for t, tree in enumerate(trees):
                        weights = tree.weights(own)
                        if staged:
                            margins[:, t] = weights
                        else:
                            margins += weights
                    if staged:
                        score = pa.array(np.cumsum(margins, axis=1).tolist(), pa.list_(pa.float64()))
                    else:
                        score = pa.array(1 / (1 + np.exp(-margins)))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array([text] * len(at)), pa.array([run] * len(at), pa.int32()), score], [*names, "params", "run", SCORE])

    return scored


def fit_boosted(rows: DataFrame, configs: Sequence[tuple[str, Mapping]], runs: int = 1, seed: int = 0, min_cases: int = 1, fallback: float = 0.5,
                columns: Mapping[int, Sequence[int]] | None = None, bins: int = BINS, refresh: int = REFRESH) -> Boosted:
    """Boosted trees of every bucket, parameter set (text, parameters) and run.

    Parameters: ``n_estimators``, ``learning_rate``, ``max_depth`` (3), ``subsample`` (1), ``colsample_bytree`` (1), ``min_child_weight``
    (1: the least Hessian sum of a leaf) and ``reg_lambda`` (1). Runs differ by what they draw. ``columns`` names the features that a bucket
    may use, where it isn't all.
    """
    guards = Guards.of(rows, min_cases, fallback)
    keys = [(text, run) for text, _ in configs for run in range(runs)]
    if not guards.buckets:
        return Boosted(guards, {}, keys, [])
    table = by_bucket(rows, guards.buckets)
    cuts = learn_cuts(table, bins)
    models = [(text, run, _Params.of(p)) for text, p in configs for run in range(runs)]
    binned = keep(_binned(table, cuts), "binned")
    forget(table)
    usable = {b: np.array(sorted(columns[b])) if columns and b in columns else np.arange(len(cuts)) for b in guards.buckets}
    grown = {(b, text, run): [] for b in guards.buckets for text, run, _ in models}
    fresh = 0  # trees that the margins of the table know of
    for t in range(max(p.n_estimators for _, _, p in models)):
        active = [j for j, (_, _, p) in enumerate(models) if t < p.n_estimators]
        growing = {(b, j): Tree() for b in guards.buckets for j in active}
        chosen = {(b, j): usable[b][draws(seed + models[j][1], t, len(usable[b]), models[j][2].colsample)] for b, j in growing}
        frontier = {k: [0] for k in growing}
        recent = {(b, j): [Routes.by_code(x) for x in grown[b, models[j][0], models[j][1]][fresh:]] for b, j in growing}
        level = 0
        while any(frontier.values()):
            found = _splits(binned, cuts, models, growing, frontier, chosen, recent, t, seed, level).collect()
            frontier = {k: [] for k in growing}
            for r in found:
                key, params = (r["bucket"], r["model"]), models[r["model"]][2]
                tree, node = growing[key], r["slot"]
                if r["feature"] < 0:
                    tree.weight[node] = params.leaf(r["g"], r["h"])
                    continue
                left, right = tree.part(node, r["feature"], r["cut"])
                for child, g, h in ((left, r["left_g"], r["left_h"]), (right, r["g"] - r["left_g"], r["h"] - r["left_h"])):
                    tree.weight[child] = params.leaf(g, h)
                    if level + 1 < params.max_depth:
                        frontier[key].append(child)
            level += 1
        for (b, j), tree in growing.items():
            grown[b, models[j][0], models[j][1]].append(tree)
        if t + 1 - fresh >= refresh:
            newest = {(b, j): [Routes.by_code(x) for x in grown[b, models[j][0], models[j][1]][fresh:]] for b, j in growing}
            moved = keep(_moved(binned, newest, len(models)), "binned")
            forget(binned)
            binned, fresh = moved, t + 1
    forget(binned)
    return Boosted(guards, grown, keys, cuts)


@dataclass(frozen=True)
class _Params:
    n_estimators: int
    rate: float
    max_depth: int
    subsample: float
    colsample: float
    least: float
    penalty: float

    @classmethod
    def of(cls, p: Mapping) -> _Params:
        return cls(int(float(p["n_estimators"])), float(p.get("learning_rate", 0.3)), int(float(p.get("max_depth", 3))), float(p.get("subsample", 1.0)),
                   float(p.get("colsample_bytree", 1.0)), float(p.get("min_child_weight", 1.0)), float(p.get("reg_lambda", PENALTY)))

    def leaf(self, g: float, h: float) -> float:
        return -g / (h + self.penalty) * self.rate


_BINNED = "bucket long, y double, key long, codes binary, margins binary"


def _binned(table: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """The rows with a byte for each feature, and no margins: they are 0 for each model."""
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("x"))
            codes = np.empty(x.shape, np.uint8)
            for i, cut in enumerate(cuts):
                codes[:, i] = np.searchsorted(cut, x[:, i], side="right")
            yield pa.RecordBatch.from_arrays([b.column("bucket"), b.column("y"), b.column("key"), pa.array([r.tobytes() for r in codes], pa.binary()),
                                              pa.array([b""] * len(x), pa.binary())], ["bucket", "y", "key", "codes", "margins"])
    return table.mapInArrow(coded, _BINNED)


def _bytes_matrix(values: pa.Array, kind) -> np.ndarray:
    """Binary values of one length, a row each."""
    rows = values.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    """The codes of the rows, a column of the table in one piece."""
    return np.ascontiguousarray(_bytes_matrix(batch.column("codes"), np.uint8).T)


def _margins(batch: pa.RecordBatch, columns: np.ndarray, bucket: int, trees, n_models: int) -> np.ndarray:
    """For each model the margins of the rows of a bucket, with the trees that the table does not know of."""
    known = _bytes_matrix(batch.column("margins"), np.float64)
    margins = known.T.copy() if known.shape[1] else np.zeros((n_models, len(batch)))
    for (b, j), arrays in trees.items():
        if b == bucket:
            for one in arrays:
                margins[j] += one.weights(columns)
    return margins


def _moved(binned: DataFrame, trees, n_models: int) -> DataFrame:
    """The table with margins that know the given trees."""
    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, start, end in runs_of(batch.column("bucket").to_numpy()):
                b = batch.slice(start, end - start)
                margins = np.ascontiguousarray(_margins(b, _codes(b), bucket, trees, n_models).T)
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([r.tobytes() for r in margins], pa.binary())], b.schema.names)
    return binned.mapInArrow(moved, _BINNED)


def _splits(binned: DataFrame, cuts, models, growing, frontier, chosen, recent, t: int, seed: int, level: int) -> DataFrame:
    """The best split of each open node of each growing tree; feature -1 where none gains."""
    widths = np.array([len(x) + 1 for x in cuts])
    offsets = np.concatenate(([0], np.cumsum(widths)))
    total = int(offsets[-1])
    partial_trees = {k: Routes.by_code(tree) for k, tree in growing.items()}
    per_bucket: dict[int, list[int]] = {}
    for (b, j), nodes in frontier.items():
        if nodes:
            per_bucket.setdefault(b, []).append(j)
    params = [p for _, _, p in models]
    run_of = [run for _, run, _ in models]

    def add(bucket: int, batch: pa.RecordBatch):
        if bucket not in per_bucket:
            return
        columns = _codes(batch)
        y, keys = batch.column("y").to_numpy(), batch.column("key").to_numpy()
        margins = _margins(batch, columns, bucket, recent, len(models))
        drawn: dict[tuple[int, float], np.ndarray] = {}
        for j in per_bucket[bucket]:
            p = 1 / (1 + np.exp(-margins[j]))
            g, h = p - y, p * (1 - p)
            tree, nodes = partial_trees[bucket, j], frontier[bucket, j]
            place = np.full(len(tree.weight), -1)
            place[nodes] = np.arange(len(nodes))
            slot = place[tree.nodes(columns)]
            draw = (seed + run_of[j], params[j].subsample)
            if draw not in drawn:
                drawn[draw] = sampled(keys, draw[0], t, draw[1])
            at = np.flatnonzero(drawn[draw] & (slot >= 0))
            slot, g, h = slot[at], g[at], h[at]
            sums = np.zeros((len(nodes), 2 * total + 2))
            for f in chosen[bucket, j].tolist():
                places, size = columns[f][at] + slot * widths[f], len(nodes) * int(widths[f])
                for start, values in ((offsets[f], g), (total + offsets[f], h)):
                    sums[:, start:start + widths[f]] = np.bincount(places, values, size).reshape(len(nodes), -1)
            for i, node in enumerate(nodes):
                own = slot == i
                if own.any():
                    sums[i, -2:] = g[own].sum(), h[own].sum()
                    yield j, node, sums[i]

    def finish(bucket: int, model: int, slot: int, sums: np.ndarray):
        own, cols = params[model], chosen[bucket, model]
        g, h = sums[-2:]
        best = (LEAST_GAIN, -1, 0, 0.0, 0.0)
        for f in cols.tolist():
            low, high = offsets[f], offsets[f + 1] - 1  # a cut after each value but the last
            left_g, left_h = np.cumsum(sums[low:high]), np.cumsum(sums[total + low:total + high])
            right_g, right_h = g - left_g, h - left_h
            gain = 0.5 * (left_g ** 2 / (left_h + own.penalty) + right_g ** 2 / (right_h + own.penalty) - g ** 2 / (h + own.penalty))
            gain[(left_h < own.least) | (right_h < own.least)] = -np.inf
            if len(gain) and gain.max() > best[0]:
                cut = int(gain.argmax())
                best = (float(gain[cut]), f, cut, float(left_g[cut]), float(left_h[cut]))
        return best[1], best[2], float(g), float(h), best[3], best[4]

    return _summed(binned, add, finish, "bucket long, model int, slot int, feature int, cut int, g double, h double, left_g double, left_h double")

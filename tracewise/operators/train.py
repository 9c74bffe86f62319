"""Training per bucket, repeated runs, and scoring of parameter sets."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.feature import StandardScaler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.eventlog import EventLog
from tracewise.functions.columns import c
from tracewise.functions.params import params_from_text
from tracewise.operators.batched import Guards, fit_boosted, fit_logit
from tracewise.operators.bucket import BUCKET, bucketer
from tracewise.operators.clean import is_positive
from tracewise.operators.encode import EventEncoder, assemble, encoding
from tracewise.operators.forest import fit_forests
from tracewise.operators.models import FEATURES, LABEL, SCORE, GuardedClassifier, Platt, estimator, few_partitions, is_deep
from tracewise.operators.prefix import PREFIX, prefixes
from tracewise.operators.recurrent import DECAYS, state_features
from tracewise.operators.sparse import SparseEncoding
from tracewise.operators.split import class_ratio
from tracewise.session import keep

BATCHED = ("logit", "xgboost")


@dataclass
class EncodedSplits:
    """Prefixes of the splits as (case, prefix_nr, y, bucket, features), encoded once for all models.

    Levels are learned on all training prefixes. A level that does not occur in a bucket gives a column
    of zeros there; ``used`` lists the other columns of each bucket, so that a bucket's model sees exactly
    the columns its own prefixes would have given.
    """

    method: str
    case: str
    sides: dict[str, DataFrame]
    used: dict[int, list[int]]
    ratio: float

    def bucket(self, side: str, bucket: int) -> DataFrame:
        rows = self.sides[side].where(F.col(BUCKET) == bucket)
        if bucket not in self.used:
            return rows
        slicer = VectorSlicer(inputCol="__all", outputCol=FEATURES, indices=self.used[bucket])
        return slicer.transform(rows.withColumnRenamed(FEATURES, "__all")).drop("__all")

    def release(self) -> None:
        for df in self.sides.values():
            df.unpersist()


def encode_splits(train: EventLog, others: Mapping[str, EventLog], method: str, max_length: int | None,
                  clusters: int = 2, seed: int = 22, sparse: bool = False) -> EncodedSplits:
    """Bucket and encode a training log and other logs by it; ``method`` is ``<bucketing>_<encoding>``.

    With ``sparse`` the features are sparse vectors (``operators.sparse``), for attributes of any number of levels; the model of a
    bucket then sees all positions, those without a value in it as zeros.
    """
    bucketing, encoding_name = method.split("_")
    logs = {"train": train, **others}
    logs = {k: prefixes(v, max_length) for k, v in logs.items()}
    groups = bucketer(bucketing, train.spec, clusters, seed).fit(logs["train"])
    logs = {k: groups.transform(v) for k, v in logs.items()}
    ratio = class_ratio(train).first()[0] or 0.0
    if sparse:
        index = SparseEncoding(encoding(encoding_name, train.spec)).fit(logs["train"])
        sides = {k: index.transform(v).persist(StorageLevel.MEMORY_AND_DISK) for k, v in logs.items()}
        return EncodedSplits(method, train.spec.case, sides, {}, float(ratio))
    enc = encoding(encoding_name, train.spec).fit(logs["train"])
    names = enc.columns
    sides = {k: assemble(enc.transform(v), names).persist(StorageLevel.MEMORY_AND_DISK) for k, v in logs.items()}
    # one vector per bucket: how many rows have something other than 0 in each column
    seen = sides["train"].groupBy(BUCKET).agg(Summarizer.numNonZeros(F.col(FEATURES)).alias("n")).collect()
    used = {r[BUCKET]: [i for i, n in enumerate(r["n"].toArray()) if n > 0] or [0] for r in seen}
    return EncodedSplits(method, train.spec.case, sides, used, float(ratio))


def _own_params(params: Mapping, bucket: int) -> Mapping:
    """The parameters of a bucket, where they are keyed by bucket (``None`` names those of all others)."""
    if not params or not all(isinstance(v, Mapping) for v in params.values()):
        return params
    if bucket not in params and None not in params:
        raise KeyError(f"no parameters for bucket {bucket}; known: {', '.join(map(str, params))}")
    return params.get(bucket, params.get(None))


def fit_predict_encoded(data: EncodedSplits, cls: str, params: Mapping, score_side: str = "test", seed: int = 22,
                        min_cases: int = 1, dataset: str = "log", threads: int = 1, but: Collection[int] = ()) -> DataFrame:
    """One model per bucket of the scored side, ``but`` some; their predictions stacked.

    ``params`` may be keyed by bucket. A name ending in ``_calibrated`` calibrates on the side ``val``.
    Buckets are few (prefix lengths, states of one attribute, clusters), and every fit is a distributed job;
    ``threads`` lets several of them run at a time.
    """
    calibrated = cls.endswith("_calibrated")
    name = cls.removesuffix("_calibrated")
    if cls in BATCHED and not any(isinstance(v, Mapping) for v in params.values()):
        return evaluate_batched(data, cls, [("", params)], 1, score_side, dataset, seed, min_cases).drop("run", "params")
    buckets = sorted({r[0] for r in data.sides[score_side].select(BUCKET).distinct().collect()} - set(but))

    def one(bucket: int) -> DataFrame:
        own = _own_params(params, bucket)
        model = GuardedClassifier(name, own, seed, min_cases, data.ratio).fit(data.bucket("train", bucket))
        scored = model.score(data.bucket(score_side, bucket))
        if calibrated:
            scored = Platt().fit(model.score(data.bucket("val", bucket))).transform(scored)
        return scored

    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        parts = list(pool.map(one, buckets))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return _predictions(out, data, cls, dataset)


def _predictions(scored: DataFrame, data: EncodedSplits, cls: str, dataset: str, *others: str) -> DataFrame:
    return scored.select(
        F.lit(dataset).alias("dataset"), F.lit(data.method).alias("method"), F.lit(cls).alias("cls"),
        F.col(PREFIX).cast("int").alias("nr_events"), F.col(BUCKET).cast("long").alias(BUCKET),
        F.col(SCORE).cast("double").alias(SCORE), F.col(LABEL).alias("actual"),
        c(data.case).cast("string").alias("case_id"), *others)


def fit_predict_buckets(train: EventLog, val: EventLog, test: EventLog, method: str, cls: str, params: Mapping,
                        max_length: int | None, seed: int = 22, min_cases: int = 1, threads: int = 1) -> DataFrame:
    """Bucket, encode, train, calibrate and score in one call."""
    clusters = int(params.get("n_clusters", 2))
    data = encode_splits(train, {"val": val, "test": test}, method, max_length, clusters, seed)
    scored = keep(fit_predict_encoded(data, cls, params, "test", seed, min_cases, train.spec.name, threads), "predictions")
    data.release()
    return scored


def fit_predict_runs(data: EncodedSplits, cls: str, params: Mapping, n_runs: int, score_side: str = "val",
                     dataset: str = "log", params_text: str = "", threads: int = 1, but: Collection[int] = ()) -> DataFrame:
    """The same model trained with several seeds; rows are told apart by ``run``."""
    out = None
    for run in range(n_runs):
        one = fit_predict_encoded(data, cls, params, score_side, seed=run, dataset=dataset, threads=threads, but=but)
        one = one.withColumns({"run": F.lit(run), "params": F.lit(params_text)})
        out = one if out is None else out.unionByName(one)
    return out


def evaluate_configs(data: EncodedSplits, cls: str, configs: Sequence[str], n_runs: int = 1, score_side: str = "val",
                     dataset: str = "log", threads: int = 1) -> DataFrame:
    """Predictions of every parameter set (given as text), over shared encoded prefixes.

    Classifiers of ``BATCHED`` are fitted all at once, and so are the deep forests of a large bucket; the others one after the other.
    """
    if cls in BATCHED:
        return evaluate_batched(data, cls, [(text, params_from_text(text, cls)) for text in configs], n_runs, score_side, dataset)
    out, together = None, []
    if cls == "rf":
        sets = [(text, params_from_text(text, cls)) for text in configs]
        guards = Guards.of(data.sides["train"].select(BUCKET, LABEL), 1, data.ratio)
        together = [b for b in guards.buckets if all(is_deep(params, guards.rows[b]) for _, params in sets)]
        for bucket in together:
            one = _forests(data, bucket, guards.rows[bucket], sets, n_runs, score_side, dataset)
            out = one if out is None else out.unionByName(one)
        if not data.sides[score_side].where(~F.col(BUCKET).isin(together)).limit(1).count():
            return out
    for text in configs:
        one = fit_predict_runs(data, cls, params_from_text(text, cls.removesuffix("_calibrated")), n_runs, score_side,
                               dataset, text, threads, together)
        out = one if out is None else out.unionByName(one)
    return out


def _forests(data: EncodedSplits, bucket: int, rows: int, sets: Sequence[tuple[str, Mapping]], n_runs: int, score_side: str, dataset: str) -> DataFrame:
    """Predictions of the deep forests of a bucket, for all parameter sets and runs, grown together."""
    models = [(text, run, params) for text, params in sets for run in range(n_runs)]
    fitted = fit_forests(few_partitions(data.bucket("train", bucket), rows), [(params, run) for _, run, params in models])
    scored = fitted.score(data.bucket(score_side, bucket), "__scores")
    each = F.explode(F.array(*[F.struct(F.lit(run).alias("run"), F.lit(text).alias("params"), F.col("__scores")[i].alias(SCORE))
                               for i, (text, run, _) in enumerate(models)])).alias("x")
    return _predictions(scored.select("*", each).select("*", "x.*"), data, "rf", dataset, "run", "params")


def evaluate_batched(data: EncodedSplits, cls: str, configs: Sequence[tuple[str, Mapping]], n_runs: int = 1, score_side: str = "val",
                     dataset: str = "log", seed: int = 0, min_cases: int = 1) -> DataFrame:
    """Predictions of the models of all buckets, parameter sets (text, parameters) and runs, fitted in jobs that they share."""
    rows = data.sides["train"].select(BUCKET, LABEL, FEATURES, c(data.case), PREFIX)
    if cls == "logit":
        fitted = fit_logit(rows, configs, n_runs, min_cases, data.ratio)
    else:
        fitted = fit_boosted(rows, configs, n_runs, seed, min_cases, data.ratio, data.used or None)
    return fitted.score(data.sides[score_side]).select(
        F.lit(dataset).alias("dataset"), F.lit(data.method).alias("method"), F.lit(cls).alias("cls"),
        F.col(PREFIX).cast("int").alias("nr_events"), F.col(BUCKET).cast("long").alias(BUCKET),
        F.col(SCORE).cast("double").alias(SCORE), F.col(LABEL).alias("actual"),
        c(data.case).cast("string").alias("case_id"), "run", "params")


def sequence_curves(train: EventLog, val: EventLog, configs: Sequence[str], max_length: int, epochs: int | None = None,
                    seed: int = 22, standardize: bool = False) -> DataFrame:
    """Losses of the sequence classifier after each epoch, for each parameter text: params, epoch, train_loss, val_loss, and the rows of each.

    An epoch continues from the weights of the one before. ``epochs`` overrides what a parameter text says. Sequences are
    encoded once for all; what comes back to the driver is two numbers an epoch. With ``standardize`` features are deviations from their mean.
    """
    events = EventEncoder(train.spec).fit(train)
    columns = [f"event__{n}" for n in events.columns]
    held = [_sequence_rows(events, columns, log, max_length).persist(StorageLevel.MEMORY_AND_DISK) for log in (train, val)]
    scaled = _standard(held[0], standardize)
    sides = [scaled(rows) for rows in held]
    curve = []
    for text in configs:
        params = {**params_from_text(text, "lstm"), "inputs": len(columns) * (1 + len(DECAYS))}
        weights = None
        for epoch in range(epochs or int(params.get("nb_epoch", 50))):
            one = estimator("sequence", {**params, "nb_epoch": 1}, seed)
            model = (one if weights is None else one.setInitialWeights(weights)).fit(sides[0])
            weights = model.weights
            (train_loss, n_train), (val_loss, n_val) = [log_loss(model.transform(rows)) for rows in sides]
            curve.append((text, epoch, train_loss, val_loss, n_train, n_val))
    for rows in held:
        rows.unpersist()
    return train.df.sparkSession.createDataFrame(curve, "params string, epoch int, train_loss double, val_loss double, train_rows long, val_rows long")


def log_loss(scored: DataFrame) -> tuple[float, int]:
    """Mean negative log likelihood of the labels, and the number of rows; 0 without rows."""
    p = vector_to_array(F.col("probability"))
    own = F.when(F.col(LABEL) == 1, p[1]).otherwise(p[0])
    found = scored.agg(F.avg(-F.log(F.greatest(own, F.lit(1e-15)))).alias("loss"), F.count(F.lit(1)).alias("n")).first()
    return found["loss"] or 0.0, found["n"]


def _sequence_rows(events: EventEncoder, columns: list[str], log: EventLog, max_length: int) -> DataFrame:
    """Each prefix as its last event and the states of its recurrences: as many numbers whatever its length."""
    encoded = events.transform(prefixes(log, max_length))
    return state_features(encoded, columns, [c(log.spec.case), c(PREFIX), is_positive(encoded).alias(LABEL)], max_length=max_length)


def _standard(fit_rows: DataFrame, wanted: bool) -> Callable[[DataFrame], DataFrame]:
    """Features in deviations from their mean over the training prefixes: states of slow decay are many times the event, and would drown it."""
    if not wanted or fit_rows.isEmpty():
        return lambda rows: rows
    model = StandardScaler(inputCol=FEATURES, outputCol="__standard", withMean=True, withStd=True).fit(fit_rows)
    return lambda rows: model.transform(rows).drop(FEATURES).withColumnRenamed("__standard", FEATURES)


def fit_predict_sequences(train: EventLog, val: EventLog, test: EventLog, params: Mapping, max_length: int,
                          cls: str = "sequence_calibrated", seed: int = 22) -> DataFrame:
    """One classifier over the recurrent states of prefixes of all lengths, scored per prefix length; the parameter ``standardize`` as in ``sequence_curves``."""
    events = EventEncoder(train.spec).fit(train)
    columns = [f"event__{n}" for n in events.columns]

    fit_rows = _sequence_rows(events, columns, train, max_length).persist(StorageLevel.MEMORY_AND_DISK)
    scaled = _standard(fit_rows, bool(params.get("standardize", False)))

    def rows(log: EventLog) -> DataFrame:
        return scaled(_sequence_rows(events, columns, log, max_length))

    model = GuardedClassifier(cls.removesuffix("_calibrated"), {**params, "inputs": len(columns) * (1 + len(DECAYS))}, seed,
                              1, float(class_ratio(train).first()[0] or 0.0)).fit(scaled(fit_rows))
    fit_rows.unpersist()
    scored = model.score(rows(test))
    if cls.endswith("_calibrated"):
        scored = Platt().fit(model.score(rows(val))).transform(scored)
    return scored.select(
        F.lit(train.spec.name).alias("dataset"), F.lit("sequence").alias("method"), F.lit(cls).alias("cls"),
        F.col(PREFIX).cast("int").alias("nr_events"), F.lit(1).cast("long").alias(BUCKET),
        F.col(SCORE).cast("double").alias(SCORE), F.col(LABEL).alias("actual"),
        c(train.spec.case).cast("string").alias("case_id"))

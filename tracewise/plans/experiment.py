"""The whole way from a labelled log to evaluated predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.eventlog import EventLog
from tracewise.operators import stability as S
from tracewise.operators import tune
from tracewise.operators.auc import auc, weighted_auc
from tracewise.operators.clean import report_names
from tracewise.operators.split import max_prefix_length, split_strict, split_val
from tracewise.operators.train import (
    encode_splits,
    evaluate_configs,
    fit_predict_buckets,
    fit_predict_sequences,
    sequence_curves,
)
from tracewise.session import keep

TRAIN_RATIO = 0.8
VAL_RATIO = 0.2
FINAL_TREES = 500


def splits(log: EventLog, seed: int = 22) -> tuple[EventLog, EventLog, EventLog]:
    """64 % training, 16 % validation and 20 % test cases; the last by time."""
    train, test = split_strict(log, TRAIN_RATIO)
    train, val = split_val(train, VAL_RATIO, "random", seed)
    return train, val, test


def _written(log: EventLog) -> EventLog:
    """The log as a table: borders, caps, levels and prefixes of the sides are some ten jobs, each of which would make it anew."""
    return log.with_df(keep(log.df, "log"))


def final_predictions(log: EventLog, method: str, cls: str, params: Mapping, truncate: bool = True,
                      n_estimators: int | None = FINAL_TREES, threads: int = 1) -> DataFrame:
    """Train on the training cases, calibrate on the validation cases, score the test cases."""
    log = _written(log)
    train, val, test = splits(log)
    cap = max_prefix_length(log, truncate)
    if method == "lstm" or cls.startswith("sequence"):
        return fit_predict_sequences(train, val, test, params, cap, cls)
    if n_estimators is not None:
        params = ({k: {**v, "n_estimators": n_estimators} for k, v in params.items()}
                  if all(isinstance(v, Mapping) for v in params.values()) else {**params, "n_estimators": n_estimators})
    return fit_predict_buckets(train, val, test, method, cls, params, cap, threads=threads)


def tuning_predictions(log: EventLog, method: str, cls: str, configs: Sequence[str] | int = 16, n_runs: int = 1,
                       truncate: bool = True, seed: int = 22, threads: int = 1, epochs: int | None = None,
                       standardize: bool = False) -> DataFrame:
    """Scores of the validation cases under every parameter set; the test cases stay unseen.

    For the sequence classifier (``lstm``) these are its learning curves, from which ``tune.best_by_val_loss`` picks parameters
    and epoch; ``params_from_text`` of what it picks are the parameters of the final model.
    """
    log = _written(log)
    train, val, _ = splits(log)
    if isinstance(configs, int):
        configs = [r["params"] for r in tune.sample_params(log.df.sparkSession, cls, configs, seed).collect()]
    if method == "lstm" or cls == "lstm":
        return sequence_curves(train, val, configs, max_prefix_length(log, truncate), epochs, seed, standardize)
    data = encode_splits(train, {"val": val}, method, max_prefix_length(log, truncate))
    scored = keep(evaluate_configs(data, cls, configs, n_runs, "val", log.spec.name, threads), "predictions")
    data.release()
    return scored


def report(pred: DataFrame) -> DataFrame:
    """Weighted AUC and stability of each dataset and method, under the names used in reports."""
    named = report_names(pred)
    aucs = weighted_auc(auc(named, ["dataset", "Method", "nr_events"]))
    stable = S.stability_mean(named)
    return aucs.join(stable, ["dataset", "Method"], "left")


def evaluate(pred: DataFrame, max_length: int | None = None) -> DataFrame:
    """AUC and stability of calibrated predictions under each smoothing weight."""
    named = pred.withColumn("Method", F.concat_ws("_", "cls", "method"))
    return S.smoothing_sweep(named, max_length=max_length)

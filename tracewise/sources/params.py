"""Best parameter sets as a table keyed by dataset, method and classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.functions.params import params_from_text

KEYS = ("dataset", "method", "cls")


def save_params(best: DataFrame, path: str) -> None:
    """One row per best set: the keys, ``params`` as text and, for per-length sets, ``nr_events``."""
    if "nr_events" not in best.columns:
        best = best.withColumn("nr_events", F.lit(None).cast("int"))
    (best.select(*KEYS, F.col("nr_events").cast("int"), "params")
     .write.mode("overwrite").partitionBy("dataset").parquet(path))


def load_params(spark: SparkSession, path: str, dataset: str, method: str, cls: str,
                n_estimators: int | None = None) -> dict:
    """Parameters of one cell; a dict per prefix length if the set was chosen per length.

    ``n_estimators`` replaces the tuned number of trees (final models use more of them).
    """
    rows = (spark.read.parquet(path)
            .where((F.col("dataset") == dataset) & (F.col("method") == method) & (F.col("cls") == cls))
            .select("nr_events", "params").collect())  # at most one row per prefix length
    if not rows:
        raise LookupError(f"no parameters for {dataset}, {method}, {cls}")
    override = {} if n_estimators is None else {"n_estimators": n_estimators}
    parsed = {r["nr_events"]: {**params_from_text(r["params"], cls), **override} for r in rows}
    return parsed[None] if set(parsed) == {None} else parsed

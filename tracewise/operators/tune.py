"""Drawing parameter sets and choosing the best one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.functions.columns import c, cs
from tracewise.operators.auc import auc, auc_runs
from tracewise.operators.stability import rmspd

CELL = ("dataset", "method", "cls")

# Search spaces. (kind, bounds or choices); integer ranges leave out their upper end.
SEARCH_SPACES = {
    "rf": {"n_estimators": ("int", 150, 1000), "max_features": ("rescaled_exp", 0.01, 0.9)},
    "xgboost": {"n_estimators": ("int", 150, 1000), "learning_rate": ("uniform", 0.01, 0.07),
                "subsample": ("uniform", 0.5, 1.0), "max_depth": ("int", 3, 9),
                "colsample_bytree": ("uniform", 0.5, 1.0), "min_child_weight": ("int", 1, 3)},
    "lstm": {"lstmsize": ("rescaled_exp_int", 10, 150), "dropout": ("uniform", 0.0, 0.3),
             "n_layers": ("choice", 1, 2, 3), "batch_size": ("choice", 8, 16, 32, 64),
             "optimizer": ("choice", "rmsprop", "adam"), "learning_rate": ("rescaled_exp", 0.000001, 0.0001)},
}


def uniform_draw(key: Column) -> Column:
    """A number in [0, 1) that depends on the key only: 52 bits of its MD5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(2 ** 52)


def draw(u: Column, rule: Sequence) -> Column:
    kind, *args = rule
    if kind == "choice":
        return F.element_at(F.array(*[F.lit(a) for a in args]), (F.floor(u * len(args)) + 1).cast("int"))
    low, high = args
    if kind == "int":
        return (F.floor(u * (high - low)) + low).cast("int")
    if kind == "uniform":
        return u * (high - low) + low
    # an exponential of a uniform number, rescaled linearly to the range
    value = (F.exp(u) - 1) * (high - low) / (F.exp(F.lit(1.0)) - 1) + low
    return value.cast("int") if kind == "rescaled_exp_int" else value


def sample_params(spark: SparkSession, space: Mapping[str, Sequence] | str, n: int = 16, seed: int = 22) -> DataFrame:
    """``n`` parameter sets, one row each, with ``params`` as text; the same seed gives the same sets."""
    rules = SEARCH_SPACES[space] if isinstance(space, str) else space
    drawn = spark.range(n).select(F.col("id").alias("draw"), *[
        draw(uniform_draw(F.concat_ws("_", F.lit(str(seed)), F.col("id").cast("string"), F.lit(name))), rule).alias(name)
        for name, rule in rules.items()])
    return drawn.withColumn("params", F.concat_ws("_", *[c(name).cast("string") for name in rules]))


def best_by_auc(pred: DataFrame, by: Sequence[str] = CELL, per_length: bool = False) -> DataFrame:
    """The parameter set with the highest AUC per cell, or per cell and prefix length."""
    by = [*by, "nr_events"] if per_length else list(by)
    return _best(auc(pred, [*by, "params"]), by, F.col("auc"), "auc")


def best_by_auc_stability(pred: DataFrame, alpha: float = 1.0, beta: float = 5.0, by: Sequence[str] = CELL,
                          keys: Sequence[str] = ("case_id", "nr_events"), runs: int | None = None) -> DataFrame:
    """The set with the highest alpha * mean AUC - beta * RMSPD over training runs."""
    by = list(by)
    both = auc_runs(pred, [*by, "params"]).join(rmspd(pred, [*by, "params"], keys, runs), [*by, "params"])
    return _best(both, by, alpha * F.col("auc") - beta * F.col("rmspd"), "score")


def best_by_val_loss(curves: DataFrame, min_epoch: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """The parameter set and epoch with the lowest validation loss; the epoch is appended to the text."""
    late = curves.where(F.col("epoch") >= min_epoch)
    text = F.concat_ws("_", "params", F.col("epoch").cast("string"))
    key = F.struct(F.col("val_loss"), text.alias("params"))
    best = late.where(F.col("val_loss").isNotNull()).groupBy(*cs(by)).agg(F.min(key).alias("__best"))
    return best.select(*cs(by), F.col("__best.params").alias("params"), F.col("__best.val_loss").alias("val_loss"))


def _best(table: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    # equal values are settled by the text of the parameters
    key = F.struct((-value).alias("v"), F.col("params").alias("params"))
    best = table.where(value.isNotNull()).groupBy(*cs(by)).agg(F.min(key).alias("__best"))
    return best.select(*cs(by), F.col("__best.params").alias("params"), (-F.col("__best.v")).alias(name))

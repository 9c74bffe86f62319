"""Area under the ROC curve, overall and per group, from counts per distinct score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.functions.columns import c, cs
from tracewise.operators.scan import HotKeys, Whole, find_hot, running_sum, scan


def score_counts(pred: DataFrame, by: Sequence[str], score: str = "predicted", actual: str = "actual") -> DataFrame:
    """Positives and negatives per group and distinct score; combined before the shuffle."""
    positive = F.when(c(actual) == 1, 1).otherwise(0)
    return pred.groupBy(*cs(by), c(score).alias("__score")).agg(
        F.sum(positive).alias("__pos"), F.sum(1 - positive).alias("__neg"))


def auc(pred: DataFrame, by: Sequence[str] = (), score: str = "predicted", actual: str = "actual",
        hot: HotKeys | None | str = "auto") -> DataFrame:
    """Per group: rows, rank AUC (ties count half), and AUC with automatic direction.

    ``auc`` is null for a group of one class. ``auc_auto`` is 1 - auc where the median score of the
    negatives is above that of the positives. The scores of a group are scanned in order, so a group with
    very many distinct scores is cut into segments like an oversized case.
    """
    if hot == "auto" and find_hot(pred, list(by)) is None:
        hot = None  # no group has too many rows, let alone scores
    return auc_of_counts(score_counts(pred, by, score, actual), by, hot)


def auc_of_counts(counts: DataFrame, by: Sequence[str], hot: HotKeys | None | str = "auto") -> DataFrame:
    by = list(by)
    hot = find_hot(counts, by) if hot == "auto" else hot
    ranked = scan(counts, by, ["__score"], [
        running_sum("__cum_pos", F.col("__pos")), running_sum("__cum_neg", F.col("__neg")),
        Whole("__p", F.sum("__pos")), Whole("__n", F.sum("__neg"))], hot)
    wins = F.sum(F.col("__pos") * (F.col("__cum_neg") - F.col("__neg") / 2.0))
    pairs = F.max(F.col("__p").cast("double") * F.col("__n"))

    def median(total: str, upto: str):
        low = F.min(F.when(F.col(upto) >= F.floor((F.col(total) + 1) / 2), F.col("__score")))
        high = F.min(F.when(F.col(upto) >= F.floor(F.col(total) / 2) + 1, F.col("__score")))
        return (low + high) / 2

    measured = ranked.groupBy(*cs(by)).agg(
        F.sum(F.col("__pos") + F.col("__neg")).alias("count"),
        F.when(pairs > 0, wins / pairs).alias("auc"),
        median("__p", "__cum_pos").alias("__mid_pos"), median("__n", "__cum_neg").alias("__mid_neg"))
    flipped = F.when(F.col("__mid_neg") > F.col("__mid_pos"), 1 - F.col("auc")).otherwise(F.col("auc"))
    return measured.select(*cs(by), "count", "auc", flipped.alias("auc_auto"))


def metrics_long(pred: DataFrame, by: Sequence[str] = ("dataset", "method", "cls"),
                 hot: HotKeys | None | str = "auto") -> DataFrame:
    """AUC per prefix length, and over all lengths as ``nr_events`` -1, as rows of a long metric table."""
    keys = [*by, "nr_events"]
    if hot == "auto" and find_hot(pred, list(by)) is None:
        hot = None
    counts = score_counts(pred, keys)
    both = counts.withColumn("nr_events", F.explode(F.array(F.col("nr_events").cast("int"), F.lit(-1))))
    merged = both.groupBy(*cs(keys), "__score").agg(F.sum("__pos").alias("__pos"), F.sum("__neg").alias("__neg"))
    return auc_of_counts(merged, keys, hot).select(*cs(keys), F.lit("auc").alias("metric"), F.col("auc").alias("score"))


def weighted_auc(aucs: DataFrame, by: Sequence[str] = ("dataset", "Method"), value: str = "auc") -> DataFrame:
    """Mean AUC over prefix lengths, weighted by rows and plain.

    A length without an AUC adds nothing above the line but its rows below it.
    """
    return aucs.groupBy(*cs(by)).agg(
        (F.sum(c(value) * F.col("count")) / F.sum("count")).alias("avg_weighted_auc"),
        F.avg(c(value)).alias("avg_auc"))


def auc_runs(pred: DataFrame, by: Sequence[str] = ("params",), hot: HotKeys | None | str = "auto") -> DataFrame:
    """Mean over training runs of the AUC of each run."""
    return auc(pred, [*by, "run"], hot=hot).groupBy(*cs(by)).agg(F.avg("auc").alias("auc"))


def pivot_metric(df: DataFrame, value: str, rows: str = "dataset", cols: str = "Method",
                 names: list[str] | None = None) -> DataFrame:
    """Long to wide: one row per dataset, one column per method."""
    return df.groupBy(c(rows)).pivot(cols, names).avg(value)


def auc_vs_stability(aucs: DataFrame, stability: DataFrame, by: Sequence[str] = ("dataset", "Method", "beta")) -> DataFrame:
    return aucs.join(stability, list(by))


def auc_vs_train_size(counts: DataFrame, aucs: DataFrame) -> DataFrame:
    """AUC next to the number of training prefixes of the same length."""
    train = counts.where((F.col("data_type") == "train") & (F.col("label") == "all"))
    return train.join(aucs, ["dataset", "nr_events"])

"""How steady scores are along a case, between training runs, and after smoothing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.functions.columns import c, cs, null_safe_join
from tracewise.operators.auc import auc, weighted_auc
from tracewise.operators.scan import HotKeys, earliest, exact_quantiles, find_hot, latest, mark_hot, measure, position, previous, scan

CASE = ("dataset", "Method", "case_id")
GROUP = ("dataset", "Method")


def _hot(pred: DataFrame, keys: Sequence[str], hot: HotKeys | None | str) -> HotKeys | None:
    return find_hot(pred, list(keys)) if hot == "auto" else hot


def successive_diff(pred: DataFrame, keys: Sequence[str] = CASE, score: str = "predicted",
                    hot: HotKeys | None | str = "auto") -> DataFrame:
    """The score one event earlier, and the absolute change; null at the first prefix of a case."""
    seen = scan(pred, list(keys), ["nr_events"], [previous("lag_value", c(score))], _hot(pred, keys, hot))
    return seen.withColumn("diff", F.abs(c(score) - F.col("lag_value")))


def stability_pooled(diffs: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """1 - mean absolute change over all events."""
    return diffs.where(F.col("lag_value").isNotNull()).groupBy(*cs(by)).agg((1 - F.avg("diff")).alias("stability"))


def case_volatility(pred: DataFrame, keys: Sequence[str] = CASE, score: str = "predicted",
                    hot: HotKeys | None | str = "auto") -> DataFrame:
    """Four measures of change per case; null where a case has too few events for them."""
    keys = list(keys)
    hot = _hot(pred, keys, hot)
    diffs = successive_diff(pred, keys, score, hot).withColumn("__d", c(score) - F.col("lag_value"))
    means = [(1 - F.avg("diff")).alias("coef_mean_abs"), (1 - F.stddev_samp("__d")).alias("coef_sd")]
    if hot is None:
        table = diffs.groupBy(*cs(keys)).agg(
            *means, F.percentile("diff", 0.5).alias("coef_median_abs"),
            F.percentile("__d", 0.1).alias("__q10"), F.percentile("__d", 0.9).alias("__q90"))
    else:
        table = diffs.groupBy(*cs(keys)).agg(*means)
        table = null_safe_join(table, exact_quantiles(diffs, keys, F.col("diff"), {"coef_median_abs": 0.5}, hot),
                               keys, "left")
        table = null_safe_join(table, exact_quantiles(diffs, keys, F.col("__d"), {"__q10": 0.1, "__q90": 0.9}, hot),
                               keys, "left")
    return table.select(*cs(keys), "coef_mean_abs", "coef_median_abs", "coef_sd",
                        (1 - F.abs(F.col("__q90") - F.col("__q10"))).alias("coef_idr"))


def stability_mean(pred: DataFrame, by: Sequence[str] = GROUP, case: str = "case_id", score: str = "predicted",
                   hot: HotKeys | None | str = "auto") -> DataFrame:
    """Mean over cases of 1 - mean absolute change; cases of one event do not count."""
    keys = [*by, case]
    per_case = successive_diff(pred, keys, score, hot).groupBy(*cs(keys)).agg((1 - F.avg("diff")).alias("__s"))
    return per_case.groupBy(*cs(by)).agg(F.avg("__s").alias("mean_mean_abs"))


def rmspd(pred: DataFrame, by: Sequence[str] = ("params",),
          keys: Sequence[str] = ("case_id", "dataset_name", "nr_events"), runs: int | None = None) -> DataFrame:
    """Root of the mean, over pairs of runs, of the mean squared difference of their scores.

    The scores of a prefix are laid side by side, one column per run; a pair of runs is then a pair of
    columns, and rows are neither joined with themselves nor multiplied.
    """
    if runs is None:
        runs = pred.agg(F.max("run")).first()[0] + 1
    group = [*by, *keys]
    side_by_side = pred.groupBy(*cs(group)).agg(
        *[F.max(F.when(F.col("run") == r, F.col("predicted"))).alias(f"__r{r}") for r in range(runs)])
    pairs = [(i, j) for i in range(runs) for j in range(i)]
    squared = [F.avg((F.col(f"__r{i}") - F.col(f"__r{j}")) * (F.col(f"__r{i}") - F.col(f"__r{j}"))).alias(f"__m{i}_{j}")
               for i, j in pairs]
    total = F.lit(0.0)
    for i, j in pairs:
        total = total + F.col(f"__m{i}_{j}")
    per_pair = side_by_side.groupBy(*cs(by)).agg(*(squared or [F.lit(0.0).alias("__none")]))
    return per_pair.select(*cs(by), F.sqrt(total / max(len(pairs), 1)).alias("rmspd"))


def block_length(beta: float) -> int:
    """Positions after which a weight falls below 1e-250, the reach of one closed-form block."""
    return max(1, math.floor(250 / -math.log10(beta))) if 0 < beta < 1 else 1


def smooth(pred: DataFrame, betas: Sequence[float] | float, keys: Sequence[str] = CASE, score: str = "predicted",
           names: Sequence[str] | None = None, hot: HotKeys | None | str = "auto",
           max_length: int | None = None) -> DataFrame:
    """Exponential smoothing along a case: s1 = p1, sn = beta * s(n-1) + (1 - beta) * pn.

    A case that does not start at 1 is left out, and one with a gap ends there. Written out, sn is
    beta^n times a running sum of pi / beta^i, which a window computes in one pass. So that the powers stay
    in range, the sum restarts every ``block_length`` positions; what a block takes over from the one
    before is one term, and from older ones less than 1e-250.

    Several betas give several columns over the same window. Where no case is longer than a block
    (``max_length``, known from a prefix cap or measured), there is one block and nothing to take over.
    """
    single = not isinstance(betas, Sequence)
    betas = [betas] if single else list(betas)
    names = list(names or (["smoothed"] if single else [f"smoothed_{i}" for i in range(len(betas))]))
    keys = list(keys)
    if hot == "auto":
        sizes = measure(pred, keys)
        hot, max_length = sizes.hot, min(sizes.longest, max_length or sizes.longest)
    numbered = scan(mark_hot(pred, hot), keys, ["nr_events"], [position("__pos")], hot)
    chain = numbered.where(F.col("__pos") == F.col("nr_events"))
    columns: dict[str, Column] = {}
    carried, firsts = {}, []
    at = F.col("__pos") - 1
    for i, beta in enumerate(betas):
        if beta == 0:
            columns[names[i]] = c(score)
            continue
        if beta == 1:
            firsts.append(earliest(names[i], c(score)))
            continue
        size = block_length(beta)
        one_block = max_length is not None and max_length <= size
        inside = at if one_block else at % size
        term = F.when(at == 0, c(score)).otherwise(c(score) * (1 - beta)) * F.pow(F.lit(1 / beta), inside)
        block = [] if one_block else [F.floor(at / size)]
        window = (Window.partitionBy(*cs(keys), *block).orderBy("__pos")
                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        columns[names[i]] = F.pow(F.lit(beta), inside) * F.sum(term).over(window)
        if not one_block:
            carried[i] = (size, beta)
    result = chain.withColumns(columns)
    if firsts:
        result = scan(result, keys, ["__pos"], firsts, hot)
    if carried:
        ends = [previous(f"__end{i}", F.when(at % size == size - 1, c(names[i]))) for i, (size, _) in carried.items()]
        result = scan(result, keys, ["__pos"], ends, hot)
        result = scan(result, keys, ["__pos"], [latest(f"__carry{i}", F.col(f"__end{i}")) for i in carried], hot)
        result = result.withColumns({
            names[i]: c(names[i]) + F.coalesce(F.pow(F.lit(beta), at % size + 1) * F.col(f"__carry{i}"), F.lit(0.0))
            for i, (size, beta) in carried.items()})
        result = result.drop(*[f"__end{i}" for i in carried], *[f"__carry{i}" for i in carried])
    return result.drop("__pos", hot.mark) if hot else result.drop("__pos")


# Betas of the smoothing sweep
SWEEP_BETAS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9)


def smoothing_sweep(pred: DataFrame, betas: Sequence[float] = SWEEP_BETAS, value: str = "auc_auto",
                    hot: HotKeys | None | str = "auto", max_length: int | None = None, crowded: bool | None = None) -> DataFrame:
    """Per dataset, method and beta: count-weighted AUC and mean stability of the smoothed scores.

    ``crowded`` says whether some prefix length of a dataset and method may have too many rows for a task; it is counted if not given.
    """
    if hot == "auto":
        sizes = measure(pred, list(CASE))
        hot, max_length = sizes.hot, min(sizes.longest, max_length or sizes.longest)
    if crowded is None:
        crowded = find_hot(pred, [*GROUP, "nr_events"]) is not None
    names = [f"__s{i}" for i in range(len(betas))]
    smoothed = smooth(pred, list(betas), CASE, names=names, hot=hot, max_length=max_length)
    pairs = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("beta"), F.col(n).alias("smoothed"))
                                for b, n in zip(betas, names)])).alias("x")
    long = smoothed.select("dataset", "Method", "nr_events", "actual", pairs).select(
        "dataset", "Method", "nr_events", "actual", "x.*")
    # smoothing adds no rows: where no length has too many of them before, none has per beta
    aucs = auc(long, ["dataset", "Method", "beta", "nr_events"], score="smoothed", hot="auto" if crowded else None)
    quality = weighted_auc(aucs, ["dataset", "Method", "beta"], value).select(
        "dataset", "Method", "beta", F.col("avg_weighted_auc").alias("avg_auc"))
    # changes of all betas from one window, means per case from one shuffle
    lagged = scan(smoothed, list(CASE), ["nr_events"],
                  [previous(f"__l{i}", F.col(n)) for i, n in enumerate(names)], hot)
    per_case = lagged.groupBy(*cs(CASE)).agg(*[
        (1 - F.avg(F.abs(F.col(n) - F.col(f"__l{i}")))).alias(f"__m{i}") for i, n in enumerate(names)])
    means = per_case.groupBy(*cs(GROUP)).agg(*[F.avg(f"__m{i}").alias(f"__m{i}") for i in range(len(betas))])
    steady = means.select(*cs(GROUP), F.explode(F.array(*[
        F.struct(F.lit(float(b)).alias("beta"), F.col(f"__m{i}").alias("mean_mean_abs"))
        for i, b in enumerate(betas)])).alias("x")).select(*cs(GROUP), "x.*")
    return quality.join(steady, [*GROUP, "beta"])

"""Projection, imputation and relabelling of raw logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.eventlog import EventLog
from tracewise.functions.columns import c
from tracewise.functions.time import minutes_between
from tracewise.operators.scan import latest
from tracewise.session import keep
from tracewise.spec import REPORT_NAMES

# Kept levels up to this number become a literal list, up to the next one a broadcast table.
LITERAL_LEVELS = 1_000
BROADCAST_LEVELS = 200_000


def strip_col_prefix(df: DataFrame, prefix: str = "(case) ") -> DataFrame:
    return df.withColumnsRenamed({n: n.replace(prefix, "") for n in df.columns if prefix in n})


def project_roles(log: EventLog, extra: Sequence[str] = ()) -> EventLog:
    """Keep the columns the spec names and ``extra``; time features not made yet are left out."""
    marks = [n for n in log.df.columns if n.startswith("__hot:")]
    wanted = dict.fromkeys((*log.spec.roles, *extra, *marks))
    return log.with_df(log.df.select(*[c(n) for n in wanted if n in log.df.columns]))


def fill_case_id(df: DataFrame, case: str, value: str = "missing_caseid") -> DataFrame:
    return df.withColumn(case, F.coalesce(c(case).cast("string"), F.lit(value)))


def ffill(log: EventLog, cols: Sequence[str]) -> EventLog:
    """Nulls take the last known value of the same case."""
    filled = log.scan(*[latest(f"__filled_{i}", c(n)) for i, n in enumerate(cols)], order=log.spec.time_order)
    names = {n: F.col(f"__filled_{i}") for i, n in enumerate(cols)}
    return log.with_df(filled.df.select(*[names[n].alias(n) if n in names else c(n) for n in log.df.columns]))


def fill_missing(df: DataFrame, cat: Sequence[str], num: Sequence[str]) -> DataFrame:
    return df.withColumns({**{n: F.coalesce(c(n).cast("string"), F.lit("missing")) for n in cat},
                           **{n: F.coalesce(c(n), F.lit(0).cast(df.schema[n].dataType)) for n in num}})


def level_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, level, count) of several columns in one pass; nulls are no level."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), c(n).cast("string").alias("level"))
                                for n in cols])).alias("pair")
    return (df.select(pairs).select("pair.*").where(F.col("level").isNotNull())
            .groupBy("column", "level").agg(F.count(F.lit(1)).alias("count")))


def keep_levels(df: DataFrame, kept: DataFrame, cols: Sequence[str], other: str = "other") -> DataFrame:
    """Levels not listed in ``kept`` (column, level) become ``other``.

    A short list is written into the plan; a longer one is a table, of which the driver learns the length alone, and is joined.
    """
    rows = kept.select("column", "level").limit(LITERAL_LEVELS + 1).collect()
    if len(rows) <= LITERAL_LEVELS:
        by_column: dict[str, list[str]] = {n: [] for n in cols}
        for r in rows:
            by_column[r["column"]].append(r["level"])
        return df.withColumns({n: F.when(c(n).cast("string").isin(by_column[n]), c(n).cast("string")).otherwise(other) for n in cols})
    table = keep(kept.select("column", "level"), "levels")
    sizes = {r["column"]: r["count"] for r in table.groupBy("column").count().collect()}  # a row for each column
    for n in cols:
        levels = table.where(F.col("column") == n).select(F.col("level").alias("__level"))
        joined = df.join(F.broadcast(levels) if sizes.get(n, 0) <= BROADCAST_LEVELS else levels, c(n).cast("string") == F.col("__level"), "left")
        df = joined.withColumn(n, F.coalesce(F.col("__level"), F.lit(other))).drop("__level")
    return df


def collapse_rare(df: DataFrame, cols: Sequence[str], min_count: int = 10, exempt: Sequence[str] = ()) -> DataFrame:
    """Levels on fewer than ``min_count`` rows become ``other``."""
    cols = [n for n in cols if n not in exempt]
    return keep_levels(df, level_counts(df, cols).where(F.col("count") >= min_count), cols) if cols else df


def collapse_topk(df: DataFrame, cols: Sequence[str], k: int = 10) -> DataFrame:
    """All but the ``k`` most frequent levels become ``other``; equal counts are ordered by value."""
    place = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("level"))
    top = level_counts(df, cols).withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)
    return keep_levels(df, top, cols)


def relabel(df: DataFrame, col: str, mapping: Mapping[str, str], where: Column | None = None) -> DataFrame:
    """Replace values in one pass, so that two values may be swapped."""
    value = c(col)
    new = F.coalesce(*[F.when(value == old, F.lit(to)) for old, to in mapping.items()], value)
    return df.withColumn(col, new if where is None else F.when(where, new).otherwise(value))


def numeric_label(log: EventLog, name: str = "y") -> EventLog:
    return log.with_df(log.df.withColumn(name, is_positive(log)))


def is_positive(log: EventLog) -> Column:
    return F.when(c(log.spec.label) == log.spec.pos_label, 1).otherwise(0)


def original_case_id(case_id: Column, nr_events: Column) -> Column:
    """``a_b_3`` -> ``a_b`` for prefixes of two or more events; the shortest one has a bare id."""
    parts = F.split(case_id, "_")
    return F.when(nr_events < 2, case_id).otherwise(
        F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "_"))


def report_names(pred: DataFrame) -> DataFrame:
    """Normalise classifier, method and dataset names of prediction tables and add ``Method``."""
    # Names used in reports
    classifiers = {"lstm_calibrated": "LSTM", "rf_calibrated": "RF", "xgboost_calibrated": "XGB"}
    methods = {"single_agg": "agg", "prefix_index": "idx_mul", "single_index": "idx_pad"}
    kept = pred.where(F.col("cls").contains("calibrated"))
    named = relabel(relabel(relabel(kept, "cls", classifiers), "method", methods), "dataset", REPORT_NAMES)
    return named.withColumn("Method", F.when(F.col("cls") == "LSTM", F.lit("LSTM"))
                            .otherwise(F.concat_ws("_", "cls", "method")))


def duration(df: DataFrame, start: str, end: str, name: str = "activity_duration") -> DataFrame:
    """Minutes from start to end; 0 where one of them is unknown."""
    return df.withColumn(name, F.coalesce(minutes_between(c(end), c(start)), F.lit(0.0)))


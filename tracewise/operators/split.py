"""Splits by case and measures of a labelled log."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.eventlog import EventLog
from tracewise.functions.columns import c
from tracewise.operators.scan import Whole, find_hot, position, running_sum, scan, scan_all
from tracewise.session import hot_rows


def case_table(log: EventLog) -> DataFrame:
    """One row per case: start, end, length and label (the first known one)."""
    spec = log.spec
    ts = c(spec.timestamp)
    columns = [F.min(ts).alias("start_time"), F.max(ts).alias("end_time"), F.count(F.lit(1)).alias("case_length")]
    if spec.label in log.df.columns:
        order = F.struct(*[c(n) for n in spec.event_order])
        columns.append(F.min_by(c(spec.label), F.when(c(spec.label).isNotNull(), order)).alias(spec.label))
    return log.df.groupBy(c(spec.case)).agg(*columns)


@dataclass(frozen=True)
class Border:
    """The first case, by a sort key and its id, that is past a share of all cases."""

    key: str
    key_type: str
    case: object

    def reached(self, key: Column, case: Column) -> Column:
        """Never null: a case without an id, or without a key, comes before all others, as it does in a sort."""
        own = F.lit(self.key).cast(self.key_type)
        tied = F.lit(True) if self.case is None else F.coalesce(case >= F.lit(self.case), F.lit(False))
        return F.coalesce((key > own) | ((key == own) & tied), F.lit(False))

    def key_value(self) -> Column:
        return F.lit(self.key).cast(self.key_type)


def _border(cases: DataFrame, place: Callable[[Column], Column], at_most: int | None) -> Border | None:
    """Find a border in a table of (id, key); ``place`` gives its rank from the number of cases.

    One row comes back to the driver. As a literal it makes the sides of a split plain filters, which any
    number of later jobs can evaluate without looking for the border again.
    """
    ranked = scan_all(cases, ["key", "id"], [position("__rank"), Whole("__n", F.count(F.lit(1)))], at_most)
    rows = (ranked.where(F.col("__rank") == place(F.col("__n")))
            .select(F.col("key").cast("string").alias("key"), "id").collect())  # one row at most
    return Border(rows[0]["key"], dict(cases.dtypes)["key"], rows[0]["id"]) if rows else None


def _starts(log: EventLog) -> DataFrame:
    return log.df.groupBy(c(log.spec.case).alias("id")).agg(F.min(c(log.spec.timestamp)).alias("key"))


def _after(ratio: float) -> Callable[[Column], Column]:
    """Rank of the first case after the share ``ratio``, which is cut down to whole cases."""
    return lambda n: F.floor(F.lit(ratio) * n) + 1


def _last(ratio: float) -> Callable[[Column], Column]:
    """Rank of the first of the last cases that make up the share ``ratio``."""
    return lambda n: n - F.floor(F.lit(ratio) * n) + 1


def split_strict(log: EventLog, ratio: float = 0.8) -> tuple[EventLog, EventLog]:
    """The first ``int(ratio * n)`` cases by start train; the others test.

    Training events at or after the first test event are dropped. That event is the start of the first
    test case, so the border row is all that is needed to tell the sides apart.
    """
    sides = _strict_sides(log, ratio)
    return (sides.with_df(sides.df.where(F.col("__side") == "train").drop("__side")),
            sides.with_df(sides.df.where(F.col("__side") == "test").drop("__side")))


def _strict_sides(log: EventLog, ratio: float) -> EventLog:
    border = _border(_starts(log), _after(ratio), log.cases)
    if border is None:
        return log.with_df(log.df.withColumn("__side", F.lit("train")))
    ts, case = c(log.spec.timestamp), c(log.spec.case)
    started = log.scan(Whole("__start", F.min(ts)))
    is_test = border.reached(F.col("__start"), case)
    df = started.df.where(is_test | (ts < border.key_value()))
    return log.with_df(df.withColumn("__side", F.when(is_test, "test").otherwise("train")).drop("__start"))


def split_val(log: EventLog, ratio: float = 0.2, how: str = "random", seed: int = 22) -> tuple[EventLog, EventLog]:
    """Hold out ``int(ratio * n)`` cases: the latest ones, or the last ones by a seeded hash of the id.

    Every event is on one side. Events without a case id are one case for the temporal way and are never drawn by the random one.
    """
    case = c(log.spec.case)
    if how == "temporal":
        border = _border(_starts(log), _last(ratio), log.cases)
        df, key = log.scan(Whole("__key", F.min(c(log.spec.timestamp)))).df, F.col("__key")
    elif how == "random":
        border = _random_border(log.df, case, ratio, seed, log.cases)
        df, key = log.df, _draw(case, seed)
    else:
        raise ValueError(f"unknown split {how!r}; known: random, temporal")
    held = F.lit(False) if border is None else border.reached(key, case)
    return log.with_df(df.where(~held).drop("__key")), log.with_df(df.where(held).drop("__key"))


def _random_border(df: DataFrame, case: Column, ratio: float, seed: int, at_most: int | None) -> Border | None:
    # events without a case id have no draw; they stay where they are
    ids = df.select(case.alias("id")).where(F.col("id").isNotNull()).distinct()
    return _border(ids.select("id", _draw(F.col("id"), seed).alias("key")), _last(ratio), at_most)


def assign_splits(log: EventLog, train_ratio: float = 0.8, val_ratio: float = 0.2, seed: int = 22,
                  name: str = "data_type") -> EventLog:
    """Strict and validation split in one table, told apart by a column: train, val or test."""
    sides = _strict_sides(log, train_ratio)
    case = c(log.spec.case)
    border = _random_border(sides.df.where(F.col("__side") == "train"), case, val_ratio, seed, log.cases)
    held = F.lit(False) if border is None else border.reached(_draw(case, seed), case)
    side = F.when((F.col("__side") == "train") & held, "val").otherwise(F.col("__side"))
    return log.with_df(sides.df.withColumn(name, side).drop("__side"))


def _draw(case: Column, seed: int) -> Column:
    return F.md5(F.concat(case.cast("string"), F.lit(f"_{seed}")))


def class_ratio(log: EventLog, per: str = "event") -> DataFrame:
    """Share of positives among events, or among cases."""
    positive = F.when(c(log.spec.label) == log.spec.pos_label, 1.0).otherwise(0.0)
    if per == "event":
        return log.df.where(c(log.spec.label).isNotNull()).agg(F.avg(positive).alias("class_ratio"))
    return case_table(log).agg(F.avg(positive).alias("class_ratio"))


def positive_lengths(log: EventLog) -> DataFrame:
    """Histogram of the lengths of positive cases."""
    return (log.df.where(c(log.spec.label) == log.spec.pos_label)
            .groupBy(c(log.spec.case)).agg(F.count(F.lit(1)).alias("length"))
            .groupBy("length").agg(F.count(F.lit(1)).alias("cases")))


def pos_length_quantile(log: EventLog, q: float = 0.9) -> DataFrame:
    # lengths differ, so a log of N events has at most sqrt(2N) of them
    return positive_lengths(log).agg(
        F.ceil(F.percentile("length", q, F.col("cases"))).cast("int").alias("length_quantile"))


def max_pos_length(log: EventLog) -> DataFrame:
    return positive_lengths(log).agg(F.max("length").cast("int").alias("max_length"))


# Prefix caps. Logs named here have their own, all others the default one.
PREFIX_CAPS = {"traffic_fines": ("fixed", 10), "bpic2017": ("quantile", 20)}
DEFAULT_CAP = ("quantile", 40)


def max_prefix_length(log: EventLog, truncate: bool = True, q: float = 0.9) -> int:
    """Longest prefix to look at: a fixed cap, or the q-quantile of positive lengths up to a cap.

    Without a positive case it is the cap, or the length of the longest case if there is none.
    """
    if not truncate:
        longest = max_pos_length(log).first()["max_length"]
        return longest if longest is not None else log.df.groupBy(c(log.spec.case)).count().agg(F.max("count")).first()[0] or 0
    rule, cap = next((v for k, v in PREFIX_CAPS.items() if k in log.spec.name), DEFAULT_CAP)
    if rule == "fixed":
        return cap
    quantile = pos_length_quantile(log, q).first()["length_quantile"]
    return cap if quantile is None else min(cap, quantile)


def case_length_counts(log: EventLog, dataset: str | None = None) -> DataFrame:
    """Number of cases by class and length; a case counts with its events of each class."""
    cls = F.when(c(log.spec.label) == log.spec.pos_label, "pos").otherwise("neg")
    return (log.df.groupBy(cls.alias("label"), c(log.spec.case)).agg(F.count(F.lit(1)).alias("nr_events"))
            .groupBy("label", "nr_events").agg(F.count(F.lit(1)).alias("case_count"))
            .select(F.lit(dataset or log.spec.name).alias("dataset"), "label", "nr_events", "case_count"))


def prefix_length_counts(log: EventLog, longest: DataFrame, dataset: str, side: str = "data_type",
                         sides: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Cases with at least n events, by split x (all, pos, neg) x n, for n up to the longest length.

    ``log`` has the split in a column (see ``assign_splits``) and ``longest`` is a one-row table (see
    ``max_pos_length``). Lengths are counted first, so what follows works on one row per split, class and
    length.
    """
    cls = F.when(c(log.spec.label) == log.spec.pos_label, "pos").when(c(log.spec.label) == log.spec.neg_label, "neg")
    order = F.struct(*[c(n) for n in log.spec.event_order])
    cases = log.df.groupBy(c(side).alias("data_type"), c(log.spec.case)).agg(
        F.count(F.lit(1)).alias("length"), F.min_by(cls, F.when(cls.isNotNull(), order)).alias("label"))
    sizes = cases.groupBy("data_type", "label", "length").agg(F.count(F.lit(1)).alias("cases"))
    sizes = sizes.withColumn("label", F.explode(F.array(F.lit("all"), F.col("label")))).where("label IS NOT NULL")
    spark = log.df.sparkSession
    top = longest.first()[0] or 0
    wanted = spark.range(1, top + 1).select(F.col("id").cast("int").alias("nr_events"))
    labels = F.explode(F.array(F.lit("all"), F.lit("pos"), F.lit("neg"))).alias("label")
    kinds = F.explode(F.array(*[F.lit(n) for n in sides])).alias("data_type")
    grid = wanted.select("nr_events", labels).select("nr_events", "label", kinds)
    # a length l counts for every n up to l; lengths past the longest wanted one count as that one
    capped = (sizes.groupBy("data_type", "label", F.least("length", F.lit(top)).cast("int").alias("nr_events"))
              .agg(F.sum("cases").alias("cases")))
    per_length = grid.join(capped, ["data_type", "label", "nr_events"], "left")

    keys = ["data_type", "label"]
    hot = find_hot(per_length, keys) if top > hot_rows(spark) else None
    counted = scan(per_length, keys, [F.desc("nr_events")], [running_sum("case_count", F.col("cases"))], hot)
    return counted.select(F.lit(dataset).alias("dataset"), "data_type", "label", "nr_events",
                          F.coalesce("case_count", F.lit(0)).cast("long").alias("case_count"))


def histogram(df: DataFrame, col: str, by: list[str], width: float = 1.0) -> DataFrame:
    low = (F.floor(c(col) / width) * width).alias("bin")
    return df.groupBy(*[c(b) for b in by], low).agg(F.count(F.lit(1)).alias("count"))

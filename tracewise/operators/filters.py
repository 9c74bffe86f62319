"""Keeping and dropping whole cases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.eventlog import EventLog
from tracewise.functions.columns import c, null_safe_join
from tracewise.operators.scan import HotKeys, Whole, find_hot, scan, split_hot


def keep_cases_with(log: EventLog, activities: Sequence[str]) -> EventLog:
    """Complete cases only: those with at least one of the activities."""
    marked = log.scan(Whole("__any", F.max(c(log.spec.activity).isin(list(activities)))))
    return marked.with_df(marked.df.where("__any")).drop("__any")


def drop_cases_ending(log: EventLog, activity: str) -> EventLog:
    """Drop the cases whose last known activity is the given one."""
    last = F.max_by(c(log.spec.activity), F.when(c(log.spec.activity).isNotNull(),
                                                 F.struct(*[c(n) for n in log.spec.time_order])))
    marked = log.scan(Whole("__last", last))
    return marked.with_df(marked.df.where(~F.col("__last").eqNullSafe(F.lit(activity)))).drop("__last")


def for_cases(log: EventLog, ids: DataFrame) -> EventLog:
    """Events of the listed cases; ``ids`` has the case column."""
    return _by_case(log, ids, "left_semi")


def except_cases(log: EventLog, ids: DataFrame) -> EventLog:
    return _by_case(log, ids, "left_anti")


def _by_case(log: EventLog, ids: DataFrame, how: str) -> EventLog:
    case = log.spec.case
    ids = ids.select(c(case))
    if log.hot is None:
        return log.with_df(null_safe_join(log.df, ids, [case], how))
    # the events of an oversized case stay where they are; only its id travels
    usual, oversized = split_hot(log.df, log.hot)
    listed = null_safe_join(log.hot.groups, ids, [case], "left_semi")
    return log.with_df(null_safe_join(usual, ids, [case], how)
                       .unionByName(null_safe_join(oversized, listed, [case], how, small=True)))


def only_max_length(pred: DataFrame, lengths: Mapping[str, int], case: str = "case_id", dataset: str = "dataset",
                    hot: HotKeys | None | str = "auto") -> DataFrame:
    """Only the cases that reach the length set for their dataset.

    ``lengths`` maps a part of the dataset name to a length; datasets without a rule pass unfiltered.
    """
    hot = find_hot(pred, [dataset, case]) if hot == "auto" else hot
    sized = scan(pred, [dataset, case], ["nr_events"], [Whole("case_length", F.max("nr_events"))], hot)
    keep = F.lit(True)
    for part, length in lengths.items():
        keep = keep & (~c(dataset).contains(part) | (F.col("case_length") == length))
    return sized.where(keep)


# Longest evaluated prefix per log
LONGEST_PREFIX = {"bpic2012": 40, "bpic2017": 20, "sepsis_cases_1": 29, "sepsis_cases_2": 13, "sepsis_cases_3": 22,
                  "hospital_billing": 8, "traffic_fines": 10, "production": 16}

"""Binary outcomes of cases, and cutting a case before the event that gives its outcome away."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewise.eventlog import EventLog
from tracewise.functions.columns import c
from tracewise.operators.scan import Whole, position


def label_predicate(log: EventLog, predicate: Column, cut: bool = True, invert: bool = False,
                    and_first: Column | None = None) -> EventLog:
    """Positive if the predicate holds for some event of the case.

    ``cut`` keeps only the events before the first such event (a case that starts with it disappears);
    ``invert`` makes a match negative; ``and_first`` is a further condition on the first matching event.
    """
    marked = _first_match(log, predicate)
    hit = F.col("__first").isNotNull()
    if and_first is not None:
        # the condition at the first match, told to all events of the case
        at_first = Whole("__holds", F.max(F.when(F.col("__nr") == F.col("__first"), and_first)))
        marked = marked.scan(at_first)
        hit = hit & F.coalesce(F.col("__holds"), F.lit(False))
    spec = log.spec
    yes, no = (spec.neg_label, spec.pos_label) if invert else (spec.pos_label, spec.neg_label)
    df = marked.df.withColumn(spec.label, F.when(hit, yes).otherwise(no))
    if cut:
        df = df.where(F.col("__first").isNull() | (F.col("__nr") < F.col("__first")))
    return log.with_df(df.drop("__nr", "__first", "__holds"))


def _first_match(log: EventLog, predicate: Column) -> EventLog:
    numbered = log.scan(position("__nr"), order=log.spec.time_order)
    return numbered.scan(Whole("__first", F.min(F.when(predicate, F.col("__nr")))))


def label_activity(log: EventLog, activity: str, cut: bool = True) -> EventLog:
    return label_predicate(log, c(log.spec.activity) == activity, cut)


def label_activity_within(log: EventLog, activity: str, max_minutes: float = 28 * 1440,
                          gap: str = "timesincelastevent") -> EventLog:
    """Positive only if the activity came soon after the event before it; cut either way."""
    return label_predicate(log, c(log.spec.activity) == activity, cut=True, and_first=c(gap) <= max_minutes)


def label_attribute_present(log: EventLog, attribute: str, cut: bool = True, invert: bool = True) -> EventLog:
    """A case in which the flag is ever true is negative (positive with ``invert=False``)."""
    return label_predicate(log, c(attribute).try_cast("boolean"), cut, invert)


def label_attribute_equals(log: EventLog, attribute: str, value, cut: bool = False) -> EventLog:
    return label_predicate(log, c(attribute) == value, cut)


def label_threshold_reached(log: EventLog, target: str, running: str, cut: bool = True) -> EventLog:
    """Positive if ``running`` ever reaches the case's largest ``target``."""
    sized = log.scan(Whole("__target", F.max(c(target))))
    return label_predicate(sized, c(running) >= F.col("__target"), cut).drop("__target")


def label_last_of(log: EventLog, subset: Column, outcomes: Sequence[str], name: str = "outcome") -> EventLog:
    """One labelled copy of the log per outcome, told apart by the column ``name``.

    The outcome of a case is its last activity within the subset of events; cases without one, or with
    one that is not listed, are left out.
    """
    activity = c(log.spec.activity)
    order = F.struct(*[c(n) for n in log.spec.time_order])
    last = F.max_by(activity, F.when(subset & activity.isNotNull(), order))
    df = log.scan(Whole("__last", last)).df.where(F.col("__last").isin(list(outcomes)))
    df = df.withColumn(name, F.explode(F.array(*[F.lit(o) for o in outcomes])))
    label = F.when(F.col("__last") == F.col(name), log.spec.pos_label).otherwise(log.spec.neg_label)
    return log.with_df(df.withColumn(log.spec.label, label).drop("__last"))


def cut_before(log: EventLog, activity: str) -> EventLog:
    """Only the events before the first one of the activity."""
    marked = _first_match(log, c(log.spec.activity) == activity)
    df = marked.df.where(F.col("__first").isNull() | (F.col("__nr") < F.col("__first")))
    return log.with_df(df.drop("__nr", "__first"))

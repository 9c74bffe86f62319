"""From the raw public logs to labelled logs: one recipe per log family.

Each takes the raw table (see ``read_raw_log``) and gives labelled logs by dataset name. The steps are
lazy column expressions over one partitioning by case; only level counts are looked at on the way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.eventlog import EventLog
from tracewise.functions.columns import c
from tracewise.operators import clean, filters, label, timefeat
from tracewise.session import keep
from tracewise.sources.logs import SEQ
from tracewise.spec import (
    BPIC2012,
    BPIC2017,
    HOSPITAL_BILLING,
    PRODUCTION,
    SEPSIS_CASES,
    TIME_FEATURES,
    TRAFFIC_FINES,
    LogSpec,
    spec,
)

# ------------------------------------------------------------------------------------------------
# Activities, attributes and thresholds of the recipes

SEPSIS_RELEASES = ("Release A", "Release B", "Release C", "Release D", "Release E")
SEPSIS_RETURN_MINUTES = 28 * 1440
HOSPITAL_ENDS = ("BILLED", "DELETE", "FIN")
HOSPITAL_LABEL_COLUMNS = ("isCancelled", "isClosed", "closeCode")
TRAFFIC_UNFINISHED = "Send Fine"
BPIC2012_OUTCOMES = {"bpic2012_cancelled": "O_CANCELLED-COMPLETE", "bpic2012_accepted": "O_ACCEPTED-COMPLETE",
                     "bpic2012_declined": "O_DECLINED-COMPLETE"}
BPIC2017_OUTCOMES = {"bpic2017_cancelled": "O_Cancelled", "bpic2017_accepted": "O_Accepted",
                     "bpic2017_refused": "O_Refused"}
RARE_BELOW = 10
TOP_LEVELS = 10
# ------------------------------------------------------------------------------------------------


def _start(raw: DataFrame, base: LogSpec, fill_case: bool = False) -> EventLog:
    raw = clean.strip_col_prefix(raw)
    if fill_case:
        raw = clean.fill_case_id(raw, base.case)
    return EventLog.of(raw, base.with_(tie=(SEQ,)))


def _impute(log: EventLog, cat: Sequence[str], zero: Sequence[str] = ()) -> EventLog:
    """Carry values forward within a case, then fill what is still unknown."""
    known = set(log.df.columns)
    cat = [n for n in cat if n in known]
    # time features are never unknown
    attributes = [n for n in (*cat, *log.spec.num) if n in known and n not in TIME_FEATURES]
    log = clean.ffill(log, attributes)
    num = [n for n in (*log.spec.num, *zero) if n in known]
    return log.with_df(clean.fill_missing(log.df, cat, dict.fromkeys(num)))


def _named(log: EventLog, name: str, drop: Sequence[str] = ()) -> EventLog:
    """The log under a dataset's spec; labels are written as the recipe's positive and negative."""
    return EventLog(log.df.drop(*drop), spec(name).with_(tie=(SEQ,)), log.hot, log.cases)


def _reused(log: EventLog, reuse: bool) -> EventLog:
    return log.with_df(keep(log.df, "cleaned")) if reuse else log


def sepsis_cases(raw: DataFrame, reuse: bool = False) -> dict[str, EventLog]:
    log = _start(raw, SEPSIS_CASES, fill_case=True)
    log = clean.project_roles(filters.keep_cases_with(log, SEPSIS_RELEASES))
    log = _impute(log, log.spec.cat)
    log = log.with_df(clean.collapse_rare(log.df, log.spec.cat, RARE_BELOW))
    log = _reused(timefeat.open_cases(timefeat.timestamp_features(log)), reuse)
    labelled = {"sepsis_cases_1": label.label_activity_within(log, "Return ER", SEPSIS_RETURN_MINUTES),
                "sepsis_cases_2": label.label_activity(log, "Admission IC"),
                "sepsis_cases_3": label.label_activity(log, "Return ER"),
                "sepsis_cases_4": label.label_activity(log, "Release A")}
    return {n: _named(x, n) for n, x in labelled.items()}


def hospital_billing(raw: DataFrame, reuse: bool = False) -> dict[str, EventLog]:
    log = _start(raw, HOSPITAL_BILLING, fill_case=True)
    log = clean.project_roles(filters.keep_cases_with(log, HOSPITAL_ENDS), HOSPITAL_LABEL_COLUMNS)
    cat = (*log.spec.cat, *HOSPITAL_LABEL_COLUMNS)
    log = _impute(log, cat)
    log = log.with_df(clean.collapse_rare(log.df, cat, RARE_BELOW))
    log = _reused(timefeat.open_cases_scan(timefeat.timestamp_features(log)), reuse)
    labelled = {"hospital_billing_1": label.label_attribute_present(log, "isCancelled", cut=True),
                "hospital_billing_2": label.label_attribute_present(log, "isClosed", cut=False),
                "hospital_billing_3": label.label_activity(log, "REOPEN")}
    for number, code in ((4, "C"), (5, "A"), (6, "B")):
        labelled[f"hospital_billing_{number}"] = label.label_attribute_equals(log, "closeCode", code, cut=False)
    drops = {"hospital_billing_1": ("isCancelled",), "hospital_billing_2": ("isClosed",)}
    return {n: _named(x, n, drops.get(n, ())) for n, x in labelled.items()}


def traffic_fines(raw: DataFrame, reuse: bool = False) -> dict[str, EventLog]:
    log = _start(raw, TRAFFIC_FINES)
    log = filters.drop_cases_ending(log, TRAFFIC_UNFINISHED)
    log = clean.project_roles(log, ["totalPaymentAmount"])
    log = _impute(log, log.spec.cat, zero=["totalPaymentAmount"])
    log = log.with_df(clean.collapse_rare(log.df, log.spec.cat, RARE_BELOW, exempt=[log.spec.activity]))
    log = _reused(timefeat.open_cases(timefeat.timestamp_features(log)), reuse)
    return {"traffic_fines_1": _named(label.label_activity(log, "Send for Credit Collection"), "traffic_fines_1"),
            "traffic_fines_2": _named(label.label_threshold_reached(log, "amount", "totalPaymentAmount"),
                                      "traffic_fines_2")}


def production(raw: DataFrame) -> dict[str, EventLog]:
    log = _start(raw, PRODUCTION)
    log = log.with_df(clean.duration(log.df, "Start Timestamp", log.spec.timestamp))
    log = label.label_predicate(log, F.col("Qty_Rejected") > 0)
    log = clean.project_roles(log, [log.spec.label])
    log = _impute(log, log.spec.cat)
    log = log.with_df(clean.collapse_rare(log.df, log.spec.cat, RARE_BELOW))
    # the outcome is cut off before the clock starts, so gaps and open cases are those of the cut log
    log = timefeat.open_cases(timefeat.timestamp_features(log))
    return {"production": _named(log, "production")}


def bpic2012(raw: DataFrame, reuse: bool = False) -> dict[str, EventLog]:
    log = _start(raw, BPIC2012)
    log = clean.ffill(log, [log.spec.resource])
    log = timefeat.open_cases(timefeat.timestamp_features(log))
    log = _reused(label.label_last_of(log, c(log.spec.activity).startswith("O"), list(BPIC2012_OUTCOMES.values())), reuse)
    kept = clean.project_roles(log, ["lifecycle:transition", log.spec.label, "outcome"])
    cat = (*kept.spec.cat, "lifecycle:transition")
    return _per_outcome(kept, BPIC2012_OUTCOMES, cat, lambda df: clean.collapse_rare(df, cat, RARE_BELOW))


def bpic2017(raw: DataFrame, reuse: bool = False) -> dict[str, EventLog]:
    log = _start(raw, BPIC2017)
    log = timefeat.open_cases(timefeat.timestamp_features(log))
    log = _reused(label.label_last_of(log, c("EventOrigin") == "Offer", list(BPIC2017_OUTCOMES.values())), reuse)
    kept = clean.project_roles(log, [log.spec.label, "outcome"])
    many = [n for n in kept.spec.cat if n not in (kept.spec.activity, kept.spec.resource)]

    def collapse(df: DataFrame) -> DataFrame:
        return clean.collapse_topk(clean.collapse_rare(df, [kept.spec.resource], RARE_BELOW), many, TOP_LEVELS)

    return _per_outcome(kept, BPIC2017_OUTCOMES, kept.spec.cat, collapse)


def _per_outcome(log: EventLog, outcomes: dict[str, str], cat, collapse) -> dict[str, EventLog]:
    out = {}
    for name, outcome in outcomes.items():
        one = log.with_df(log.df.where(F.col("outcome") == outcome).drop("outcome"))
        one = _impute(one, cat)
        out[name] = _named(one.with_df(collapse(one.df)), name)
    return out


RECIPES = {"sepsis_cases": sepsis_cases, "hospital_billing": hospital_billing, "traffic_fines": traffic_fines,
           "production": production, "bpic2012": bpic2012, "bpic2017": bpic2017}

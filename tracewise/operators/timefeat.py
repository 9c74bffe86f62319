"""Time features of events and counts of cases running at the same time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.eventlog import EventLog
from tracewise.functions.columns import c
from tracewise.functions.time import micros, minutes_between
from tracewise.operators.scan import earliest, position, previous, running_sum, scan_all


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    """Month, weekday (Monday is 0), hour and minutes since midnight."""
    at = c(ts)
    return df.withColumns({"timesincemidnight": F.hour(at) * 60 + F.minute(at), "month": F.month(at),
                           "weekday": F.weekday(at), "hour": F.hour(at)})


def time_since_last(log: EventLog, name: str = "timesincelastevent") -> EventLog:
    """Minutes since the event before, 0 for the first.

    Among events at the same instant the last one gets the gap and the others 0. Reading ties backwards,
    the row before a tied row is at the same instant, except for the tie's last row.
    """
    ts, ties = log.spec.timestamp, [n for n in log.spec.time_order if n != log.spec.timestamp]
    order = [c(ts).asc(), *[c(n).desc() for n in ties]]
    seen = log.scan(previous("__before", c(ts)), order=order)
    gap = F.coalesce(minutes_between(c(ts), F.col("__before")), F.lit(0.0))
    return seen.with_df(seen.df.withColumn(name, gap)).drop("__before")


def time_since_start(log: EventLog, name: str = "timesincecasestart") -> EventLog:
    started = log.scan(earliest("__start", c(log.spec.timestamp)), order=log.spec.time_order)
    gap = minutes_between(c(log.spec.timestamp), F.col("__start"))
    return started.with_df(started.df.withColumn(name, gap)).drop("__start")


def event_nr(log: EventLog, name: str = "event_nr") -> EventLog:
    """Position in the case, from 1."""
    return log.scan(position(name), order=log.spec.time_order)


def timestamp_features(log: EventLog) -> EventLog:
    """Calendar columns, both gaps and the position."""
    log = log.with_df(calendar_features(log.df, log.spec.timestamp))
    ts = log.spec.timestamp
    log = time_since_last(log)
    # position and start share one ordering, hence one window
    log = log.scan(position("event_nr"), earliest("__start", c(ts)), order=log.spec.time_order)
    return log.with_df(log.df.withColumn("timesincecasestart", minutes_between(c(ts), F.col("__start")))).drop("__start")


def case_spans(log: EventLog) -> DataFrame:
    ts = c(log.spec.timestamp)
    return log.df.groupBy(c(log.spec.case)).agg(F.min(ts).alias("start_time"), F.max(ts).alias("end_time"))


def open_cases(log: EventLog, name: str = "open_cases") -> EventLog:
    """Number of cases with ``start <= t < end`` at the time t of each event.

    That is (starts up to t) - (ends up to t), a running sum over time. Per instant there is one row; the
    sum is taken within seconds (at most a million instants), within days (86,400 seconds) and over days,
    so no task gets more rows than a second, a day or the calendar has.
    """
    ts = log.spec.timestamp

    def at(time) -> Column:
        # never null, so that all uses of the table below keep one plan and Spark computes it once
        return F.coalesce(micros(time), F.lit(0)).alias("at")

    spans = case_spans(log).where(F.col("start_time") < F.col("end_time"))
    deltas = spans.select(F.explode(F.array(F.struct(at(F.col("start_time")), F.lit(1).alias("d")),
                                            F.struct(at(F.col("end_time")), F.lit(-1).alias("d")))).alias("x"))
    # every instant of the log needs a row, also one without a change
    instants = log.df.where(c(ts).isNotNull()).select(at(c(ts)), F.lit(0).alias("d"))
    changes = deltas.select("x.*").unionByName(instants).groupBy("at").agg(F.sum("d").alias("d"))
    second = F.floor(F.col("at") / 1_000_000)
    changes = changes.select("at", "d", F.coalesce(second, F.lit(0)).alias("second"),
                             F.coalesce(F.floor(second / 86_400), F.lit(0)).alias("day"))
    before = Window.unboundedPreceding, -1
    seconds = changes.groupBy("day", "second").agg(F.sum("d").alias("d"))
    days = seconds.groupBy("day").agg(F.sum("d").alias("d"))
    days = days.select("day", F.sum("d").over(Window.orderBy("day").rowsBetween(*before)).alias("day_before"))
    seconds = seconds.select("day", "second", F.sum("d").over(
        Window.partitionBy("day").orderBy("second").rowsBetween(*before)).alias("second_before"))
    # one row per calendar day: at most some ten thousands
    starts = seconds.join(F.broadcast(days), "day").select(
        "second", (F.coalesce("second_before", F.lit(0)) + F.coalesce("day_before", F.lit(0))).alias("base"))
    inside = changes.select("at", "second", F.sum("d").over(
        Window.partitionBy("second").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    levels = inside.join(starts, "second").select(F.col("at").alias("__at"), (F.col("n") + F.col("base")).alias(name))
    # one row per instant on the right, so a busy instant can be split on the left
    joined = log.df.withColumn("__ts", micros(c(ts))).join(levels, F.col("__ts") == F.col("__at"), "left")
    return log.with_df(joined.drop("__ts", "__at"))


def open_cases_scan(log: EventLog, name: str = "open_cases") -> EventLog:
    """Number of cases open just before each event, read in the order (time, case, ties).

    A case opens at its first event, unless that is at its end already, and closes at its first event at
    its end. So a case changes the count at two instants at most, by the first of its events there.
    """
    spec = log.spec
    case, ts = spec.case, spec.timestamp
    spans = case_spans(log).where(F.col("start_time") < F.col("end_time"))
    changes = spans.select(c(case).alias("__case"), F.explode(F.array(
        F.struct(F.col("start_time").alias("at"), F.lit(1).alias("d")),
        F.struct(F.col("end_time").alias("at"), F.lit(-1).alias("d")))).alias("x")).select("x.at", "__case", "x.d")
    visits = log.df.groupBy(c(ts).alias("at"), c(case).alias("__case")).agg(F.lit(0).alias("d"))
    steps = changes.unionByName(visits).groupBy("at", "__case").agg(F.sum("d").alias("d"))
    levels = scan_all(steps, ["at", "__case"], [running_sum("__level", F.col("d"))]).select(
        F.col("at").alias("__at"), "__case", (F.col("__level") - F.col("d")).alias("__before"),
        F.col("d").alias("__own"))
    marked = log.scan(previous("__last_ts", c(ts)), order=spec.time_order).df
    joined = marked.join(levels, (c(ts) == F.col("__at")) & c(case).eqNullSafe(F.col("__case")), "left")
    own = F.when(F.col("__last_ts") == c(ts), F.col("__own")).otherwise(0)
    return log.with_df(joined.withColumn(name, F.col("__before") + own)
                       .drop("__last_ts", "__at", "__case", "__before", "__own"))

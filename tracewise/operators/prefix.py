"""Prefixes: each running case as it looked after each of its events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewise.eventlog import EventLog
from tracewise.functions.columns import c, cs
from tracewise.operators.scan import position

PREFIX = "prefix_nr"


def prefixes(log: EventLog, max_length: int | None = None) -> EventLog:
    """Number the events of each case; event n stands for the prefix of length n.

    With a cap only the first events of a case are kept, already before the shuffle, after which no case
    is longer than the cap. Running encoders look backwards only, so the cut does not change them.
    """
    if max_length is None:
        return log.scan(position(PREFIX))
    at = Window.partitionBy(c(log.spec.case)).orderBy(*cs(log.spec.event_order))
    df = log.df.withColumn(PREFIX, F.row_number().over(at)).where(F.col(PREFIX) <= max_length)
    return EventLog(df.withColumn(PREFIX, F.col(PREFIX).cast("long")), log.spec, None, log.cases)


def prefix_log(log: EventLog, min_length: int, max_length: int) -> EventLog:
    """Every prefix spelled out as a case of its own, with id ``<case>_<n>``.

    The shortest prefix keeps the bare id; ``orig_case_id`` and ``prefix_nr`` identify a prefix without
    parsing. Event i goes to the prefixes from max(i, min_length) to the case's length, so one pass with
    a generated sequence serves all lengths.
    """
    case = log.spec.case
    first = prefixes(log, max_length)
    whole = Window.partitionBy(c(case))  # at most max_length rows each
    df = first.df.withColumnRenamed(PREFIX, "__pos").withColumn("__size", F.count(F.lit(1)).over(whole))
    df = df.where(F.col("__size") >= min_length)
    lengths = F.sequence(F.greatest(F.col("__pos"), F.lit(min_length).cast("long")), F.col("__size"))
    df = df.withColumn(PREFIX, F.explode(lengths)).withColumn("orig_case_id", c(case))
    name = F.when(F.col(PREFIX) == min_length, c(case).cast("string")).otherwise(
        F.concat_ws("_", c(case).cast("string"), F.col(PREFIX).cast("string")))
    df = df.withColumn(case, name).withColumn("case_length", F.col(PREFIX))
    return EventLog(df.drop("__pos", "__size"), log.spec)  # more cases, each of bounded length

"""Running cases on streams: smoothed scores and running features, kept as state per case.

State lives in a keyed store, of which a trigger touches what it brings and what that releases. Scores that come before their turn
wait next to the last one of their case, beyond ``HELD`` in a map by position. Events wait in a list until the watermark has passed them and are then numbered in the order of time,
so files may arrive in any order within the watermark; a timer of the case wakes it. ``maxFilesPerTrigger`` (or the like) bounds what one
trigger brings. Both functions take a streaming DataFrame and give one; they also run on a trigger that drains what
is there (``availableNow``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tracewise.functions.columns import c, cs
from tracewise.session import shared_folder
from tracewise.spec import LogSpec

STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # the one that keeps maps, lists and timers


HELD = 64  # waiting scores of a case that are kept with its value; more are kept by position


def keyed_store(spark: SparkSession) -> None:
    """Streams started from here on keep their state in the store that these operators need."""
    spark.conf.set(STORE_KEY, STORE)


def _milliseconds(duration: str) -> int:
    return int(pd.Timedelta(duration).total_seconds() * 1000)


class Smoother(StatefulProcessor):
    """State of a case: last smoothed score, its position, how many scores wait, and the first ``HELD`` of these; the others by position.

    Every question of the state is a message to the store and back, so what few scores wait come and go with the value that is read anyway.
    """

    def __init__(self, beta: float, keys: Sequence[str], score: str, ttl: int | None):
        self.beta, self.keys, self.score, self.ttl = beta, list(keys), score, ttl

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", "last double, at int, waiting long, positions array<int>, scores array<double>", self.ttl)
        self.waiting = handle.getMapState("waiting", "position int", "score double", self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = self.known.get()
        last, at, waiting, *packed = found if found is not None else (0.0, 0, 0)
        held = dict(zip(*packed, strict=True)) if packed else {}
        beta, made = self.beta, Row(*self.keys, "nr_events", self.score, "smoothed")
        # what a trigger brings for a case, two numbers a row; of a position that comes again the first score counts
        come: dict[int, float] = {}
        for r in rows:
            if r["nr_events"] is not None and r["nr_events"] > at:
                come.setdefault(r["nr_events"], r[self.score])

        def waits(position: int) -> bool:
            return position in held or (waiting > len(held) and self.waiting.containsKey((position,)))

        out = []
        for position in sorted(come):
            if position <= at:
                continue  # a waiting score has gone ahead
            if position > at + 1:
                if not waits(position):
                    if len(held) < HELD:
                        held[position] = come[position]
                    else:
                        self.waiting.updateValue((position,), (come[position],))
                    waiting += 1
                continue
            score, kept = come[position], False
            while True:
                last = score if at == 0 else beta * last + (1 - beta) * score
                at += 1
                out.append(made(*key, at, score, last))
                if kept:
                    if at in held:
                        del held[at]
                    else:
                        self.waiting.removeKey((at,))
                    waiting -= 1
                kept = waits(at + 1)
                if not kept:
                    break
                score = held[at + 1] if at + 1 in held else self.waiting.getValue((at + 1,))[0]
                if at + 1 in come:
                    come[at + 1] = score  # it was there first
        self.known.update((last, at, waiting, list(held), list(held.values())))
        return iter(out)

    def close(self) -> None:
        pass


def smooth_stream(pred: DataFrame, beta: float, keys: Sequence[str] = ("dataset", "Method", "case_id"),
                  score: str = "predicted", idle: str | None = None) -> DataFrame:
    """Exponential smoothing of arriving scores.

    A position before its turn waits in the state until those before it have come, so files may arrive in any order; one
    that was smoothed already is dropped, as is a null position, and of one that comes again the first counts. A case starts at position 1; what
    follows a gap that never fills is never smoothed, as in the batch operator. ``idle`` (a duration) forgets what was not written for so
    long, in processing time.
    """
    types = dict(pred.dtypes)
    keys = list(keys)
    keyed_store(pred.sparkSession)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "nr_events int", f"`{score}` double", "smoothed double"])
    processor = Smoother(beta, keys, score, _milliseconds(idle) if idle else None)
    return (pred.select(*cs(keys), F.col("nr_events").cast("int"), c(score).cast("double")).groupBy(*cs(keys))
            .transformWithState(processor, _struct(schema), "Append", "ProcessingTime" if idle else "None"))


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


class Numberer(StatefulProcessor):
    """State of a case: events that the watermark has not passed, and what is known of those before."""

    def __init__(self, own: Sequence[str], waiting: T.StructType, order: Sequence[str], activity: str, levels: Sequence[str], counts: Sequence[str], grace: int):
        self.own, self.schema, self.order, self.activity = list(own), waiting, list(order), activity
        self.levels, self.counts, self.grace = list(levels), list(counts), grace

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.known = handle.getValueState("known", "nr long, start long, last long, levels array<long>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        come = [tuple(r) for r in rows]
        self.waiting.appendList(come)
        self.handle.registerTimer(self._due(come))
        return iter(())

    def _due(self, rows: list[tuple]) -> int:
        """The first millisecond that is later than the earliest of the rows."""
        return min(r[-1] for r in rows) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if r[-1] // 1000 < mark]
        rest = [r for r in rows if r[-1] // 1000 >= mark]
        nr, start, last, seen = self.known.get() if self.known.exists() else (0, None, None, [0] * len(self.levels))
        if not ready:
            if not rest and last is not None and last // 1000 + self.grace <= mark:
                self.known.clear()
            return iter(())
        places = [len(self.own) if n is None else self.own.index(n) for n in self.order]
        ready.sort(key=lambda r: [(r[i] is not None, r[i]) for i in places])
        what, seen, out = self.own.index(self.activity), list(seen), []
        names = [*self.own, "event_nr", "timesincecasestart", "timesincelastevent", *self.counts]
        for r in ready:
            at, nr = r[-1], nr + 1
            start, last = at if start is None else start, at if last is None else last
            seen = [n + (r[what] == level) for n, level in zip(seen, self.levels, strict=True)]
            out.append(Row(**dict(zip(names, (*r[:-1], nr, (at - start) / 6e7, (at - last) / 6e7, *seen), strict=True))))
            last = at
        self.known.update((nr, start, last, seen))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(self._due(rest))
        else:
            self.waiting.clear()
        self.handle.registerTimer(last // 1000 + self.grace)
        return iter(out)

    def close(self) -> None:
        pass


def running_features_stream(events: DataFrame, spec: LogSpec, levels: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Position, minutes since start and since the last event, and level counts of each event, in the order of time and ties.

    An event is answered once the watermark has passed it, ``late`` behind the latest event seen, so events of a case may arrive in any order
    within that time; later ones are dropped, and so are events without a time. What is known of a case is forgotten once
    the watermark is ``late`` past its last event; what comes after starts anew. A finite source answers its last events if it
    ends with ``closing_row``.
    """
    case, ts, activity = spec.case, spec.timestamp, spec.activity
    keyed_store(events.sparkSession)
    order = list(spec.time_order)
    own = list(dict.fromkeys([case, activity, *order]))
    counts = [f"{activity}_{level}" for level in levels]
    timed = events.withColumn(ts, c(ts).cast("timestamp")).where(c(ts).isNotNull()).withWatermark(ts, late)
    rows = timed.select(*cs(own), F.unix_micros(c(ts)).alias("__at"))
    waiting = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    made = T.StructType([*waiting.fields[:-1], T.StructField("event_nr", T.LongType()), T.StructField("timesincecasestart", T.DoubleType()),
                         T.StructField("timesincelastevent", T.DoubleType()), *[T.StructField(n, T.LongType()) for n in counts]])
    order = [None if n == ts else n for n in order]  # the time is compared by its number
    processor = Numberer(own, waiting, order, activity, levels, counts, _milliseconds(late))
    return rows.groupBy(c(case)).transformWithState(processor, made, "Append", "EventTime")


def closing_row(events: DataFrame, spec: LogSpec, late: str = "1 hour") -> DataFrame:
    """One event, of no case, so late that the watermark passes all others; it is never answered itself."""
    end = events.agg(F.max(c(spec.timestamp)).alias("t")).where("t IS NOT NULL")
    after = F.col("t") + F.expr(f"INTERVAL {2 * _milliseconds(late) + 1000} MILLISECONDS".replace("MILLISECONDS", "MILLISECOND"))
    return end.select(*[(after if f.name == spec.timestamp else F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])


def drain_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there now, into a Parquet folder, and read that."""
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows")
             .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")

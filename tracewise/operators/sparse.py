"""Encodings as sparse vectors, for attributes of any number of levels.

``encode`` gives a column to each level, which is what one wants to look at, and too much for an attribute with a million of them.
Here the columns of an encoding are the rows of a table, the index (feature, level -> position). It is learned by one aggregate and stays a
table. What an event changes in the features of its case goes along as rows, (feature, level) set to a value or raised by one, O(events)
whatever the number of levels; they meet the index by a join. A running map for each case, from position to value,
then turns them into the sparse vector of each prefix.

The map is folded along the rows of a case in order and never holds more than what is not zero. Cases that are too long for a task are
cut into segments by their numbered events; the map with which a segment begins comes from sums and last values per position of the
segments before, so the segments are folded independently.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.eventlog import EventLog
from tracewise.functions.columns import c, cs, null_safe_join
from tracewise.operators.clean import is_positive
from tracewise.operators.encode import AggregateEncoder, Encoder, IndexEncoder, StateEncoder, UnionEncoder
from tracewise.operators.prefix import PREFIX
from tracewise.operators.scan import Running, Whole, position, previous, scan_all
from tracewise.session import hot_rows, keep

BROADCAST_LEVELS = 200_000  # rows of the index that may be broadcast
TASK_EVENTS = 200_000  # events whose changes a task holds
_KEY = ["feature", "numeric", "level"]
_VECTOR = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


def _change(feature, level: Column | None, value, add: bool = False) -> Column:
    """A change of one feature; ``level`` is None for a number. Without a feature or a level there is none."""
    feature = F.lit(feature) if isinstance(feature, str) else feature
    made = F.struct(feature.alias("feature"), F.lit(level is None).alias("numeric"),
                    (F.lit("") if level is None else level.cast("string")).alias("level"),
                    (value if isinstance(value, Column) else F.lit(value)).cast("double").alias("value"), F.lit(add).alias("add"))
    known = feature.isNotNull() if level is None else feature.isNotNull() & level.isNotNull()
    return F.when(known, made)


@dataclass(frozen=True)
class _Changes:
    """Columns to be run along a case, columns to be run over these, and the changes that they make.

    Those of all encoders run together: two windows, however many encoders there are.
    """

    running: list[Running]
    over: list[Running]
    levels: list[Column]
    numbers: list[Column]


def _state_changes(enc: StateEncoder, prefix: str, at: str) -> _Changes:
    names = {n: (f"{at}now{i}", f"{at}old{i}") for i, n in enumerate((*enc.cat, *enc.num))}
    levels, numbers = [], []
    for n in enc.cat:
        now, old = map(F.col, names[n])
        other = ~now.eqNullSafe(old)
        levels += [F.when(other, _change(prefix + n, old, 0.0)), F.when(other, _change(prefix + n, now, 1.0))]
    for n in enc.num:
        now, old = (F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for x in names[n])
        numbers.append(F.when(now != old, _change(prefix + n, None, now)))
    return _Changes([enc.pick(now, c(n)) for n, (now, _) in names.items()], [previous(old, F.col(now)) for now, old in names.values()], levels, numbers)


def _aggregate_changes(enc: AggregateEncoder, prefix: str, at: str) -> _Changes:
    levels = [_change(prefix + n, c(n), 1.0, add=not enc.boolean) for n in enc.cat]
    names = {(stat, n): f"{at}{stat}{i}" for stat in enc._STATISTICS for i, n in enumerate(enc.num)}
    numbers = [_change(f"{prefix}{stat}_{n}", None, F.coalesce(F.col(temp).cast("double"), F.lit(0.0))) for (stat, n), temp in names.items()]
    return _Changes([enc._STATISTICS[stat](temp, c(n)) for (stat, n), temp in names.items()], [], levels, numbers)


def _index_changes(enc: IndexEncoder, prefix: str, at: str) -> _Changes:
    here = (c(PREFIX) - 1).cast("string")
    known = F.lit(True) if enc.max_events is None else c(PREFIX) <= enc.max_events
    place = {n: F.when(known, F.concat_ws("_", F.lit(prefix + n), here)) for n in (*enc.cat, *enc.num)}
    return _Changes([], [], [_change(place[n], c(n), 1.0) for n in enc.cat], [
        _change(place[n], None, F.coalesce(c(n).cast("double"), F.lit(0.0))) for n in enc.num])


_CHANGES = {StateEncoder: _state_changes, AggregateEncoder: _aggregate_changes, IndexEncoder: _index_changes}


class SparseEncoding:
    """The features of one or more encoders as sparse vectors; ``fit`` learns the index.

    Names are those of ``encode``: <feature>_<level>, or the name of the number, with <encoder>__ before them in a union. Levels that
    training did not show are ignored, as are nulls; what is absent is 0.
    """

    def __init__(self, encoder: Encoder | Sequence[Encoder]):
        parts = encoder.parts if isinstance(encoder, UnionEncoder) else encoder if isinstance(encoder, Sequence) else None
        self.parts = [(f"{p.name}__", p) for p in parts] if parts is not None else [("", encoder)]
        self.index: DataFrame | None = None
        self.size = 0
        self.numbers_often, self.levels_often = False, True

    def changes(self, log: EventLog, *kept: str, levels: bool = True, numbers: bool = True) -> DataFrame:
        """(case, prefix, feature, numeric, level, value, add) for each feature that an event changes; the log is numbered. ``kept`` go along.

        Without ``levels`` or ``numbers`` those are left out, and so are the windows that they alone need.
        """
        parts = [_CHANGES[type(part)](part, prefix, f"__s{k}_") for k, (prefix, part) in enumerate(self.parts)]
        for columns in ([x for p in parts for x in p.running], [x for p in parts for x in p.over]):
            log = log.scan(*columns) if columns else log
        hot = [c(log.hot.mark)] if log.hot is not None and log.hot.keys else []
        own = [c(log.spec.case), c(PREFIX), *hot, *cs(kept)]
        made = [x for p in parts for x in (p.levels if levels else []) + (p.numbers if numbers else [])]
        none = _change("", None, 0.0)  # for the type, where there are none
        rows = log.df.select(*own, F.explode(F.array(*made) if made else F.slice(F.array(none), 1, 0)).alias("x")).where("x IS NOT NULL")
        return rows.select(*own, *[F.col("x")[n].alias(n) for n in (*_KEY, "value", "add")])

    def written(self, log: EventLog) -> EventLog:
        """A numbered log as a table of what is encoded alone, ordered by its numbers: what makes, joins and orders the log happens once, and its shuffle files go."""
        names = [log.spec.case, PREFIX, *[n for _, p in self.parts for n in (*p.cat, *p.num)], log.spec.label, "bucket", *([log.hot.mark] if log.hot is not None else [])]
        df = log.df.select(*cs([n for n in dict.fromkeys(names) if n in log.df.columns]))
        return log.with_df(keep(df, "numbered", clean=True)).with_spec(timestamp=PREFIX, activity=PREFIX, tie=())

    def fit(self, log: EventLog) -> SparseEncoding:
        found = self.changes(_spread(log)).where("numeric OR value <> 0").groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
        found = keep(found, "levels", clean=True)
        row = found.agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n")).first()
        # those with more than their share of all changes, and so fewer than may be broadcast
        often = F.col("n") * BROADCAST_LEVELS > (row["n"] or 0)
        index = scan_all(found, _KEY, [position("nr")], at_most=row["size"])
        self.index = keep(index.select(*_KEY, (F.col("nr") - 1).cast("int").alias("position"), often.alias("often")), "index", clean=True)
        self.size = row["size"]
        if self.size > BROADCAST_LEVELS:
            some = self.index.agg(F.every(~F.col("numeric") | F.col("often")).alias("numbers"), F.some(~F.col("numeric") & F.col("often")).alias("levels")).first()
            self.numbers_often, self.levels_often = some["numbers"], some["levels"]
        return self

    def names(self) -> DataFrame:
        """(position, name) of each feature."""
        return self.index.select("position", _name().alias("name"))

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Rows of known (feature, level), with their position.

        A large index is joined in two parts, as a number or a frequent level has far more rows than a task may get: rows of those meet them by
        broadcast and stay where they are, and only the rest is shuffled, by key.
        """
        if self.size <= BROADCAST_LEVELS:
            return rows.join(F.broadcast(self.index.drop("often")), _KEY)
        found = self._often(rows)
        return found.unionByName(self._rare(self._without_often(rows)).select(*cs(found.columns)))

    def _often(self, rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(self.index.where("often").drop("often")), _KEY)

    def _without_often(self, rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(self.index.where("often").select(*_KEY)), _KEY, "left_anti")

    def _rare(self, rows: DataFrame, parts: int | None = None) -> DataFrame:
        rest = self.index.where("NOT often").drop("often")
        if parts is not None:
            rows, rest = rows.repartition(parts, *_KEY), rest.repartition(parts, *_KEY)
        return rows.join(rest, _KEY)

    def _rows(self, log: EventLog) -> DataFrame:
        """The stream of each segment: the map it begins with, changes, and a row to be answered for each event."""
        case, limit = log.spec.case, hot_rows(log.df.sparkSession)
        long_cases = log.hot is not None and bool(log.hot.keys)
        segment = F.floor((c(PREFIX) - 1) / limit).cast("long") if long_cases else F.lit(0).cast("long")
        placed = self._placed(self.changes(log))
        kept = [n for n in ("bucket",) if n in log.df.columns]
        label = [is_positive(log).alias("y")] if log.spec.label in log.df.columns else []
        answers = log.df.select(c(case), segment.alias("__segment"), c(PREFIX), F.lit(2).alias("__kind"), F.lit(None).cast("int").alias("position"),
                                F.lit(None).cast("double").alias("value"), F.lit(False).alias("add"), *label, *cs(kept))
        none = [F.lit(None).cast(answers.schema[n].dataType).alias(n) for n in answers.columns[7:]]
        changes = placed.select(c(case), segment.alias("__segment"), c(PREFIX), F.lit(1).alias("__kind"), "position", "value", "add", *none)
        if long_cases:
            ends = log.df.where(c(log.hot.mark)).groupBy(c(case)).agg(F.max(segment).alias("__end"))  # one row for each long case
            changes = changes.unionByName(_carried(placed.where(c(log.hot.mark)), F.broadcast(ends), case, ["position"], segment).select(
                c(case), "__segment", F.lit(0).cast("long").alias(PREFIX), F.lit(0).alias("__kind"), "position", "value", F.lit(False).alias("add"), *none))
        return changes.unionByName(answers)

    def _folded(self, log: EventLog, vectors: bool) -> DataFrame:
        rows, case, size = self._rows(log), log.spec.case, self.size
        names = [case, PREFIX, *rows.columns[7:]]
        fields = [T.StructField(n, rows.schema[n].dataType) for n in names]
        made = [T.StructField("features", VectorUDT())] if vectors else [
            T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))]

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, order, now = None, [], {}
            for b in batches:
                at, out = [], []
                columns = (b.column(n).to_pylist() for n in (case, "__segment", "__kind", "position", "value", "add"))
                for i, (own, segment, kind, place, value, add) in enumerate(zip(*columns, strict=True)):
                    if (own, segment) != key:
                        key, order, now = (own, segment), [], {}
                    if kind == 2:
                        at.append(i)
                        out.append((order.copy(), [now[p] for p in order]))
                        continue
                    if place not in now:
                        insort(order, place)
                        now[place] = 0.0
                    now[place] = now[place] + value if add else value
                    if now[place] == 0.0:
                        del now[place]
                        order.remove(place)
                kept = b.select(names).take(pa.array(at, pa.int64()))
                if vectors:
                    found = [pa.array([{"type": 0, "size": size, "indices": p, "values": v} for p, v in out], _VECTOR)]
                else:
                    found = [pa.array([p for p, _ in out], pa.list_(pa.int32())), pa.array([v for _, v in out], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*kept.columns, *found], [*names, *(f.name for f in made)])

        keys = [c(case), F.col("__segment")]
        stream = rows.repartition(*keys).sortWithinPartitions(*keys, c(PREFIX), "__kind", "position")
        return stream.mapInArrow(fold, T.StructType(fields + made))

    def transform(self, log: EventLog) -> DataFrame:
        """Case, prefix, label and bucket where the log has them, and the sparse vector of each prefix."""
        return self._folded(log, True)

    def long(self, log: EventLog) -> DataFrame:
        """(case, prefix, name, value) of each feature that is not zero; prefixes of a case are numbered from 1 without gaps.

        A change holds from its event to the one before the next change of the feature, or the end of the case or segment. It is known
        where the events of the case are, so only changes to something else than zero meet the index. With a large index frequent
        features (numbers, as a rule) and the rest go apart from the start, and only the rest is shuffled once more.
        """
        last = "__last"
        parts = _tasks(log)
        log = _spread(log, parts).scan(Whole(last, F.max(c(PREFIX))))
        if self.size <= BROADCAST_LEVELS:
            rows = self._placed(self._held(log, self.changes(log, last), last))
        else:
            often = self._held(log, self._often(self.changes(log, last, levels=self.levels_often)).drop("position"), last)
            rest = self._held(log, self._without_often(self.changes(log, last, numbers=not self.numbers_often)), last)
            rows = often.unionByName(self._rare(rest, parts).select(*cs(often.columns)))
        each = F.explode(F.sequence("__from", F.col("__until") - 1)).alias(PREFIX)
        return rows.select(c(log.spec.case), each, _name().alias("name"), "value")

    def _held(self, log: EventLog, changes: DataFrame, last: str) -> DataFrame:
        """(case, feature, numeric, level, value, __from, __until): the events at which a feature stands at a value that is not zero."""
        case, limit = log.spec.case, hot_rows(log.df.sparkSession)
        segment = F.lit(0).cast("long")
        if log.hot is not None and log.hot.keys:
            segment = F.floor((c(PREFIX) - 1) / limit).cast("long")
            long_ones = changes.where(c(log.hot.mark))
            ends = log.df.where(c(log.hot.mark)).groupBy(c(case)).agg(F.max(segment).alias("__end"), F.max(last).alias(last))  # one row for each long case
            carried = _carried(long_ones, F.broadcast(ends), case, _KEY, segment, [last])
            # what a segment begins with stands before its first event
            changes = changes.select("*", segment.alias("__segment")).drop(log.hot.mark).unionByName(
                carried.withColumns({PREFIX: (F.col("__segment") * limit).cast("long")}))
        else:
            changes = changes.withColumn("__segment", segment)
        own = Window.partitionBy(c(case), "__segment", *_KEY).orderBy(c(PREFIX))
        value = F.col("value")
        if any(isinstance(p, AggregateEncoder) and p.cat and not p.boolean for _, p in self.parts):
            value = F.when(F.col("add"), F.sum("value").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))).otherwise(value)
        end = F.col(last) + 1
        if log.hot is not None and log.hot.keys:
            end = F.least(end, (F.col("__segment") + 1) * limit + 1)
        rows = changes.select(c(case), *_KEY, value.alias("value"), "__segment", c(PREFIX).alias("__from"), F.coalesce(F.lead(c(PREFIX)).over(own), end).alias("__until"))
        if log.hot is not None and log.hot.keys:
            rows = rows.withColumn("__from", F.greatest("__from", F.col("__segment") * limit + 1))
        return rows.where("value <> 0 AND __until > __from").drop("__segment")


def _name() -> Column:
    return F.when(F.col("numeric"), F.col("feature")).otherwise(F.concat_ws("_", "feature", "level"))


def _tasks(log: EventLog) -> int:
    return max(1, math.ceil(log.df.count() / TASK_EVENTS))


def _spread(log: EventLog, parts: int | None = None) -> EventLog:
    """The cases dealt to tasks of a bounded number of events, as each event becomes many rows. Long cases are cut by other means."""
    if log.hot is not None:
        return log
    return log.with_df(log.df.repartition(_tasks(log) if parts is None else parts, c(log.spec.case)))


def _carried(placed: DataFrame, ends: DataFrame, case: str, by: list[str], segment: Column, kept: Sequence[str] = ()) -> DataFrame:
    """(case, segment, by ..., value): what the features of long cases stand at when a segment begins, if not at zero.

    ``ends`` has the last segment of each case as ``__end``. A row for each feature and segment in which it changes, and then one for each later segment up to the
    next change. ``kept`` are columns of ``ends`` that go along.
    """
    each = placed.groupBy(c(case), *by, segment.alias("__own")).agg(
        F.max("add").alias("add"), F.sum("value").alias("__sum"), F.max_by("value", c(PREFIX)).alias("__set"))
    ordered = Window.partitionBy(c(case), *by).orderBy("__own")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumns({"value": F.when(F.col("add"), F.sum("__sum").over(so_far)).otherwise(F.col("__set")), "__next": F.lead("__own").over(ordered)})
    each = null_safe_join(each, ends, [case], "left").where("value <> 0")
    until = F.coalesce("__next", "__end")
    return each.where(until > F.col("__own")).select(c(case), F.explode(F.sequence(F.col("__own") + 1, until)).alias("__segment"), *by, "value", "add", *cs(kept))


class SparseOneHot:
    """Single values as positions in an index table, for columns of any number of levels; see ``encode.OneHot``."""

    def __init__(self, cols: Sequence[str]):
        self.cols = tuple(cols)
        self.index: DataFrame | None = None
        self.size = 0

    def _pairs(self, df: DataFrame) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("feature"), c(n).cast("string").alias("level")) for n in self.cols])

    def fit(self, df: DataFrame) -> SparseOneHot:
        found = df.select(F.explode(self._pairs(df)).alias("x")).select("x.*").where("level IS NOT NULL").distinct()
        self.index = keep(scan_all(found, ["feature", "level"], [position("nr")]).select("feature", "level", (F.col("nr") - 1).cast("int").alias("position")), "index")
        self.size = self.index.count()
        return self

    def long(self, df: DataFrame, keys: Sequence[str]) -> DataFrame:
        """(keys ..., position, name) of each known value."""
        rows = df.select(*cs(keys), F.explode(self._pairs(df)).alias("x")).select(*cs(keys), "x.*")
        index = F.broadcast(self.index) if self.size <= BROADCAST_LEVELS else self.index
        return rows.join(index, ["feature", "level"]).select(*cs(keys), "position", F.concat_ws("_", "feature", "level").alias("name"))

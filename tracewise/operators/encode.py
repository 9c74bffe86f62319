"""Encoders: one numeric feature row per prefix.

The prefixes of a case are not spelled out. A feature of the prefix of length n is a running column at
event n, so an encoded log has one row per event, and all encoders of a union share one window.

An encoder learns its columns (levels of categories, number of positions) on a training log and keeps
them: a level missing later gives zeros, a new one is ignored, and so are nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.eventlog import EventLog
from tracewise.functions.columns import c, cs
from tracewise.operators.clean import is_positive
from tracewise.operators.prefix import PREFIX
from tracewise.operators.scan import (
    Running,
    Whole,
    earliest,
    latest,
    previous,
    running_max,
    running_mean,
    running_min,
    running_std,
    running_sum,
)
from tracewise.spec import LogSpec

# One-hot columns are real columns; beyond this the log should be collapsed first (see operators.clean).
MAX_COLUMNS = 20_000
WIDE = 40  # columns of a vector from which on their code is kept out of a whole stage


class Encoder:
    """Base: ``fit`` learns levels, ``transform`` gives ids, label and feature columns."""

    name = ""

    def __init__(self, cat: Sequence[str] = (), num: Sequence[str] = ()):
        self.cat, self.num = tuple(cat), tuple(num)
        self.levels: dict[str, list[str]] | None = None

    # -- to be given by each encoder
    def level_columns(self) -> tuple[list[Running], list[tuple[Column, Column]]]:
        """Running columns needed for fitting, and pairs (feature name, level) to collect."""
        raise NotImplementedError

    def running(self) -> list[Running]:
        raise NotImplementedError

    def features(self) -> dict[str, Column]:
        """Feature columns over the running ones, by name."""
        raise NotImplementedError

    def learn(self, log: EventLog) -> None:
        """Learn anything that has to be known before levels."""

    def prepare(self, df: DataFrame) -> DataFrame:
        """Columns between the running ones and the features."""
        return df

    # -- shared
    def fit(self, log: EventLog) -> Encoder:
        self.learn(log)
        running, pairs = self.level_columns()
        self.levels = _collect_levels(log, running, pairs)
        return self

    @property
    def columns(self) -> list[str]:
        return list(self.features())

    def transform(self, log: EventLog) -> DataFrame:
        return _encode(log, self)

    def fit_transform(self, log: EventLog) -> DataFrame:
        return self.fit(log).transform(log)

    def extend(self, log: EventLog, prefix: str) -> tuple[EventLog, list[str]]:
        """The log with its own columns and the features next to them, under prefixed names."""
        scanned = log.scan(*self.running())
        scanned = scanned.with_df(self.prepare(scanned.df))
        features = {f"{prefix}{n}": F.coalesce(v.cast("double"), F.lit(0.0)) for n, v in self.features().items()}
        df = scanned.df.select(*cs(log.df.columns), *[v.alias(n) for n, v in features.items()])
        return log.with_df(df), list(features)

    def _one_hot(self, feature: str, value: Column) -> dict[str, Column]:
        return {f"{feature}_{level}": F.when(value == level, 1).otherwise(0)
                for level in self.levels.get(feature, [])}

    def _temp(self, *parts) -> str:
        return "__" + "_".join([self.name, *map(str, parts)])


def _collect_levels(log: EventLog, running: list[Running], pairs: list[tuple[Column, Column]]) -> dict[str, list[str]]:
    if not pairs:
        return {}
    df = log.scan(*running).df if running else log.df
    stacked = F.explode(F.array(*[F.struct(n.alias("feature"), v.cast("string").alias("level")) for n, v in pairs]))
    found = (df.select(stacked.alias("x")).select("x.*").where("level IS NOT NULL AND feature IS NOT NULL")
             .distinct().limit(MAX_COLUMNS + 1).collect())
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} one-hot columns; collapse rare levels first")
    levels: dict[str, list[str]] = {}
    for row in found:
        levels.setdefault(row["feature"], []).append(row["level"])
    return {k: sorted(v) for k, v in levels.items()}


def _ids(log: EventLog) -> list[Column]:
    ids = [c(log.spec.case), c(PREFIX)]
    return ids + [is_positive(log).alias("y")] if log.spec.label in log.df.columns else ids


def _encode(log: EventLog, encoder: Encoder) -> DataFrame:
    running = encoder.running()
    scanned = log.scan(*running) if running else log
    kept = [c(n) for n in log.df.columns if n in ("bucket",)]
    return encoder.prepare(scanned.df).select(*_ids(log), *kept, *[
        F.coalesce(v.cast("double"), F.lit(0.0)).alias(n) for n, v in encoder.features().items()])


class StateEncoder(Encoder):
    """One value per attribute: first known, last known, or that of the event before."""

    def __init__(self, name: str, pick, cat: Sequence[str] = (), num: Sequence[str] = ()):
        super().__init__(cat, num)
        self.name, self.pick = name, pick

    def level_columns(self):
        if self.pick is latest:  # every known value is the last one at its own event
            return [], [(F.lit(n), c(n)) for n in self.cat]
        return ([self.pick(self._temp(i), c(n)) for i, n in enumerate(self.cat)],
                [(F.lit(n), F.col(self._temp(i))) for i, n in enumerate(self.cat)])

    def running(self):
        return [self.pick(self._temp(i), c(n)) for i, n in enumerate((*self.cat, *self.num))]

    def features(self):
        out = {n: F.col(self._temp(len(self.cat) + i)) for i, n in enumerate(self.num)}
        for i, n in enumerate(self.cat):
            out.update(self._one_hot(n, F.col(self._temp(i))))
        return out


class AggregateEncoder(Encoder):
    """How often each level occurred (or whether it did), and statistics of numbers."""

    def __init__(self, cat: Sequence[str] = (), num: Sequence[str] = (), boolean: bool = False):
        super().__init__(cat, num)
        self.boolean = boolean
        self.name = "bool" if boolean else "agg"

    def level_columns(self):
        return [], [(F.lit(n), c(n)) for n in self.cat]

    def _counts(self):
        """(feature name, temporary name, indicator) of each level."""
        for i, n in enumerate(self.cat):
            for j, level in enumerate(self.levels.get(n, [])):
                yield f"{n}_{level}", self._temp(i, j), F.when(c(n) == level, 1).otherwise(0)

    _STATISTICS = {"mean": running_mean, "max": running_max, "min": running_min, "sum": running_sum,
                   "std": running_std}

    def running(self):
        count = running_max if self.boolean else running_sum
        return ([count(temp, hit) for _, temp, hit in self._counts()]
                + [pick(self._temp(stat, i), c(n)) for stat, pick in self._STATISTICS.items()
                   for i, n in enumerate(self.num)])

    def features(self):
        out = {name: F.col(temp) for name, temp, _ in self._counts()}
        out.update({f"{stat}_{n}": F.col(self._temp(stat, i)) for stat in self._STATISTICS
                    for i, n in enumerate(self.num)})
        return out


class IndexEncoder(Encoder):
    """The attributes of the event at each position; zeros past the end of the prefix.

    The first events of a case, ``max_events`` at most, are gathered once and looked up by position, so the plan doesn't
    grow with positions times attributes.
    """

    name = "index"

    def __init__(self, cat: Sequence[str] = (), num: Sequence[str] = (), max_events: int | None = None):
        super().__init__(cat, num)
        self.max_events = max_events

    def learn(self, log):
        if self.max_events is None:
            self.max_events = log.df.agg(F.max(PREFIX)).first()[0] or 0

    def level_columns(self):
        here = (c(PREFIX) - 1).cast("string")
        known = c(PREFIX) <= self.max_events
        return [], [(F.when(known, F.concat_ws("_", F.lit(n), here)), c(n)) for n in self.cat]

    def running(self):
        own = F.struct(*[c(n).alias(f"a{k}") for k, n in enumerate((*self.cat, *self.num))])
        first = F.when(c(PREFIX) <= self.max_events, F.struct(c(PREFIX).cast("int").alias("at"), own.alias("own")))
        return [Whole(self._temp("events"), F.collect_list(first))]

    def prepare(self, df):
        events, at = F.col(self._temp("events")), F.col(self._temp("at"))
        df = df.withColumn(self._temp("at"), F.sort_array(events))
        # events 1 to n without a gap lie at their places, where a map would be searched for every attribute and level; others are looked for
        dense = F.get(at, F.size(at) - 1)["at"] == F.size(at)
        spread = F.transform(F.sequence(F.lit(1), F.lit(max(1, int(self.max_events)))), lambda i: F.get(F.filter(at, lambda e: e["at"] == i), F.lit(0)))
        return df.withColumn(self._temp("at"), F.when(dense, at).otherwise(spread))

    def _value(self, k: int, i: int) -> Column:
        return F.when(c(PREFIX) > i, F.get(F.col(self._temp("at")), F.lit(i))["own"][f"a{k}"])

    def features(self):
        out = {}
        for k, n in enumerate(self.num):
            out.update({f"{n}_{i}": self._value(len(self.cat) + k, i) for i in range(self.max_events)})
        for k, n in enumerate(self.cat):
            for i in range(self.max_events):
                out.update(self._one_hot(f"{n}_{i}", self._value(k, i)))
        return out


class UnionEncoder(Encoder):
    """Several encoders side by side, in one pass over the log."""

    def __init__(self, parts: Sequence[Encoder]):
        super().__init__()
        self.parts = list(parts)

    def fit(self, log):
        for part in self.parts:
            part.learn(log)
        fits = [part.level_columns() for part in self.parts]
        pairs = [(F.concat(F.lit(f"{k}:"), n), v) for k, (_, ps) in enumerate(fits) for n, v in ps]
        levels = _collect_levels(log, [r for rs, _ in fits for r in rs], pairs)
        for k, part in enumerate(self.parts):
            part.levels = {n.split(":", 1)[1]: v for n, v in levels.items() if n.split(":", 1)[0] == str(k)}
        return self

    def running(self):
        return [r for part in self.parts for r in part.running()]

    def prepare(self, df):
        for part in self.parts:
            df = part.prepare(df)
        return df

    def features(self):
        return {f"{part.name}__{n}": v for part in self.parts for n, v in part.features().items()}


# Encoders by name: (attributes of the case or of the event, constructor)
_ENCODERS = {
    "static": ("static", lambda cat, num, k: StateEncoder("static", earliest, cat, num)),
    "last": ("dynamic", lambda cat, num, k: StateEncoder("last", latest, cat, num)),
    "previous": ("dynamic", lambda cat, num, k: StateEncoder("previous", previous, cat, num)),
    "agg": ("dynamic", lambda cat, num, k: AggregateEncoder(cat, num)),
    "bool": ("dynamic", lambda cat, num, k: AggregateEncoder(cat, num, boolean=True)),
    "index": ("dynamic", lambda cat, num, k: IndexEncoder(cat, num, k)),
}

# Encoders that make up each named encoding
ENCODINGS = {"laststate": ("static", "last"), "agg": ("static", "agg"), "index": ("static", "index"),
             "combined": ("static", "last", "agg")}


def encoder(name: str, spec: LogSpec | None = None, cat: Sequence[str] | None = None,
            num: Sequence[str] | None = None, max_events: int | None = None) -> Encoder:
    """An encoder by name over the attributes of a spec, or over given columns."""
    if name not in _ENCODERS:
        raise KeyError(f"unknown encoder {name!r}; known: {', '.join(_ENCODERS)}")
    kind, build = _ENCODERS[name]
    if spec is not None:
        cat = (spec.static_cat if kind == "static" else spec.dynamic_cat) if cat is None else cat
        num = (spec.static_num if kind == "static" else spec.dynamic_num) if num is None else num
    return build(cat or (), num or (), max_events)


def encoding(name: str, spec: LogSpec, max_events: int | None = None) -> UnionEncoder:
    """The union of encoders a method name stands for."""
    if name not in ENCODINGS:
        raise KeyError(f"unknown encoding {name!r}; known: {', '.join(ENCODINGS)}")
    return UnionEncoder([encoder(n, spec, max_events=max_events) for n in ENCODINGS[name]])


def index_extract(encoded: DataFrame, cat: Sequence[str], num: Sequence[str], max_events: int,
                  columns: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The columns of the first positions of an index encoding; wanted ones it lacks are 0."""
    if columns is None:
        starts = tuple(f"{n}_{i}_" for n in cat for i in range(max_events))
        numbers = [f"{n}_{i}" for n in num for i in range(max_events)]
        columns = [n for n in encoded.columns if starts and n.startswith(starts)] + numbers
    present = set(encoded.columns)
    ids = [n for n in encoded.columns if n in (PREFIX, "y", "bucket")] or []
    first = encoded.columns[0]
    chosen = [c(n) if n in present else F.lit(0.0).alias(n) for n in columns]
    return encoded.select(c(first), *[c(n) for n in ids if n != first], *chosen), list(columns)


class OneHot:
    """One-hot columns of single values with levels frozen at fit."""

    def __init__(self, cols: Sequence[str]):
        self.cols = tuple(cols)
        self.levels: dict[str, list[str]] = {}

    def fit(self, df: DataFrame) -> OneHot:
        pairs = [(F.lit(n), c(n)) for n in self.cols]
        self.levels = _collect_levels(EventLog(df, LogSpec("")), [], pairs)
        return self

    def expressions(self) -> dict[str, Column]:
        return {f"{n}_{level}": F.when(c(n) == level, 1).otherwise(0)
                for n in self.cols for level in self.levels.get(n, [])}

    def transform(self, df: DataFrame) -> DataFrame:
        kept = [c(n) for n in df.columns if n not in self.cols]
        return df.select(*kept, *[v.alias(n) for n, v in self.expressions().items()])


class Standardizer:
    """Zero mean and unit (population) deviation; a constant column becomes 0."""

    def __init__(self, cols: Sequence[str]):
        self.cols = tuple(cols)
        self.moments: list[tuple[float, float]] = []

    def fit(self, df: DataFrame) -> Standardizer:
        row = df.agg(*[F.avg(c(n)).alias(f"m{i}") for i, n in enumerate(self.cols)],
                     *[F.stddev_pop(c(n)).alias(f"s{i}") for i, n in enumerate(self.cols)]).first()
        self.moments = [(row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i in range(len(self.cols))]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = {n: (c(n) - F.lit(m)) / F.lit(s) for n, (m, s) in zip(self.cols, self.moments)}
        return df.select(*[scaled[n].alias(n) if n in scaled else c(n) for n in df.columns])


class EventEncoder:
    """Event rows as numbers: min-max scaled numerics and one-hot categories, fitted on training events."""

    def __init__(self, spec: LogSpec):
        self.spec = spec
        self.one_hot = OneHot(spec.cat)
        self.ranges: dict[str, tuple[float, float]] = {}

    def fit(self, log: EventLog) -> EventEncoder:
        self.one_hot.fit(log.df)
        if self.spec.num:
            row = log.df.agg(*[F.min(c(n)).alias(f"l{i}") for i, n in enumerate(self.spec.num)],
                             *[F.max(c(n)).alias(f"h{i}") for i, n in enumerate(self.spec.num)]).first()
            self.ranges = {n: (float(row[f"l{i}"] or 0.0), float(row[f"h{i}"] or 0.0))
                           for i, n in enumerate(self.spec.num)}
        return self

    def expressions(self) -> dict[str, Column]:
        scaled = {n: (c(n) - F.lit(low)) / F.lit(high - low or 1.0) for n, (low, high) in self.ranges.items()}
        return {**scaled, **self.one_hot.expressions()}

    @property
    def columns(self) -> list[str]:
        return list(self.expressions())

    def transform(self, log: EventLog) -> EventLog:
        """Keeps case, time, ties and label next to the encoded columns."""
        spec = self.spec
        own = [n for n in dict.fromkeys((spec.case, spec.label, *spec.event_order, PREFIX)) if n in log.df.columns]
        features = {f"event__{n}": F.coalesce(v.cast("double"), F.lit(0.0)) for n, v in self.expressions().items()}
        return log.with_df(log.df.select(*cs(own), *[v.alias(n) for n, v in features.items()]))


def sequences(log: EventLog, columns: Sequence[str], max_len: int, flat: bool = False) -> DataFrame:
    """Every prefix up to ``max_len`` as a sequence of event vectors, zeros on the left.

    ``log`` is an encoded and numbered log (``prefixes(log, max_len)``), so a case has at most
    ``max_len`` rows and a list never grows beyond that.
    """
    so_far = (Window.partitionBy(c(log.spec.case)).orderBy(PREFIX)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    vector = F.array(*[c(n).cast("float") for n in columns])
    zeros = F.array_repeat(F.lit(0.0).cast("float"), len(columns))
    df = log.df.where(F.col(PREFIX) <= max_len)
    seen = F.collect_list(vector).over(so_far)
    padded = F.concat(F.array_repeat(zeros, F.lit(max_len) - F.col(PREFIX).cast("int")), seen)
    return df.select(*_ids(log), (F.flatten(padded) if flat else padded).alias("sequence"))


def sequences_at(log: EventLog, columns: Sequence[str], max_len: int, n: int) -> DataFrame:
    """The sequences of one prefix length: one row per case that long, from its first n events."""
    df = log.df.where(F.col(PREFIX) <= n)
    vector = F.struct(F.col(PREFIX), F.array(*[c(x).cast("float") for x in columns]).alias("v"))
    label = [F.max(is_positive(log)).alias("y")] if log.spec.label in log.df.columns else []
    zeros = F.array_repeat(F.lit(0.0).cast("float"), len(columns))
    # at most n rows per case are collected
    grouped = df.groupBy(c(log.spec.case)).agg(F.array_sort(F.collect_list(vector)).alias("__events"), *label)
    seen = F.transform("__events", lambda x: x["v"])
    padded = F.concat(F.array_repeat(zeros, max(max_len - n, 0)), seen)
    return grouped.where(F.size("__events") == n).select(
        c(log.spec.case), F.lit(n).cast("long").alias(PREFIX), *[F.col("y") for _ in label], padded.alias("sequence"))


def assemble(df: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    """Feature columns as one ML vector, the others as they are.

    Many of them in one whole-stage method are more bytecode than the JVM compiles. A higher-order function keeps them out of such a
    stage; Spark then cuts their code into methods that are compiled.
    """
    chosen = set(columns)
    values = F.array(*[c(n).cast("double") for n in columns])
    if len(columns) > WIDE:
        values = F.transform(values, lambda v: v)
    return df.select(*[c(n) for n in df.columns if n not in chosen], array_to_vector(values).alias(name))

"""User functions over whole cases."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegralType, StructType

from tracewise.eventlog import EventLog
from tracewise.functions.columns import ascending, c, cs
from tracewise.operators.scan import position, scan, split_hot
from tracewise.session import hot_rows, keep

CHUNK_ROWS = 10_000


def per_case(log: EventLog, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Call ``fn`` with the ordered events of each case.

    Spark brings cases together and sorts them; a batch of many cases becomes one table, of which each call gets a slice.
    A function of a whole case gets it as one table, so the longest case has to fit into a task's memory; where it may
    not, use ``fold_cases``, cut cases with ``prefixes(log, max_length)`` first, or express the function by running columns.
    """
    df, case = log.df, log.spec.case
    names, made = df.columns, StructType.fromDDL(schema)
    fields = made.fieldNames()
    # a null elsewhere in the batch would make a case's whole numbers floats: they come without nulls, and a mark tells where these were
    marks = {n: f"__null{i}" for i, n in enumerate(names) if isinstance(df.schema[n].dataType, (IntegralType, BooleanType))}
    stream = df.repartition(c(case)).sortWithinPartitions(c(case), *[c(n).asc_nulls_last() for n in log.spec.time_order])
    filled = [F.coalesce(c(n), F.lit(0).cast(df.schema[n].dataType)).alias(n) if n in marks else c(n) for n in names]
    rows = stream.select(*filled, *[c(n).isNull().alias(mark) for n, mark in marks.items()])

    def called(events: pd.DataFrame) -> pd.DataFrame:
        own = events[names].reset_index(drop=True)
        for n, mark in marks.items():
            absent = events[mark].to_numpy()
            if absent.any():
                own[n] = own[n].astype(object).where(~absent, None) if own[n].dtype == bool else own[n].astype(float).mask(absent)
        return fn(own)

    def joined(results: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        results = [r for r in results if len(r.columns)]
        if results:
            out = pd.concat(results, ignore_index=True)
            if len(out.columns) != len(fields):
                raise ValueError(f"columns {list(out.columns)} for {fields}")
            yield out[fields] if any(isinstance(n, str) for n in out.columns) else out.set_axis(fields, axis=1)

    def cases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the case that may go on in the next batch
        key = None
        for b in batches:
            if not len(b):
                continue
            known = b[case].where(~b[marks[case]], None).tolist() if case in marks else b[case].where(b[case].notna(), None).tolist()
            starts = [0, *(i for i in range(1, len(known)) if known[i] != known[i - 1])]
            done = []
            for start, end in zip(starts, [*starts[1:], len(known)], strict=True):
                if held and known[start] != key:
                    done.append(called(pd.concat(held) if len(held) > 1 else held[0]))
                    held = []
                held.append(b.iloc[start:end])
                key = known[start]
            yield from joined(done)
        if held:
            yield from joined([called(pd.concat(held) if len(held) > 1 else held[0])])

    return rows.mapInPandas(cases, made)


def fold_cases(log: EventLog, start: Callable[[], Any], step: Callable[[Any, pd.DataFrame], Any], finish: Callable[[Any, Any], Iterable[tuple]], schema: str,
               chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A function of whole cases that sees a chunk of their ordered events at a time.

    A case begins with ``start()``; ``step(state, events)`` gives the state after the next events, ``chunk_rows`` at most, and
    ``finish(case, state)`` the rows of the result. A state can be pickled. Cases of ordinary size are folded along sorted partitions, where a
    task holds a chunk and a state. Oversized ones are cut into segments by the places of their events; what a segment ends
    with is written as a table, from which the next one goes on, so a lost executor repeats a segment and never a case.
    """
    case, order = log.spec.case, list(log.spec.time_order)
    made = StructType.fromDDL(schema)
    if log.hot is None or not log.hot.keys:
        return _folded(log.df, case, order, start, step, chunk_rows, made, finish)
    usual, long = split_hot(log.df, log.hot)
    mark = log.hot.mark
    out = _folded(usual.drop(mark), case, order, start, step, chunk_rows, made, finish)
    limit = hot_rows(log.df.sparkSession)
    placed = scan(long, [case], order, [position("__place")], log.hot).drop(mark)
    placed = keep(placed.withColumn("__segment", F.floor((F.col("__place") - 1) / limit).cast("long")), "long-cases")
    ends = keep(placed.groupBy(c(case)).agg(F.max("__segment").alias("__last")), "ends")  # a row for each oversized case
    last = ends.agg(F.max("__last")).first()[0]
    states = None
    for segment in range(0 if last is None else last + 1):
        rows = placed.where(F.col("__segment") == segment).drop("__segment", "__place")
        after = keep(_folded(rows, case, order, start, step, chunk_rows, None, None, states), "states")
        done = after.join(F.broadcast(ends.where(F.col("__last") == segment)), case, "left_semi")
        out = out.unionByName(done.mapInArrow(_finishing(case, made, finish), made))
        states = after
    return out


def _record(rows: list[tuple], made: StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(made)
    columns = list(zip(*rows, strict=True)) or [()] * len(made)
    return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(columns, arrow, strict=True)], schema=arrow)


def _finishing(case: str, made: StructType, finish):
    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cases, states = b.column(case).to_pylist(), b.column("__state").to_pylist()
            yield _record([tuple(r) for own, state in zip(cases, states, strict=True) for r in finish(own, pickle.loads(state))], made)
    return finished


def _folded(rows: DataFrame, case: str, order: list[str], start, step, chunk_rows: int, made: StructType | None, finish, states: DataFrame | None = None) -> DataFrame:
    """Results of the cases, or (case, __state) where ``made`` is None; ``states`` has what cases begin with, if not with ``start()``."""
    names = rows.columns
    stream = rows.withColumns({"__begun": F.lit(1), "__state": F.lit(None).cast("binary")})
    if states is not None:
        known = rows.select(c(case)).distinct()
        begun = states.join(known, case, "left_semi")
        empty = [F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in names if n != case]
        stream = stream.unionByName(begun.select(c(case), *empty, F.lit(0).alias("__begun"), "__state"))
    stream = stream.repartition(c(case)).sortWithinPartitions(c(case), "__begun", *ascending(order))
    out_type = made if made is not None else StructType([rows.schema[case]]).add("__state", "binary")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        key, state, held = none, None, []

        def stepped(state, held: list[pa.RecordBatch]):
            return step(state, pa.Table.from_batches(held).to_pandas()) if held else state

        def ended(key, state) -> list[tuple]:
            return [(key, pickle.dumps(state))] if made is None else [tuple(r) for r in finish(key, state)]

        for b in batches:
            out, cases, begun, n = [], b.column(case).to_pylist(), b.column("__begun").to_pylist(), b.num_rows
            at = 0
            while at < n:
                if key is none or cases[at] != key:
                    if key is not none:
                        out += ended(key, stepped(state, held))
                    key, state, held = cases[at], start(), []
                    if not begun[at]:
                        state = pickle.loads(b.column("__state")[at].as_py())
                        at += 1
                        continue
                end, room = at, chunk_rows - sum(x.num_rows for x in held)
                while end < n and cases[end] == key and end - at < room:
                    end += 1
                held.append(b.select(names).slice(at, end - at))
                if end - at == room:
                    state, held = stepped(state, held), []
                at = end
            yield _record(out, out_type)
        if key is not none:
            yield _record(ended(key, stepped(state, held)), out_type)

    return stream.select(*cs([*names, "__begun", "__state"])).mapInArrow(fold, out_type)

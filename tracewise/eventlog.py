"""An event log: a DataFrame with one row per event, its roles, and its oversized cases."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame

from tracewise.operators.scan import HotKeys, Running, Whole, mark_hot, scan, screen
from tracewise.spec import LogSpec


@dataclass(frozen=True)
class EventLog:
    """Operators take a log and give a log.

    ``hot`` and ``cases`` (a bound of the number of cases) travel along: no operator makes a case longer or
    adds one, unless it says so.
    """

    df: DataFrame
    spec: LogSpec
    hot: HotKeys | None = None
    cases: int | None = None

    @classmethod
    def of(cls, df: DataFrame, spec: LogSpec, counted: DataFrame | None = None) -> EventLog:
        """Wrap a table, looking once for cases that are too long for a single task.

        ``counted`` is a cheaper table with the same events per case (before a join, say), if there is one.
        """
        sizes = screen(df if counted is None else counted, [spec.case])
        return cls(mark_hot(df, sizes.hot), spec, sizes.hot, sizes.groups)

    def with_df(self, df: DataFrame) -> EventLog:
        return replace(self, df=df)

    def with_spec(self, **changes) -> EventLog:
        return replace(self, spec=self.spec.with_(**changes))

    def pipe(self, fn: Callable[..., Any], *args, **kwargs) -> Any:
        return fn(self, *args, **kwargs)

    def scan(self, *columns: Running | Whole, order=None) -> EventLog:
        """Add columns computed along each case."""
        order = list(order or self.spec.event_order)
        return self.with_df(scan(self.df, [self.spec.case], order, list(columns), self.hot))

    def drop(self, *names: str) -> EventLog:
        return self.with_df(self.df.drop(*names))

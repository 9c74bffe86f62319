"""Order-aware features of running cases: linear recurrences over event vectors.

h(n) = a h(n - 1) + x(n) for each column x and each of several decays a. Like the state of a recurrent network it tells not only
what happened but how long ago, and it needs one number a column and decay whatever the length of the case, where a padded sequence needs
all events. Written out, h(n) is a^n times a running sum of x(i) / a^i, which a window computes; the sum restarts before its powers leave the
range of a double, and a block takes over the state with which the one before ended. A block has some thousand rows at most, so no
task gets more of a case, however long it is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.eventlog import EventLog
from tracewise.functions.columns import c, cs
from tracewise.operators.prefix import PREFIX
from tracewise.operators.scan import latest, previous

DECAYS = (0.5, 0.9)
REACH = 250  # powers of ten that the weights of a block may span


def block_length(decay: float) -> int:
    return max(1, math.floor(REACH / -math.log10(decay)))


def state_names(columns: Sequence[str], decays: Sequence[float] = DECAYS) -> list[str]:
    return [f"{n}~{a}" for a in decays for n in columns]


def states(log: EventLog, columns: Sequence[str], decays: Sequence[float] = DECAYS, max_length: int | None = None) -> EventLog:
    """The numbered log with a column ``<column>~<decay>`` for each column and decay, which is between 0 and 1; nulls count as 0.

    ``max_length`` is a bound of the length of cases, where known: up to a block there is nothing to take over.
    """
    if any(not 0 < a < 1 for a in decays):
        raise ValueError("a decay lies between 0 and 1")
    case, at = log.spec.case, c(PREFIX) - 1
    for a in decays:
        size = block_length(a)
        one_block = max_length is not None and max_length <= size
        inside = at if one_block else at % size
        keys = [c(case)] if one_block else [c(case), F.floor(at / size)]
        so_far = Window.partitionBy(*keys).orderBy(c(PREFIX)).rowsBetween(Window.unboundedPreceding, Window.currentRow)

        def own(n: str) -> Column:
            term = F.coalesce(c(n).cast("double"), F.lit(0.0)) * F.pow(F.lit(1 / a), inside)
            return F.pow(F.lit(a), inside) * F.sum(term).over(so_far)

        names = dict(zip(columns, state_names(columns, [a]), strict=True))
        log = log.with_df(log.df.withColumns({name: own(n) for n, name in names.items()}))
        if not one_block:
            last = inside == size - 1
            log = log.scan(*[previous(f"__end{i}", F.when(last, c(name))) for i, name in enumerate(names.values())], order=[PREFIX])
            log = log.scan(*[latest(f"__carry{i}", F.col(f"__end{i}")) for i in range(len(names))], order=[PREFIX])
            carried = {name: c(name) + F.coalesce(F.pow(F.lit(a), inside + 1) * F.col(f"__carry{i}"), F.lit(0.0)) for i, name in enumerate(names.values())}
            log = log.with_df(log.df.withColumns(carried)).drop(*[f"__{kind}{i}" for kind in ("end", "carry") for i in range(len(names))])
    return log


def state_features(log: EventLog, columns: Sequence[str], ids: Sequence[Column], decays: Sequence[float] = DECAYS, max_length: int | None = None) -> DataFrame:
    """``ids`` and ``features``: the event itself and its states, for each event of a numbered log."""
    known = states(log, columns, decays, max_length)
    values = F.array(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in cs([*columns, *state_names(columns, decays)])])
    return known.df.select(*ids, array_to_vector(values).alias("features"))

"""Small column helpers used everywhere."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def c(name: str) -> Column:
    """A column by its exact name; log columns may hold dots, colons and blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def cs(names: Iterable[str]) -> list[Column]:
    return [c(n) for n in names]


def ascending(items: Iterable[str | Column]) -> list[Column]:
    return [c(i).asc() if isinstance(i, str) else i for i in items]


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
                   small: bool = False) -> DataFrame:
    """Join on equal keys, nulls matching nulls; ``small`` only for sides of a proven size."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    if small:
        renamed = F.broadcast(renamed)
    condition = None
    for k in keys:
        equal = left[f"`{k}`"].eqNullSafe(renamed[f"`__right_{k}`"])
        condition = equal if condition is None else condition & equal
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__right_{k}" for k in keys])

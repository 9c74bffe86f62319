"""Running columns along ordered groups, exact for groups of any size.

Nearly all operators of this library look along the events of one case. A plain window does that well
as long as a group fits into one task. A case that holds a large share of all rows (events without a
case id all share one, for instance) does not, so such groups are found by one counting job and take
a second way:

1. their rows are range-partitioned by (group, order), which cuts a group into segments of bounded size;
2. the running columns are computed inside each segment, and the value at the end of a segment is its total;
3. the totals (one row per segment) are scanned and each row is combined with the total of the
   segments before its own.

Both ways give the same values. The segments are written to the shared folder before use, so that a lost
executor cannot draw the borders anew between steps 2 and 3.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.functions.columns import ascending, c, cs, null_safe_join
from tracewise.session import hot_rows, keep

TRACKED = 1 << 16  # keys that a sketch of frequent keys holds
MOST_TRACKED = 1_000_000  # what Spark allows
MERGERS = 256  # tasks that merge the sketches of all others, before a last one merges theirs

@dataclass(frozen=True)
class HotKeys:
    """Groups with more rows than one task may hold.

    Each has more than ``hot_rows`` rows, so a table of N rows has fewer than N / hot_rows of them
    (500,000 for a trillion rows): small enough to broadcast.
    """

    keys: tuple[str, ...]
    groups: DataFrame | None
    rows: int

    @property
    def mark(self) -> str:
        """Name of the column that tells the rows of these groups (see ``mark_hot``)."""
        return "__hot:" + ",".join(self.keys)


@dataclass(frozen=True)
class Running:
    """A column over the rows of a group up to and including the current one."""

    name: str
    kind: str
    value: Column | None = None


@dataclass(frozen=True)
class Whole:
    """An order-free aggregate over the whole group, given to each of its rows."""

    name: str
    aggregate: Column


def position(name: str) -> Running:
    return Running(name, "position")


def running_sum(name: str, value: Column) -> Running:
    return Running(name, "sum", value)


def running_min(name: str, value: Column) -> Running:
    return Running(name, "min", value)


def running_max(name: str, value: Column) -> Running:
    return Running(name, "max", value)


def running_mean(name: str, value: Column) -> Running:
    return Running(name, "mean", value)


def running_std(name: str, value: Column) -> Running:
    """Sample standard deviation; null for a single value."""
    return Running(name, "std", value)


def latest(name: str, value: Column) -> Running:
    """Last non-null value so far."""
    return Running(name, "latest", value)


def earliest(name: str, value: Column) -> Running:
    """First non-null value so far."""
    return Running(name, "earliest", value)


def previous(name: str, value: Column) -> Running:
    """Value of the row before, null or not."""
    return Running(name, "previous", value)


@dataclass(frozen=True)
class Sizes:
    """What one counting job tells about groups; with ``screen`` the last two are upper bounds."""

    hot: HotKeys | None
    longest: int
    groups: int


def find_hot(df: DataFrame, keys: list[str]) -> HotKeys | None:
    """Count rows per group (combined before the shuffle) and keep the oversized groups; for keys of few groups."""
    return measure(df, keys).hot


def screen(df: DataFrame, keys: list[str], tracked: int = TRACKED) -> Sizes:
    """The same oversized groups as ``measure`` finds, without a shuffle of all keys.

    Each task sends one sketch of its frequent keys (``tracked`` at most), the sketches are merged in two levels, and only
    the few groups that may be oversized are counted, exactly. A sketch over N rows with room for m keys is off by less
    than 2.625 N / m and names every key with more than twice that many rows (map of m / 0.75 entries, error of 3.5 / map),
    so nothing oversized is missed while 5.25 N / m is within the limit. Where it isn't, a larger sketch is taken, and
    beyond the largest that Spark offers all groups are counted. ``longest`` and ``groups`` are bounds from above; that of
    ``groups`` holds to five standard errors.
    """
    if not keys:
        return measure(df, keys)
    spark, limit = df.sparkSession, hot_rows(df.sparkSession)
    key = F.xxhash64(*cs(keys))
    nothing = spark.range(1).select(F.lit(None).cast("long").alias("k"))  # sketches can't be merged where there is none
    parts = (df.select(key.alias("k")).unionAll(nothing).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGERS))).groupBy("part")
             .agg(F.expr(f"approx_top_k_accumulate(k, {tracked})").alias("top"), F.count("k").alias("n"),
                  F.hll_sketch_agg("k", 12).alias("distinct")))
    found = (parts.agg(F.expr(f"approx_top_k_combine(top, {tracked})").alias("top"), F.sum("n").alias("n"), F.hll_union_agg("distinct").alias("distinct"))
             .select("n", F.hll_sketch_estimate("distinct").alias("groups"), F.expr(f"approx_top_k_estimate(top, {tracked})").alias("top")).first())
    rows = found["n"] or 0
    if rows == 0:
        return Sizes(None, 0, 0)
    if 5.25 * rows > limit * tracked:
        larger = math.ceil(5.25 * rows / limit)
        return screen(df, keys, larger) if larger <= MOST_TRACKED else measure(df, keys)
    groups = min(rows, math.ceil(found["groups"] * (1 + 5 * 1.04 / 64)))
    top = [r for r in found["top"] if r["item"] is not None]
    maybe = [(r["item"],) for r in top if r["count"] > limit]
    longest = max([r["count"] for r in top], default=math.ceil(5.25 * rows / tracked))
    if not maybe:
        return Sizes(None, min(longest, rows), groups)
    few = F.broadcast(spark.createDataFrame(maybe, "__key long"))  # groups of more than half the limit: 2 N / limit at most
    sizes = df.select(*cs(keys), key.alias("__key")).join(few, "__key", "left_semi").groupBy(*cs(keys)).agg(F.count(F.lit(1)).alias("__rows"))
    exact = sizes.where(F.col("__rows") > limit).collect()
    if not exact:
        return Sizes(None, min(longest, rows), groups)
    hot = spark.createDataFrame(exact, sizes.schema)
    return Sizes(HotKeys(tuple(keys), hot.drop("__rows"), sum(r["__rows"] for r in exact)), max(r["__rows"] for r in exact), groups)


def measure(df: DataFrame, keys: list[str]) -> Sizes:
    """The oversized groups, the rows of the largest group, and the number of groups."""
    limit = hot_rows(df.sparkSession)
    if not keys:
        rows = df.count()
        return Sizes(HotKeys((), None, rows) if rows > limit else None, rows, 1)
    sizes = df.groupBy(*cs(keys)).agg(F.count(F.lit(1)).alias("__rows"))
    # the largest size comes along with the rare oversized groups, in one job
    found = (sizes.agg(F.max("__rows").alias("top"), F.count(F.lit(1)).alias("n"),
                       F.collect_list(F.when(F.col("__rows") > limit, F.struct("*"))).alias("groups")).first())
    if not found["groups"]:
        return Sizes(None, found["top"] or 0, found["n"])
    groups = df.sparkSession.createDataFrame(found["groups"], sizes.schema)
    rows = sum(g["__rows"] for g in found["groups"])
    return Sizes(HotKeys(tuple(keys), groups.drop("__rows"), rows), found["top"], found["n"])


def mark_hot(df: DataFrame, hot: HotKeys | None) -> DataFrame:
    """Tell the rows of oversized groups by a column, so that later scans part them by a plain filter.

    The column is constant on either side of a scan's union. Catalyst pushes the filter of the next scan
    into the union and drops the side it empties, so a chain of scans reads each side once per scan.
    """
    if hot is None or not hot.keys or hot.mark in df.columns:
        return df
    marked = null_safe_join(df, hot.groups.withColumn(hot.mark, F.lit(True)), list(hot.keys), "left", small=True)
    return marked.withColumn(hot.mark, F.coalesce(c(hot.mark), F.lit(False)))


def split_hot(df: DataFrame, hot: HotKeys) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary groups, and rows of oversized ones."""
    if hot.mark in df.columns:
        return (df.where(~c(hot.mark)).withColumn(hot.mark, F.lit(False)),
                df.where(c(hot.mark)).withColumn(hot.mark, F.lit(True)))
    keys = list(hot.keys)
    return (null_safe_join(df, hot.groups, keys, "left_anti", small=True),
            null_safe_join(df, hot.groups, keys, "left_semi", small=True))


def scan(df: DataFrame, keys: list[str], order: list[str | Column], columns: list[Running | Whole],
         hot: HotKeys | None) -> DataFrame:
    """Add ``columns`` to every row of ``df``, computed within ``keys`` in the given (total) order."""
    if hot is None:
        return _plain(df, keys, order, columns)
    if set(hot.keys) != set(keys):
        raise ValueError(f"groups {keys} were measured by {list(hot.keys)}")
    if not keys:
        return _segmented(df, keys, order, columns, hot.rows)
    usual, oversized = split_hot(df, hot)
    usual = _plain(usual, keys, order, columns)
    oversized = _segmented(oversized, keys, order, columns, hot.rows)
    if hot.mark in df.columns:
        usual = usual.withColumn(hot.mark, F.lit(False))
        oversized = oversized.withColumn(hot.mark, F.lit(True))
    return usual.unionByName(oversized)


def scan_all(df: DataFrame, order: list[str | Column], columns: list[Running | Whole],
             at_most: int | None = None) -> DataFrame:
    """Scan a whole table as one group; ``at_most`` is a bound of its rows, where known."""
    if at_most is not None and at_most <= hot_rows(df.sparkSession):
        return scan(df, [], order, columns, None)
    return scan(df, [], order, columns, find_hot(df, []))


def _windows(keys: list[Column], order: list[Column]):
    ordered = Window.partitionBy(*keys).orderBy(*order)
    return ordered, ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _plain(df: DataFrame, keys, order, columns) -> DataFrame:
    at, so_far = _windows(cs(keys), ascending(order))
    group = Window.partitionBy(*cs(keys))
    build = {
        "position": lambda v: F.row_number().over(at).cast("long"),
        "sum": lambda v: F.sum(v).over(so_far),
        "min": lambda v: F.min(v).over(so_far),
        "max": lambda v: F.max(v).over(so_far),
        "mean": lambda v: F.avg(v).over(so_far),
        "std": lambda v: F.stddev_samp(v).over(so_far),
        "latest": lambda v: F.last(v, ignorenulls=True).over(so_far),
        "earliest": lambda v: F.first(v, ignorenulls=True).over(so_far),
        "previous": lambda v: F.lag(v, 1).over(at),
    }
    return df.withColumns({
        column.name: column.aggregate.over(group) if isinstance(column, Whole) else build[column.kind](column.value)
        for column in columns})


# What a segment has to know of each running column: parts computed inside the segment ...
_PARTS = {
    "position": lambda v, at, run: {"n": F.row_number().over(at).cast("long")},
    "sum": lambda v, at, run: {"s": F.sum(v).over(run)},
    "min": lambda v, at, run: {"m": F.min(v).over(run)},
    "max": lambda v, at, run: {"m": F.max(v).over(run)},
    "mean": lambda v, at, run: {"n": F.count(v).over(run), "s": F.sum(v).over(run)},
    "std": lambda v, at, run: {"n": F.count(v).over(run), "a": F.avg(v).over(run), "p": F.var_pop(v).over(run)},
    "latest": lambda v, at, run: {"v": F.last(v, ignorenulls=True).over(run)},
    "earliest": lambda v, at, run: {"v": F.first(v, ignorenulls=True).over(run)},
    "previous": lambda v, at, run: {"v": F.lag(v, 1).over(at), "own": v},
}


def _carried(kind: str, part, before) -> dict[str, Column]:
    """... and what the segments before it hand on."""
    if kind == "position":
        return {"n": F.sum(part("n")).over(before)}
    if kind == "sum":
        return {"s": F.sum(part("s")).over(before)}
    if kind == "min":
        return {"m": F.min(part("m")).over(before)}
    if kind == "max":
        return {"m": F.max(part("m")).over(before)}
    if kind == "mean":
        return {"n": F.sum(part("n")).over(before), "s": F.sum(part("s")).over(before)}
    if kind == "std":
        # moments about a mean of the group itself, so that little is lost by cancellation
        off = part("a") - part("about")
        return {"n": F.sum(part("n")).over(before),
                "s": F.sum(part("n") * off).over(before),
                "q": F.sum(part("n") * (part("p") + off * off)).over(before),
                "about": F.max(part("about")).over(before)}
    if kind == "latest":
        return {"v": F.last(part("v"), ignorenulls=True).over(before)}
    if kind == "earliest":
        return {"v": F.first(part("v"), ignorenulls=True).over(before)}
    return {"v": F.last(part("own")).over(before)}


def _combined(kind: str, here, carry, first_in_segment: Column) -> Column:
    if kind == "position":
        return here("n") + F.coalesce(carry("n"), F.lit(0))
    if kind == "sum":
        return F.coalesce(here("s") + carry("s"), here("s"), carry("s"))
    if kind == "min":
        return F.least(here("m"), carry("m"))
    if kind == "max":
        return F.greatest(here("m"), carry("m"))
    if kind == "mean":
        count = here("n") + F.coalesce(carry("n"), F.lit(0))
        total = F.coalesce(here("s") + carry("s"), here("s"), carry("s"))
        return F.when(count > 0, total / count)
    if kind == "std":
        count_before = F.coalesce(carry("n"), F.lit(0)).cast("double")
        count = here("n") + count_before
        off_before = F.when(count_before > 0, carry("s") / count_before).otherwise(F.lit(0.0))
        mean_before = off_before + F.coalesce(carry("about"), F.lit(0.0))
        spread_before = F.when(count_before > 0, carry("q") - count_before * off_before * off_before
                               ).otherwise(F.lit(0.0))
        mean_here = F.coalesce(here("a"), F.lit(0.0))
        gap = mean_here - mean_before
        spread = (F.greatest(spread_before, F.lit(0.0)) + F.coalesce(here("n") * here("p"), F.lit(0.0))
                  + gap * gap * here("n") * count_before / F.when(count > 0, count))
        return F.when(count > 1, F.sqrt(spread / (count - 1)))
    if kind == "latest":
        return F.coalesce(here("v"), carry("v"))
    if kind == "earliest":
        return F.coalesce(carry("v"), here("v"))
    return F.when(first_in_segment, carry("v")).otherwise(here("v"))


def _segmented(df: DataFrame, keys, order, columns, rows: int) -> DataFrame:
    spark = df.sparkSession
    own_names = df.columns
    running = [x for x in columns if isinstance(x, Running)]
    whole = [x for x in columns if isinstance(x, Whole)]
    if running:
        segments = max(2, math.ceil(rows / hot_rows(spark)))
        sort = ascending(order)
        work = df.withColumns({f"__v{i}": x.value for i, x in enumerate(running) if x.value is not None})
        # rows and borders are written together
        work = keep(work.repartitionByRange(segments, *ascending(keys), *sort)
                    .withColumn("__segment", F.spark_partition_id()), "segments")
        df = work
        at, so_far = _windows(cs([*keys, "__segment"]), sort)
        parts = {"__row": F.row_number().over(at),
                 "__rows": F.count(F.lit(1)).over(Window.partitionBy(*cs([*keys, "__segment"])))}
        for i, x in enumerate(running):
            for tag, expr in _PARTS[x.kind](F.col(f"__v{i}"), at, so_far).items():
                parts[f"__p{i}_{tag}"] = expr
        work = work.withColumns(parts)
        # one row per segment; a window over them holds at most N / hot_rows rows
        totals = work.where(F.col("__row") == F.col("__rows"))
        group = Window.partitionBy(*cs(keys))
        totals = totals.withColumns({f"__p{i}_about": F.max(F.col(f"__p{i}_a")).over(group)
                                     for i, x in enumerate(running) if x.kind == "std"})
        before = (group.orderBy("__segment")
                  .rowsBetween(Window.unboundedPreceding, -1))
        carry = totals.select(*cs(keys), "__segment", *[
            expr.alias(f"__c{i}_{tag}")
            for i, x in enumerate(running)
            for tag, expr in _carried(x.kind, lambda t, i=i: F.col(f"__p{i}_{t}"), before).items()])
        work = null_safe_join(work, carry, [*keys, "__segment"], "left", small=True)
        result = work.select(*cs(own_names), *[
            _combined(x.kind, lambda t, i=i: F.col(f"__p{i}_{t}"), lambda t, i=i: F.col(f"__c{i}_{t}"),
                      F.col("__row") == 1).alias(x.name)
            for i, x in enumerate(running)])
    else:
        result = df
    if whole:
        per_group = df.groupBy(*cs(keys)).agg(*[x.aggregate.alias(x.name) for x in whole])
        result = null_safe_join(result, per_group, keys, "left", small=True) if keys else \
            result.crossJoin(F.broadcast(per_group))
    return result.select(*cs(own_names), *[c(x.name) for x in columns])


def exact_quantiles(df: DataFrame, keys: list[str], value: Column, quantiles: dict[str, float],
                    hot: HotKeys | None) -> DataFrame:
    """Interpolated quantiles of the non-null values of each group; one row per group."""
    valued = df.select(*cs(keys), value.alias("__value"))

    def direct(side: DataFrame) -> DataFrame:
        return side.groupBy(*cs(keys)).agg(*[F.percentile("__value", q).alias(n) for n, q in quantiles.items()])

    def by_rank(side: DataFrame) -> DataFrame:
        ranked = _segmented(side.where(F.col("__value").isNotNull()), keys, ["__value"],
                            [position("__rank"), Whole("__size", F.count(F.lit(1)))], hot.rows)
        picks = []
        for name, q in quantiles.items():
            at = F.lit(q) * (F.col("__size") - 1)
            low = F.max(F.when(F.col("__rank") - 1 == F.floor(at), F.col("__value")))
            high = F.max(F.when(F.col("__rank") - 1 == F.ceil(at), F.col("__value")))
            share = F.max(at - F.floor(at))
            picks.append((low + share * (high - low)).alias(name))
        values = ranked.groupBy(*cs(keys)).agg(*picks)
        return null_safe_join(side.select(*cs(keys)).distinct(), values, keys, "left")

    if hot is None:
        return direct(valued)
    if not hot.keys:
        return by_rank(valued)
    usual, oversized = split_hot(valued, hot)
    return direct(usual).unionByName(by_rank(oversized))

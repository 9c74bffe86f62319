"""Event logs over the driver's tables, as used by the registered queries.

The tables are not event logs, so cases are made from them: weeks of a user's events, orders of a
customer, and items of an order. A table of predictions is derived from the first one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.eventlog import EventLog
from tracewise.functions.columns import c, null_safe_join
from tracewise.functions.time import micros
from tracewise.operators.clean import is_positive
from tracewise.operators.label import label_predicate
from tracewise.operators.prefix import PREFIX, prefixes
from tracewise.operators.scan import mark_hot, screen, split_hot
from tracewise.session import hot_rows
from tracewise.spec import LogSpec

EVENTS_SPEC = LogSpec(
    name="log_events", case="case_id", activity="event_type", timestamp="ts", tie=("event_id",),
    pos_label="deviant", neg_label="regular", dynamic_cat=("event_type",), dynamic_num=("value", "amount"),
    static_cat=("weekday_first",), static_num=("k_first",))
ORDERS_SPEC = LogSpec(
    name="log_orders", case="case_id", activity="o_orderpriority", timestamp="o_orderdate", tie=("o_orderkey",),
    dynamic_cat=("o_orderpriority", "o_orderstatus"), dynamic_num=("o_totalprice",),
    static_cat=("c_mktsegment",), static_num=("c_nationkey", "c_acctbal"))
ITEMS_SPEC = LogSpec(
    name="log_items", case="case_id", activity="l_returnflag", timestamp="l_shipdate",
    tie=("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
         "l_linestatus", "o_orderdate"),
    dynamic_cat=("l_returnflag", "l_linestatus"), dynamic_num=("l_quantity", "l_extendedprice", "l_discount"))

MICROS_PER_WEEK = 7 * 86_400_000_000
FIRST_DAY = 1_704_067_200_000_000  # 2024-01-01
SCORE_LIMIT = 95


def log_events(spark: SparkSession, sf_dir: str) -> EventLog:
    """A case is one user in one week; ``amount`` is known for purchases only."""
    return EventLog.of(week_cases(spark.read.parquet(f"{sf_dir}/events.parquet")), EVENTS_SPEC)


def week_cases(raw: DataFrame) -> DataFrame:
    """Row by row, so it serves streams as well."""
    week = F.floor((micros(F.col("ts")) - FIRST_DAY) / MICROS_PER_WEEK).cast("string")
    return raw.select(
        F.concat_ws("_", F.col("user_id").cast("string"), week).alias("case_id"), "ts", "event_id", "event_type", "value",
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))


def _joined(facts: DataFrame, dim: DataFrame, spec: LogSpec, columns: list[str]) -> EventLog:
    """Facts with the columns of their case's row in ``dim`` (one a case), as a log.

    Cases are measured and marked before the join. Rows of oversized ones meet their few rows of ``dim`` by broadcast, so no
    task of the join gets a whole such case.
    """
    sizes = screen(facts, [spec.case])
    if sizes.hot is None:
        return EventLog(facts.join(dim, spec.case).select(*columns), spec, None, sizes.groups)
    usual, long = split_hot(mark_hot(facts, sizes.hot), sizes.hot)
    few = null_safe_join(dim, sizes.hot.groups, [spec.case], "left_semi", small=True)
    both = usual.join(dim, spec.case).unionByName(long.join(F.broadcast(few), spec.case))  # as many rows as oversized cases
    return EventLog(both.select(*columns, c(sizes.hot.mark)), spec, sizes.hot, sizes.groups)


def log_orders(spark: SparkSession, sf_dir: str) -> EventLog:
    """A case is one customer."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_custkey", "case_id")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumnRenamed("c_custkey", "case_id")
    # the case is the join key, so windows over cases find the rows where the join has put them
    return _joined(orders, customer.select("case_id", "c_mktsegment", "c_nationkey", "c_acctbal"), ORDERS_SPEC, [
        "case_id", "o_orderdate", "o_orderkey", "o_orderpriority",
        "o_orderstatus", "o_totalprice", "c_mktsegment", "c_nationkey", "c_acctbal"])


def log_items(spark: SparkSession, sf_dir: str) -> EventLog:
    """A case is one order, an event one of its items."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_orderkey", "case_id")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("case_id"), "o_orderdate")
    return _joined(items, orders, ITEMS_SPEC, [
        "case_id", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey",
        "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "o_orderdate"])


def labelled_events(spark: SparkSession, sf_dir: str) -> EventLog:
    """``log_events`` with its outcome (any event with k >= 95) and nothing cut."""
    return label_predicate(log_events(spark, sf_dir), F.col("k") >= SCORE_LIMIT, cut=False)


@dataclass(frozen=True)
class Sized:
    """What the log tells about its predictions, so that they need not be counted again.

    Cases of predictions are those of the log: where none is oversized, ``case`` is None. A prefix length has at most one
    row a case: where the cases are few enough for a task, ``length`` is None. Otherwise groups are counted (``auto``).
    """

    case: None | str
    length: None | str


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Sized]:
    """``predictions`` and the sizes of their groups."""
    log = prefixes(labelled_events(spark, sf_dir))
    small = log.cases is not None and log.cases <= hot_rows(spark)
    return _predicted(log), Sized(None if log.hot is None else "auto", None if small else "auto")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every prefix: k / 100 of its last event, against the outcome of the case.

    ``dataset`` is the week of the case and ``Method`` the parity of the user, to have several groups.
    """
    return _predicted(prefixes(labelled_events(spark, sf_dir)))


def _predicted(log: EventLog) -> DataFrame:
    user = F.split("case_id", "_")[0].cast("long")
    return log.df.select(
        F.concat(F.lit("week"), F.split("case_id", "_")[1]).alias("dataset"),
        F.when(user % 2 == 0, "RF_agg").otherwise("XGB_agg").alias("Method"),
        "case_id", F.col(PREFIX).cast("int").alias("nr_events"),
        (F.col("k") / 100.0).alias("predicted"), is_positive(log).alias("actual"), "k")


def run_predictions(spark: SparkSession, sf_dir: str, runs: int = 5) -> DataFrame:
    """The same with five training runs, and two parameter sets that score differently."""
    pred = predictions(spark, sf_dir)
    run = F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")
    params = F.explode(F.array(F.lit("500_0.3"), F.lit("200_0.7"))).alias("params")
    each = pred.select("*", run).select("*", params)
    step = F.when(F.col("params") == "500_0.3", F.col("run") + 3).otherwise(F.lit(1) + (F.col("run") % 2))
    return each.select(
        "dataset", F.col("Method").alias("method"), F.lit("rf").alias("cls"), "case_id", "nr_events", "actual", "run",
        "params", (F.pmod(F.col("k") * step, F.lit(101)) / 100.0).alias("predicted"))

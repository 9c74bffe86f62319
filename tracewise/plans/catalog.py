"""Registered queries over the driver's tables, each with an SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewise.eventlog import EventLog
from tracewise.functions import params as P
from tracewise.functions.columns import c
from tracewise.functions.time import micros
from tracewise.operators import auc as A
from tracewise.operators import bucket as B
from tracewise.operators import clean, filters, label, models, split, timefeat, tune
from tracewise.operators import encode as E
from tracewise.operators import recurrent as R
from tracewise.operators import stability as S
from tracewise.operators.batched import fit_boosted
from tracewise.operators.custom import fold_cases, per_case
from tracewise.operators.prefix import PREFIX, prefix_log, prefixes
from tracewise.operators.scan import running_mean, running_sum
from tracewise.operators.sparse import SparseEncoding, SparseOneHot
from tracewise.operators.train import encode_splits
from tracewise.plans import views as V
from tracewise.plans.experiment import evaluate, final_predictions, report, splits, tuning_predictions
from tracewise.session import keep, shared_folder
from tracewise.sources.logs import read_log, read_raw_log, read_results, read_tagged, write_table
from tracewise.sources.params import save_params
from tracewise.streaming import running

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = "WITH " + sql.strip()
        return fn
    return register


def r6(value, name: str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6).alias(name)


# ------------------------------------------------------------------ shared SQL of the event logs

EV = """
ev AS (
  SELECT CAST(user_id AS VARCHAR) || '_' || CAST((epoch_us(ts) - 1704067200000000) // 604800000000 AS VARCHAR) AS case_id,
         ts, event_id, event_type, value, CASE WHEN event_type = 'purchase' THEN value END AS amount,
         CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k
  FROM events)"""
LAB = EV + """,
lab AS (
  SELECT *, CASE WHEN max(k) OVER (PARTITION BY case_id) >= 95 THEN 'deviant' ELSE 'regular' END AS label,
         row_number() OVER (PARTITION BY case_id ORDER BY ts, event_type, event_id) AS prefix_nr
  FROM ev)"""
LABY = LAB + """,
laby AS (SELECT *, CASE WHEN label = 'deviant' THEN 1 ELSE 0 END AS y FROM lab)"""
ORD = """
ord AS (
  SELECT o_custkey AS case_id, o_orderdate, o_orderkey, o_orderpriority, o_orderstatus,
         o_totalprice, c_mktsegment, c_nationkey, c_acctbal,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nr,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderpriority, o_orderkey) AS prefix_nr
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
ITEM = """
item AS (
  SELECT l_orderkey AS case_id, l_shipdate, l_linenumber, l_partkey, l_suppkey, l_returnflag,
         l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax, o_orderdate,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity,
                            l_extendedprice, l_discount, l_tax, l_linestatus, o_orderdate) AS nr
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
PRED = LABY + """,
pred AS (
  SELECT 'week' || split_part(case_id, '_', 2) AS dataset,
         CASE WHEN CAST(split_part(case_id, '_', 1) AS BIGINT) % 2 = 0 THEN 'RF_agg' ELSE 'XGB_agg' END AS "Method",
         case_id, CAST(prefix_nr AS INTEGER) AS nr_events, k / 100.0::DOUBLE AS predicted, y AS actual, k
  FROM laby)"""
DIFF = PRED + """,
dif AS (
  SELECT *, predicted - lag(predicted) OVER (PARTITION BY dataset, "Method", case_id ORDER BY nr_events) AS d
  FROM pred)"""
RUNS = PRED + """,
runs AS (
  SELECT dataset, "Method" AS method, 'rf' AS cls, case_id, nr_events, actual, run, params,
         ((k * CASE WHEN params = '500_0.3' THEN run + 3 ELSE 1 + run % 2 END) % 101) / 100.0::DOUBLE AS predicted
  FROM pred, (SELECT unnest(range(5)) AS run), (SELECT unnest(['500_0.3', '200_0.7']) AS params))"""


def auc_sql(source: str, by: str, score: str = "predicted") -> str:
    """Rank AUC by counts per score, and the automatic direction, as CTEs ending in ``aucs``."""
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f""",
cnt AS (SELECT {cols}{score} AS s, sum(actual) AS pos, sum(1 - actual) AS neg FROM {source}
        GROUP BY {cols}{score}),
cum AS (SELECT *, sum(neg) OVER ({part} ORDER BY s) AS cum_neg FROM cnt),
raw AS (SELECT {cols}CAST(sum(pos + neg) AS BIGINT) AS count,
               sum(pos * (cum_neg - neg / 2.0::DOUBLE)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS auc
        FROM cum {group}),
mid AS (SELECT {cols}median({score}) FILTER (actual = 1) AS mp, median({score}) FILTER (actual = 0) AS mn
        FROM {source} {group}),
aucs AS (SELECT raw.*, CASE WHEN mn > mp THEN 1 - auc ELSE auc END AS auc_auto
         FROM raw {"JOIN mid USING (" + by + ")" if by else ", mid"})"""


EVENT_LEVELS = ("click", "error", "purchase", "signup", "view")
PRIORITY_LEVELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
RUN_W = "OVER (PARTITION BY case_id ORDER BY prefix_nr ROWS UNBOUNDED PRECEDING)"

# ------------------------------------------------------------------ flagship


@query(LABY + f"""
SELECT case_id, prefix_nr, y, {", ".join(
    f"CAST(sum(CASE WHEN event_type = '{x}' THEN 1 ELSE 0 END) {RUN_W} AS DOUBLE) AS event_type_{x}"
    for x in EVENT_LEVELS)},
  round(avg(value) {RUN_W}, 6) AS mean_value, round(max(value) {RUN_W}, 6) AS max_value,
  round(min(value) {RUN_W}, 6) AS min_value, round(sum(value) {RUN_W}, 6) AS sum_value,
  round(coalesce(stddev_samp(value) {RUN_W}, 0), 6) AS std_value
FROM laby""")
def encode_agg(spark, sf_dir):
    """Every running case after each event, and how it ended."""
    log = prefixes(V.labelled_events(spark, sf_dir))
    enc = E.encoder("agg", cat=["event_type"], num=["value"])
    df = enc.fit_transform(log)
    return df.select("case_id", PREFIX, "y", *[r6(c(n), n) for n in enc.columns])


# ------------------------------------------------------------------ sources and cleaning


@query("t AS (SELECT 1) SELECT event_id, epoch_us(ts) AS at, user_id, event_type, value, props FROM events")
def read_raw_table(spark, sf_dir):
    raw = read_raw_log(spark, f"{sf_dir}/events.parquet", ["ts"])
    return raw.select("event_id", micros(F.col("ts")).alias("at"), "user_id", "event_type", "value", "props")


@query(EV + "SELECT case_id, event_type, value, amount, event_id, epoch_us(ts) AS at FROM ev")
def project_roles(spark, sf_dir):
    log = clean.project_roles(V.log_events(spark, sf_dir))
    return log.df.select("case_id", "event_type", "value", "amount", "event_id", micros(F.col("ts")).alias("at"))


@query("t AS (SELECT 1) SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def strip_col_prefix(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", F.col("o_custkey").alias("(case) o_custkey"), F.col("o_totalprice").alias("(case) o_totalprice"))
    return clean.strip_col_prefix(raw)


@query("""t AS (SELECT 1) SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) END,
'missing_caseid') AS user_id FROM events""")
def fill_case_id(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"))
    return clean.fill_case_id(raw, "user_id")


@query(EV + """, g AS (SELECT *, count(amount) OVER (PARTITION BY case_id ORDER BY ts, event_id
                                                ROWS UNBOUNDED PRECEDING) AS grp FROM ev)
SELECT event_id, max(amount) OVER (PARTITION BY case_id, grp) AS amount FROM g""")
def ffill(spark, sf_dir):
    return clean.ffill(V.log_events(spark, sf_dir), ["amount"]).df.select("event_id", "amount")


@query(EV + """SELECT event_id, coalesce(CASE WHEN k < 50 THEN event_type END, 'missing') AS event_type,
  coalesce(amount, 0) AS amount FROM ev""")
def fill_missing(spark, sf_dir):
    df = V.log_events(spark, sf_dir).df.withColumn("event_type", F.when(F.col("k") < 50, F.col("event_type")))
    return clean.fill_missing(df, ["event_type"], ["amount"]).select("event_id", "event_type", "amount")


@query("""n AS (SELECT p_type, count(*) AS c FROM part GROUP BY 1), s AS (SELECT p_size, count(*) AS c FROM part GROUP BY 1)
SELECT p_partkey, p_brand, CASE WHEN n.c >= 300 THEN p_type ELSE 'other' END AS p_type,
  CASE WHEN s.c >= 40 THEN CAST(p_size AS VARCHAR) ELSE 'other' END AS p_size
FROM part JOIN n USING (p_type) JOIN s USING (p_size)""")
def collapse_rare(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type", "p_size", "p_brand")
    rare_types = clean.collapse_rare(df, ["p_type", "p_brand"], 300, exempt=["p_brand"])
    return clean.collapse_rare(rare_types, ["p_size"], 40)


def _top(col: str, k: int) -> str:
    return f"""t_{col} AS (SELECT {col}, row_number() OVER (ORDER BY count(*) DESC, CAST({col} AS VARCHAR)) AS r
                            FROM part GROUP BY 1 QUALIFY r <= {k})"""


@query(f"""{_top("p_type", 3)}, {_top("p_size", 3)}
SELECT p_partkey, CASE WHEN p_type IN (SELECT p_type FROM t_p_type) THEN p_type ELSE 'other' END AS p_type,
  CASE WHEN p_size IN (SELECT p_size FROM t_p_size) THEN CAST(p_size AS VARCHAR) ELSE 'other' END AS p_size FROM part""")
def collapse_topk(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type", "p_size")
    return clean.collapse_topk(df, ["p_type", "p_size"], 3)


@query("""t AS (SELECT 1) SELECT event_id, CASE WHEN value >= 10 AND event_type = 'view' THEN 'click'
  WHEN value >= 10 AND event_type = 'click' THEN 'view' ELSE event_type END AS event_type FROM events""")
def relabel(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
    return clean.relabel(df, "event_type", {"view": "click", "click": "view"}, F.col("value") >= 10).drop("value")


@query(LABY + "SELECT event_id, y FROM laby")
def numeric_label(spark, sf_dir):
    return clean.numeric_label(V.labelled_events(spark, sf_dir)).df.select("event_id", "y")


@query(EV + """SELECT event_id, k AS n_estimators, value AS max_features, CAST(k AS VARCHAR) AS as_text,
  CAST(k AS VARCHAR) || '_x' AS formatted FROM ev""")
def parse_params(spark, sf_dir):
    df = V.log_events(spark, sf_dir).df
    names = P.PARAM_NAMES["rf"]
    text = F.concat_ws("_", F.col("k").cast("string"), F.col("value").cast("string"))
    parsed = df.select("event_id", P.parse_params(text, names).alias("p"), P.params_map(text, names).alias("m"))
    shown = F.struct(F.col("p.n_estimators").alias("n_estimators"), F.lit("x").alias("max_features"))
    return parsed.select("event_id", "p.n_estimators", "p.max_features", F.col("m")["n_estimators"].alias("as_text"),
                         P.format_params(shown, names).alias("formatted"))


@query(LAB + """SELECT event_id, CASE WHEN prefix_nr < 2 THEN case_id ELSE case_id || '_' || prefix_nr END AS prefix_id,
  case_id AS orig FROM lab""")
def strip_prefix_id(spark, sf_dir):
    df = prefixes(V.log_events(spark, sf_dir)).df
    prefix_id = F.when(F.col(PREFIX) < 2, F.col("case_id")).otherwise(F.concat_ws("_", "case_id", PREFIX))
    named = df.select("event_id", prefix_id.alias("prefix_id"), PREFIX)
    return named.select("event_id", "prefix_id",
                        clean.original_case_id(F.col("prefix_id"), F.col(PREFIX)).alias("orig"))


# ------------------------------------------------------------------ filters


@query(EV + """SELECT event_id FROM ev WHERE case_id IN (SELECT case_id FROM ev WHERE event_type IN ('signup', 'error'))""")
def keep_cases_with(spark, sf_dir):
    return filters.keep_cases_with(V.log_events(spark, sf_dir), ["signup", "error"]).df.select("event_id")


@query(EV + """SELECT event_id FROM ev WHERE case_id NOT IN (
  SELECT case_id FROM (SELECT case_id, arg_max(event_type, (ts, event_id)) AS last FROM ev GROUP BY 1) WHERE last = 'view')""")
def drop_cases_ending(spark, sf_dir):
    return filters.drop_cases_ending(V.log_events(spark, sf_dir), "view").df.select("event_id")


def _buyers(log: EventLog) -> DataFrame:
    return log.df.where(F.col("amount") > 50).select("case_id").distinct()


@query(EV + "SELECT event_id FROM ev WHERE case_id IN (SELECT case_id FROM ev WHERE amount > 50)")
def for_cases(spark, sf_dir):
    log = V.log_events(spark, sf_dir)
    return filters.for_cases(log, _buyers(log)).df.select("event_id")


@query(EV + "SELECT event_id FROM ev WHERE case_id NOT IN (SELECT case_id FROM ev WHERE amount > 50)")
def except_cases(spark, sf_dir):
    log = V.log_events(spark, sf_dir)
    return filters.except_cases(log, _buyers(log)).df.select("event_id")


@query("""t AS (SELECT 1) SELECT p_partkey, p_name FROM part
WHERE p_name LIKE 'small%' OR (p_name LIKE '%ring%' AND NOT regexp_matches(p_name, '^(red|blue)'))""")
def name_patterns(spark, sf_dir):
    name = F.col("p_name")
    return spark.read.parquet(f"{sf_dir}/part.parquet").where(
        name.startswith("small") | (name.contains("ring") & ~name.rlike("^(red|blue)"))).select("p_partkey", "p_name")


# ------------------------------------------------------------------ time and inter-case features


@query("""t AS (SELECT 1) SELECT event_id, CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) - 1 AS INTEGER) AS weekday,
  CAST(hour(ts) AS INTEGER) AS hour, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS timesincemidnight FROM events""")
def calendar_features(spark, sf_dir):
    df = timefeat.calendar_features(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts")
    return df.select("event_id", "month", "weekday", "hour", "timesincemidnight")


@query(ORD + """SELECT o_orderkey, round(coalesce((epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER (
  PARTITION BY case_id ORDER BY o_orderdate, o_orderkey DESC))) / 6e7, 0), 6) AS timesincelastevent FROM ord""")
def time_since_last(spark, sf_dir):
    df = timefeat.time_since_last(V.log_orders(spark, sf_dir)).df
    return df.select("o_orderkey", r6("timesincelastevent", "timesincelastevent"))


@query(EV + """SELECT event_id, epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY case_id)) AS micros_since_start FROM ev""")
def time_since_start(spark, sf_dir):
    """Shown in whole microseconds, as minutes with six digits would be a matter of rounding."""
    df = timefeat.time_since_start(V.log_events(spark, sf_dir)).df
    return df.select("event_id", F.round(F.col("timesincecasestart") * 6e7).cast("long").alias("micros_since_start"))


@query(ORD + "SELECT o_orderkey, nr AS event_nr FROM ord")
def event_nr(spark, sf_dir):
    return timefeat.event_nr(V.log_orders(spark, sf_dir)).df.select("o_orderkey", "event_nr")


@query("""t AS (SELECT 1) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 6e7, 6) AS activity_duration
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def activity_duration(spark, sf_dir):
    df = clean.duration(V.log_items(spark, sf_dir).df, "o_orderdate", "l_shipdate")
    return df.select(F.col("case_id").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey",
                     "l_extendedprice", r6("activity_duration", "activity_duration"))


@query(EV + """, sp AS (SELECT case_id, min(ts) AS s, max(ts) AS e FROM ev GROUP BY 1)
SELECT event_id, (SELECT count(*) FROM sp WHERE s <= ts AND e > ts) AS open_cases FROM ev""")
def open_cases(spark, sf_dir):
    return timefeat.open_cases(V.log_events(spark, sf_dir)).df.select("event_id", "open_cases")


@query(ORD + """, sp AS (
  SELECT *, min(o_orderdate) OVER (PARTITION BY case_id) AS s, max(o_orderdate) OVER (PARTITION BY case_id) AS e,
         row_number() OVER (PARTITION BY case_id, o_orderdate ORDER BY o_orderkey) AS tie FROM ord),
d AS (SELECT *, CASE WHEN s = e THEN 0 WHEN nr = 1 THEN 1 WHEN o_orderdate = e AND tie = 1 THEN -1 ELSE 0 END AS d FROM sp)
SELECT o_orderkey, CAST(coalesce(sum(d) OVER (ORDER BY o_orderdate, case_id, o_orderkey
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS open_cases FROM d""")
def open_cases_scan(spark, sf_dir):
    return timefeat.open_cases_scan(V.log_orders(spark, sf_dir)).df.select("o_orderkey", "open_cases")


@query(ORD + """SELECT o_orderkey, nr AS event_nr, CAST(month(o_orderdate) AS INTEGER) AS month,
  CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday,
  round((epoch_us(o_orderdate) - epoch_us(min(o_orderdate) OVER (PARTITION BY case_id))) / 6e7, 6) AS timesincecasestart,
  round(coalesce((epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER (
    PARTITION BY case_id ORDER BY o_orderdate, o_orderkey DESC))) / 6e7, 0), 6) AS timesincelastevent FROM ord""")
def timestamp_features(spark, sf_dir):
    df = timefeat.timestamp_features(V.log_orders(spark, sf_dir)).df
    return df.select("o_orderkey", "event_nr", "month", "weekday", r6("timesincecasestart", "timesincecasestart"),
                     r6("timesincelastevent", "timesincelastevent"))


# ------------------------------------------------------------------ labels


def _first(predicate: str, source: str = "ev", order: str = "ts, event_id") -> str:
    return f""", nrd AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {order}) AS n FROM {source}),
fst AS (SELECT *, min(CASE WHEN {predicate} THEN n END) OVER (PARTITION BY case_id) AS f FROM nrd)"""


_POS = "CASE WHEN f IS NOT NULL THEN 'deviant' ELSE 'regular' END AS label"
_NEG = "CASE WHEN f IS NOT NULL THEN 'regular' ELSE 'deviant' END AS label"
_CUT = "WHERE f IS NULL OR n < f"


@query(EV + _first("event_type = 'error'") + f"SELECT event_id, {_POS} FROM fst {_CUT}")
def label_activity(spark, sf_dir):
    return label.label_activity(V.log_events(spark, sf_dir), "error").df.select("event_id", "label")


@query(EV + _first("event_type = 'error'") + f"SELECT event_id, {_POS} FROM fst")
def label_activity_uncut(spark, sf_dir):
    return label.label_activity(V.log_events(spark, sf_dir), "error", cut=False).df.select("event_id", "label")


@query(EV + """, gap AS (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (
    PARTITION BY case_id ORDER BY ts, event_id DESC))) / 6e7, 0) AS g FROM ev)""" + _first("event_type = 'purchase'", "gap") + f"""
, hit AS (SELECT *, max(CASE WHEN n = f AND g <= 720 THEN 1 ELSE 0 END) OVER (PARTITION BY case_id) AS h FROM fst)
SELECT event_id, CASE WHEN h = 1 THEN 'deviant' ELSE 'regular' END AS label FROM hit {_CUT}""")
def label_activity_within(spark, sf_dir):
    log = timefeat.time_since_last(V.log_events(spark, sf_dir))
    return label.label_activity_within(log, "purchase", 720).df.select("event_id", "label")


@query(EV + _first("k >= 98") + f"SELECT event_id, {_NEG} FROM fst {_CUT}")
def label_attribute_present(spark, sf_dir):
    log = V.log_events(spark, sf_dir)
    log = log.with_df(log.df.withColumn("flag", F.col("k") >= 98))
    return label.label_attribute_present(log, "flag").df.select("event_id", "label")


@query(ORD + _first("o_orderstatus = 'P'", "ord", "o_orderdate, o_orderkey") + f"SELECT o_orderkey, {_POS} FROM fst")
def label_attribute_equals(spark, sf_dir):
    return label.label_attribute_equals(V.log_orders(spark, sf_dir), "o_orderstatus", "P").df.select("o_orderkey", "label")


@query(ITEM + _first("l_discount > 0.08", "item", "nr") + f"SELECT case_id, nr, l_quantity, {_POS} FROM fst {_CUT}")
def label_predicate(spark, sf_dir):
    log = timefeat.event_nr(V.log_items(spark, sf_dir), "nr")
    return label.label_predicate(log, F.col("l_discount") > 0.08).df.select("case_id", "nr", "l_quantity", "label")


@query(ITEM + """, cum AS (SELECT *, sum(l_quantity) OVER (PARTITION BY case_id ORDER BY nr ROWS UNBOUNDED PRECEDING) AS paid,
  max(l_quantity * 3) OVER (PARTITION BY case_id) AS target FROM item)""" + _first("paid >= target", "cum", "nr") + f"""
SELECT case_id, nr, {_POS} FROM fst {_CUT}""")
def label_threshold_reached(spark, sf_dir):
    log = timefeat.event_nr(V.log_items(spark, sf_dir), "nr")
    log = log.scan(running_sum("paid", F.col("l_quantity")), order=log.spec.time_order)
    log = log.with_df(log.df.withColumn("amount", F.col("l_quantity") * 3))
    return label.label_threshold_reached(log, "amount", "paid").df.select("case_id", "nr", "label")


@query(ORD + """, l AS (SELECT case_id, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS last
                    FROM ord WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_orderkey, outcome, CASE WHEN last = outcome THEN 'deviant' ELSE 'regular' END AS label
FROM ord JOIN l USING (case_id), (SELECT unnest(['1-URGENT', '2-HIGH', '5-LOW']) AS outcome)
WHERE last IN ('1-URGENT', '2-HIGH', '5-LOW')""")
def label_last_of(spark, sf_dir):
    log = label.label_last_of(V.log_orders(spark, sf_dir), F.col("o_orderstatus") == "F", ["1-URGENT", "2-HIGH", "5-LOW"])
    return log.df.select("o_orderkey", "outcome", "label")


@query(EV + _first("event_type = 'purchase'") + f"SELECT event_id FROM fst {_CUT}")
def cut_before(spark, sf_dir):
    return label.cut_before(V.log_events(spark, sf_dir), "purchase").df.select("event_id")


# ------------------------------------------------------------------ splits and measures

SPLIT = LAB + """,
cs AS (SELECT case_id, min(ts) AS s, row_number() OVER (ORDER BY min(ts), case_id) AS r, count(*) OVER () AS n
       FROM lab GROUP BY 1),
test AS (SELECT lab.* FROM lab JOIN cs USING (case_id) WHERE r > CAST(floor(0.8 * n) AS BIGINT)),
train AS (SELECT lab.* FROM lab JOIN cs USING (case_id) WHERE r <= CAST(floor(0.8 * n) AS BIGINT)
          AND ts < (SELECT min(ts) FROM test)),
vr AS (SELECT case_id, row_number() OVER (ORDER BY md5(case_id || '_22'), case_id) AS r, count(*) OVER () AS n
       FROM train GROUP BY case_id),
val AS (SELECT train.* FROM train JOIN vr USING (case_id) WHERE r > n - CAST(floor(0.2 * n) AS BIGINT)),
fit AS (SELECT train.* FROM train JOIN vr USING (case_id) WHERE r <= n - CAST(floor(0.2 * n) AS BIGINT))"""


def _sides(**sides: EventLog) -> DataFrame:
    out = None
    for name, log in sides.items():
        one = log.df.select("event_id", F.lit(name).alias("side"))
        out = one if out is None else out.unionByName(one)
    return out


@query(SPLIT + "SELECT event_id, 'train' AS side FROM train UNION ALL SELECT event_id, 'test' FROM test")
def split_strict(spark, sf_dir):
    train, test = split.split_strict(V.log_events(spark, sf_dir), 0.8)
    return _sides(train=train, test=test)


@query(SPLIT + "SELECT event_id, 'train' AS side FROM fit UNION ALL SELECT event_id, 'val' FROM val")
def split_val_random(spark, sf_dir):
    train, _ = split.split_strict(V.log_events(spark, sf_dir), 0.8)
    train, val = split.split_val(train, 0.2)
    return _sides(train=train, val=val)


@query(EV + """, nl AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN case_id END AS case_id FROM ev),
vr AS (SELECT case_id, row_number() OVER (ORDER BY md5(case_id || '_22'), case_id) AS r, count(*) OVER () AS n
       FROM nl WHERE case_id IS NOT NULL GROUP BY case_id)
SELECT event_id, CASE WHEN r > n - CAST(floor(0.2 * n) AS BIGINT) THEN 'val' ELSE 'train' END AS side
FROM nl LEFT JOIN vr USING (case_id)""")
def split_val_null_cases(spark, sf_dir):
    """Events of one type have no case id: they stay in train, and no event is lost."""
    log = V.log_events(spark, sf_dir)
    df = log.df.withColumn("case_id", F.when(F.col("event_type") != "error", F.col("case_id")))
    train, val = split.split_val(EventLog.of(df.select("case_id", "event_id", "event_type", "ts"), log.spec), 0.2)
    return _sides(train=train, val=val)


@query(SPLIT + """SELECT event_id, 'train' AS side FROM fit UNION ALL SELECT event_id, 'val' FROM val
UNION ALL SELECT event_id, 'test' FROM test""")
def assign_splits(spark, sf_dir):
    return split.assign_splits(V.log_events(spark, sf_dir), name="side").df.select("event_id", "side")


@query(LAB + """, cs AS (SELECT case_id, row_number() OVER (ORDER BY min(ts), case_id) AS r, count(*) OVER () AS n
                     FROM lab GROUP BY 1)
SELECT event_id, CASE WHEN r > n - CAST(floor(0.2 * n) AS BIGINT) THEN 'val' ELSE 'train' END AS side
FROM lab JOIN cs USING (case_id)""")
def split_val_temporal(spark, sf_dir):
    train, val = split.split_val(V.log_events(spark, sf_dir), 0.2, "temporal")
    return _sides(train=train, val=val)


@query(LABY + """SELECT 'event' AS per, round(avg(y), 6) AS class_ratio FROM laby UNION ALL
SELECT 'case', round(avg(y), 6) FROM (SELECT case_id, max(y) AS y FROM laby GROUP BY 1)""")
def class_ratio(spark, sf_dir):
    log = V.labelled_events(spark, sf_dir)
    both = [split.class_ratio(log, per).select(F.lit(per).alias("per"), r6("class_ratio", "class_ratio"))
            for per in ("event", "case")]
    return both[0].unionByName(both[1])


_POSLEN = LABY + ", len AS (SELECT count(*) AS n FROM laby WHERE y = 1 GROUP BY case_id)"


@query(_POSLEN + "SELECT CAST(ceil(quantile_cont(n, 0.9)) AS INTEGER) AS length_quantile FROM len")
def pos_length_quantile(spark, sf_dir):
    return split.pos_length_quantile(V.labelled_events(spark, sf_dir), 0.9)


@query(_POSLEN + "SELECT CAST(max(n) AS INTEGER) AS max_length FROM len")
def max_pos_length(spark, sf_dir):
    return split.max_pos_length(V.labelled_events(spark, sf_dir))


@query(_POSLEN + """, cap AS (SELECT least(40, CAST(ceil(quantile_cont(n, 0.9)) AS BIGINT)) AS cap FROM len)
SELECT case_id, least(count(*), any_value(cap)) AS kept FROM laby, cap GROUP BY 1""")
def max_prefix_length(spark, sf_dir):
    log = V.labelled_events(spark, sf_dir)
    kept = prefixes(log, split.max_prefix_length(log)).df
    return kept.groupBy("case_id").agg(F.count(F.lit(1)).alias("kept"))


@query(LAB + """SELECT case_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS case_length,
  min(label) AS label FROM lab GROUP BY 1""")
def case_table(spark, sf_dir):
    return split.case_table(V.labelled_events(spark, sf_dir)).select(
        "case_id", micros(F.col("start_time")).alias("start_us"), micros(F.col("end_time")).alias("end_us"),
        "case_length", "label")


@query(LABY + """, len AS (SELECT case_id, y, count(*) AS n FROM laby GROUP BY 1, 2)
SELECT 'log_events' AS dataset, CASE WHEN y = 1 THEN 'pos' ELSE 'neg' END AS label, n AS nr_events,
  count(*) AS case_count FROM len GROUP BY 2, 3""")
def case_length_counts(spark, sf_dir):
    return split.case_length_counts(V.labelled_events(spark, sf_dir))


@query(SPLIT + """,
parts AS (SELECT 'train' AS data_type, * FROM fit UNION ALL SELECT 'val', * FROM val UNION ALL SELECT 'test', * FROM test),
len AS (SELECT data_type, case_id, label, count(*) AS n FROM parts GROUP BY 1, 2, 3),
grid AS (SELECT unnest(range(1, (SELECT max(c) FROM (SELECT count(*) AS c FROM lab WHERE label = 'deviant' GROUP BY case_id)) + 1))
         AS nr_events),
kinds AS (SELECT unnest(['train', 'val', 'test']) AS data_type), labels AS (SELECT unnest(['all', 'pos', 'neg']) AS label)
SELECT 'log_events' AS dataset, g.data_type, g.label, CAST(nr_events AS INTEGER) AS nr_events, count(len.case_id) AS case_count
FROM (SELECT * FROM grid, kinds, labels) g LEFT JOIN len ON len.data_type = g.data_type AND n >= nr_events
  AND (g.label = 'all' OR (g.label = 'pos') = (len.label = 'deviant')) GROUP BY 2, 3, 4""")
def prefix_length_counts(spark, sf_dir):
    log = V.labelled_events(spark, sf_dir)
    return split.prefix_length_counts(split.assign_splits(log), split.max_pos_length(log), "log_events")


@query(LABY + """SELECT label, floor(value / 1.0) AS bin, count(*) AS count FROM laby GROUP BY 1, 2""")
def histogram(spark, sf_dir):
    return split.histogram(V.labelled_events(spark, sf_dir).df, "value", ["label"], 1.0)


# ------------------------------------------------------------------ prefixes, encoders, buckets


@query(LAB + """SELECT CASE WHEN p.prefix_nr = 1 THEN p.case_id ELSE p.case_id || '_' || p.prefix_nr END AS case_id,
  p.case_id AS orig_case_id, p.prefix_nr, p.prefix_nr AS case_length, e.event_id, e.label
FROM lab p JOIN lab e ON p.case_id = e.case_id AND e.prefix_nr <= p.prefix_nr WHERE p.prefix_nr <= 10""")
def prefix_log_table(spark, sf_dir):
    df = prefix_log(V.labelled_events(spark, sf_dir), 1, 10).df
    return df.select("case_id", "orig_case_id", PREFIX, "case_length", "event_id", "label")


@query(LAB + """SELECT CASE WHEN p.prefix_nr = 1 THEN p.case_id ELSE p.case_id || '_' || p.prefix_nr END AS case_id,
  p.case_id AS orig_case_id, p.prefix_nr, p.prefix_nr AS case_length, e.event_id, e.label
FROM lab p JOIN lab e ON p.case_id = e.case_id AND e.prefix_nr <= p.prefix_nr""")
def prefix_log_table_whole(spark, sf_dir):
    """All prefixes up to the longest case."""
    log = V.labelled_events(spark, sf_dir)
    df = prefix_log(log, 1, _longest(log)).df
    return df.select("case_id", "orig_case_id", PREFIX, "case_length", "event_id", "label")


def _longest(log: EventLog) -> int:
    return log.df.groupBy("case_id").count().agg(F.max("count")).first()[0] or 1


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _dummies(col: str, levels, name: str | None = None) -> str:
    return ", ".join(f"CAST(coalesce({col} = '{x}', false) AS DOUBLE) AS \"{name or col}_{x}\"" for x in levels)


@query(ORD + f"""SELECT case_id, prefix_nr, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_acctbal,
  {_dummies("c_mktsegment", SEGMENTS)} FROM ord""")
def encode_static(spark, sf_dir):
    return E.encoder("static", V.ORDERS_SPEC).fit_transform(prefixes(V.log_orders(spark, sf_dir)))


@query(LABY + f""", g AS (SELECT *, count(amount) {RUN_W} AS grp FROM laby)
SELECT case_id, prefix_nr, y, value, coalesce(max(amount) OVER (PARTITION BY case_id, grp), 0) AS amount,
  {_dummies("event_type", EVENT_LEVELS)} FROM g""")
def encode_last(spark, sf_dir):
    enc = E.encoder("last", cat=["event_type"], num=["value", "amount"])
    return enc.fit_transform(prefixes(V.labelled_events(spark, sf_dir)))


@query(LABY + f"""SELECT case_id, prefix_nr, y, {", ".join(
    f"CAST(max(CASE WHEN event_type = '{x}' THEN 1 ELSE 0 END) {RUN_W} AS DOUBLE) AS event_type_{x}" for x in EVENT_LEVELS)},
  round(coalesce(avg(amount) {RUN_W}, 0), 6) AS mean_amount, coalesce(max(amount) {RUN_W}, 0) AS max_amount,
  coalesce(min(amount) {RUN_W}, 0) AS min_amount, round(coalesce(sum(amount) {RUN_W}, 0), 6) AS sum_amount,
  round(coalesce(stddev_samp(amount) {RUN_W}, 0), 6) AS std_amount FROM laby""")
def encode_bool(spark, sf_dir):
    enc = E.encoder("bool", cat=["event_type"], num=["amount"])
    df = enc.fit_transform(prefixes(V.labelled_events(spark, sf_dir)))
    return df.select("case_id", PREFIX, "y", *[r6(c(n), n) for n in enc.columns])


def _at(col: str, i: int) -> str:
    return f"max(CASE WHEN prefix_nr = {i + 1} THEN {col} END) {RUN_W}"


def _positions(k: int, levels=True) -> str:
    numbers = [f"coalesce({_at('o_totalprice', i)}, 0) AS o_totalprice_{i}" for i in range(k)]
    dummies = [f"CAST(coalesce({_at('o_orderpriority', i)} = '{x}', false) AS DOUBLE) AS \"o_orderpriority_{i}_{x}\""
               for i in range(k) for x in PRIORITY_LEVELS]
    return ", ".join(numbers + dummies)


@query(ORD + f"SELECT case_id, prefix_nr, {_positions(5)} FROM ord")
def encode_index(spark, sf_dir):
    enc = E.encoder("index", cat=["o_orderpriority"], num=["o_totalprice"], max_events=5)
    return enc.fit_transform(prefixes(V.log_orders(spark, sf_dir)))


def _at_positions(encoded: DataFrame, enc, prefix: str, number: str, levels: dict[str, list[str]]) -> DataFrame:
    """Index columns as rows (case, prefix, position, value, level of each attribute); zeros past the prefix are no rows."""
    at = []
    for i in range(enc.max_events):
        shown = [F.coalesce(*[F.when(c(f"{prefix}{n}_{i}_{x}") == 1, F.lit(x)) for x in known if f"{prefix}{n}_{i}_{x}" in encoded.columns] or [F.lit(None)])
                 .cast("string").alias(n) for n, known in levels.items()]
        at.append(F.struct(F.lit(i).alias("position"), c(f"{prefix}{number}_{i}").alias(number), *shown))
    rows = encoded.select("case_id", PREFIX, F.explode(F.array(*at)).alias("x")).select("case_id", PREFIX, "x.*")
    past = F.col("position") >= F.col(PREFIX)
    return rows.where(~past | (c(number) != 0) | F.coalesce(*[c(n).isNotNull() for n in levels]))


_AT = """SELECT p.case_id, p.prefix_nr, CAST(e.prefix_nr - 1 AS INTEGER) AS position, e.o_totalprice, e.o_orderpriority{more}
FROM ord p JOIN ord e ON p.case_id = e.case_id AND e.prefix_nr <= p.prefix_nr"""


@query(ORD + _AT.format(more=""))
def encode_index_learned(spark, sf_dir):
    """All positions up to the longest case."""
    enc = E.encoder("index", cat=["o_orderpriority"], num=["o_totalprice"])
    encoded = enc.fit_transform(prefixes(V.log_orders(spark, sf_dir)))
    return _at_positions(encoded, enc, "", "o_totalprice", {"o_orderpriority": PRIORITY_LEVELS})


@query(ORD + _AT.format(more=", e.o_orderstatus, p.c_acctbal, p.c_mktsegment"))
def encode_union_index(spark, sf_dir):
    enc = E.encoding("index", V.ORDERS_SPEC)
    encoded = enc.fit_transform(prefixes(V.log_orders(spark, sf_dir)))
    rows = _at_positions(encoded, enc.parts[1], "index__", "o_totalprice", {"o_orderpriority": PRIORITY_LEVELS, "o_orderstatus": list("FOP")})
    segment = F.coalesce(*[F.when(c(f"static__c_mktsegment_{x}") == 1, F.lit(x)) for x in SEGMENTS])
    static = encoded.select("case_id", PREFIX, F.col("static__c_acctbal").alias("c_acctbal"), segment.alias("c_mktsegment"))
    return rows.join(static, ["case_id", PREFIX])


@query(ORD + f"SELECT case_id, prefix_nr, {_positions(2)} FROM ord")
def index_extract(spark, sf_dir):
    enc = E.encoder("index", cat=["o_orderpriority"], num=["o_totalprice"], max_events=5)
    encoded = enc.fit_transform(prefixes(V.log_orders(spark, sf_dir)))
    return E.index_extract(encoded, ["o_orderpriority"], ["o_totalprice"], 2)[0]


@query(LABY + f""", p AS (SELECT case_id, prefix_nr, y,
    lag(event_type) OVER (PARTITION BY case_id ORDER BY prefix_nr) AS event_type,
    lag(amount) OVER (PARTITION BY case_id ORDER BY prefix_nr) AS amount FROM laby)
SELECT case_id, prefix_nr, y, coalesce(amount, 0) AS amount, {_dummies("event_type", EVENT_LEVELS)} FROM p""")
def encode_previous(spark, sf_dir):
    enc = E.encoder("previous", cat=["event_type"], num=["amount"])
    return enc.fit_transform(prefixes(V.labelled_events(spark, sf_dir)))


@query(SPLIT + """SELECT event_id, """ + ", ".join(
    f"CASE WHEN event_type = '{x}' THEN 1 ELSE 0 END AS event_type_{x}" for x in EVENT_LEVELS) + " FROM test")
def one_hot(spark, sf_dir):
    train, test = split.split_strict(V.log_events(spark, sf_dir), 0.8)
    return E.OneHot(["event_type"]).fit(train.df).transform(test.df.select("event_id", "event_type"))


_BOTH = ", both_sides AS (SELECT 'train' AS side, * FROM train UNION ALL SELECT 'test', * FROM test)"


@query(SPLIT + _BOTH + " SELECT side, event_id, " + ", ".join(
    f"CASE WHEN event_type = '{x}' THEN 1 ELSE 0 END AS event_type_{x}" for x in EVENT_LEVELS) + " FROM both_sides")
def one_hot_sides(spark, sf_dir):
    sides = split.split_strict(V.log_events(spark, sf_dir), 0.8)
    enc = E.OneHot(["event_type"]).fit(sides[0].df)
    one, other = (enc.transform(x.df.select(F.lit(n).alias("side"), "event_id", "event_type")) for n, x in zip(("train", "test"), sides, strict=True))
    return one.unionByName(other)


# ------------------------------------------------------------------ sparse encodings: a level for each part

PART = """
it AS (
  SELECT l_orderkey AS case_id, l_partkey, l_quantity, l_returnflag,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_returnflag, l_linenumber, l_partkey, l_suppkey, l_quantity,
                            l_extendedprice, l_discount, l_tax, l_linestatus, o_orderdate) AS prefix_nr
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_SO_FAR = "FROM it p JOIN it e ON p.case_id = e.case_id AND e.prefix_nr <= p.prefix_nr"


def _sparse_items(spark, sf_dir, encoder: E.Encoder) -> DataFrame:
    encoding = SparseEncoding(encoder)
    log = encoding.written(prefixes(V.log_items(spark, sf_dir)))
    return encoding.fit(log).long(log)


@query(PART + f"""SELECT p.case_id, p.prefix_nr, 'l_partkey_' || e.l_partkey AS name, CAST(count(*) AS DOUBLE) AS value {_SO_FAR} GROUP BY ALL""")
def sparse_agg(spark, sf_dir):
    return _sparse_items(spark, sf_dir, E.encoder("agg", cat=["l_partkey"]))


@query(PART + f"""SELECT DISTINCT p.case_id, p.prefix_nr, 'l_partkey_' || e.l_partkey AS name, CAST(1 AS DOUBLE) AS value {_SO_FAR}""")
def sparse_bool(spark, sf_dir):
    return _sparse_items(spark, sf_dir, E.encoder("bool", cat=["l_partkey"]))


@query(PART + f"""SELECT p.case_id, p.prefix_nr, 'l_partkey_' || (e.prefix_nr - 1) || '_' || e.l_partkey AS name, CAST(1 AS DOUBLE) AS value {_SO_FAR}
UNION ALL SELECT p.case_id, p.prefix_nr, 'l_quantity_' || (e.prefix_nr - 1), e.l_quantity {_SO_FAR}""")
def sparse_index(spark, sf_dir):
    return _sparse_items(spark, sf_dir, E.encoder("index", cat=["l_partkey"], num=["l_quantity"]))


@query(PART + f""", u AS (
  SELECT case_id, prefix_nr, 'last__l_partkey_' || l_partkey AS name, CAST(1 AS DOUBLE) AS value FROM it
  UNION ALL SELECT p.case_id, p.prefix_nr, 'previous__l_partkey_' || e.l_partkey, 1 {_SO_FAR.replace("<=", "+ 1 =")}
  UNION ALL SELECT p.case_id, p.prefix_nr, 'static__l_partkey_' || e.l_partkey, 1 {_SO_FAR} AND e.prefix_nr = 1
  UNION ALL SELECT p.case_id, p.prefix_nr, 'agg__sum_l_quantity', sum(e.l_quantity) {_SO_FAR} GROUP BY ALL
  UNION ALL SELECT p.case_id, p.prefix_nr, 'agg__max_l_quantity', max(e.l_quantity) {_SO_FAR} GROUP BY ALL
  UNION ALL SELECT p.case_id, p.prefix_nr, 'agg__min_l_quantity', min(e.l_quantity) {_SO_FAR} GROUP BY ALL
  UNION ALL SELECT p.case_id, p.prefix_nr, 'agg__mean_l_quantity', avg(e.l_quantity) {_SO_FAR} GROUP BY ALL
  UNION ALL SELECT p.case_id, p.prefix_nr, 'agg__std_l_quantity', stddev_samp(e.l_quantity) {_SO_FAR} GROUP BY ALL)
SELECT case_id, prefix_nr, name, round(value, 6) AS value FROM u WHERE round(value, 6) <> 0""")
def sparse_union(spark, sf_dir):
    parts = [E.encoder(n, cat=["l_partkey"]) for n in ("last", "previous", "static")] + [E.encoder("agg", num=["l_quantity"])]
    rows = _sparse_items(spark, sf_dir, E.UnionEncoder(parts))
    return rows.select("case_id", PREFIX, "name", r6("value", "value")).where("value <> 0")


@query("""cut AS (SELECT *, l_shipdate >= TIMESTAMP '1995-06-17' AS test FROM lineitem),
known AS (SELECT DISTINCT l_partkey FROM cut WHERE NOT test), flags AS (SELECT DISTINCT l_returnflag FROM cut WHERE NOT test)
SELECT l_orderkey, l_linenumber, 'l_partkey_' || l_partkey AS name FROM cut SEMI JOIN known USING (l_partkey)
UNION ALL SELECT l_orderkey, l_linenumber, 'l_returnflag_' || l_returnflag FROM cut SEMI JOIN flags USING (l_returnflag)""")
def sparse_one_hot(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate")
    train = items.where(F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp_ntz"))
    return SparseOneHot(["l_partkey", "l_returnflag"]).fit(train).long(items, ["l_orderkey", "l_linenumber"]).drop("position")


_UNION_PARTS = {
    "static": [f"CAST(c_nationkey AS DOUBLE) AS static__c_nationkey", "c_acctbal AS static__c_acctbal",
               *[f"CAST(c_mktsegment = '{x}' AS DOUBLE) AS static__c_mktsegment_{x}" for x in SEGMENTS]],
    "last": ["o_totalprice AS last__o_totalprice",
             *[f"CAST(o_orderpriority = '{x}' AS DOUBLE) AS \"last__o_orderpriority_{x}\"" for x in PRIORITY_LEVELS],
             *[f"CAST(o_orderstatus = '{x}' AS DOUBLE) AS last__o_orderstatus_{x}" for x in "FOP"]],
    "agg": [*[f"CAST(sum(CASE WHEN {n} = '{x}' THEN 1 ELSE 0 END) {RUN_W} AS DOUBLE) AS \"agg__{n}_{x}\""
              for n, levels in (("o_orderpriority", PRIORITY_LEVELS), ("o_orderstatus", "FOP")) for x in levels],
            *[f"round(coalesce({fn}(o_totalprice) {RUN_W}, 0) + 1e-7, 4) AS agg__{name}_o_totalprice"
              for name, fn in (("mean", "avg"), ("max", "max"), ("min", "min"), ("sum", "sum"), ("std", "stddev_samp"))]],
}


def _union_query(name: str, parts: tuple[str, ...]) -> None:
    def run(spark, sf_dir):
        enc = E.encoding(name, V.ORDERS_SPEC)
        df = enc.fit_transform(prefixes(V.log_orders(spark, sf_dir)))
        return df.select("case_id", PREFIX, *[
            # a mean of 8 prices may end in a 5 at the fifth digit: pushed off the rounding border
            F.round(c(n) + 1e-7, 4).alias(n) if "agg__" in n and n.endswith("totalprice") else c(n) for n in enc.columns])

    run.__name__ = f"encode_union_{name}"
    query(ORD + "SELECT case_id, prefix_nr, " + ", ".join(x for p in parts for x in _UNION_PARTS[p]) + " FROM ord")(run)


_union_query("laststate", ("static", "last"))
_union_query("agg", ("static", "agg"))
_union_query("combined", ("static", "last", "agg"))


@query(ORD + f""", e AS (SELECT case_id, prefix_nr, o_totalprice AS x, avg(o_totalprice) {RUN_W} AS m FROM ord),
s AS (SELECT avg(x) AS ax, stddev_pop(x) AS sx, avg(m) AS am, stddev_pop(m) AS sm FROM e)
SELECT case_id, prefix_nr, round((x - ax) / sx, 6) AS x, round((m - am) / sm, 6) AS m FROM e, s""")
def standardize(spark, sf_dir):
    log = prefixes(V.log_orders(spark, sf_dir)).scan(running_mean("m", F.col("o_totalprice")))
    df = log.df.select("case_id", PREFIX, F.col("o_totalprice").alias("x"), "m")
    scaled = E.Standardizer(["x", "m"]).fit(df).transform(df)
    return scaled.select("case_id", PREFIX, r6("x", "x"), r6("m", "m"))


_ENCODED = SPLIT + """, mm AS (SELECT min(value) AS lo, max(value) AS hi FROM train),
enc AS (SELECT case_id, event_id, prefix_nr, label, (value - lo) / (hi - lo) AS v, """ + ", ".join(
    f"CAST(event_type = '{x}' AS DOUBLE) AS event_type_{x}" for x in EVENT_LEVELS) + " FROM test, mm)"

_EVENT_SPEC = V.EVENTS_SPEC.with_(dynamic_num=("value",), static_cat=(), static_num=())


def _encoded_events(spark, sf_dir, side: int = 1):
    log = V.labelled_events(spark, sf_dir)
    log = EventLog(log.df, _EVENT_SPEC, log.hot, log.cases)
    sides = split.split_strict(log, 0.8)
    enc = E.EventEncoder(_EVENT_SPEC).fit(sides[0])
    return enc, sides[side]


@query(_ENCODED + "SELECT event_id, round(v, 6) AS event__value, " + ", ".join(
    f"event_type_{x} AS event__event_type_{x}" for x in EVENT_LEVELS) + " FROM enc")
def encode_events(spark, sf_dir):
    enc, test = _encoded_events(spark, sf_dir)
    df = enc.transform(test).df
    return df.select("event_id", *[r6(c(f"event__{n}"), f"event__{n}") for n in enc.columns])


def _as_text(col: str) -> Column:
    """A sequence of vectors as text, thousandths of its numbers."""
    return F.array_join(F.transform(F.flatten(F.col(col)),
                                    lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string")), ",")


_VECTOR = "[CAST(round(CAST(CAST(v AS FLOAT) AS DOUBLE) * 1000) AS BIGINT), " + ", ".join(
    f"CAST(event_type_{x} * 1000 AS BIGINT)" for x in EVENT_LEVELS) + "]"
_SEQ = _ENCODED + f""",
vec AS (SELECT *, {_VECTOR} AS vec FROM enc),
seq AS (SELECT case_id, prefix_nr, label, flatten(list(vec) {RUN_W}) AS seen FROM vec WHERE prefix_nr <= 8)"""
_PAD = """repeat('0,', 6 * (8 - prefix_nr)::INTEGER) || array_to_string(seen, ',')"""


@query(_SEQ + f"SELECT case_id, prefix_nr, CASE WHEN label = 'deviant' THEN 1 ELSE 0 END AS y, {_PAD} AS sequence FROM seq")
def sequences(spark, sf_dir):
    enc, test = _encoded_events(spark, sf_dir)
    log = enc.transform(prefixes(test, 8))
    df = E.sequences(log, [f"event__{n}" for n in enc.columns], 8)
    return df.select("case_id", PREFIX, "y", _as_text("sequence").alias("sequence"))


@query(_SEQ + f"""SELECT case_id, prefix_nr, CASE WHEN label = 'deviant' THEN 1 ELSE 0 END AS y, {_PAD} AS sequence
FROM seq WHERE prefix_nr = 3""")
def sequences_at(spark, sf_dir):
    enc, test = _encoded_events(spark, sf_dir)
    log = enc.transform(prefixes(test, 8))
    df = E.sequences_at(log, [f"event__{n}" for n in enc.columns], 8, 3)
    return df.select("case_id", PREFIX, "y", _as_text("sequence").alias("sequence"))


_ENCODED_SIDES = SPLIT + _BOTH + """, mm AS (SELECT min(value) AS lo, max(value) AS hi FROM train),
enc AS (SELECT side, case_id, event_id, prefix_nr, label, (value - lo) / (hi - lo) AS v, """ + ", ".join(
    f"CAST(event_type = '{x}' AS DOUBLE) AS event_type_{x}" for x in EVENT_LEVELS) + " FROM both_sides, mm)"
_SEQ_SIDES = _ENCODED_SIDES + f""",
longest AS (SELECT max(prefix_nr) AS m FROM lab), vec AS (SELECT *, {_VECTOR} AS vec FROM enc),
seq AS (SELECT side, case_id, prefix_nr, label, flatten(list(vec) OVER (PARTITION BY side, case_id ORDER BY prefix_nr)) AS seen FROM vec)
SELECT side, case_id, prefix_nr, CASE WHEN label = 'deviant' THEN 1 ELSE 0 END AS y,
  repeat('0,', 6 * (m - prefix_nr)::INTEGER) || array_to_string(seen, ',') AS sequence FROM seq, longest"""


def _on_both_sides(spark, sf_dir, made: Callable[[EventLog, list[str], int], DataFrame]) -> DataFrame:
    """``made`` of the encoded and numbered events of each side, their columns and the length of the longest case, with the side."""
    enc, train = _encoded_events(spark, sf_dir, 0)
    test = _encoded_events(spark, sf_dir, 1)[1]
    longest = _longest(V.labelled_events(spark, sf_dir))
    one, other = (made(enc.transform(prefixes(x)), [f"event__{n}" for n in enc.columns], longest).withColumn("side", F.lit(n))
                  for n, x in (("train", train), ("test", test)))
    return one.unionByName(other)


@query(_ENCODED_SIDES + "SELECT side, event_id, round(v, 6) AS event__value, " + ", ".join(
    f"event_type_{x} AS event__event_type_{x}" for x in EVENT_LEVELS) + " FROM enc")
def encode_events_sides(spark, sf_dir):
    return _on_both_sides(spark, sf_dir, lambda log, names, _: log.df.select("event_id", *[r6(c(n), n) for n in names]))


@query(_SEQ_SIDES)
def sequences_sides(spark, sf_dir):
    """Both sides, all prefixes up to the longest case."""
    return _on_both_sides(spark, sf_dir, lambda log, names, longest: E.sequences(log, names, longest).select(
        "case_id", PREFIX, "y", _as_text("sequence").alias("sequence")))


@query(_SEQ_SIDES + " WHERE prefix_nr = 3")
def sequences_at_sides(spark, sf_dir):
    return _on_both_sides(spark, sf_dir, lambda log, names, longest: E.sequences_at(log, names, longest, 3).select(
        "case_id", PREFIX, "y", _as_text("sequence").alias("sequence")))


@query(LAB + "SELECT event_id, CAST(1 AS BIGINT) AS bucket FROM lab")
def bucket_single(spark, sf_dir):
    return B.bucketer("single", V.EVENTS_SPEC).transform(prefixes(V.log_events(spark, sf_dir))).df.select("event_id", "bucket")


@query(LAB + "SELECT event_id, prefix_nr AS bucket FROM lab")
def bucket_length(spark, sf_dir):
    return B.bucketer("prefix", V.EVENTS_SPEC).transform(prefixes(V.log_events(spark, sf_dir))).df.select("event_id", "bucket")


@query(LAB + f""", e AS (SELECT event_id, label, {", ".join(
    f"sum(CASE WHEN event_type = '{x}' THEN 1 ELSE 0 END) {RUN_W} AS n_{x}" for x in EVENT_LEVELS)} FROM lab),
st AS (SELECT *, row_number() OVER (ORDER BY {", ".join(f"n_{x}" for x in EVENT_LEVELS)}) - 1 AS bucket
       FROM (SELECT DISTINCT {", ".join(f"n_{x}" for x in EVENT_LEVELS)} FROM e WHERE label = 'deviant'))
SELECT event_id, coalesce(bucket, -1) AS bucket FROM e LEFT JOIN st USING ({", ".join(f"n_{x}" for x in EVENT_LEVELS)})""")
def bucket_state(spark, sf_dir):
    """States of positive cases, looked up for all cases, so that some are unseen."""
    log = prefixes(V.labelled_events(spark, sf_dir))
    positive = log.with_df(log.df.where(F.col("label") == "deviant"))
    states = B.StateBucketer(E.encoder("agg", cat=["event_type"])).fit(positive)
    return states.transform(log).df.select("event_id", "bucket")


@query(EV + """SELECT case_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS variant, count(*) AS n FROM ev GROUP BY 1""")
def custom_per_case(spark, sf_dir):
    def variant(events: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"case_id": [events["case_id"].iloc[0]], "variant": [">".join(events["event_type"])],
                             "n": [len(events)]})

    return per_case(V.log_events(spark, sf_dir), variant, "case_id string, variant string, n long")


@query(EV + """, o AS (SELECT *, row_number() OVER w AS nr, row_number() OVER (PARTITION BY case_id, event_type ORDER BY ts, event_id) AS own FROM ev
  WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id)),
r AS (SELECT case_id, event_type, nr - own AS island, count(*) AS n, min(nr) AS first FROM o GROUP BY ALL)
SELECT case_id, event_type, n AS streak, first AS since FROM r QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n DESC, first) = 1""")
def custom_fold(spark, sf_dir):
    """The longest run of equal events of each case, from chunks of its events."""
    def step(state: tuple, events: pd.DataFrame) -> tuple:
        nr, last, run, best = state
        for what in events["event_type"]:
            nr, run = nr + 1, run + 1 if what == last else 1
            last = what
            if run > best[1]:
                best = (what, run, nr - run + 1)
        return nr, last, run, best

    return fold_cases(V.log_events(spark, sf_dir), lambda: (0, None, 0, (None, 0, 0)), step, lambda case, state: [(case, *state[3])],
                      "case_id string, event_type string, streak long, since long")


# ------------------------------------------------------------------ evaluation


@query(PRED + auc_sql("pred", "") + "SELECT count, round(auc, 6) AS auc, round(auc_auto, 6) AS auc_auto FROM aucs")
def auc_overall(spark, sf_dir):
    return A.auc(V.predictions(spark, sf_dir)).select("count", r6("auc", "auc"), r6("auc_auto", "auc_auto"))


@query(PRED + auc_sql("pred", 'dataset, "Method", nr_events') + """
SELECT dataset, "Method", nr_events, count, round(auc, 6) AS auc, round(auc_auto, 6) AS auc_auto FROM aucs""")
def auc_by_length(spark, sf_dir):
    pred, sized = V.scored(spark, sf_dir)
    return A.auc(pred, ["dataset", "Method", "nr_events"], hot=sized.length).select(
        "dataset", "Method", "nr_events", "count", r6("auc", "auc"), r6("auc_auto", "auc_auto"))


@query(PRED + """, long AS (SELECT * FROM pred UNION ALL SELECT dataset, "Method", case_id, -1, predicted, actual, k FROM pred)"""
       + auc_sql("long", 'dataset, "Method", nr_events') + """
SELECT dataset, "Method" AS method, 'cls' AS cls, nr_events, 'auc' AS metric, round(auc, 6) AS score FROM aucs""")
def metrics_long(spark, sf_dir):
    pred = V.predictions(spark, sf_dir).withColumnRenamed("Method", "method").withColumn("cls", F.lit("cls"))
    return A.metrics_long(pred).withColumn("score", F.round("score", 6))


@query(PRED + auc_sql("pred", 'dataset, "Method", nr_events') + """
SELECT dataset, "Method", round(sum(auc * count) / sum(count), 6) AS avg_weighted_auc, round(avg(auc), 6) AS avg_auc
FROM aucs GROUP BY 1, 2""")
def weighted_auc(spark, sf_dir):
    pred, sized = V.scored(spark, sf_dir)
    aucs = A.auc(pred, ["dataset", "Method", "nr_events"], hot=sized.length)
    return A.weighted_auc(aucs).select("dataset", "Method", r6("avg_weighted_auc", "avg_weighted_auc"), r6("avg_auc", "avg_auc"))


@query(DIFF + """SELECT dataset, "Method", case_id, nr_events, round(lag(predicted) OVER (
  PARTITION BY dataset, "Method", case_id ORDER BY nr_events), 6) AS lag_value, round(abs(d), 6) AS diff FROM dif""")
def successive_diff(spark, sf_dir):
    pred, sized = V.scored(spark, sf_dir)
    return S.successive_diff(pred, hot=sized.case).select(
        "dataset", "Method", "case_id", "nr_events", r6("lag_value", "lag_value"), r6("diff", "diff"))


@query(DIFF + 'SELECT dataset, "Method", round(1 - avg(abs(d)), 6) AS stability FROM dif GROUP BY 1, 2')
def stability_pooled(spark, sf_dir):
    pred, sized = V.scored(spark, sf_dir)
    pooled = S.stability_pooled(S.successive_diff(pred, hot=sized.case))
    return pooled.select("dataset", "Method", r6("stability", "stability"))


@query(DIFF + """SELECT dataset, "Method", case_id, round(1 - avg(abs(d)), 6) AS coef_mean_abs,
  round(median(abs(d)), 6) AS coef_median_abs, round(1 - stddev_samp(d), 6) AS coef_sd,
  round(1 - abs(quantile_cont(d, 0.9) - quantile_cont(d, 0.1)), 6) AS coef_idr FROM dif GROUP BY 1, 2, 3""")
def case_volatility(spark, sf_dir):
    pred, sized = V.scored(spark, sf_dir)
    table = S.case_volatility(pred, hot=sized.case)
    return table.select("dataset", "Method", "case_id", *[
        r6(n, n) for n in ("coef_mean_abs", "coef_median_abs", "coef_sd", "coef_idr")])


@query(DIFF + """, cs AS (SELECT dataset, "Method", case_id, 1 - avg(abs(d)) AS s FROM dif GROUP BY 1, 2, 3)
SELECT dataset, "Method", round(avg(s), 6) AS mean_mean_abs FROM cs GROUP BY 1, 2""")
def stability_mean(spark, sf_dir):
    pred, sized = V.scored(spark, sf_dir)
    return S.stability_mean(pred, hot=sized.case).select("dataset", "Method", r6("mean_mean_abs", "mean_mean_abs"))


_RUN_AUC = RUNS + auc_sql("runs", "dataset, method, cls, params, run") + """,
ra AS (SELECT dataset, method, cls, params, avg(auc) AS auc FROM aucs GROUP BY ALL)"""
_RMSPD = """,
prs AS (SELECT x.dataset, x.method, x.cls, x.params, x.run AS i, z.run AS j, avg(pow(x.predicted - z.predicted, 2)) AS m
        FROM runs x JOIN runs z ON x.case_id = z.case_id AND x.nr_events = z.nr_events AND x.dataset = z.dataset
          AND x.method = z.method AND x.cls = z.cls AND x.params = z.params AND x.run > z.run GROUP BY ALL),
rm AS (SELECT dataset, method, cls, params, sqrt(avg(m)) AS rmspd FROM prs GROUP BY ALL)"""
_CELL = "dataset, method, cls"


@query(_RUN_AUC + f"SELECT {_CELL}, params, round(auc, 6) AS auc FROM ra")
def auc_runs(spark, sf_dir):
    return A.auc_runs(V.run_predictions(spark, sf_dir), [*tune.CELL, "params"]).withColumn("auc", F.round("auc", 6))


@query(RUNS + _RMSPD + f"SELECT {_CELL}, params, round(rmspd, 6) AS rmspd FROM rm")
def rmspd(spark, sf_dir):
    table = S.rmspd(V.run_predictions(spark, sf_dir), [*tune.CELL, "params"], ["case_id", "nr_events"], runs=5)
    return table.withColumn("rmspd", F.round("rmspd", 6))


def _smooth_sql(source: str, betas: str) -> str:
    return f""", smo AS (
  SELECT n.dataset, n."Method", n.case_id, n.nr_events, any_value(n.actual) AS actual, beta,
         sum(i.predicted * CASE WHEN i.nr_events = 1 THEN pow(beta, n.nr_events - 1)
             ELSE (1 - beta) * pow(beta, n.nr_events - i.nr_events) END) AS s
  FROM {source} n JOIN {source} i ON n.case_id = i.case_id AND i.nr_events <= n.nr_events,
       (SELECT unnest({betas}) AS beta) GROUP BY ALL)"""


@query(PRED + _smooth_sql("pred", "[0.8::DOUBLE]") +
       """SELECT dataset, "Method", case_id, nr_events, round(s, 6) AS smoothed FROM smo""")
def smooth(spark, sf_dir):
    pred, sized = V.scored(spark, sf_dir)
    return S.smooth(pred, 0.8, hot=sized.case).select(
        "dataset", "Method", "case_id", "nr_events", r6("smoothed", "smoothed"))


# scores of different users differ by more than the last digits of a sum, so that no tie depends on the order of adding
_APART = ", apart AS (SELECT * REPLACE (predicted + CAST(split_part(case_id, '_', 1) AS BIGINT) * 1e-9::DOUBLE AS predicted) FROM pred)"


@query(PRED + _APART + _smooth_sql("apart", "[0.0::DOUBLE, 0.1, 0.25, 0.5, 0.75, 0.9]")
       + ", sm AS (SELECT * FROM smo)" + auc_sql("sm", 'dataset, "Method", beta, nr_events', "s") + """,
wa AS (SELECT dataset, "Method", beta, sum(auc_auto * count) / sum(count) AS avg_auc FROM aucs GROUP BY 1, 2, 3),
df AS (SELECT *, abs(s - lag(s) OVER (PARTITION BY dataset, "Method", case_id, beta ORDER BY nr_events)) AS d FROM sm),
cst AS (SELECT dataset, "Method", beta, case_id, 1 - avg(d) AS m FROM df GROUP BY 1, 2, 3, 4),
stb AS (SELECT dataset, "Method", beta, avg(m) AS mean_mean_abs FROM cst GROUP BY 1, 2, 3)
SELECT dataset, "Method", beta, round(avg_auc, 6) AS avg_auc, round(mean_mean_abs, 6) AS mean_mean_abs
FROM wa JOIN stb USING (dataset, "Method", beta)""")
def smoothing_sweep(spark, sf_dir):
    pred, sized = V.scored(spark, sf_dir)
    apart = pred.withColumn("predicted", F.col("predicted") + F.split("case_id", "_")[0].cast("long") * F.lit(1e-9))
    crowded = False if sized.length is None else None
    return S.smoothing_sweep(apart, hot=sized.case, crowded=crowded).select(
        "dataset", "Method", "beta", r6("avg_auc", "avg_auc"), r6("mean_mean_abs", "mean_mean_abs"))


@query(DIFF + """, cs AS (SELECT dataset, "Method", case_id, 1 - avg(abs(d)) AS s FROM dif GROUP BY 1, 2, 3)
SELECT dataset, round(avg(s) FILTER ("Method" = 'RF_agg'), 6) AS "RF_agg",
  round(avg(s) FILTER ("Method" = 'XGB_agg'), 6) AS "XGB_agg" FROM cs GROUP BY 1""")
def pivot_metric(spark, sf_dir):
    pred, sized = V.scored(spark, sf_dir)
    wide = A.pivot_metric(S.stability_mean(pred, hot=sized.case), "mean_mean_abs", names=["RF_agg", "XGB_agg"])
    return wide.select("dataset", r6("RF_agg", "RF_agg"), r6("XGB_agg", "XGB_agg"))


_LENGTHS = {"week1": 14, "week2": 13, "week3": 12}
_REACHED = PRED + """, sized AS (SELECT *, max(nr_events) OVER (PARTITION BY dataset, case_id) AS case_length FROM pred),
longest AS (SELECT * FROM sized WHERE """ + " AND ".join(
    f"(dataset NOT LIKE '%{k}%' OR case_length = {v})" for k, v in _LENGTHS.items()) + ")"


@query(_REACHED + """SELECT dataset, "Method", case_id, nr_events, case_length FROM longest""")
def only_max_length(spark, sf_dir):
    return filters.only_max_length(V.predictions(spark, sf_dir), _LENGTHS).select(
        "dataset", "Method", "case_id", "nr_events", "case_length")


@query(_REACHED + auc_sql("longest", 'dataset, "Method", nr_events') + """
SELECT dataset, "Method", nr_events, count, round(auc, 6) AS auc FROM aucs""")
def auc_max_length(spark, sf_dir):
    pred, sized = V.scored(spark, sf_dir)
    longest = filters.only_max_length(pred, _LENGTHS)
    return A.auc(longest, ["dataset", "Method", "nr_events"], hot=sized.length).select("dataset", "Method", "nr_events", "count", r6("auc", "auc"))


@query(DIFF + auc_sql("pred", 'dataset, "Method", nr_events') + """,
wa AS (SELECT dataset, "Method", sum(auc * count) / sum(count) AS avg_auc FROM aucs GROUP BY 1, 2),
st AS (SELECT dataset, "Method", 1 - avg(abs(d)) AS stability FROM dif GROUP BY 1, 2)
SELECT dataset, "Method", round(avg_auc, 6) AS avg_auc, round(stability, 6) AS stability
FROM wa JOIN st USING (dataset, "Method")""")
def auc_vs_stability(spark, sf_dir):
    pred, sized = V.scored(spark, sf_dir)
    aucs = A.weighted_auc(A.auc(pred, ["dataset", "Method", "nr_events"], hot=sized.length)).select(
        "dataset", "Method", r6("avg_weighted_auc", "avg_auc"))
    stable = S.stability_pooled(S.successive_diff(pred, hot=sized.case)).select("dataset", "Method", r6("stability", "stability"))
    return A.auc_vs_stability(aucs, stable, ["dataset", "Method"])


@query(SPLIT + PRED.replace(EV, "", 1).replace(",\nlab AS", ",\nlab2 AS", 1).replace("FROM lab)", "FROM lab2)", 1)
       + ", one AS (SELECT 'log_events' AS dataset, nr_events, predicted, actual FROM pred)"
       + auc_sql("one", "dataset, nr_events") + """,
len AS (SELECT case_id, count(*) AS n FROM fit GROUP BY 1),
top AS (SELECT max(c) AS top FROM (SELECT count(*) AS c FROM lab WHERE label = 'deviant' GROUP BY case_id))
SELECT dataset, nr_events, (SELECT count(*) FROM len WHERE n >= nr_events) AS case_count, count, round(auc, 6) AS auc
FROM aucs, top WHERE nr_events <= top""")
def auc_vs_train_size(spark, sf_dir):
    log = V.labelled_events(spark, sf_dir)
    counts = split.prefix_length_counts(split.assign_splits(log), split.max_pos_length(log), "log_events")
    pred = V.predictions(spark, sf_dir).withColumn("dataset", F.lit("log_events"))
    return A.auc_vs_train_size(counts, A.auc(pred, ["dataset", "nr_events"])).select(
        "dataset", "nr_events", "case_count", "count", r6("auc", "auc"))


# ------------------------------------------------------------------ choosing parameters


@query(RUNS + auc_sql("runs", f"{_CELL}, params") + f"""
SELECT {_CELL}, arg_min(params, (-round(auc, 9), params)) AS params, round(max(auc), 6) AS auc FROM aucs
WHERE auc IS NOT NULL GROUP BY {_CELL}""")
def best_by_auc(spark, sf_dir):
    return tune.best_by_auc(V.run_predictions(spark, sf_dir)).withColumn("auc", F.round("auc", 6))


@query(RUNS + auc_sql("runs", f"{_CELL}, nr_events, params") + f"""
SELECT {_CELL}, nr_events, arg_min(params, (-round(auc, 9), params)) AS params, round(max(auc), 6) AS auc
FROM aucs WHERE auc IS NOT NULL GROUP BY {_CELL}, nr_events""")
def best_by_auc_per_length(spark, sf_dir):
    best = tune.best_by_auc(V.run_predictions(spark, sf_dir), per_length=True)
    return best.withColumn("auc", F.round("auc", 6))


def _stable_sql(beta: float) -> str:
    return _RUN_AUC + _RMSPD + f""", sc AS (SELECT {_CELL}, params, auc - {beta} * rmspd AS score
  FROM ra JOIN rm USING ({_CELL}, params))
SELECT {_CELL}, arg_min(params, (-round(score, 9), params)) AS params, round(max(score), 6) AS score FROM sc
WHERE score IS NOT NULL GROUP BY {_CELL}"""


@query(_stable_sql(5))
def best_by_auc_stability(spark, sf_dir):
    return tune.best_by_auc_stability(V.run_predictions(spark, sf_dir), runs=5).withColumn("score", F.round("score", 6))


@query(_stable_sql(0))
def best_by_run_auc(spark, sf_dir):
    best = tune.best_by_auc_stability(V.run_predictions(spark, sf_dir), beta=0.0, runs=5)
    return best.withColumn("score", F.round("score", 6))


_CURVE = PRED + """, cur AS (SELECT dataset, "Method" AS params, nr_events - 1 AS epoch, avg(abs(predicted - actual)) AS val_loss
                         FROM pred GROUP BY 1, 2, 3)"""


@query(_CURVE + """SELECT dataset, arg_min(params || '_' || epoch, (round(val_loss, 9), params || '_' || epoch)) AS params,
  round(min(val_loss), 6) AS val_loss FROM cur WHERE epoch >= 5 GROUP BY 1""")
def best_by_val_loss(spark, sf_dir):
    """Learning curves made from the predictions: the prefix length stands for the epoch."""
    pred = V.predictions(spark, sf_dir)
    curves = pred.groupBy("dataset", F.col("Method").alias("params"), (F.col("nr_events") - 1).alias("epoch")).agg(
        F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("val_loss"))
    return tune.best_by_val_loss(curves, by=["dataset"]).withColumn("val_loss", F.round("val_loss", 6))


# ------------------------------------------------------------------ tables written and read back


@query(LAB + """SELECT case_id, event_id, epoch_us(ts) AS at, event_type, value, amount, label FROM lab""")
def labelled_log_file(spark, sf_dir):
    """A labelled log written as CSV and read with the types of its spec."""
    folder = shared_folder(spark, "labelled")
    log = V.labelled_events(spark, sf_dir)
    write_table(log.df, folder)
    spec = V.EVENTS_SPEC.with_(static_cat=(), static_num=())
    back = read_log(spark, folder, spec)
    return back.df.select("case_id", F.col("event_id").cast("long").alias("event_id"), micros(F.col("ts")).alias("at"),
                          "event_type", "value", "amount", "label")


@query(PRED + """SELECT dataset, "Method", case_id, nr_events, round(predicted, 6) AS predicted, actual FROM pred""")
def prediction_files(spark, sf_dir):
    """One CSV folder of predictions per method, read as one table."""
    folder = shared_folder(spark, "predictions")
    write_table(V.predictions(spark, sf_dir).drop("k"), folder, partition_by=["Method"])
    back = read_results(spark, folder)
    return back.select("dataset", "Method", "case_id", "nr_events", r6("predicted", "predicted"), "actual")


@query(ORACLES["smoothing_sweep"].removeprefix("WITH "))
def sweep_files(spark, sf_dir):
    """The sweep written per beta; beta comes back from the folder names."""
    folder = shared_folder(spark, "sweep")
    write_table(QUERIES["smoothing_sweep"](spark, sf_dir), folder, partition_by=["beta"])
    return read_tagged(spark, folder).withColumn("avg_auc", F.col("avg_auc").cast("double"))


@query(ORACLES["best_by_auc"].removeprefix("WITH ").replace(", round(max(auc), 6) AS auc FROM", " FROM"))
def parameter_table(spark, sf_dir):
    folder = shared_folder(spark, "params")
    save_params(tune.best_by_auc(V.run_predictions(spark, sf_dir)), folder)
    return spark.read.parquet(folder).select(*tune.CELL, "params")


# ------------------------------------------------------------------ streams


@query(LAB + f"""SELECT event_id, case_id, prefix_nr AS event_nr,
  epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY case_id)) AS micros_since_start,
  coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY case_id ORDER BY prefix_nr)), 0) AS micros_since_last,
  {", ".join(f"CAST(sum(CASE WHEN event_type = '{x}' THEN 1 ELSE 0 END) {RUN_W} AS BIGINT) AS event_type_{x}"
             for x in EVENT_LEVELS)} FROM lab""")
def running_features_stream(spark, sf_dir):
    """Features of running cases, from a stream over the event table that arrives out of order.

    Events are written in four quarters of arrival by a time that is up to three days off, and read about a quarter of the files a trigger: a trigger
    wakes every case that it brings, so their number must not grow with the files. Within eleven days (a quarter of the month and these three) all
    are in time, whatever the order of the files of a quarter and wherever a trigger ends.
    """
    events = V.week_cases(spark.read.parquet(f"{sf_dir}/events.parquet"))
    folder = shared_folder(spark, "arriving")
    off = F.pmod(F.xxhash64("event_id"), F.lit(3 * 86_400)) * 1_000_000
    quarter = F.least(F.greatest(F.floor((micros(F.col("ts")) + off - V.FIRST_DAY) / (8 * 86_400_000_000)), F.lit(0)), F.lit(3))
    for i in range(4):
        events.where(quarter == i).write.mode("append").parquet(folder)
    running.closing_row(events, V.EVENTS_SPEC, "11 days").write.mode("append").parquet(folder)
    files = len(spark.read.schema(events.schema).parquet(folder).inputFiles())
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(1, files // 4)).parquet(folder)
    stream = running.running_features_stream(source, V.EVENTS_SPEC, EVENT_LEVELS, "11 days")
    df = running.drain_to_table(stream, "features")
    return df.select("event_id", "case_id", "event_nr",
                     F.round(F.col("timesincecasestart") * 6e7).cast("long").alias("micros_since_start"),
                     F.round(F.col("timesincelastevent") * 6e7).cast("long").alias("micros_since_last"),
                     *[f"event_type_{x}" for x in EVENT_LEVELS])


@query(ORACLES["smooth"].removeprefix("WITH "))
def smooth_stream(spark, sf_dir):
    """Smoothing of scores as they arrive: four files, each with some positions of every case, read one at a time."""
    folder = shared_folder(spark, "arriving")
    pred = V.predictions(spark, sf_dir)
    pred.repartition(4, F.pmod(F.col("nr_events") * 7 + 3, F.lit(4))).write.parquet(folder)
    source = spark.readStream.schema(pred.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    df = running.drain_to_table(running.smooth_stream(source, 0.8), "smoothed")
    return df.select("dataset", "Method", "case_id", "nr_events", r6("smoothed", "smoothed"))


# ------------------------------------------------------------------ whole ways


@query(EV + """, kept AS (SELECT * FROM ev WHERE case_id IN (SELECT case_id FROM ev WHERE event_type IN ('signup', 'error'))),
sp AS (SELECT case_id, min(ts) AS s, max(ts) AS e FROM kept GROUP BY 1),
lv AS (SELECT event_type, count(*) AS c FROM kept GROUP BY 1),
cs AS (SELECT case_id, s, row_number() OVER (ORDER BY s, case_id) AS r, count(*) OVER () AS n FROM sp),
lim AS (SELECT min(s) AS t FROM cs WHERE r > CAST(floor(0.8 * n) AS BIGINT)),
g AS (SELECT kept.*, count(amount) OVER (PARTITION BY case_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp,
      max(k) OVER (PARTITION BY case_id) AS top, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS event_nr FROM kept),
f AS (SELECT *, max(amount) OVER (PARTITION BY case_id, grp) AS filled FROM g)
SELECT event_id, event_nr, epoch_us(ts) - epoch_us(s) AS micros_since_start,
  (SELECT count(*) FROM sp q WHERE q.s <= f.ts AND q.e > f.ts) AS open_cases, coalesce(filled, 0) AS amount,
  CASE WHEN c >= 400 THEN f.event_type ELSE 'other' END AS event_type, CASE WHEN top >= 95 THEN 'deviant' ELSE 'regular' END AS label,
  CASE WHEN r > CAST(floor(0.8 * n) AS BIGINT) THEN 'test' ELSE 'train' END AS side
FROM f JOIN lv ON lv.event_type = f.event_type JOIN cs ON cs.case_id = f.case_id, lim
WHERE r > CAST(floor(0.8 * n) AS BIGINT) OR ts < t""")
def labelled_pipeline(spark, sf_dir):
    """A raw log to labelled sides: filter, time features, open cases, forward fill, rare levels, outcome, split."""
    log = filters.keep_cases_with(V.log_events(spark, sf_dir), ["signup", "error"])
    log = timefeat.open_cases(timefeat.timestamp_features(log))
    log = clean.ffill(log, ["amount"])
    log = log.with_df(clean.collapse_rare(clean.fill_missing(log.df, ["event_type"], ["amount"]), ["event_type"], 400))
    train, test = split.split_strict(label.label_predicate(log, F.col("k") >= V.SCORE_LIMIT, cut=False), 0.8)
    both = train.df.withColumn("side", F.lit("train")).unionByName(test.df.withColumn("side", F.lit("test")))
    return both.select("event_id", "event_nr", F.round(F.col("timesincecasestart") * 6e7).cast("long").alias("micros_since_start"),
                       "open_cases", "amount", "event_type", "label", "side")


@query(EV + """, g AS (SELECT *, count(amount) OVER (PARTITION BY case_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp,
  row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS event_nr FROM ev),
f AS (SELECT *, max(amount) OVER (PARTITION BY case_id, grp) AS filled FROM g), sp AS (SELECT case_id, min(ts) AS s, max(ts) AS e FROM ev GROUP BY 1),
la AS (SELECT case_id, arg_max(event_type, (ts, event_id)) AS last FROM ev WHERE event_type IN ('purchase', 'signup', 'error') GROUP BY 1),
o AS (SELECT f.*, outcome, last FROM f JOIN la USING (case_id), (SELECT unnest(['purchase', 'signup']) AS outcome) WHERE last IN ('purchase', 'signup')),
lv AS (SELECT outcome, event_type, count(*) AS c FROM o GROUP BY 1, 2)
SELECT event_id, outcome, event_nr, epoch_us(ts) - epoch_us(s) AS micros_since_start, (SELECT count(*) FROM sp q WHERE q.s <= o.ts AND q.e > o.ts) AS open_cases,
  coalesce(filled, 0) AS amount, CASE WHEN c >= 400 THEN event_type ELSE 'other' END AS event_type, CASE WHEN last = outcome THEN 'deviant' ELSE 'regular' END AS label
FROM o JOIN lv USING (outcome, event_type) JOIN sp USING (case_id)""")
def labelled_outcomes(spark, sf_dir):
    """A raw log to a labelled copy for each outcome: forward fill, time features, open cases, last of a subset, rare levels of each copy."""
    log = timefeat.open_cases(timefeat.timestamp_features(clean.ffill(V.log_events(spark, sf_dir), ["amount"])))
    log = label.label_last_of(log, F.col("event_type").isin("purchase", "signup", "error"), ["purchase", "signup"])
    rows, out = keep(log.df, "outcomes"), None
    for outcome in ("purchase", "signup"):
        one = clean.fill_missing(rows.where(F.col("outcome") == outcome), ["event_type"], ["amount"])
        one = clean.collapse_rare(one, ["event_type"], 400)
        out = one if out is None else out.unionByName(one)
    return out.select("event_id", "outcome", "event_nr", F.round(F.col("timesincecasestart") * 6e7).cast("long").alias("micros_since_start"),
                      "open_cases", "amount", "event_type", "label")


@query(DIFF.replace("'XGB_agg'", "'XGB_idx_mul'") + auc_sql("pred", 'dataset, "Method", nr_events') + """,
wa AS (SELECT dataset, "Method", sum(auc * count) / sum(count) AS w, avg(auc) AS a FROM aucs GROUP BY 1, 2),
cs AS (SELECT dataset, "Method", case_id, 1 - avg(abs(d)) AS s FROM dif GROUP BY 1, 2, 3),
st AS (SELECT dataset, "Method", avg(s) AS m FROM cs GROUP BY 1, 2)
SELECT dataset, "Method", round(w, 6) AS avg_weighted_auc, round(a, 6) AS avg_auc, round(m, 6) AS mean_mean_abs FROM wa LEFT JOIN st USING (dataset, "Method")""")
def prediction_report(spark, sf_dir):
    """Calibrated predictions of two methods, under report names."""
    pred = V.predictions(spark, sf_dir)
    pred = pred.withColumnRenamed("Method", "which")
    first = F.col("which") == "RF_agg"
    raw = pred.withColumn("cls", F.when(first, "rf_calibrated").otherwise("xgboost_calibrated")).withColumn(
        "method", F.when(first, "single_agg").otherwise("prefix_index")).drop("which")
    return report(raw).select("dataset", "Method", r6("avg_weighted_auc", "avg_weighted_auc"), r6("avg_auc", "avg_auc"), r6("mean_mean_abs", "mean_mean_abs"))


# ------------------------------------------------------------------ models

# The models of these queries are small (5 or 10 trees, 20 epochs, two parameter sets, two runs) where a study fits 500 trees, 16
# sets and 5 runs: a query shows the way from a log to scores, and a larger model takes longer on the same way. All rows are used.
_SMALL = {"rf": {"n_estimators": 10, "max_features": 0.5, "max_depth": 5},
          "xgboost": {"n_estimators": 5, "learning_rate": 0.1, "subsample": 0.8, "max_depth": 3, "colsample_bytree": 0.8,
                      "min_child_weight": 1},
          "gbm": {"n_estimators": 5, "learning_rate": 0.1, "max_features": 0.5},
          "dt": {"max_depth": 5}, "logit": {"C": 2}, "svm": {"C": 1, "gamma": -3}}
# what a model may see: not k, which decides the outcome
_MODEL_SPEC = V.EVENTS_SPEC.with_(dynamic_num=("value", "hour", "timesincelastevent"), static_cat=(), static_num=())


def _model_log(spark, sf_dir) -> EventLog:
    log = V.labelled_events(spark, sf_dir)
    log = timefeat.time_since_last(log.with_df(timefeat.calendar_features(log.df, "ts")))
    return EventLog(log.df, _MODEL_SPEC, log.hot, log.cases)


def _model_query(cls: str, method: str = "single_agg") -> None:
    def run(spark, sf_dir):
        params = _SMALL[cls.removesuffix("_calibrated")]
        pred = final_predictions(_model_log(spark, sf_dir), method, cls, params, n_estimators=None, threads=4)
        return pred.withColumn("predicted", F.round("predicted", 9))

    run.__name__ = f"predict_{cls}" if method == "single_agg" else f"predict_{cls}_{method}"
    query()(run)


for _cls in ("rf", "xgboost", "gbm", "dt", "logit", "svm", "rf_calibrated"):
    _model_query(_cls)
_model_query("logit", "state_laststate")
_model_query("logit", "cluster_agg")
_model_query("dt", "prefix_index")


@query()
def bucket_cluster(spark, sf_dir):
    log = prefixes(V.log_events(spark, sf_dir))
    groups = B.bucketer("cluster", V.EVENTS_SPEC, k=4).fit(log)
    return groups.transform(log).df.select("event_id", "bucket")


@query()
def predict_sequence(spark, sf_dir):
    params = {"lstmsize": 8, "n_layers": 1, "nb_epoch": 20}
    return final_predictions(_model_log(spark, sf_dir), "lstm", "sequence_calibrated", params)


@query()
def learning_curve(spark, sf_dir):
    log = _model_log(spark, sf_dir)
    train, val, _ = splits(log)
    data = encode_splits(train, {"val": val}, "single_agg", split.max_prefix_length(log))
    return models.learning_curve(_SMALL["xgboost"], data.bucket("train", 1), data.bucket("val", 1), params_text="small")


@query()
def tuning_runs(spark, sf_dir):
    """Two parameter sets, two runs each, on the validation cases; the better one by AUC and stability."""
    pred = tuning_predictions(_model_log(spark, sf_dir), "single_agg", "rf", ["5_0.3", "5_0.9"], n_runs=2)
    return tune.best_by_auc_stability(pred, runs=2)


@query()
def stability_report(spark, sf_dir):
    """Log to splits, forest, calibration, smoothing sweep: AUC and stability per smoothing weight."""
    pred = final_predictions(_model_log(spark, sf_dir), "single_agg", "rf_calibrated", _SMALL["rf"], n_estimators=None)
    return evaluate(pred)


# ------------------------------------------------------------------ what SQL can say of models


_CAP = """, plen AS (SELECT count(*) AS n FROM lab WHERE label = 'deviant' GROUP BY case_id),
cap AS (SELECT least(40, CAST(ceil(quantile_cont(n, 0.9)) AS BIGINT)) AS cap FROM plen)"""
_ROWS_SQL = SPLIT + _CAP + """ SELECT CAST(prefix_nr AS INTEGER) AS nr_events, count(*) AS n_rows,
  CAST(sum(CASE WHEN label = 'deviant' THEN 1 ELSE 0 END) AS BIGINT) AS positives, true AS valid, true AS better
FROM test, cap WHERE prefix_nr <= cap GROUP BY 1"""
# k decides the outcome, so a model that sees it must do better than chance
_SEEING_SPEC = V.EVENTS_SPEC.with_(dynamic_num=("k",), static_cat=(), static_num=())


def _seeing_log(spark, sf_dir) -> EventLog:
    log = V.labelled_events(spark, sf_dir)
    return EventLog(log.df, _SEEING_SPEC, log.hot, log.cases)


def _shown(pred: DataFrame, by: tuple[str, ...] = ("nr_events",), margin: bool = False) -> DataFrame:
    """Rows and positives of each prefix length; whether all scores are valid, and better than chance over all rows."""
    score = F.col("predicted")
    valid = score.isNotNull() & ~F.isnan(score) & (F.lit(True) if margin else score.between(0, 1))
    better = A.auc(pred).select((F.col("auc") > 0.5).alias("better"))
    rows = pred.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("actual").cast("long")).alias("positives"), F.every(valid).alias("valid"))
    return rows.crossJoin(F.broadcast(better))  # one row


def _rows_query(cls: str, method: str = "single_agg") -> None:
    def run(spark, sf_dir):
        pred = final_predictions(_seeing_log(spark, sf_dir), method, cls, _SMALL[cls.removesuffix("_calibrated")], n_estimators=None, threads=4)
        return _shown(pred, margin=cls == "svm")

    run.__name__ = f"rows_{cls}" if method == "single_agg" else f"rows_{cls}_{method}"
    query(_ROWS_SQL.removeprefix("WITH "))(run)


for _cls in ("rf", "xgboost", "gbm", "dt", "logit", "svm", "rf_calibrated"):
    _rows_query(_cls)
_rows_query("dt", "prefix_agg")
_rows_query("dt", "state_agg")


@query(SPLIT + _CAP + """ SELECT params, run, CAST(prefix_nr AS INTEGER) AS nr_events, count(*) AS n_rows,
  CAST(sum(CASE WHEN label = 'deviant' THEN 1 ELSE 0 END) AS BIGINT) AS positives, true AS valid, true AS better
FROM val, cap, (SELECT unnest(['5_0.3', '5_0.9']) AS params), (SELECT CAST(unnest(range(2)) AS INTEGER) AS run)
WHERE prefix_nr <= cap GROUP BY 1, 2, 3""")
def rows_tuning(spark, sf_dir):
    """Every parameter set and run scores all validation prefixes."""
    return _shown(tuning_predictions(_seeing_log(spark, sf_dir), "single_agg", "rf", ["5_0.3", "5_0.9"], n_runs=2), ("params", "run", "nr_events"))


_GRID = {"logit": [str(i) for i in range(-8, 8)],
         "xgboost": [f"4_{rate}_{rows}_{depth}_{columns}_1" for rate in (0.1, 0.3) for rows in (0.7, 1.0) for depth in (2, 3) for columns in (0.6, 1.0)]}


def _grid_query(cls: str, method: str) -> None:
    @query(SPLIT + _CAP + f""" SELECT params, run, CAST(prefix_nr AS INTEGER) AS nr_events, count(*) AS n_rows,
  CAST(sum(CASE WHEN label = 'deviant' THEN 1 ELSE 0 END) AS BIGINT) AS positives, true AS valid, true AS better
FROM val, cap, (SELECT unnest({_GRID[cls]}) AS params), (SELECT CAST(unnest(range(5)) AS INTEGER) AS run)
WHERE prefix_nr <= cap GROUP BY 1, 2, 3""")
    def run(spark, sf_dir):
        """Sixteen parameter sets, five runs and all buckets, fitted in the jobs of one model, score all validation prefixes."""
        return _shown(tuning_predictions(_seeing_log(spark, sf_dir), method, cls, _GRID[cls], n_runs=5), ("params", "run", "nr_events"))

    QUERIES[f"rows_grid_{cls}"], ORACLES[f"rows_grid_{cls}"] = QUERIES.pop("run"), ORACLES.pop("run")


_grid_query("logit", "prefix_agg")
_grid_query("xgboost", "state_agg")


@query(SPLIT + _CAP + """, t AS (SELECT coalesce(k, 0)::DOUBLE AS k, event_type, CASE WHEN label = 'deviant' THEN 1 ELSE 0 END AS y FROM fit, cap WHERE prefix_nr <= cap),
v AS (SELECT 'k' AS f, k AS x, sum(0.5 - y) AS g, count(*) * 0.25 AS h FROM t GROUP BY ALL
  UNION ALL SELECT e, CASE WHEN event_type = e THEN 1 ELSE 0 END, sum(0.5 - y), count(*) * 0.25 FROM t, (SELECT DISTINCT event_type AS e FROM t) GROUP BY ALL),
s AS (SELECT f, x, lead(x) OVER w AS next, sum(g) OVER (w ROWS UNBOUNDED PRECEDING) AS gl, sum(h) OVER (w ROWS UNBOUNDED PRECEDING) AS hl,
  sum(g) OVER (PARTITION BY f) AS ga, sum(h) OVER (PARTITION BY f) AS ha FROM v WINDOW w AS (PARTITION BY f ORDER BY x)),
b AS (SELECT *, gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) AS gain FROM s
  WHERE next IS NOT NULL AND hl >= 1 AND ha - hl >= 1 ORDER BY gain DESC LIMIT 1)
SELECT 'left' AS side, (x + next)::DOUBLE / 2 AS threshold, round(-gl::DOUBLE / (hl + 1), 9) AS weight FROM b
UNION ALL SELECT 'right', (x + next)::DOUBLE / 2, round(-(ga - gl)::DOUBLE / (ha - hl + 1), 9) FROM b""")
def boosted_stump(spark, sf_dir):
    """The first tree of depth one: the cut with the most gain, and leaves of -G / (H + lambda)."""
    log = _seeing_log(spark, sf_dir)
    train, val, _ = splits(log)
    data = encode_splits(train, {"val": val}, "single_laststate", split.max_prefix_length(log))
    nodes = fit_boosted(data.sides["train"], [("one", {"n_estimators": 1, "learning_rate": 1.0, "max_depth": 1})]).table(spark)
    root = nodes.where("node = 0").select("threshold", F.explode(F.create_map(F.lit("left"), "left", F.lit("right"), "right")).alias("side", "node"))
    return root.join(nodes.select("node", "weight"), "node").select("side", "threshold", F.round("weight", 9).alias("weight"))


def _trained(spark, sf_dir, cls: str, params: dict, min_cases: int = 1):
    log = _seeing_log(spark, sf_dir)
    train, val, _ = splits(log)
    data = encode_splits(train, {"val": val}, "single_agg", split.max_prefix_length(log))
    return models.GuardedClassifier(cls, params, min_cases=min_cases).fit(data.bucket("train", 1)), data


@query(SPLIT + _CAP + """ SELECT round(avg(CASE WHEN label = 'deviant' THEN 1.0::DOUBLE ELSE 0.0 END), 3) AS mean_score
FROM fit, cap WHERE prefix_nr <= cap""")
def logit_mean_score(spark, sf_dir):
    """The intercept has no penalty, so scores average to the outcomes of the training prefixes."""
    model, data = _trained(spark, sf_dir, "logit", {"C": 2})
    return model.score(data.bucket("train", 1)).agg(F.round(F.avg("predicted"), 3).alias("mean_score"))


@query(SPLIT + _CAP + """ SELECT round(avg(CASE WHEN label = 'deviant' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS mean_score
FROM fit, cap WHERE prefix_nr <= cap""")
def tree_mean_score(spark, sf_dir):
    """A leaf's score is the average outcome of its training prefixes, so all scores average to that of all prefixes."""
    model, data = _trained(spark, sf_dir, "dt", {})
    return model.score(data.bucket("train", 1)).agg(F.round(F.avg("predicted"), 6).alias("mean_score"))


@query(SPLIT + _CAP + """, n AS (SELECT sum(CASE WHEN label = 'deviant' THEN 1 ELSE 0 END)::DOUBLE AS p, count(*)::DOUBLE AS n
  FROM val, cap WHERE prefix_nr <= cap) SELECT round((p * (p + 1) / (p + 2) + (n - p) / (n - p + 2)) / n, 3) AS mean_score FROM n""")
def platt_mean_score(spark, sf_dir):
    """Calibrated scores average to the smoothed targets of the rows they were calibrated on."""
    model, data = _trained(spark, sf_dir, "dt", {"max_depth": 3})
    scored = model.score(data.bucket("val", 1))
    return models.Platt().fit(scored).transform(scored).agg(F.round(F.avg("predicted"), 3).alias("mean_score"))


@query(SPLIT + _CAP + """, t AS (SELECT label, prefix_nr FROM fit, cap WHERE prefix_nr <= cap)
SELECT 'few' AS kind, round(avg(CASE WHEN label = 'deviant' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS predicted FROM t
UNION ALL SELECT 'one class', 1.0 UNION ALL SELECT 'none', 0.25""")
def guard_constants(spark, sf_dir):
    """Too few rows give their mean, one class gives that class, no rows the fallback."""
    _, data = _trained(spark, sf_dir, "dt", {"max_depth": 1})
    rows = data.bucket("train", 1)
    kinds = {"few": (rows, 1_000_000_000), "one class": (rows.where("y = 1"), 1), "none": (rows.where("y > 1"), 1)}
    out = None
    for kind, (some, least) in kinds.items():
        guard = models.GuardedClassifier("dt", {}, min_cases=least, fallback=0.25).fit(some)
        one = guard.score(rows.limit(1)).select(F.lit(kind).alias("kind"), r6("predicted", "predicted"))
        out = one if out is None else out.unionByName(one)
    return out


@query(LAB + "SELECT event_id, true AS nearest FROM lab")
def cluster_nearest(spark, sf_dir):
    """Each prefix is in the bucket whose centre is nearest."""
    log = prefixes(V.log_events(spark, sf_dir))
    groups = B.bucketer("cluster", V.EVENTS_SPEC, k=4).fit(log)
    extended, names = groups.encoder.extend(groups.transform(log), "__point_")
    gaps = F.array(*[sum(((c(n) - float(x)) * (c(n) - float(x)) for n, x in zip(names, centre)), F.lit(0.0))
                     for centre in groups.model.clusterCenters()])
    own = F.element_at(gaps, (F.col("bucket") + 1).cast("int"))
    return extended.df.select("event_id", (own <= F.array_min(gaps) + 1e-9).alias("nearest"))


_LSTM = ["8_0.1_1_16_adam_0.01_6", "4_0.1_1_16_adam_0.01_6"]


@query(SPLIT + _CAP + f""" SELECT params, epoch, (SELECT count(*) FROM fit, cap WHERE prefix_nr <= cap) AS train_rows,
  (SELECT count(*) FROM val, cap WHERE prefix_nr <= cap) AS val_rows, true AS falls
FROM (SELECT unnest({_LSTM}) AS params), (SELECT CAST(unnest(range(6)) AS INTEGER) AS epoch)""")
def sequence_tuning(spark, sf_dir):
    """Losses of the sequence classifier after each epoch: over all training and validation prefixes, and the first falls."""
    curves = tuning_predictions(_seeing_log(spark, sf_dir), "lstm", "lstm", _LSTM)
    before = F.lag("train_loss").over(Window.partitionBy("params").orderBy("epoch"))  # a row for each set and epoch
    return curves.select("params", "epoch", "train_rows", "val_rows", F.coalesce(F.col("train_loss") <= before + 1e-9, F.lit(True)).alias("falls"))


@query(SPLIT + _CAP + """ SELECT CAST(prefix_nr AS INTEGER) AS nr_events, count(*) AS n_rows,
  CAST(sum(CASE WHEN label = 'deviant' THEN 1 ELSE 0 END) AS BIGINT) AS positives, true AS valid, true AS better
FROM test, cap WHERE prefix_nr <= cap GROUP BY 1""")
def rows_sequence(spark, sf_dir):
    """Sequence tuning to the final model: curves, best parameters and epoch, predictions of the test cases."""
    log = _seeing_log(spark, sf_dir)
    best = tune.best_by_val_loss(tuning_predictions(log, "lstm", "lstm", _LSTM, standardize=True), min_epoch=2).first()["params"]
    params = {**P.params_from_text(best.rpartition("_")[0], "lstm"), "nb_epoch": 1 + int(best.rpartition("_")[2]), "standardize": True}
    return _shown(final_predictions(log, "lstm", "sequence_calibrated", params))


@query(LABY + """, d AS (SELECT unnest([0.37::DOUBLE, 0.83]) AS decay)
SELECT p.case_id, p.prefix_nr, decay, round(sum(pow(decay, p.prefix_nr - e.prefix_nr) * coalesce(e.amount, 0)) + 1.234567e-8, 6) AS amount,
  round(sum(pow(decay, p.prefix_nr - e.prefix_nr) * CASE WHEN e.event_type = 'click' THEN 1 ELSE 0 END) + 1.234567e-8, 6) AS clicks
FROM laby p JOIN laby e ON p.case_id = e.case_id AND e.prefix_nr <= p.prefix_nr, d GROUP BY ALL""")
def recurrent_states(spark, sf_dir):
    """Linear recurrences of two columns with two decays, for every prefix; pushed off the border of rounding."""
    log = prefixes(V.labelled_events(spark, sf_dir))
    log = log.with_df(log.df.withColumn("clicks", (F.col("event_type") == "click").cast("int")))
    df = R.states(log, ["amount", "clicks"], (0.37, 0.83)).df
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("decay"), c(f"amount~{a}").alias("amount"), c(f"clicks~{a}").alias("clicks")) for a in (0.37, 0.83)]))
    return df.select("case_id", PREFIX, rows.alias("x")).select("case_id", PREFIX, "x.decay", *[r6(F.col(f"x.{n}") + 1.234567e-8, n) for n in ("amount", "clicks")])


@query("t AS (SELECT count(*) AS n FROM events) SELECT CAST(unnest(range(5)) AS INTEGER) AS epoch, true AS falls, true AS better FROM t")
def learning_rounds(spark, sf_dir):
    """Each round of boosting lowers the training loss, and the validation AUC is better than chance."""
    log = _seeing_log(spark, sf_dir)
    train, val, _ = splits(log)
    data = encode_splits(train, {"val": val}, "single_agg", split.max_prefix_length(log))
    params = {**_SMALL["xgboost"], "subsample": 1.0, "colsample_bytree": 1.0}
    curve = models.learning_curve(params, data.bucket("train", 1), data.bucket("val", 1))
    before = F.lag("train_loss").over(Window.orderBy("epoch"))  # one row a round
    return curve.select("epoch", F.coalesce(F.col("train_loss") <= before, F.lit(True)).alias("falls"), (F.col("val_auc") > 0.5).alias("better"))

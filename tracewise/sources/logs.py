"""Readers and writers of event logs, predictions and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.eventlog import EventLog
from tracewise.functions.columns import c
from tracewise.spec import LogSpec

SEQ = "seq"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# Types of the columns of prediction and metric files; other columns stay text.
RESULT_TYPES = {"nr_events": "int", "predicted": "double", "actual": "int", "run": "int", "score": "double",
                "epoch": "int", "train_loss": "double", "val_loss": "double", "val_auc": "double",
                "count": "bigint", "auc": "double", "stability": "double", "case_count": "bigint",
                "mean_mean_abs": "double", "beta": "double"}


def read_log(spark: SparkSession, path: str, spec: LogSpec, timestamp_format: str | None = None) -> EventLog:
    """A labelled log in ``;``-separated CSV, with the types its spec declares.

    The declared columns are matched by header name, so files may hold more columns or another order.
    """
    raw = spark.read.option("sep", ";").option("header", True).csv(path)
    types = {f.name: f.dataType for f in spec.schema().fields}
    absent = [n for n in types if n not in raw.columns]
    if absent:
        raise ValueError(f"{path} lacks the columns {absent} of {spec.name}")
    typed = raw.select(*[_parse_time(c(n), timestamp_format).alias(n) if n == spec.timestamp
                         else c(n).cast(types.get(n, "string")).alias(n) for n in raw.columns])
    return EventLog.of(_with_seq(typed), spec.with_(tie=spec.tie or (SEQ,)))


def read_raw_log(spark: SparkSession, path: str, ts_cols: list[str], schema=None,
                 timestamp_format: str | None = None) -> DataFrame:
    """A raw log; types are inferred unless a schema is given. Parquet keeps its own types."""
    if path.rstrip("/").endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        reader = spark.read.option("sep", ";").option("header", True)
        raw = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    present = dict(raw.dtypes)
    parsed = {n: _parse_time(c(n), timestamp_format) for n in ts_cols if not present[n].startswith("timestamp")}
    return _with_seq(raw.withColumns(parsed) if parsed else raw)


def _parse_time(text, fmt):
    return F.to_timestamp_ntz(text, F.lit(fmt)) if fmt else F.to_timestamp_ntz(text)


def _with_seq(df: DataFrame) -> DataFrame:
    # file order: rises within a file split and from split to split
    return df if SEQ in df.columns else df.withColumn(SEQ, F.monotonically_increasing_id())


def read_results(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Many result files (a glob, a folder or a list) as one table; ``None`` is null."""
    raw = spark.read.option("sep", ";").option("header", True).option("nullValue", "None").csv(path)
    return _typed(raw)


def read_tagged(spark: SparkSession, path: str | list[str], pattern: str = r"_([0-9.]+)\.csv$",
                name: str = "beta") -> DataFrame:
    """Result files whose names carry a number, which becomes a column.

    Tables written by ``write_table(..., partition_by=[name])`` need no pattern: partition discovery
    finds the column.
    """
    raw = spark.read.option("sep", ";").option("header", True).option("nullValue", "None").csv(path)
    if name in raw.columns:
        return _typed(raw)
    return _typed(raw.withColumn(name, F.regexp_extract(F.col("_metadata.file_name"), pattern, 1)))


def _typed(raw: DataFrame) -> DataFrame:
    casts = {n: c(n).cast(t) for n, t in RESULT_TYPES.items() if n in raw.columns}
    return raw.withColumns(casts) if casts else raw


def write_table(df: DataFrame, path: str, fmt: str = "csv", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    writer = df.drop(*[n for n in df.columns if n.startswith("__hot:")]).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        (writer.option("sep", ";").option("header", True).option("timestampFormat", TIME_FORMAT)
         .option("timestampNTZFormat", TIME_FORMAT).csv(path))
    else:
        writer.format(fmt).save(path)

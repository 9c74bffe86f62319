"""Session settings shared by the command line, the tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Largest number of rows of one group (case, metric group, ...) that a single task may hold.
HOT_ROWS_KEY = "spark.tracewise.hotRows"
HOT_ROWS_DEFAULT = 2_000_000
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "tracewise", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_KEY, str(HOT_ROWS_DEFAULT)))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only in local mode and where none is named."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tracewise-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name next to the checkpoints, where every executor can write."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it from there.

    Cuts the lineage: what is read does not change when an executor is lost, and is computed once. With ``clean`` the shuffle files of the job
    that writes it are deleted when it ends, which is for large tables that nothing but the written one is used of.
    """
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, name)
    before = spark.conf.get(CLEANUP_KEY, None)
    if clean:
        spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.parquet(folder)
    finally:
        if clean:
            spark.conf.unset(CLEANUP_KEY) if before is None else spark.conf.set(CLEANUP_KEY, before)
    return spark.read.schema(df.schema).parquet(folder)


def forget(df: DataFrame) -> None:
    """Delete a table that ``keep`` wrote, once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

"""Bucketers: which prefixes share a model."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.eventlog import EventLog
from tracewise.functions.columns import c, cs
from tracewise.operators.encode import Encoder, assemble, encoder
from tracewise.operators.prefix import PREFIX
from tracewise.operators.scan import position, scan_all

BUCKET = "bucket"


class SingleBucketer:
    """All prefixes in bucket 1."""

    def fit(self, log: EventLog) -> SingleBucketer:
        return self

    def transform(self, log: EventLog) -> EventLog:
        return log.with_df(log.df.withColumn(BUCKET, F.lit(1).cast("long")))


class LengthBucketer(SingleBucketer):
    """One bucket per prefix length."""

    def transform(self, log: EventLog) -> EventLog:
        return log.with_df(log.df.withColumn(BUCKET, c(PREFIX).cast("long")))


class StateBucketer:
    """One bucket per distinct encoded training prefix, numbered in sorted order; an unseen one is -1."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.states: DataFrame | None = None

    def fit(self, log: EventLog) -> StateBucketer:
        encoded = self.encoder.fit_transform(log)
        names = self.encoder.columns
        # ranks follow from the states alone, so it does no harm if they are computed anew
        distinct = encoded.select(*cs(names)).distinct()
        ranked = scan_all(distinct, names, [position("__rank")])
        self.states = ranked.select(*cs(names), (F.col("__rank") - 1).alias(BUCKET))
        return self

    def transform(self, log: EventLog) -> EventLog:
        own = log.df.columns
        extended, names = self.encoder.extend(log, "__state_")
        states = self.states.toDF(*names, BUCKET)
        # no broadcast hint: the number of states grows with the data
        found = extended.df.join(states, names, "left")
        return log.with_df(found.select(*cs(own), F.coalesce(BUCKET, F.lit(-1).cast("long")).alias(BUCKET)))


class ClusterBucketer:
    """k-means over the encoded control flow."""

    def __init__(self, encoder: Encoder, k: int, seed: int = 22):
        self.encoder, self.k, self.seed = encoder, k, seed
        self.model = None

    def fit(self, log: EventLog) -> ClusterBucketer:
        points = assemble(self.encoder.fit_transform(log), self.encoder.columns)
        self.model = KMeans(k=self.k, seed=self.seed, featuresCol="features", predictionCol="__cluster").fit(points)
        return self

    def transform(self, log: EventLog) -> EventLog:
        own = log.df.columns
        extended, names = self.encoder.extend(log, "__point_")
        found = self.model.transform(assemble(extended.df, names))
        return log.with_df(found.select(*cs(own), F.col("__cluster").cast("long").alias(BUCKET)))


def bucketer(method: str, log_spec, k: int = 2, seed: int = 22):
    """A bucketer by name, over the activity column only."""
    if method == "single":
        return SingleBucketer()
    if method == "prefix":
        return LengthBucketer()
    if method == "state":
        return StateBucketer(encoder("last", cat=[log_spec.activity]))
    if method == "cluster":
        return ClusterBucketer(encoder("agg", cat=[log_spec.activity]), k, seed)
    raise KeyError(f"unknown bucketer {method!r}; known: single, prefix, state, cluster")

"""A bounded sample of labelled documents, from which the corpus classifiers learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(column: str, divisor: int) -> Column:
    """crc32 of an id as text, modulo ``divisor``; that of the empty text for null."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, learn: Column | None = None) -> DataFrame:
    """(doc_id, y, text) of at most ``per_class`` documents of each label, the first by a hash of their id.

    ``learn`` (over ``doc_id``) says which labels may be seen at all. A document with contradicting labels, or one
    whose id comes more than once, isn't used. The ids are at most 2 x ``per_class``, so they can be broadcast.
    """
    seen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if learn is not None:
        seen = seen.where(learn)
    seen = seen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("y"), F.max(label).alias("z"))
    seen = seen.where("y = z").select("doc_id", F.col("y").cast("int").alias("y"), F.xxhash64("doc_id").alias("h"))
    ids = None
    for y in (0, 1):
        part = seen.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class)
        ids = part if ids is None else ids.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    found = texts.join(F.broadcast(ids.select("doc_id", "y")), "doc_id")
    once = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("y").alias("y"), F.max("text").alias("text"))
    return once.where("n = 1").select("doc_id", "y", "text")

"""Mixing sources to target weights, by DataFrame functions only.

Targets share all words among the sources by weight, and stop at three times what a source has; the excess goes to the
others by weight. Each source then takes all its documents a whole number of times, and for the rest of its target a part of them
once more: those whose hash lies below a threshold of their source. The threshold comes from histograms. Words are
summed by source and the leading twelve bits of the hash; the bucket in which the running sum passes the budget is the
boundary, and only its documents are counted again by the next twelve bits, until the boundary is a single hash.
Thresholds for smaller budgets lie below those for larger ones, so a smaller mix is part of a larger one. Nothing is
sorted but the buckets of a source, 4,096 at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.llm.words import WORD_RE, text_key
from tracewise.session import keep

WEIGHTS = (5, 2, 1)
CAP = 3
BITS, LEVELS = 12, 5  # the hash has 60 bits
SMALL = 100_000  # sources up to which their table is broadcast (some 10 MB)
SALTS = 32


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def _key(source: str) -> Column:
    """A source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def _parts(docs: DataFrame) -> DataFrame:
    """(key, h, size) of each row."""
    return docs.select(_key("source").alias("key"), text_key("doc_id", "text").alias("h"), size_of(F.col("text")).alias("size"))


def targets(parts: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(key, source_size, target) of each source.

    Sources by code point take the weights in turn, null last. Poured like water: sources in the order in which they
    reach their cap; the level is that of the first which stays below its own. One row a source goes through one task here.
    """
    sizes = parts.groupBy("key").agg(F.sum("size").alias("s"))
    order = Window.orderBy(F.col("key") == "null", "key")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = reduce(lambda c, i: c.when(turn == i, F.lit(weights[i])), range(1, len(weights)), F.when(turn == 0, F.lit(weights[0])))
    sizes = sizes.withColumn("w", weight.cast("long"))
    by_cap = Window.orderBy(F.col("s") / F.col("w"), "key")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    poured = sizes.select(
        "key", "s", "w", (F.sum("s").over(whole) - cap * F.coalesce(F.sum("s").over(before), F.lit(0))).alias("left"),
        F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)).alias("ws"),
        F.row_number().over(by_cap).alias("nr"))
    open_ = poured.where(F.col("left") * F.col("w") <= cap * F.col("s") * F.col("ws")).orderBy("nr").limit(1).select(
        F.col("left").alias("level"), F.col("ws").alias("open_w"))
    share = (F.col("w") * F.col("level")).cast("double") / F.col("open_w")
    return sizes.crossJoin(F.broadcast(open_)).select(  # one row
        "key", F.col("s").alias("source_size"), F.least(share, (cap * F.col("s")).cast("double")).alias("target"))


def _with(rows: DataFrame, state: DataFrame, n_sources: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their source: broadcast up to a checked number of sources, else a salted join."""
    if n_sources <= SMALL:
        return rows.join(F.broadcast(state), "key", how)
    salted = state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", (F.col("h") % SALTS).cast("int")).join(salted, ["key", "salt"], how).drop("salt")


def thresholds(parts: DataFrame, state: DataFrame, n_sources: int) -> DataFrame:
    """(key, cut): rows of a source with a hash below ``cut`` hold about ``rest`` words.

    ``state`` has (key, rest). A boundary of a single hash is taken if that comes nearer to ``rest``.
    """
    now = state.select("key", "rest", F.lit(0).cast("long").alias("got"))
    rows, found = parts, None
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        bucket = F.shiftright("h", shift)
        counted = rows.groupBy("key", bucket.alias("b")).agg(F.sum("size").alias("t"), F.min("h").alias("low"), F.max("h").alias("high"))
        run = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("before", F.coalesce(F.sum("t").over(run), F.lit(0))).join(now, "key")
        over = F.col("got") + F.col("before")
        edge = keep(counted.where((over <= F.col("rest")) & (over + F.col("t") > F.col("rest"))).select(
            "key", "rest", over.alias("got"), "b", "t", "low", "high"), "boundary")
        nearer = (F.col("got") + F.col("t") - F.col("rest")) < (F.col("rest") - F.col("got"))
        single = edge.where("low = high").select("key", F.when(nearer, F.col("low") + 1).otherwise(F.col("low")).alias("cut"))
        found = single if found is None else found.union(single)
        if level == LEVELS or edge.where("low < high").limit(1).count() == 0:
            return found
        now = edge.where("low < high").select("key", "rest", "got", "b")
        rows = keep(_with(rows, now.select("key", "b"), n_sources).where(bucket == F.col("b")).select("key", "h", "size"), "boundary-rows")
        now = now.drop("b")
    return found


def _plan(docs: DataFrame, weights: tuple[int, ...], cap: int) -> tuple[DataFrame, int]:
    """(key, source_size, target, whole, cut) of each source, and their number."""
    parts = keep(_parts(docs), "sizes")
    state = keep(targets(parts, weights, cap), "targets")
    n = state.count()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = state.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    cuts = thresholds(parts, state.where("rest > 0"), n)
    return keep(state.join(cuts, "key", "left").select("key", "source_size", "target", "whole", F.coalesce("cut", F.lit(0)).alias("cut")), "mix"), n


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row of ``docs`` (doc_id, text, source, any more columns).

    Whole documents are taken: ``taken`` is a multiple of ``size``, ``cap`` times at most. A null text has no words. Null is a source
    of its own. Rows that repeat an id and its text share a hash and are taken together. An empty table gives no rows.
    """
    state, n = _plan(docs, weights, cap)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key("source").alias("key"), text_key("doc_id", "text").alias("h"),
                       size_of(F.col("text")).alias("size"))
    times = F.col("whole") + (F.col("h") < F.col("cut")).cast("long")
    return _with(rows, state, n).select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` with how often the mix takes each row (``copies``); rows that it doesn't take are left out."""
    state, n = _plan(docs, weights, cap)
    names = [F.col(c) for c in docs.columns if c != "copies"]
    own = F.struct(*names).alias("row")
    rows = docs.select(own, _key("source").alias("key"), text_key("doc_id", "text").alias("h"))
    times = F.col("whole") + (F.col("h") < F.col("cut")).cast("long")
    return _with(rows, state, n).withColumn("copies", times).where("copies > 0").select("row.*", "copies")


SQL = f"""WITH d AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS key,
  coalesce(len(regexp_extract_all(text, '{WORD_RE}')), 0) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT key, source IS NULL AS last, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY key, source IS NULL),
w AS (SELECT key, s, CASE (row_number() OVER (ORDER BY last, key) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
p AS (SELECT key, s, w, (SELECT sum(s) FROM w) - 3 * coalesce(sum(s) OVER (ORDER BY s / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
  sum(w) OVER (ORDER BY s / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws, row_number() OVER (ORDER BY s / w, key) AS nr FROM w),
o AS (SELECT l, ws FROM p WHERE l * w <= 3 * s * ws ORDER BY nr LIMIT 1),
t AS (SELECT key, w.s AS source_size, least(CAST(CAST(w.w * o.l AS BIGINT) AS DOUBLE) / CAST(o.ws AS BIGINT), CAST(3 * w.s AS DOUBLE)) AS target FROM w, o),
q AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM t),
c AS (SELECT key, h, size, sum(size) OVER (PARTITION BY key ORDER BY h) AS upto, sum(size) OVER (PARTITION BY key, h) AS grp, doc_id FROM d),
r AS (SELECT c.*, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS rest FROM c JOIN q USING (key))
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN upto <= rest THEN 1
  WHEN upto - grp <= rest AND upto - rest < rest - (upto - grp) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""

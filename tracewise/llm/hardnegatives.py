"""Hard negatives of anchors by exact integer inner products, multiplied tile by tile in Strassen's way.

Vectors become whole numbers. Anchors are dealt to blocks and candidates to slices by a hash, both of bounded size; each pair of a
block and a slice is one unit of work that gets its rows by a shuffle, so no table is broadcast and the number of units grows with the product of
the two tables, as the work does. In a unit the scores are a matrix product of int64 tiles: padded with zeros to even sizes, cut
into quarters and multiplied with seven products instead of eight, down to tiles that are multiplied directly. Sums and differences of
whole numbers are exact, even where they wrap around, so the scores are exact whenever they fit into 64 bits themselves.

The first pass multiplies only rows of equal label and keeps the best positives of each anchor in a heap of bounded size; the second
one all others, and keeps a heap for the window of scores of each positive. The heaps of all slices are merged as they come, sorted by anchor:
of two heaps the best entries are the best of both.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from tracewise.session import keep

POSITIVES, NEGATIVES = 5, 10
SCALE = 256
BLOCK, SLICE = 1024, 8192  # anchors and candidates of a unit, about
LEAF = 16  # a tile with a side of this or less is multiplied directly
ROWS = 128  # anchors of a tile
LARGEST = (1 << 63) // 400  # scores are held to this, so that a hundred times one still fits


# ------------------------------------------------------------------ tiles

def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices, modulo 2**64."""
    n, k, m = *a.shape, b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    if n % 2 or k % 2 or m % 2:
        a = np.pad(a, ((0, n % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, m % 2)))
        return strassen(a, b, leaf)[:n, :m]
    n, k, m = n // 2, k // 2, m // 2
    a11, a12, a21, a22 = a[:n, :k], a[:n, k:], a[n:, :k], a[n:, k:]
    b11, b12, b21, b22 = b[:k, :m], b[:k, m:], b[k:, :m], b[k:, m:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    q = strassen(a21 + a22, b11, leaf)
    r = strassen(a11, b12 - b22, leaf)
    s = strassen(a22, b21 - b11, leaf)
    t = strassen(a11 + a12, b22, leaf)
    u = strassen(a21 - a11, b11 + b12, leaf)
    v = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * n, 2 * m), np.int64)
    out[:n, :m], out[:n, m:], out[n:, :m], out[n:, m:] = p + s - t + v, r + t, q + s, p - q + r + u
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices; those beyond ``LARGEST`` are held to it, which takes exact numbers of any size."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if int(np.abs(a.astype(np.float64)).max()) * int(np.abs(b.astype(np.float64)).max()) * (a.shape[1] + 1) < LARGEST:
        return strassen(a, np.ascontiguousarray(b.T))
    whole = np.array([[sum(x * y for x, y in zip(p, q, strict=True)) for q in b.tolist()] for p in a.tolist()], object)
    return np.clip(whole, -LARGEST, LARGEST).astype(np.int64)


def matrix(values: pa.Array, width: int) -> np.ndarray:
    """A matrix from lists of whole numbers, short ones filled up with zeros."""
    lengths = np.asarray(values.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(values), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = values.flatten().to_numpy(zero_copy_only=False)
    return out


# ------------------------------------------------------------------ heaps

def merged(one: list[tuple], other: list[tuple], k: int) -> list[tuple]:
    """Of two sorted heaps of (minus score, nameless, id, copies) the first entries that make up ``k`` rows."""
    out, rows = [], 0
    for entry in heapq.merge(one, other):
        if rows >= k:
            break
        out.append(entry)
        rows += entry[3]
    return out


class Candidates:
    """Candidates of a slice in the order in which ties are broken, as arrays."""

    def __init__(self, rows: pa.Table, width: int):
        ids = rows.column("their vec_id").combine_chunks()
        self.nameless = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((self.ids, self.nameless))
        self.nameless, self.ids = self.nameless[order], self.ids[order]
        self.labels = rows.column("their label").to_numpy()[order]
        self.copies = rows.column("their copies").to_numpy()[order]
        self.rows = rows.column("their row").to_numpy(zero_copy_only=False)[order]
        self.q = matrix(rows.column("their q").combine_chunks(), width)[order]

    def heap(self, at: np.ndarray, score: np.ndarray, copies: np.ndarray, k: int) -> list[tuple]:
        """The first entries of places ``at`` (ascending, so that equal scores stay in order) that make up ``k`` rows."""
        if len(at) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            some = score >= least
            at, score, copies = at[some], score[some], copies[some]
        first = np.argsort(-score, kind="stable")[:k]
        entries = zip((-score[first]).tolist(), self.nameless[at[first]].tolist(), self.ids[at[first]].tolist(), copies[first].tolist(), strict=True)
        return merged(list(entries), [], k)


def positives_here(anchors: pa.Table, found: Candidates, width: int, k: int) -> list[tuple[bytes, list[tuple]]]:
    """For each anchor the best rows of its label among the candidates, the anchor's own row once less."""
    out = []
    labels, rows, q = anchors.column("label").to_numpy(), anchors.column("row").to_pylist(), matrix(anchors.column("q").combine_chunks(), width)
    for label in np.unique(labels).tolist():
        theirs = np.flatnonzero(found.labels == label)
        mine = np.flatnonzero(labels == label)
        if not len(theirs):
            continue
        b, copies, place = found.q[theirs], found.copies[theirs], {found.rows[x]: j for j, x in enumerate(theirs.tolist())}
        for start in range(0, len(mine), ROWS):
            part = mine[start:start + ROWS]
            for i, score in zip(part.tolist(), scores(q[part], b), strict=True):
                own, left = place.get(rows[i]), copies
                if own is not None:
                    left = copies.copy()
                    left[own] -= 1
                some = left > 0
                if some.any():
                    out.append((rows[i], found.heap(theirs[some], score[some], left[some], k)))
    return out


def negatives_here(anchors: pa.Table, found: Candidates, width: int, k: int) -> list[tuple[bytes, int, list[tuple]]]:
    """For each anchor and score of a positive the best rows of other labels with 30 p <= 100 n <= 90 p."""
    out = []
    labels, rows, q = anchors.column("label").to_numpy(), anchors.column("row").to_pylist(), matrix(anchors.column("q").combine_chunks(), width)
    wanted = anchors.column("targets").to_pylist()
    for start in range(0, len(rows), ROWS):
        product = scores(q[start:start + ROWS], found.q)
        for i, score in enumerate(product, start):
            other = found.labels != labels[i]
            lowest, highest = (30 * min(wanted[i]) + 99) // 100, 90 * max(wanted[i]) // 100
            at = np.flatnonzero(other & (score >= lowest) & (score <= highest))
            near = score[at]
            for p in sorted(set(wanted[i])):
                low, high = -(-30 * p // 100), 90 * p // 100
                inside = (near >= low) & (near <= high)
                if low <= high and inside.any():
                    out.append((rows[i], p, found.heap(at[inside], near[inside], found.copies[at[inside]], k)))
    return out


# ------------------------------------------------------------------ on Spark

_HEAP = "scores array<long>, nameless array<boolean>, ids array<long>, copies array<long>"
_HEAP_TYPES = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _heaps(keys: list[tuple[str, pa.DataType]], found: list[tuple]) -> pa.Table:
    """A row for each (key ..., heap)."""
    columns = [pa.array([x[i] for x in found], t) for i, (_, t) in enumerate(keys)]
    columns += [pa.array([[e[j] for e in x[-1]] for x in found], t) for j, t in enumerate(_HEAP_TYPES)]
    return pa.Table.from_arrays(columns, [*[n for n, _ in keys], "scores", "nameless", "ids", "copies"])


def _merge(df: DataFrame, names: list[str], schema: str, k: int) -> DataFrame:
    """One heap for each key from those of all slices, merged as they come."""
    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heap = None, []

        def record(done: list[tuple]) -> pa.RecordBatch:
            kinds = [(n, pa.binary() if n == "row" else pa.int64()) for n in names]
            return _heaps(kinds, done).combine_chunks().to_batches()[0] if done else pa.RecordBatch.from_pylist([], _heaps(kinds, []).schema)

        for b in batches:
            done = []
            columns = [b.column(n).to_pylist() for n in (*names, "scores", "nameless", "ids", "copies")]
            for x in zip(*columns, strict=True):
                own, entries = x[:len(names)], list(zip(*x[len(names):], strict=True))
                if own != key:
                    if key is not None:
                        done.append((*key, heap))
                    key, heap = own, []
                heap = merged(heap, entries, k)
            yield record(done)
        if key is not None:
            yield record([(*key, heap)])

    return df.repartition(*names).sortWithinPartitions(*names).mapInArrow(together, schema)


def whole_rows(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q, copies, row) of each distinct row that takes part; ``row`` tells them apart."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x")).where(~odd)
    most = float(1 << 62)
    q = F.transform("x", lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(most)), F.lit(-most))).cast("long"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", moved.alias("label"), q.alias("q"))
    row = F.unhex(F.md5(F.concat_ws(",", F.coalesce(F.col("vec_id").cast("string"), F.lit("-")), F.col("label").cast("string"), F.concat_ws(",", F.col("q").cast("array<string>")))))
    return rows.withColumn("row", row).groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.first("q").alias("q"), F.count("*").alias("copies"))


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK, size: int = SLICE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, embedding, label, any more columns).

    Anchors are rows whose id ``every`` divides. Rows with a null label or vector, or a component that is null or not finite, take
    no part. A row without id is a candidate, after others of equal score; its id in the result is null. Missing components of a
    shorter vector are zero. Rows that repeat count as so many rows: a repeated anchor has the others as positives, and its results come as often;
    likewise two rows of one id. Components are held to 2**62 and scores to +-2**63 / 400. An empty table gives no rows.
    """
    rows = keep(whole_rows(embeddings), "vectors")
    sizes = rows.agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("anchors"), F.max(F.size("q")).alias("width")).first()
    width = max(sizes.width or 0, 1)
    blocks, slices = max(1, -(-(sizes.anchors or 0) // block)), max(1, -(-sizes.n // size))
    dealt = F.conv(F.substring(F.hex("row"), 1, 12), 16, 10).cast("long")
    anchors = rows.where(F.col("vec_id") % every == 0)
    names = ["row", "label", "q"]

    def units(mine: DataFrame, more: list[str]) -> tuple[GroupedData, GroupedData]:
        """The two sides, grouped by pairs of a block and a slice."""
        left = mine.select(*names, *more, (dealt % blocks).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("j"))
        right = rows.select(*names, "vec_id", "copies", (dealt % slices).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"))
        return left.groupBy("i", "j"), right.toDF(*[f"their {c}" for c in right.columns]).groupBy("their i", "their j")

    first_keys = [("row", pa.binary())]
    second_keys = [("row", pa.binary()), ("target", pa.int64())]

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        return _heaps(first_keys, positives_here(left, Candidates(right, width), width, positives) if len(left) and len(right) else [])

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        return _heaps(second_keys, negatives_here(left, Candidates(right, width), width, negatives) if len(left) and len(right) else [])

    left, right = units(anchors, [])
    found = left.cogroup(right).applyInArrow(first, f"row binary, {_HEAP}")
    best = keep(_merge(found, ["row"], f"row binary, {_HEAP}", positives), "positives")

    wanted = best.select("row", F.array_distinct("scores").alias("targets")).withColumn("targets", F.transform("targets", lambda x: -x))
    left, right = units(anchors.join(wanted, "row"), ["targets"])
    found = left.cogroup(right).applyInArrow(second, f"row binary, target long, {_HEAP}")
    windows = _merge(found, ["row", "target"], f"row binary, target long, {_HEAP}", negatives)

    # entries stand for so many rows each, up to the number asked for
    chosen = best.join(anchors.select("row", F.col("vec_id").alias("anchor_id"), F.col("copies").alias("times")), "row")
    chosen = chosen.withColumn("p", F.explode(_spelled(positives))).select(
        "row", "anchor_id", "times", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    listed = windows.select("row", F.col("target").alias("positive_score"), F.posexplode(_spelled(negatives)).alias("at", "n"))
    listed = listed.select("row", "positive_score", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), F.col("n.score").alias("negative_score"))
    out = chosen.join(listed, ["row", "positive_score"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _spelled(k: int):
    """The rows (id, score) that a heap stands for."""
    entries = F.arrays_zip("scores", "nameless", "ids", "copies")
    rows = F.flatten(F.transform(entries, lambda e: F.array_repeat(
        F.struct(F.when(~e["nameless"], e["ids"]).alias("id"), (-e["scores"]).alias("score")), F.least(e["copies"], F.lit(k)).cast("int"))))
    return F.slice(rows, 1, k)


SQL = f"""WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
  [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)])::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own = label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE own <> label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""

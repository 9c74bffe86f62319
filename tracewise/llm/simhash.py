"""Near-duplicate documents by SimHash fingerprints that are looked up with the binary Golay code.

A fingerprint has 64 bits; two documents are linked if theirs differ in at most four. The bits are cut into three
segments of at most 23. Of two linked fingerprints, two segments have two errors or fewer each: three errors in two
segments would be six. The perfect (23, 12, 7) Golay code has the property that two words with at most two differing
bits are both within distance four of a common codeword, and a word has one or six codewords that near. So the codeword
indices of each pair of segments, 84 keys a fingerprint on average, bring every linked pair together at least once.
Pairs that share a key are then compared.

Equal fingerprints are merged first. A key with more than ``bucket`` fingerprints (near copies of one text) isn't paired
out. Its members meet by points instead: two fingerprints differ in at most four bits exactly if some 64-bit number is
within two bits of both. Each member names the 2,081 numbers within two bits, and all that name the same number are
linked, with no pair to compare and no number named by more than 2,081.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.llm.words import blobs, text_batches
from tracewise.session import forget, keep

SHINGLE = 4
DISTANCE = 4
SEGMENTS = (22, 21, 21)
BUCKET = 128
SEED = 42
_GOLAY = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_CHUNK = 1 << 16


# ------------------------------------------------------------------ fingerprints

def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of each bit over the hashes of all runs of words; 0 for a text without words."""
    words = text.lower().split()  # bytes.lower touches A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = len(words) - k + 1
    spans = zip(starts[:n].tolist(), (ends[k - 1:] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = hashes[at:at + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, row: Column | None = None) -> DataFrame:
    """(doc_id, row, fp) of each row of ``docs``; fp holds the 64 bits as a signed number."""
    text_batches(docs.sparkSession)

    def simhash_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in blobs(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(fps)], ["doc_id", "row", "fp"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(0) if row is None else row).cast("long").alias("row"), "text")
    return named.mapInArrow(simhash_of, "doc_id long, row long, fp long")


# ------------------------------------------------------------------ Golay keys

def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the bytes of a word, and by syndrome the error patterns of weight four or less, -1 filled.

    A syndrome has one pattern of weight three or less, and five more of weight four if that one weighs three.
    """
    units = []
    for i in range(23):
        x = 1 << i
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= _GOLAY << (bit - 11)
        units.append(x)
    per_byte = np.zeros((3, 256), np.int64)
    for b in range(3):
        for v in range(256):
            for i in range(8):
                if v >> i & 1 and 8 * b + i < 23:
                    per_byte[b, v] ^= units[8 * b + i]
    patterns = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            syndrome = 0
            for i in bits:
                syndrome ^= units[i]
            patterns[syndrome, used[syndrome]] = sum(1 << i for i in bits)
            used[syndrome] += 1
    return per_byte, patterns


def nearby(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Indices of the codewords within distance four of each 23-bit word: six columns, -1 where there are fewer."""
    per_byte, patterns = tables
    syndrome = per_byte[0][words & 255] ^ per_byte[1][words >> 8 & 255] ^ per_byte[2][words >> 16]
    error = patterns[syndrome]
    return np.where(error < 0, -1, (words[:, None] ^ error) >> 11)


def golay_keys(fps: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each pair of segments and each pair of codewords near them."""
    bits, at, found = fps.view(np.uint64), 0, []
    for width in SEGMENTS:
        segment = (bits >> np.uint64(at)) & np.uint64((1 << width) - 1)
        found.append(nearby(segment.astype(np.int64), tables))
        at += width
    rows, keys = [], []
    for pair, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        a, b = found[i][:, :, None], found[j][:, None, :]
        row, x, y = np.nonzero((a >= 0) & (b >= 0))
        rows.append(row)
        keys.append(pair << 24 | found[i][row, x] << 12 | found[j][row, y])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = golay_tables()
    for b in batches:
        fps = b.column("fp").to_numpy()
        for at in range(0, len(fps), 4096):
            part = fps[at:at + 4096]
            row, key = golay_keys(part, tables)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["key", "fp"])


def runs(batches: Iterator[pa.RecordBatch], keep_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted (key, fp) rows in blocks: keys, fps, and whether the row's run of equal keys is longer than ``keep_rows``.

    A run is never cut between two blocks unless it is longer; of such a run no more than a block is held.
    """
    keys = fps = np.empty(0, np.int64)
    over = None  # key of a long run of which rows were handed out
    for b in batches:
        keys = np.concatenate((keys, b.column(0).to_numpy()))
        fps = np.concatenate((fps, b.column(1).to_numpy()))
        last = np.searchsorted(keys, keys[-1]) if len(keys) else 0
        if len(keys) - last > keep_rows:
            last = len(keys)
        block, held, keys, fps = keys[:last], fps[:last], keys[last:], fps[last:]
        if len(block):
            over = (yield from _marked(block, held, keep_rows, over))
    if len(keys):
        yield from _marked(keys, fps, keep_rows, over)


def _marked(keys: np.ndarray, fps: np.ndarray, keep_rows: int, over: int | None):
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.concatenate((start, [len(keys)])))
    long = (size > keep_rows) | (keys[start] == (over if over is not None else -1))
    yield keys, fps, np.repeat(long, size)
    return int(keys[-1]) if long[-1] else None


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges (a, b) only such as connect what the others before don't."""
    if len(a) < 2:
        return a, b
    pairs = np.unique(np.stack((a, b)), axis=1)
    nodes, at = np.unique(pairs, return_inverse=True)
    above, stay = list(range(len(nodes))), []
    for k, (x, y) in enumerate(at.reshape(2, -1).T.tolist()):
        while above[x] != x:
            above[x] = x = above[above[x]]
        while above[y] != y:
            above[y] = y = above[above[y]]
        if x != y:
            above[y] = x
            stay.append(k)
    return pairs[0, stay], pairs[1, stay]


def _compared(distance: int, bucket: int):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Linked pairs (a < b) of short runs, as few as connect the same; (a, a) for each member of a long one."""
        for keys, fps, long in runs(batches, bucket):
            hot = np.unique(fps[long])
            left, right = [], []
            keys, fps = keys[~long], fps[~long]
            at = np.arange(len(keys) - 1)
            lag = 1
            while len(at):
                at = at[keys[at] == keys[at + lag]]
                near = at[np.bitwise_count(fps[at].view(np.uint64) ^ fps[at + lag].view(np.uint64)) <= distance]
                left.append(np.minimum(fps[near], fps[near + lag]))
                right.append(np.maximum(fps[near], fps[near + lag]))
                lag += 1
                at = at[at + lag < len(keys)]
            a, b = forest(np.concatenate(left), np.concatenate(right)) if left else (hot[:0], hot[:0])
            a, b = np.concatenate((hot, a)), np.concatenate((hot, b))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    return compared


# ------------------------------------------------------------------ points of long runs

def _ball() -> np.ndarray:
    """All 64-bit numbers with at most two bits set."""
    ones = [1 << i for i in range(64)]
    return np.array([0, *ones, *(x | y for x, y in combinations(ones, 2))], np.uint64)


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ball = _ball()
    for b in batches:
        fps = b.column("fp").to_numpy()
        for at in range(0, len(fps), 64):
            part = fps[at:at + 64]
            named = (part.view(np.uint64)[:, None] ^ ball[None, :]).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(named), pa.array(np.repeat(part, len(ball)))], ["key", "fp"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint with the first that named the same number."""
    for keys, fps, _ in runs(batches, len(_ball())):
        start = np.concatenate(([True], keys[1:] != keys[:-1]))
        first = fps[np.flatnonzero(start)][np.cumsum(start) - 1]
        a, b = np.minimum(first, fps), np.maximum(first, fps)
        a, b = forest(a[a < b], b[a < b])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _met(keyed: DataFrame, how) -> DataFrame:
    """Rows of a key in one task, one after another; a task streams them and holds no key as a whole."""
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(how, "a long, b long")


def links(fps: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b), a < b, between distinct fingerprints ``fp``; they connect exactly those within ``distance`` bits.

    Links that others already connect are left out where a task sees it, so not each link is an edge itself.
    """
    if distance != DISTANCE:
        raise ValueError("segments and points are made for four bits")
    found = keep(_met(fps.select("fp").mapInArrow(_keyed, "key long, fp long"), _compared(distance, bucket)).distinct(), "simhash-pairs")
    hot = found.where("a = b").select(F.col("a").alias("fp"))
    stars = _met(hot.mapInArrow(_points, "key long, fp long"), _stars)
    return found.where("a < b").union(stars).distinct()


# ------------------------------------------------------------------ groups

def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the edges (a, b), a < b; root is the smallest node it can reach.

    Large-star and small-star steps alternate until the edges stay the same. Every step is an aggregate and a join
    on a node, whose rows Spark can split if they are many; its edges are written, so that no round is done twice.
    """
    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = keep(edges.select("a", "b"), "components")
    before = state(edges)
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b")).union(
            low.select(F.col("m").alias("a"), "b")).distinct()
        after = keep(small, "components")
        now = state(after)
        forget(edges)
        edges = after
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text, any more columns).

    ``component_id`` is the smallest doc_id that can be reached over links. A null or empty text has fingerprint zero
    and is linked like any other; rows without doc_id keep their row, and a group of none but such rows has none.
    Repeated rows are returned as often as they come. An empty table gives no rows.
    """
    own = keep(fingerprints(docs, shingle).drop("row"), "simhash")
    reps = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    grouped = components(links(reps, distance, bucket))
    joined = grouped.join(reps, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("first").alias("component"))
    named = grouped.join(joined, "root").select(F.col("node").alias("fp"), "component")
    # a table of its own, so that Spark can split the rows of a fingerprint that many documents share
    named = keep(reps.join(named, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id")), "simhash-groups")
    return own.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest doc_id, or any text if none of the group has one.

    Rows are told apart by doc_id and text, so of a row that repeats, one stays; a row without doc_id gives way to one
    that has it.
    """
    row = F.xxhash64(F.col("doc_id").cast("long"), "text")
    own = keep(fingerprints(docs, options.get("shingle", SHINGLE), row), "simhash")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row")).alias("best")
    by_fp = own.groupBy("fp").agg(best)
    grouped = components(links(own.select("fp").distinct(), options.get("distance", DISTANCE), options.get("bucket", BUCKET)))
    stay = by_fp.join(grouped, F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("root"), "best")
    own_name = "row of near-duplicate group"  # no column of the table has this name
    stay = stay.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(own_name))
    return docs.withColumn(own_name, row).join(stay, own_name, "left_semi").dropDuplicates([own_name]).drop(own_name)

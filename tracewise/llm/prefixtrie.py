"""The prefix tree of conversations, with a count-min sketch that proves most prefixes to be nobody else's.

A conversation is a sequence of turns (role, text); each distinct sequence of its first d turns is a node. A node is known by the
depth and running sums of 128 bits of hash per turn, each hash salted with its depth, so prefixes are running columns that
``scan`` can cut into segments: no task has to hold, or even see, a whole conversation. Texts stay where they are; what is
shuffled is some sixty bytes a turn.

Keys of all nodes go into a count-min sketch of bounded size: four rows of counters that stop at two. A sketch never
estimates too little, so an estimate of one proves that a node has one member. Such tails are answered in place, and only what
follows a possibly shared node asks for the name of that node. Prefixes that may be shared are grouped exactly, so collisions
in the sketch cost work and change nothing; so does a table that outgrows the sketch.

What a node has to know of its subtree needs no walk. Each node is represented by its smallest member, and every node below it
is represented by a member of it, so sums over a subtree are sums over members of running sums along their own path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.operators.scan import HotKeys, Whole, measure, position, previous, running_max, running_sum, scan
from tracewise.session import keep

FAMILY, SHARES = 5, 9
ROWS = 4  # of the sketch
LEAST, MOST = 12, 25  # bits of a position in a row: 4 x 2 ** 25 counters are 16 MB, as one bit says "two or more"
ROOM = 4  # counters of a row for each key
BLOCK = 16  # bits of a position in a block
FEW = 500_000  # shared nodes up to which their table is broadcast (some 30 MB)
PIECE = 4096  # ids joined into one row before they are hashed
_KEY = ["a", "b"]


# ------------------------------------------------------------------ the sketch

class CountMin:
    """For keys of two 64-bit numbers: which of the counters stand at two or more."""

    def __init__(self, width: int, twice: np.ndarray):
        self.width, self.twice = width, twice

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which keys may have come twice; False proves that a key came once at most."""
        maybe = np.ones(len(a), bool)
        for i in range(ROWS):
            at = counters(a, b, i, self.width)
            maybe &= self.twice[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
        return maybe


def counters(a: np.ndarray, b: np.ndarray, row: int, width: int) -> np.ndarray:
    """The counter of each key in a row of the sketch, numbered through all rows."""
    x = a.astype(np.uint64) + np.uint64(row) * (b.astype(np.uint64) | np.uint64(1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - width)).astype(np.int64) + (row << width)


def _bits(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))


def sketch(keys: DataFrame, n: int, most: int = MOST) -> CountMin:
    """The sketch of ``n`` rows (a, b). Tasks count by themselves and hand on what they have seen once and twice, in two bytes a counter;
    the driver gets a bit for each counter, 2 ** (``most`` + 2) at most, however many keys there are."""
    width = min(max((ROOM * max(n, 1) - 1).bit_length(), min(LEAST, most)), most)
    size = (ROWS << width) >> 3
    schema = "block int, once binary, twice binary"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in _KEY)
            for i in range(ROWS):
                at, n_here = np.unique(counters(a, b, i, width), return_counts=True)
                before = once[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
                _bits(twice, at[before | (n_here > 1)])
                _bits(once, at)
        per = 1 << (BLOCK - 3)
        for start in range(0, size, per):
            bits = once[start:start + per]
            if bits.any():
                listed = [np.flatnonzero(np.unpackbits(x[start:start + per], bitorder="little")).astype(np.uint16).tobytes() for x in (once, twice)]
                yield pa.RecordBatch.from_arrays([pa.array([start // per], pa.int32()), *[pa.array([x], pa.binary()) for x in listed]], ["block", "once", "twice"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # a task has a share of them; all are 2048 at most, of 16 KB
        for batch in batches:
            for block, *listed in zip(*(batch.column(c).to_pylist() for c in ("block", "once", "twice")), strict=True):
                once, twice = blocks.setdefault(block, (np.zeros(1 << (BLOCK - 3), np.uint8), np.zeros(1 << (BLOCK - 3), np.uint8)))
                new, again = (np.frombuffer(x, np.uint16).astype(np.int64) for x in listed)
                _bits(twice, new[once[new >> 3] >> (new & 7).astype(np.uint8) & 1 == 1])
                _bits(twice, again)
                _bits(once, new)
        some = {k: t.tobytes() for k, (_, t) in blocks.items() if t.any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.int32()), pa.array(list(some.values()), pa.binary())], ["block", "twice"])

    twice = np.zeros(size, np.uint8)
    for r in keys.select(*_KEY).mapInArrow(counted, schema).repartition("block").mapInArrow(merged, "block int, twice binary").collect():
        part = np.frombuffer(bytes(r.twice), np.uint8)
        start = r.block << (BLOCK - 3)
        twice[start:start + len(part)] = part[:size - start]
    return CountMin(width, twice)


# ------------------------------------------------------------------ turns and their prefixes

def numbered(conversations: DataFrame) -> tuple[DataFrame, HotKeys | None]:
    """(conv_id, pos, h, size) of each turn with a conv_id: its place from 1, a hash of role and text, the bytes of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("h"), F.octet_length(text).cast("long").alias("size"))
    turns = keep(turns, "turns")
    hot = measure(turns, ["conv_id"]).hot
    return keep(scan(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), "h"], [position("pos")], hot).select("conv_id", "pos", "h", "size"), "turns"), hot


def rebuilt(turns: DataFrame, family: int = FAMILY, shares: int = SHARES) -> DataFrame:
    """(conv_id, part, pos, h, size): each conversation begins with the first turns of the first of its family, and goes on with its own.

    How many it shares is the crc32 of its id modulo ``shares``; its own turns of these places are left out. Of the first of a
    family ``shares`` - 1 turns are looked at, whatever its length.
    """
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shares
    own = turns.where(F.col("pos") > share).select("conv_id", F.lit(1).alias("part"), "pos", "h", "size")
    offsets = F.array(*[F.lit(i) for i in range(1 - family, family)])
    near = F.transform(offsets, lambda i: F.try_add(F.col("first"), i.cast("long")))
    first = turns.where((F.col("pos") < shares) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "first")
    lent = first.withColumn("conv_id", F.explode(F.filter(near, lambda x: x.isNotNull() & (x - x % family == F.col("first")))))
    lent = lent.where(F.col("pos") <= share).join(turns.select("conv_id").distinct(), "conv_id", "left_semi")
    return own.unionByName(lent.select("conv_id", F.lit(0).alias("part"), "pos", "h", "size"))


def prefixes(turns: DataFrame, hot: HotKeys | None) -> DataFrame:
    """(conv_id, depth, size, ends, a, b, pa, pb) of each place of each conversation: the keys of the node and of the one above.

    ``turns`` has conv_id, part, pos, h and size; the order within a conversation is by part and pos.
    """
    rows = scan(turns, ["conv_id"], ["part", "pos"], [position("depth"), Whole("n", F.count(F.lit(1)))], hot)
    salted = F.md5(F.concat_ws(":", F.col("depth").cast("string"), "h"))
    rows = rows.withColumn("salted", salted)
    rows = rows.withColumns({f"v{i}": F.conv(F.substring("salted", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)})
    rows = scan(rows, ["conv_id"], ["part", "pos"], [running_sum(f"s{i}", F.col(f"v{i}")) for i in range(4)], hot)
    own = _hashed(F.col("depth"), *[F.col(f"s{i}") for i in range(4)])
    above = _hashed(F.col("depth") - 1, *[F.col(f"s{i}") - F.col(f"v{i}") for i in range(4)])
    rows = rows.select("conv_id", "depth", "size", (F.col("depth") == F.col("n")).alias("ends"), own.alias("own"), above.alias("above"))
    return rows.select("conv_id", "depth", "size", "ends", _half("own", 0).alias("a"), _half("own", 1).alias("b"),
                       _half("above", 0).alias("pa"), _half("above", 1).alias("pb"))


def _hashed(*numbers: Column) -> Column:
    return F.md5(F.concat_ws(":", *[x.cast("string") for x in numbers]))


def _half(digest: str, i: int) -> Column:
    return F.conv(F.substring(digest, 16 * i + 1, 15), 16, 10).cast("long")


# ------------------------------------------------------------------ the tree

@dataclass(frozen=True)
class Trie:
    """``nodes`` (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, a, b), and ``ends`` (a, b, conv_id).

    A node is named by its smallest member and its depth. The members that end at a node of several members are the rows of ``ends``
    with its key; the member of a node of one ends there if the node has no children. The root has the key (-1, -1).
    """

    nodes: DataFrame
    ends: DataFrame


_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, a long, b long"


def trie(conversations: DataFrame, family: int = FAMILY, shares: int = SHARES, most: int = MOST) -> Trie:
    """The prefix tree of all rebuilt conversations of (conv_id, turn, role, text, any more columns).

    Turns are ordered by turn, null first, and at equal turns by a hash of role and text, so repeated rows are turns of their own
    and ties don't depend on the order of the rows. Null roles and texts are empty. Rows without conv_id belong to no conversation
    and take no part. A conversation that is left without turns is a member of the root alone. An empty table has no nodes.
    """
    spark = conversations.sparkSession
    turns, hot = numbered(conversations)
    convs = keep(turns.select("conv_id").distinct(), "conversations")
    total = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("first")).first()
    if not total.n:
        return Trie(spark.createDataFrame([], _NODES), spark.createDataFrame([], "a long, b long, conv_id long"))
    paths = keep(prefixes(rebuilt(turns, family, shares), hot), "paths")
    seen = sketch(paths, paths.count(), most)

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b, pa_, pb, depth = (x.column(c).to_numpy() for c in ("a", "b", "pa", "pb", "depth"))
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(seen.shared(a, b)), pa.array((depth == 1) | seen.shared(pa_, pb))],
                                             [*x.schema.names, "maybe", "below"])

    rows = keep(paths.mapInArrow(flagged, "conv_id long, depth long, size long, ends boolean, a long, b long, pa long, pb long, maybe boolean, below boolean"), "paths")
    maybe = rows.where("maybe")
    shared = maybe.groupBy(*_KEY).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("rep"), F.sum(F.col("ends").cast("long")).alias("n_ends"), F.max("depth").alias("depth"),
        F.max("size").alias("size"), F.max("pa").alias("pa"), F.max("pb").alias("pb")).where("n > 1")
    shared = keep(shared, "shared-prefixes")
    small = shared.count() <= FEW
    named = shared.select(*_KEY, "n", "rep", "n_ends")
    named = F.broadcast(named) if small else named

    # nodes with one member: a tail below its first node is known in place, the first one asks for the name of the node above
    first_name = F.when(F.col("depth") == 1, F.lit(total.first))
    alone = [F.col("conv_id"), F.col("depth"), F.lit(1).cast("long").alias("n_convs"), F.when(F.col("ends"), 0).otherwise(1).cast("long").alias("n_children"),
             F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.col("a"), F.col("b")]
    tails = rows.where("not maybe and not below").select(*alone, F.col("conv_id").alias("parent_conv_id"))
    edge = rows.where("not maybe and below").unionByName(maybe.join(named, _KEY, "left_anti"))
    above = named.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("rep").alias("above"))
    above = F.broadcast(above) if small else above
    edge = edge.join(above, ["pa", "pb"], "left").select(*alone, F.coalesce(first_name, "above", "conv_id").alias("parent_conv_id"))

    # shared nodes: sums over members of what a member knows of its own path from its end up
    members = maybe.join(named, _KEY).withColumns({"up": -F.col("depth"), "own": F.col("rep") == F.col("conv_id")})
    ends = members.where("ends").select(*_KEY, "conv_id")
    members = scan(members, ["conv_id"], ["up"], [
        running_sum("saved", F.when(F.col("own"), (F.col("n") - 1) * F.col("size")).otherwise(0)),
        running_max("ended", F.col("ends").cast("int")),
        running_max("leaf", (F.col("ends") & F.col("own") & (F.col("n_ends") == F.col("n"))).cast("int")),
        previous("child", F.col("own").cast("int"))], hot)
    sums = members.groupBy(*_KEY).agg(
        F.sum(F.when(F.col("ends"), 0).otherwise(F.coalesce("child", F.lit(1)))).cast("long").alias("n_children"),
        F.sum(F.when(F.col("ended") == 1, F.col("leaf")).otherwise(1)).cast("long").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    known = shared.join(sums, _KEY).join(above, ["pa", "pb"], "left").select(
        F.col("rep").alias("conv_id"), "depth", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", *_KEY,
        F.coalesce(first_name, "above").alias("parent_conv_id"))

    # the root, from sums over shared nodes and the number of conversations that have turns
    whole = shared.agg(F.sum("n_ends").alias("ends"), F.sum((F.col("n_ends") == F.col("n")).cast("long")).alias("leaves"),
                       F.sum((F.col("n") - 1) * F.col("size")).alias("saved"), F.sum(F.when(F.col("depth") == 1, F.col("n") - 1)).alias("merged")).first()
    starts = rows.where("depth = 1").select("conv_id")
    turnless = convs.join(starts, "conv_id", "left_anti")
    n = starts.count()
    root = spark.createDataFrame([(total.first, 0, None, total.n, n - (whole.merged or 0), n - (whole.ends or 0) + (whole.leaves or 0) if n else 1,
                                   whole.saved or 0, -1, -1)], _NODES)
    ends = ends.unionByName(turnless.select(F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), "conv_id"))
    return Trie(root.unionByName(tails).unionByName(edge).unionByName(known).select(*root.columns), ends)


def ids_sha256(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): the hash of the ids of a key, ascending, joined by commas.

    Ids are sorted and joined in ranges, so that what a hash has to read in order (it can't be cut) are long strings made elsewhere.
    """
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []
        for x in batches:
            for a, b, i in zip(*(x.column(c).to_pylist() for c in (*_KEY, "conv_id")), strict=True):
                if (a, b) != key or len(ids) >= PIECE:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = (a, b), []
                ids.append(i)
            yield pieces(out)
            out = []
        if ids:
            yield pieces([(*key, ids[0], ",".join(map(str, ids)))])

    def pieces(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], ["a", "b", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for x in batches:
            out = []
            for a, b, ids in zip(*(x.column(c).to_pylist() for c in (*_KEY, "ids")), strict=True):
                if (a, b) != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield digests(out)
        if key is not None:
            yield digests([(*key, digest.hexdigest())])

    def digests(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.string()], strict=True)], ["a", "b", "ends_sha256"])

    order = [*_KEY, "conv_id"]
    parts = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, "a long, b long, first long, ids string")
    return parts.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(hashed, "a long, b long, ends_sha256 string")


def prefix_tree(conversations: DataFrame, **options) -> DataFrame:
    """The nodes of ``trie`` with the hash of the ids of the members that end there."""
    made = trie(conversations, **options)
    hashes = ids_sha256(made.ends)
    none, own = F.lit(hashlib.sha256(b"").hexdigest()), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    alone = made.nodes.where("n_convs = 1").withColumn("ends_sha256", F.when(F.col("n_children") == 0, own).otherwise(none))
    found = made.nodes.where("n_convs > 1").join(hashes, _KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    return found.unionByName(alone).drop(*_KEY)


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(conv_id::VARCHAR, '')])),
    lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END)"""
SQL = f"""WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, xor({_CRC}, 4294967295) % {SHARES} AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = base AND pos <= h
  UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
d AS (SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS size, list([role, text]) OVER (w ROWS UNBOUNDED PRECEDING) AS path
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
e AS (SELECT conv_id, max(depth) AS n FROM (SELECT conv_id, depth FROM d UNION ALL SELECT conv_id, 0 FROM c) GROUP BY conv_id),
m AS (SELECT conv_id, depth, size, path FROM d UNION ALL SELECT conv_id, 0, 0, [] FROM c),
v AS (SELECT path, depth, max(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = n), '') AS ends FROM m JOIN e USING (conv_id) GROUP BY path, depth),
k AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY ALL),
x AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (path)),
s AS (SELECT path[:up] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM x) GROUP BY ALL)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM x JOIN s USING (path) LEFT JOIN v p ON x.depth > 0 AND p.depth = x.depth - 1 AND p.path = x.path[:x.depth - 1]"""

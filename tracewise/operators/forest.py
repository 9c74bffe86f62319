"""Random forests of deep trees over more rows than a driver or a level-by-level fit can follow.

A tree that is grown until its leaves are pure has about as many nodes as rows. Grown level by level, its millions of small nodes each ask for
sums from all tasks. Here only the top of a tree is: histograms of its nodes are summed over all tasks until a node has few enough rows for one
task. Then the rows of each such node go to a task of its own, packed in blocks of bytes, and the task grows the rest of the tree below it. So
the driver knows the top of each tree alone, the rest is a table, and rows to be scored are sent to the part of the tree where they belong.

The trees are those of MLlib: features are cut at 32 bins, a row enters a tree as often as a Poisson number says, each node draws its features,
takes the cut of the largest Gini gain and ends where there is none, and two leaves of one answer become one. What is drawn depends on
the seed, the tree, the row and the node, so the same rows give the same trees however they are spread. Trees of several
parameter sets and seeds grow together and read the rows once a level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.functions.columns import c
from tracewise.operators.batched import FLUSH, Tree, _record, _summed, matrix, routed, runs_of
from tracewise.operators.models import FEATURES, LABEL, TREE_DEPTH
from tracewise.session import forget, keep

BINS = 32
QUANTILES = 10_000  # of a feature, among which its cuts are chosen
SUBTREE_ROWS = 200_000  # rows of a tree that a task grows by itself
SUBTREE_TASKS = 2_000
BLOCK = 16  # bits of the position of a scored row in its block
# how many times out of one a row enters a tree less than once, twice, ...; 15 times at most, which has 4 bits
_OFTEN = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(15)])
_NODE = np.dtype([("feature", "<i4"), ("cut", "u1"), ("left", "<i4"), ("score", "<f8")])  # the right child follows the left one


def learn_cuts(rows: DataFrame) -> list[np.ndarray]:
    """Thresholds of each feature of ``x``, at most 31: between all its values, or where the counts of rows come nearest to equal shares."""
    shares = [i / (QUANTILES - 1) for i in range(QUANTILES)]
    found = rows.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.percentile_approx("v", shares, QUANTILES).alias("q")).collect()
    cuts = {r["f"]: _cuts(np.array(r["q"], np.float64)) for r in found}
    return [cuts[i] for i in range(len(cuts))]


def _cuts(sample: np.ndarray) -> np.ndarray:
    values, counts = np.unique(sample[~np.isnan(sample)], return_counts=True)
    between = (values[1:] + values[:-1]) / 2
    if len(values) <= BINS:
        return between
    stride = counts.sum() / BINS
    so_far, target, out = np.cumsum(counts), stride, []
    for i in range(1, len(values)):
        if abs(so_far[i - 1] - target) < abs(so_far[i] - target):
            out.append(between[i - 1])
            target += stride
    return np.array(out)


def _coded(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """A byte for each feature of each row: how many thresholds are below it."""
    codes = np.empty(x.shape, np.uint8)
    for i, cut in enumerate(cuts):
        codes[:, i] = np.searchsorted(cut, x[:, i], side="left")
    return codes


def _times(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row enters a tree: a Poisson number of mean 1 that its key decides."""
    x = keys.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD6E8FEB86659FD93) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.searchsorted(_OFTEN, u, side="right").astype(np.uint8)


def _drawn(draw: np.random.Generator, nodes: int, features: int, some: int) -> np.ndarray:
    """The features that each node may use."""
    if some >= features:
        return np.tile(np.arange(features), (nodes, 1))
    return np.sort(np.argpartition(draw.random((nodes, features)), some - 1, axis=1)[:, :some], axis=1)


def _gain(left_n, left_pos, n, pos):
    """The Gini gain of a cut, times n * n / 2: of integers, and so exactly 0 where both sides have equal shares."""
    return (left_pos * n - pos * left_n) ** 2 / (left_n * (n - left_n))


# ------------------------------------------------------------------ the tree below a node

def grow(rows: np.ndarray, some: int, depth: int, draw: np.random.Generator) -> np.ndarray:
    """The nodes of a tree over rows of bytes: a code for each feature, and last twice the times of the row, plus 1 for a positive one.

    All nodes of a level are parted at once. Rows stay grouped by node; for each drawn feature they are sorted by code within their node, so the
    work of a level grows with its rows, not with its nodes.
    """
    width = rows.shape[1]
    flat, times = rows.reshape(-1), np.ascontiguousarray(rows[:, -1])
    own = times.astype(np.int64)
    row, slot = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    feature, cut, left = [np.array([-1])], [np.array([0])], [np.array([0])]
    n, pos = [np.array([(own >> 1).sum()])], [np.array([((own >> 1) * (own & 1)).sum()])]
    at, size = np.zeros(1, np.int64), 1  # the open nodes, in the last level; the nodes of all levels
    if not 0 < pos[0][0] < n[0][0]:
        at, row, slot = at[:0], row[:0], slot[:0]
    for _ in range(depth):
        if not len(at):
            break
        all_n, all_pos = n[-1][at].astype(np.float64), pos[-1][at].astype(np.float64)
        before_n, before_pos = np.cumsum(all_n) - all_n, np.cumsum(all_pos) - all_pos
        drawn = _drawn(draw, len(at), width - 1, some)
        best, best_feature, best_cut = np.zeros(len(at)), np.full(len(at), -1), np.zeros(len(at), np.int64)
        kind = np.uint32 if len(at) < 1 << 22 else np.uint64  # 22 bits of a node, 5 of a code and 5 of the times and the label
        start, key = row * width, slot.astype(kind) << kind(10) | times[row].astype(kind)
        same = slot[1:] == slot[:-1]
        for j in range(drawn.shape[1]):
            found = np.sort(key | flat[start + drawn[slot, j]].astype(kind) << kind(5))
            coded = found >> kind(5)
            last = np.flatnonzero(same & (coded[1:] != coded[:-1]))  # the last row of its code, with others of the node behind it
            if not len(last):
                continue
            low = found.astype(np.uint8) & 31
            many = low >> 1
            k = slot[last]
            gain = _gain(np.cumsum(many, dtype=np.int64)[last] - before_n[k], np.cumsum(many * (low & 1), dtype=np.int64)[last] - before_pos[k], all_n[k], all_pos[k])
            firsts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            most, nodes = np.maximum.reduceat(gain, firsts), k[firsts]
            tops = np.flatnonzero(gain == np.repeat(most, np.diff(np.append(firsts, len(k)))))
            tops = tops[np.concatenate(([True], k[tops[1:]] != k[tops[:-1]]))]
            better = most > best[nodes]
            nodes = nodes[better]
            best[nodes], best_feature[nodes], best_cut[nodes] = most[better], drawn[nodes, j], coded[last[tops[better]]] & kind(31)
        parted = np.flatnonzero(best_feature >= 0)
        if not len(parted):
            break
        feature[-1][at[parted]], cut[-1][at[parted]] = best_feature[parted], best_cut[parted]
        left[-1][at[parted]] = size + 2 * np.arange(len(parted))
        child = np.full(len(at), -1)
        child[parted] = 2 * np.arange(len(parted))
        some_rows = np.flatnonzero(child[slot] >= 0)
        row, slot = row[some_rows], slot[some_rows]
        child = child[slot] + (flat[row * width + best_feature[slot]] > best_cut[slot])
        many = own[row] >> 1
        level_n = np.bincount(child, many, 2 * len(parted)).astype(np.int64)
        level_pos = np.bincount(child, many * (own[row] & 1), 2 * len(parted)).astype(np.int64)
        for values, new in ((feature, np.full(len(level_n), -1)), (cut, np.zeros(len(level_n), np.int64)), (left, np.zeros(len(level_n), np.int64)), (n, level_n), (pos, level_pos)):
            values.append(new)
        size += len(level_n)
        opened = (level_pos > 0) & (level_pos < level_n)
        at, place = np.flatnonzero(opened), np.cumsum(opened) - 1
        still = np.flatnonzero(opened[child])
        order = np.sort(place[child[still]] << 32 | row[still])
        row, slot = order & 0xFFFFFFFF, order >> 32
    return _pruned(feature, cut, left, n, pos)


def _pruned(feature: list, cut: list, left: list, n: list, pos: list) -> np.ndarray:
    """The nodes, of all levels one after the other, without pairs of leaves that give one answer."""
    edges = np.cumsum([0, *map(len, feature)])
    feature, cut, left, n, pos = map(np.concatenate, (feature, cut, left, n, pos))
    answer = 2 * pos > n
    for start, end in zip(edges[-2::-1].tolist(), edges[:0:-1].tolist(), strict=True):
        at = start + np.flatnonzero(feature[start:end] >= 0)
        low, high = left[at], left[at] + 1
        feature[at[(feature[low] < 0) & (feature[high] < 0) & (answer[low] == answer[high])]] = -1
    alive = np.zeros(len(feature), bool)
    alive[0] = True
    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        at = start + np.flatnonzero((feature[start:end] >= 0) & alive[start:end])
        alive[left[at]] = alive[left[at] + 1] = True
    place = np.cumsum(alive) - 1
    out = np.zeros(int(alive.sum()), _NODE)
    out["feature"], out["cut"], out["left"], out["score"] = feature[alive], cut[alive], np.where(feature >= 0, place[left], 0)[alive], (pos / np.maximum(n, 1))[alive]
    return out


def _scores(nodes: np.ndarray, columns: np.ndarray) -> np.ndarray:
    left = nodes["left"].astype(np.int64)
    return nodes["score"][routed(nodes["feature"], nodes["cut"].astype(np.int64) + 1, left, left + 1, columns)]


# ------------------------------------------------------------------ fitting

@dataclass(frozen=True)
class _Plan:
    """A tree to be grown: the model it belongs to, its number there, how many features a node draws, and how deep it may get."""

    model: int
    seed: int
    number: int
    some: int
    depth: int

    def draw(self, *place: int) -> np.random.Generator:
        return np.random.default_rng([self.seed, self.number, *place])


class _Top(Tree):
    """The top of a tree, with the rows and positive rows of its nodes."""

    def __init__(self):
        super().__init__()
        self.counts: dict[int, tuple[float, float]] = {}

    def score(self, node: int) -> float:
        n, pos = self.counts[node]
        return pos / n

    def prune(self, ends: dict[int, bool]) -> None:
        """``ends`` has the answers of the leaves; pairs of them that give one answer become one."""
        for node in reversed(range(len(self.feature))):  # children come after their node
            sides = (self.left[node], self.right[node])
            if self.feature[node] >= 0 and all(s in ends for s in sides) and ends[sides[0]] == ends[sides[1]]:
                self.feature[node] = -1
                n, pos = self.counts[node]
                ends[node] = 2 * pos > n

    def routes(self) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, _ = self.arrays()
        return feature, cut + 1, left, right


def fit_forests(rows: DataFrame, models: Sequence[tuple[Mapping, int]]) -> Forests:
    """A forest for each of ``models`` (parameters and seed) over all ``rows``: ``n_estimators``, ``max_features`` (a share), ``max_depth``."""
    known = [c(n) for n in rows.columns if n != FEATURES]
    x = vector_to_array(FEATURES)
    flat = rows.select(F.lit(0).cast("long").alias("bucket"), c(LABEL).cast("int").alias("y"), F.xxhash64(*known, x).alias("key"), x.alias("x"))
    cuts = learn_cuts(flat)
    plans = [_Plan(i, seed, t, min(len(cuts), math.ceil(float(p["max_features"]) * len(cuts))), int(float(p.get("max_depth", TREE_DEPTH))))
             for i, (p, seed) in enumerate(models) for t in range(int(float(p["n_estimators"])))]
    blocks = keep(_blocks(flat, cuts), "forest-rows")
    tops, handed = _tops(blocks, plans, len(cuts))
    grown = keep(_subtrees(blocks, plans, tops, handed, len(cuts)), "forest-trees")
    forget(blocks)
    ends: dict[int, dict[int, bool]] = {g: {} for g in range(len(plans))}
    for g, top in enumerate(tops):
        for node, f in enumerate(top.feature):
            if f < 0 and (g, node) not in handed:
                ends[g][node] = 2 * top.counts[node][1] > top.counts[node][0]
    for r in grown.where("leaf").select("tree", "node", "answer").collect():
        ends[r["tree"]][r["node"]] = r["answer"]
    for top, own in zip(tops, ends.values(), strict=True):
        top.prune(own)
    return Forests(cuts, plans, tops, handed, grown.select("tree", "node", "data"))


def _blocks(flat: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """The rows as blocks of bytes: labels, keys, and codes row by row."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                row = (0, len(b), b.column("y").to_numpy().astype(np.uint8).tobytes(), b.column("key").to_numpy().astype(np.int64).tobytes(), _coded(matrix(b.column("x")), cuts).tobytes())
                yield _record(("bucket", "n", "y", "keys", "codes"), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), [row])
    return flat.mapInArrow(packed, "bucket long, n long, y binary, keys binary, codes binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(codes, labels, keys) of each block."""
    for n, y, keys, codes in zip(*(batch.column(k).to_pylist() for k in ("n", "y", "keys", "codes")), strict=True):
        yield np.frombuffer(codes, np.uint8).reshape(n, -1), np.frombuffer(y, np.uint8), np.frombuffer(keys, np.int64)


def _tops(blocks: DataFrame, plans: list[_Plan], features: int) -> tuple[list[_Top], dict[tuple[int, int], int]]:
    """The tops of the trees, and for the nodes (tree, node) below which a task goes on how deep it may get there."""
    rows = blocks.agg(F.sum("n").alias("n")).first()["n"] or 0
    tops = [_Top() for _ in plans]
    small = rows <= SUBTREE_ROWS
    handed = {(g, 0): p.depth for g, p in enumerate(plans) if small}
    frontier = {} if small else {g: [0] for g in range(len(plans))}
    level = 0
    while frontier:
        found = _top_splits(blocks, plans, tops, frontier, features).collect()
        frontier = {}
        for r in sorted(found, key=lambda r: (r["model"], r["slot"])):
            g, node = r["model"], r["slot"]
            tops[g].counts[node] = (r["n"], r["pos"])
            if r["feature"] < 0:
                continue
            sides = tops[g].part(node, r["feature"], r["cut"])
            for child, n, pos in zip(sides, (r["left_n"], r["n"] - r["left_n"]), (r["left_pos"], r["pos"] - r["left_pos"]), strict=True):
                tops[g].counts[child] = (n, pos)
                if not 0 < pos < n or level + 1 >= plans[g].depth:
                    continue
                if n <= SUBTREE_ROWS:
                    handed[g, child] = plans[g].depth - level - 1
                else:
                    frontier.setdefault(g, []).append(child)
        level += 1
    return tops, handed


def _placed(routes: Mapping[int, tuple[np.ndarray, ...]], wanted: Mapping[int, Sequence[int]], plans: list[_Plan], columns: np.ndarray, keys: np.ndarray):
    """(tree, the rows that it has at wanted nodes, which of them, and how often each row enters)."""
    drawn: dict[tuple[int, int], np.ndarray] = {}
    for g, nodes in wanted.items():
        own = (plans[g].seed, plans[g].number)
        if own not in drawn:
            drawn[own] = _times(keys, *own)
        place = np.full(len(routes[g][0]), -1)
        place[list(nodes)] = np.arange(len(nodes))
        slot = place[routed(*routes[g], columns)]
        at = np.flatnonzero((slot >= 0) & (drawn[own] > 0))
        yield g, at, slot[at], drawn[own][at]


def _top_splits(blocks: DataFrame, plans: list[_Plan], tops: list[_Top], frontier: Mapping[int, list[int]], features: int) -> DataFrame:
    """The best cut of each open node; feature -1 where none gains."""
    routes = {g: tops[g].routes() for g in frontier}
    drawn = {g: np.concatenate([_drawn(plans[g].draw(0, node), 1, features, plans[g].some) for node in nodes]) for g, nodes in frontier.items()}

    def add(bucket: int, batch: pa.RecordBatch):
        for codes, y, keys in _unpacked(batch):
            columns = np.ascontiguousarray(codes.T)
            for g, at, slot, times in _placed(routes, frontier, plans, columns, keys):
                some, size = drawn[g].shape[1], len(frontier[g]) * BINS
                sums = np.zeros((len(frontier[g]), 2, some, BINS))
                positive = times * y[at]
                for j in range(some):
                    places = columns[drawn[g][slot, j], at] + slot * BINS
                    for i, values in enumerate((times, positive)):
                        sums[:, i, j] = np.bincount(places, values, size).reshape(-1, BINS)
                for i, node in enumerate(frontier[g]):
                    yield g, node, sums[i].ravel()

    def finish(bucket: int, model: int, slot: int, sums: np.ndarray):
        own = drawn[model][frontier[model].index(slot)]
        count, positive = sums.reshape(2, len(own), BINS)
        n, pos = count[0].sum(), positive[0].sum()
        left_n, left_pos = np.cumsum(count, axis=1), np.cumsum(positive, axis=1)
        both = (left_n > 0) & (left_n < n)
        gain = np.zeros(both.shape)
        gain[both] = _gain(left_n[both], left_pos[both], n, pos)
        j, cut = np.unravel_index(int(gain.argmax()), gain.shape)
        return int(own[j]) if gain[j, cut] > 0 else -1, int(cut), float(n), float(pos), float(left_n[j, cut]), float(left_pos[j, cut])

    return _summed(blocks, add, finish, "bucket long, model int, slot int, feature int, cut int, n double, pos double, left_n double, left_pos double")


class _Held:
    """Blocks of rows by where they go, handed on as one piece each."""

    def __init__(self, names: Sequence[str], types: Sequence[pa.DataType]):
        self.names, self.types, self.rows, self.size = names, types, {}, 0

    def add(self, key: tuple, *parts: np.ndarray) -> None:
        self.rows.setdefault(key, []).append(parts)
        self.size += sum(p.nbytes for p in parts)

    def handed(self) -> pa.RecordBatch:
        out = _record(self.names, self.types, [(*k, *(b"".join(p.tobytes() for p in column) for column in zip(*v, strict=True))) for k, v in self.rows.items()])
        self.rows, self.size = {}, 0
        return out


def _subtrees(blocks: DataFrame, plans: list[_Plan], tops: list[_Top], handed: Mapping[tuple[int, int], int], features: int) -> DataFrame:
    """(tree, node, leaf, answer, data): the nodes below each handed node; ``leaf`` where there is none but itself."""
    wanted: dict[int, list[int]] = {}
    for g, node in sorted(handed):
        wanted.setdefault(g, []).append(node)
    routes = {g: tops[g].routes() for g in wanted}

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(("tree", "node", "rows"), (pa.int32(), pa.int32(), pa.binary()))
        for batch in batches:
            for codes, y, keys in _unpacked(batch):
                for g, at, slot, times in _placed(routes, wanted, plans, np.ascontiguousarray(codes.T), keys):
                    order = np.argsort(slot, kind="stable")
                    at, slot = at[order], slot[order]
                    rows = np.concatenate((codes[at], (times[order] << 1 | y[at])[:, None]), axis=1)
                    for own, start, end in runs_of(slot):
                        held.add((g, wanted[g][own]), rows[start:end])
                if held.size > FLUSH:
                    yield held.handed()
        yield held.handed()

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            g, node = key
            nodes = grow(np.frombuffer(b"".join(parts), np.uint8).reshape(-1, features + 1), plans[g].some, handed[key], plans[g].draw(1, node))
            row = (g, node, len(nodes) == 1, bool(nodes["score"][0] > 0.5), nodes.tobytes())
            return _record(("tree", "node", "leaf", "answer", "data"), (pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()), [row])

        key, parts = None, []
        for batch in batches:
            for g, node, rows in zip(*(batch.column(n).to_pylist() for n in ("tree", "node", "rows")), strict=True):
                if (g, node) != key:
                    if key is not None:
                        yield done()
                    key, parts = (g, node), []
                parts.append(rows)
        if key is not None:
            yield done()

    pieces = blocks.mapInArrow(sent, "tree int, node int, rows binary").repartition(max(1, min(len(handed), SUBTREE_TASKS)), "tree", "node")
    return pieces.sortWithinPartitions("tree", "node").mapInArrow(grown, "tree int, node int, leaf boolean, answer boolean, data binary")


# ------------------------------------------------------------------ scoring

@dataclass
class Forests:
    """Forests over the same features: the tops of the trees, and a table (tree, node, data) of what is below their nodes."""

    cuts: list[np.ndarray]
    plans: list[_Plan]
    tops: list[_Top]
    handed: Mapping[tuple[int, int], int]
    below: DataFrame

    def score(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows without their features, and as ``name`` an array of the score of each model: the mean over its trees of the share of positives.

        A row goes to a task for each of its trees, and what the trees say of a block of rows is added up by another.
        """
        own = [n for n in rows.columns if n != FEATURES]
        flat = rows.select(*[c(n) for n in own], F.monotonically_increasing_id().alias("__id"), vector_to_array(FEATURES).alias("__x"))
        made = T.StructType([*[flat.schema[n] for n in (*own, "__id")], T.StructField("__codes", T.BinaryType())])
        cuts = self.cuts

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes = _coded(matrix(b.column("__x")), cuts)
                yield pa.RecordBatch.from_arrays([*b.select([*own, "__id"]).columns, pa.array([r.tobytes() for r in codes], pa.binary())], [*own, "__id", "__codes"])

        written = keep(flat.mapInArrow(coded, made), "forest-scored")  # so that ids hold
        return written.drop("__codes").join(self._summed(written.select("__id", "__codes"), name), "__id").drop("__id")

    def _trees(self, spark) -> DataFrame:
        """What a row meets where it ends in the top of a tree: nodes below, or one leaf."""
        leaves = [(g, node, np.array([(-1, 0, 0, top.score(node))], _NODE).tobytes())
                  for g, top in enumerate(self.tops) for node, f in enumerate(top.feature) if f < 0 and (g, node) not in self.handed]
        return self.below.unionByName(spark.createDataFrame(leaves, self.below.schema)) if leaves else self.below

    def _summed(self, coded: DataFrame, name: str) -> DataFrame:
        routes, features = [top.routes() for top in self.tops], len(self.cuts)
        model_of = [p.model for p in self.plans]
        trees = np.bincount(model_of)

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = _Held(("tree", "node", "block", "kind", "places", "data"), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))
            for batch in batches:
                ids = batch.column("__id").to_numpy()
                codes = np.frombuffer(b"".join(batch.column("__codes").to_pylist()), np.uint8).reshape(len(ids), -1)
                for block, first, last in runs_of(ids >> BLOCK):
                    part, places = codes[first:last], (ids[first:last] & (1 << BLOCK) - 1).astype(np.uint16)
                    columns = np.ascontiguousarray(part.T)
                    for g, route in enumerate(routes):
                        nodes = routed(*route, columns)
                        order = np.argsort(nodes, kind="stable")
                        for node, start, end in runs_of(nodes[order]):
                            held.add((g, node, block, 1), places[order[start:end]], part[order[start:end]])
                if held.size > FLUSH:
                    yield held.handed()
            yield held.handed()

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nodes = None
            for batch in batches:
                out, pieces = [], []

                def done() -> None:  # pieces of a node are scored as one
                    codes = np.frombuffer(b"".join(data for _, _, _, data in pieces), np.uint8).reshape(-1, features)
                    scores, start = _scores(nodes, np.ascontiguousarray(codes.T)), 0
                    for g, block, places, data in pieces:
                        end = start + len(data) // features
                        out.append((block, g, places, scores[start:end].tobytes()))
                        start = end
                    pieces.clear()

                for g, block, kind, places, data in zip(*(batch.column(n).to_pylist() for n in ("tree", "block", "kind", "places", "data")), strict=True):
                    if kind == 1:
                        pieces.append((g, block, places, data))
                        continue
                    if pieces:
                        done()
                    nodes = np.frombuffer(data, _NODE)
                if pieces:
                    done()
                yield _record(("block", "tree", "places", "scores"), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), out)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def done() -> pa.RecordBatch:
                at = np.flatnonzero(seen)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(trees), pa.int32()), pa.array((sums[at] / trees).ravel()))
                return pa.RecordBatch.from_arrays([pa.array((own << BLOCK) + at), values], ["__id", name])

            own, sums, seen = None, None, None
            for batch in batches:
                for block, g, places, scores in zip(*(batch.column(n).to_pylist() for n in ("block", "tree", "places", "scores")), strict=True):
                    if block != own:
                        if own is not None:
                            yield done()
                        own, sums, seen = block, np.zeros((1 << BLOCK, len(trees))), np.zeros(1 << BLOCK, bool)
                    at = np.frombuffer(places, np.uint16)
                    sums[at, model_of[g]] += np.frombuffer(scores, np.float64)
                    seen[at] = True
            if own is not None:
                yield done()

        kept = self._trees(coded.sparkSession).select("tree", "node", F.lit(-1).cast("long").alias("block"), F.lit(0).alias("kind"), F.lit(b"").alias("places"), "data")
        rows = coded.mapInArrow(sent, "tree int, node int, block long, kind int, places binary, data binary").unionByName(kept)
        parts = max(1, min(len(self.handed), SUBTREE_TASKS))
        scored = rows.repartition(parts, "tree", "node").sortWithinPartitions("tree", "node", "kind", "block").mapInArrow(met, "block long, tree int, places binary, scores binary")
        return scored.repartition("block").sortWithinPartitions("block", "tree").mapInArrow(added, f"__id long, `{name}` array<double>")

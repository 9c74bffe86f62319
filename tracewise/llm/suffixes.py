"""Repeated byte strings across documents, by merging Burrows-Wheeler transforms.

Every byte that a string of 200 bytes covers which starts anywhere else too is removed. Copies of whole texts are found by their hash and
only one of each is looked at. In the others a window of 200 bytes is known by its anchor, the run of 32 bytes in it with the least
hash, which depends on the bytes of the window alone: equal windows have equal anchors at the same place. Anchors are
counted; one that comes once can't be in a repeated window. Runs of windows of the other anchors go, with their bytes, to
the task of their anchor, so each task has all that could be equal.

There the runs are strings aligned at their anchor, cut into shards. A shard's transform holds for each column
the bytes in the order of what follows them. The transforms are merged from the last column to the first: the
interleave of the shards for one column is refined by the bytes before it in one stable counting pass, which sorts all
by one byte more, without sorting suffixes again; the same pass gives the common prefix of neighbours, the byte added to the
least common prefix between their former places. Where it reaches 200, both neighbours are repeated.

An anchor with more than ``hot`` occurrences isn't brought to one task: its windows are spread by a 128-bit hash of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm.bloom import Bloom, bloom
from tracewise.llm.words import blobs, mixed, text_batches
from tracewise.session import keep

LENGTH = 200
GRAM = 32
SHARD = 4096
BLOCK = 32768
HOT = BLOCK
EDGE = 64
_PIECE, _BUFFER = 1 << 20, 1 << 19
_POSITION = (1 << 24) - 1


# ------------------------------------------------------------------ windows and anchors

class Rolling:
    """Hashes of all runs of a length at once, from sums of powers modulo 2**64."""

    def __init__(self, seed: int, room: int = _PIECE + 2 * _BUFFER):
        rng = np.random.default_rng(seed)
        base = int(rng.integers(1 << 60, 1 << 62)) * 4 + 3
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.power, self.inverse = _powers(base, room), _powers(pow(base, -1, 1 << 64), room)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[:len(data)], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, length: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        first, last = sums[:len(sums) - length], sums[length:]
        return mixed((last[at] - first[at]) * self.inverse[:len(first)][at])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row."""
    n = len(x) - width + 1
    room = -len(x) % width
    blocks = np.concatenate((x, np.full(room, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


class Runs:
    """Runs of windows with the same anchor in a buffer: first and last start, anchor, hash, and the piece they are in."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, gram: int, rolling: Rolling):
        width = length - gram + 1
        self.sums = rolling.sums(data)
        grams = rolling.runs(self.sums, gram)
        place = np.arange(len(grams), dtype=np.uint64)
        top = grams & ~np.uint64(_POSITION)
        windows = np.arange(len(grams) - width + 1)
        left = (sliding_min(top | place, width) & np.uint64(_POSITION)).astype(np.int64)
        right = _POSITION - (sliding_min(top | (np.uint64(_POSITION) - place), width) & np.uint64(_POSITION)).astype(np.int64)
        # of equal runs of bytes in a window the one at the end of their row, if the window shows it: it stays the same for many windows
        edge = min(EDGE, width // 3)
        anchor = np.where((left - windows < edge) & (right - windows <= width - 1 - edge), right, left)
        some = sizes >= length
        count = (sizes - length + 1)[some]
        self.piece = np.repeat(np.flatnonzero(some), count)
        at = np.repeat(starts[some] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        anchor = anchor[at]
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (self.piece[1:] != self.piece[:-1])))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(at)])) - 1
        self.low, self.high, self.anchor, self.piece = at[first], at[last], anchor[first], self.piece[first]
        self.hash = grams[self.anchor]


def buffers(rows: list, texts: list[bytes], length: int) -> Iterator[tuple[bytes, list, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row of each piece, its start in the bytes, its size, its offset in the text); long texts come in pieces
    that overlap by all but one byte of a window, so each window is in one piece."""
    held: list[tuple[bytes, object, int]] = []
    total = 0
    for row, text in zip(rows, texts, strict=True):
        for at in range(0, len(text) - length + 1, _PIECE):
            held.append((text[at:at + _PIECE + length - 1], row, at))
            total += len(held[-1][0])
            if total >= _BUFFER:
                yield _joined(held)
                held, total = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    sizes = np.array([len(p) for p, _, _ in held])
    return b"".join(p for p, _, _ in held), [r for _, r, _ in held], np.cumsum(sizes) - sizes, sizes, np.array([a for _, _, a in held])


def _anchors(length: int, gram: int, reps: Bloom):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(1)
        for b in batches:
            rows, texts = _represented(b, reps)
            for data, _, starts, sizes, _ in buffers(rows, texts, length):
                found, times = np.unique(Runs(np.frombuffer(data, np.uint8), starts, sizes, length, gram, rolling).hash, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], ["hash", "n"])
    return anchors


def _represented(b: pa.RecordBatch, reps: Bloom) -> tuple[list, list[bytes]]:
    rows = b.column("row").to_numpy()
    stay = reps.has(rows.view(np.uint64))
    return rows[stay].tolist(), [t for t, s in zip(blobs(b), stay.tolist(), strict=True) if s]


_RUN_SCHEMA = "hash long, row long, low long, high long, left int, bytes binary"
_RUN_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
_RUN_NAMES = ["hash", "row", "low", "high", "left", "bytes"]


def _contexts(length: int, gram: int, reps: Bloom, again: Bloom, hot: Bloom):
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of repeated anchors with their bytes. Equal runs of a buffer prove each other: all are sent as known (no
        bytes), and one goes on without a row, for runs elsewhere."""
        rolling = Rolling(1)
        for b in batches:
            rows, texts = _represented(b, reps)
            for data, names, starts, sizes, offsets in buffers(rows, texts, length):
                runs = Runs(np.frombuffer(data, np.uint8), starts, sizes, length, gram, rolling)
                some = np.flatnonzero(again.has(runs.hash) & ~hot.has(runs.hash))
                hashes, base = runs.hash.view(np.int64)[some].tolist(), (offsets - starts)[runs.piece[some]].tolist()
                places = zip(hashes, runs.piece[some].tolist(), base, runs.low[some].tolist(), runs.high[some].tolist(),
                             (runs.anchor - runs.low)[some].tolist(), strict=True)
                groups: dict[tuple[int, bytes], list] = {}
                for h, piece, shift, low, high, left in places:
                    groups.setdefault((left, data[low:high + length]), []).append((h, names[piece], low + shift, high + shift))
                out = []
                for (left, text), same in groups.items():
                    if len(same) == 1:
                        out.append((*same[0], left, text))
                    else:
                        out.append((same[0][0], None, 0, same[0][3] - same[0][2], left, text))
                        out.extend((*one, None, None) for one in same)
                columns = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _RUN_TYPES, strict=True)], _RUN_NAMES)
    return contexts


# ------------------------------------------------------------------ transforms and their merge

class Shard:
    """Transform of aligned strings: for each column the bytes (as 1 to 256, 0 for none) in the order of what follows."""

    def __init__(self, text: np.ndarray):
        rows, columns = text.shape
        self.bytes = np.empty((columns, rows), np.uint16)
        self.order = np.empty((columns, rows), np.uint16 if rows <= 1 << 16 else np.int32)  # rows in the order of what starts at the column
        order = np.arange(rows)
        for j in range(columns - 1, -1, -1):
            own = self.bytes[j] = text[order, j]
            order = self.order[j] = order[np.argsort(own, kind="stable")]


def repeated(text: np.ndarray, length: int, starts: int, shard: int = SHARD) -> np.ndarray:
    """(rows, starts): whether the ``length`` bytes of a row from a column on are those of another row, too."""
    rows, columns = text.shape
    cuts = list(range(0, rows, shard))
    shards = [Shard(text[a:a + shard]) for a in cuts]
    source = np.repeat(np.arange(len(cuts), dtype=np.uint16), [min(shard, rows - a) for a in cuts])  # shard at each merged place
    common = np.zeros(rows + 1, np.int32)  # common prefix of a place and the one before
    out = np.zeros((rows, starts), bool)
    merged, names = np.empty(rows, np.uint16), np.empty(rows, np.int64)
    for j in range(columns - 1, -1, -1):
        merged[np.argsort(source, kind="stable")] = np.concatenate([s.bytes[j] for s in shards])
        step = np.argsort(merged, kind="stable")
        source, own = source[step], merged[step]
        same = np.flatnonzero((own[1:] == own[:-1]) & (own[1:] > 0)) + 1
        fresh = np.zeros(rows + 1, np.int32)
        if len(same):
            between = np.empty(2 * len(same), np.int64)
            between[0::2], between[1::2] = step[same - 1] + 1, step[same] + 1
            fresh[same] = 1 + np.minimum.reduceat(common, between)[::2]
        common = fresh
        if j < starts:
            hit = common[:-1] >= length
            hit |= common[1:] >= length
            if hit.any():
                names[np.argsort(source, kind="stable")] = np.concatenate([a + s.order[j].astype(np.int64) for a, s in zip(cuts, shards, strict=True)])
                out[names[hit], j] = True
    return out


def flagged(low: np.ndarray, high: np.ndarray, left: np.ndarray, texts: list[bytes], length: int, gram: int, shard: int):
    """(index, first start, last start) of the windows of the given runs that are repeated among them."""
    most = length - gram  # bytes of a window before its anchor
    sizes = np.array([len(t) for t in texts])
    text = np.zeros((len(texts), most + length), np.uint16)
    row = np.repeat(np.arange(len(texts)), sizes)
    column = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(most - left, sizes)
    text[row, column] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
    hit = np.zeros((len(texts), most + 3), np.int8)
    hit[:, 1:-1] = repeated(text, length, most + 1, shard)
    edge = np.diff(hit, axis=1)
    (which, first), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    shift = (low - (most - left))[which]
    return which, first + shift, end - 1 + shift


def _merged(length: int, gram: int, shard: int, block: int):
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row, low, high): starts of repeated windows, from runs sorted by hash; a hash is never cut between two blocks."""
        held: list[pa.Table] = []
        waiting = 0

        def done(table: pa.Table) -> pa.RecordBatch:
            hashes = table.column("hash").to_numpy()
            _, at, times = np.unique(hashes, return_inverse=True, return_counts=True)
            table = table.filter(pa.array(times[at] > 1))
            if not table.num_rows:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["row", "low", "high"])
            which, first, last = flagged(table.column("low").to_numpy(), table.column("high").to_numpy(), table.column("left").to_numpy(),
                                         table.column("bytes").to_pylist(), length, gram, shard)
            rows = table.column("row").combine_chunks().take(pa.array(which))
            out = pa.table([rows, pa.array(first), pa.array(last)], ["row", "low", "high"])
            return out.filter(out.column("row").is_valid()).combine_chunks().to_batches()[0] if out.num_rows else out.to_batches()[0]

        for b in batches:
            known = b.column("bytes").is_null()
            table = pa.Table.from_batches([b])
            yield from table.filter(known).select(["row", "low", "high"]).to_batches()
            table = table.filter(pa.array(~known.to_numpy(zero_copy_only=False)))
            held.append(table)
            waiting += table.num_rows
            if waiting >= block:
                whole = pa.concat_tables(held)
                hashes = whole.column("hash").to_numpy()
                cut = int(np.searchsorted(hashes, hashes[-1]))
                held, waiting = [whole.slice(cut)], whole.num_rows - cut
                if cut:
                    yield done(whole.slice(0, cut))
        if waiting:
            yield done(pa.concat_tables(held))
    return merged


# ------------------------------------------------------------------ anchors that are everywhere

def _hot_windows(length: int, gram: int, reps: Bloom, hot: Bloom):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, row, low, high): hashes of a window that is alone in its buffer; equal ones of a buffer prove each other,
        so they are sent as runs without hashes, and one of them goes on without a row."""
        rolling, other = Rolling(1), Rolling(2)
        for batch in batches:
            rows, texts = _represented(batch, reps)
            for data, names, starts, sizes, offsets in buffers(rows, texts, length):
                values = np.frombuffer(data, np.uint8)
                runs = Runs(values, starts, sizes, length, gram, rolling)
                some = np.flatnonzero(hot.has(runs.hash))
                if not len(some):
                    continue
                count = runs.high[some] - runs.low[some] + 1
                at = np.repeat(runs.low[some] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                piece = np.repeat(runs.piece[some], count)
                a, b = rolling.runs(runs.sums, length, at), other.runs(other.sums(values), length, at)
                _, first, where, times = np.unique(np.stack((a, b)), axis=1, return_index=True, return_inverse=True, return_counts=True)
                alone, partner = np.flatnonzero(times[where.ravel()] == 1), first[times > 1]
                row, start = np.array(names, np.int64)[piece], (offsets - starts)[piece] + at
                known = np.flatnonzero(times[where.ravel()] > 1)
                known = known[np.lexsort((at[known], piece[known]))]
                new = np.concatenate(([True], (at[known][1:] != at[known][:-1] + 1) | (piece[known][1:] != piece[known][:-1]))) if len(known) else known > 0
                low = known[new]
                high = known[np.concatenate((np.flatnonzero(new)[1:], [len(known)])) - 1] if len(known) else known
                n = (len(alone), len(partner), len(low))
                sent = np.concatenate((alone, partner, low))
                nobody, unhashed = np.repeat([False, True, False], n), np.repeat([False, False, True], n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[sent].view(np.int64), mask=unhashed), pa.array(b[sent].view(np.int64), mask=unhashed), pa.array(row[sent], mask=nobody),
                     pa.array(start[sent]), pa.array(np.concatenate((start[alone], start[partner], start[high])))], ["a", "b", "row", "low", "high"])
    return windows


def _same_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, low, high) of windows with an equal neighbour, from rows sorted by both hashes; holds a row between batches."""
    before: tuple | None = None  # (a, b, row or None, start, sent already)
    for batch in batches:
        a, b, start = (batch.column(c).to_numpy() for c in ("a", "b", "low"))
        row, named = batch.column("row").fill_null(0).to_numpy(), ~batch.column("row").is_null().to_numpy(zero_copy_only=False)
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        hit = np.zeros(len(a), bool)
        hit[1:] |= same
        hit[:-1] |= same
        late = []
        if before and len(a) and before[0] == a[0] and before[1] == b[0]:
            hit[0] = True
            if before[2] is not None and not before[4]:
                late.append((before[2], before[3]))
        if len(a):
            before = (a[-1], b[-1], int(row[-1]) if named[-1] else None, int(start[-1]), bool(hit[-1]))
        hit &= named
        rows = np.concatenate((row[hit], np.array([r for r, _ in late], np.int64)))
        at = np.concatenate((start[hit], np.array([s for _, s in late], np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(at), pa.array(at)], ["row", "low", "high"])


# ------------------------------------------------------------------ on Spark

def repeated_windows(rows: DataFrame, reps: Bloom, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(row, low, high): first and last start of runs of repeated windows in the texts (row, text) that ``reps`` may have."""
    counted = rows.mapInArrow(_anchors(length, gram, reps), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    counted = keep(counted.where("n > 1"), "anchors")
    often = counted.where(F.col("n") > hot)
    again, everywhere = bloom(counted, counted.count()), bloom(often, often.count())
    runs = rows.mapInArrow(_contexts(length, gram, reps, again, everywhere), _RUN_SCHEMA)
    found = runs.repartition("hash").sortWithinPartitions("hash").mapInArrow(_merged(length, gram, shard, block), "row long, low long, high long")
    if len(everywhere.bits):
        windows = rows.mapInArrow(_hot_windows(length, gram, reps, everywhere), "a long, b long, row long, low long, high long")
        windows = keep(windows, "windows")
        known = windows.where("a is null").select("row", "low", "high")
        others = windows.where("a is not null").select("a", "b", "row", "low").repartition("a").sortWithinPartitions("a", "b")
        found = found.union(known).union(others.mapInArrow(_same_windows, "row long, low long, high long"))
    return found


def removed(spans: list[tuple[int, int]], size: int, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows with the given first and last starts cover."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high + length)
        else:
            out.append([low, high + length])
    return [(a, min(b, size)) for a, b in out]


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row of ``docs`` (doc_id, text, any more columns).

    ``kept`` are the remaining bytes. A null text is empty. Rows that repeat remove each other's bytes like any copies, whatever
    their ids. Texts shorter than ``length`` keep all, and an empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    own = keep(rows.select("row", F.md5(F.col("text").cast("binary")).alias("content")), "contents")
    groups = own.groupBy("content").agg(F.min("row").alias("rep"), F.count("*").alias("n"))
    groups = keep(groups, "contents")
    reps = bloom(groups.select("rep"), groups.count())
    found = repeated_windows(rows.select("row", "text"), reps, length, gram, hot, shard, block)
    copies = own.join(groups.where("n > 1").select("content"), "content").select("row", F.lit(-1).cast("long").alias("low"), F.lit(-1).cast("long").alias("high"))
    touched = found.union(copies.distinct()).groupBy("row").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    touched = keep(touched, "spans")  # of one text each
    maybe = bloom(touched, touched.count())

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            more = maybe.has(b.column("row").to_numpy().view(np.uint64))
            texts = b.column("text")
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), pa.array([len(t) for t in blobs(b)], pa.int64()),
                 pa.array([None if m else hashlib.sha256(t).hexdigest() for m, t in zip(more.tolist(), blobs(b), strict=True)], pa.string()), texts],
                ["row", "doc_id", "n_bytes", "kept_sha256", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, spans in zip(blobs(b), b.column("spans").to_pylist(), strict=True):
                found = [(s["low"], s["high"]) for s in spans or ()]
                if (-1, -1) in found:  # a copy of a whole text
                    gone = [(0, len(data))] if len(data) >= length else []
                else:
                    gone = removed(found, len(data), length)
                at, stay = 0, []
                for a, e in gone:
                    stay.append(data[at:a])
                    at = e
                rest = b"".join([*stay, data[at:]])
                out.append((sum(e - a for a, e in gone), len(gone), hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*out, strict=True)) or [()] * 4
            arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string(), pa.binary()], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *arrays], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    schema = "row long, doc_id long, n_bytes long, kept_sha256 string, text string"
    marked = rows.mapInArrow(parted, schema)
    whole = marked.where("kept_sha256 is not null").select(
        "doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256", F.col("text").cast("binary").alias("kept"))
    rest = marked.where("kept_sha256 is null").select("row", "doc_id", "n_bytes", "text").join(touched, "row", "left")
    rest = rest.select("doc_id", "n_bytes", "text", "spans").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return whole.union(rest)

"""A bit set of bounded size that says for a 64-bit number "surely not in the table" or "maybe"."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 22, 28  # bits of a position: 512 KB to 32 MB
EACH = 32  # bits of the set for each number
BLOCK = 16  # bits of a position within a block
PROBES = 4
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Bloom:
    def __init__(self, width: int, bits: np.ndarray):
        self.width, self.bits = width, bits

    def __contains__(self, value: int) -> bool:
        return bool(self.has(np.array([value & (1 << 64) - 1], np.uint64))[0])

    def has(self, values: np.ndarray) -> np.ndarray:
        """Of unsigned 64-bit numbers, which may be in the table."""
        if not len(self.bits):
            return np.zeros(len(values), bool)
        found = self._probe(values, 0)
        rest = np.flatnonzero(found)
        for i in range(1, PROBES):
            rest = rest[self._probe(values[rest], i)]
        found[:] = False
        found[rest] = True
        return found

    def _probe(self, values: np.ndarray, i: int) -> np.ndarray:
        at = place(values, i, self.width)
        return self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1


def place(values: np.ndarray, i: int, width: int) -> np.ndarray:
    return ((values * (_STEP + np.uint64(2 * i))) >> np.uint64(64 - width)).astype(np.int64)


def bloom(table: DataFrame, n: int, most: int = MOST) -> Bloom:
    """The bit set of the first column of ``table``, a 64-bit number, with EACH bits for each of ``n`` rows and ``most`` at most.

    Tasks make the blocks of the set; the driver gets 2 ** ``most`` bits at most, however large the table is. With a larger
    table more numbers are "maybe" and nothing else changes.
    """
    if not n:
        return Bloom(LEAST, np.zeros(0, np.uint8))
    width = min(max(min(LEAST, most), (EACH * n - 1).bit_length()), most)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([place(values, i, width) for i in range(PROBES)]))
            yield pa.RecordBatch.from_arrays([pa.array(at >> BLOCK), pa.array(at & (1 << BLOCK) - 1)], ["block", "at"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}  # a task has a share of the blocks, of which there are 4096 at most
        for b in batches:
            block, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            for one in np.unique(block).tolist():
                bits = made.setdefault(one, np.zeros(1 << (BLOCK - 3), np.uint8))
                own = at[block == one]
                np.bitwise_or.at(bits, own >> 3, (1 << (own & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([x.tobytes() for x in made.values()], pa.binary())], ["block", "bits"])

    rows = table.select(F.col(table.columns[0]).cast("long")).where(F.col(table.columns[0]).isNotNull()).mapInArrow(
        places, "block long, at long").repartition("block").mapInArrow(packed, "block long, bits binary")
    bits = np.zeros(1 << (width - 3), np.uint8)
    for r in rows.collect():  # 4096 blocks of 8 KB at most
        bits[r.block << (BLOCK - 3):(r.block + 1) << (BLOCK - 3)] = np.frombuffer(bytes(r.bits), np.uint8)
    return Bloom(width, bits)

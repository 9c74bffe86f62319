"""Words, shingles and batches of texts: helpers of the corpus operators.

A word is a run of anything but the six ASCII white-space characters. UTF-8 keeps those bytes to themselves, so
``bytes.split()`` yields exactly the words, encoded.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"
TEXT_ROWS = 1000
TEXT_BYTES = 4 << 20
MEMO = 1 << 17  # words that a task remembers; several operators of a pipeline follow each other in one worker process
LARGE_MEMO = 1 << 19  # for operators that stand alone
_MULT = 0x9E3779B97F4A7C15


def text_batches(spark: SparkSession) -> None:
    """Bound the rows and the bytes of an Arrow batch: texts can be long, and a batch is held at once by a Python worker."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BYTES)):
        if not 0 < int(re.match(r"-?\d+", spark.conf.get(key))[0]) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blobs(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def text_key(*columns: str) -> Column:
    """A number from 0 to 2**60 - 1 for a row, the same in every run and engine."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def row_id(*columns: str) -> Column:
    """128 bits that tell rows apart by the given columns; null differs from the empty text and columns don't run together."""
    parts = [F.concat(F.octet_length(x).cast("string"), F.lit(":"), x) for x in (F.col(c).cast("string") for c in columns)]
    return F.unhex(F.md5(F.concat_ws(",", *[F.coalesce(p, F.lit("-")) for p in parts])))


class WordCodes(dict):
    """A 64-bit number for each word; forgets all when it has seen many, so that memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit number for each run of k words; fewer words are one run, none gives none."""
    n = len(codes)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(k, n)
    total = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        total = total * np.uint64(_MULT) + codes[j:n - k + 1 + j]
    return mixed(total)

"""Documents that hold items of a benchmark, by size-partitioned MinHash containment search.

The shingles of a text are its runs of five words (ASCII capitals as small letters); a text of fewer words is one
shingle. An item is found in a document if at least 0.8 of its distinct shingles are among the document's. So an item of fewer
than five words is found only in a document that consists of just these words.

Items are short and documents may be long, so the similarity of the two sets says little and signatures of equal length
don't work. Items are therefore put into classes by size, and the signature of an item is the k smallest hashes of its
shingles, with k set by its class: more than a fifth of the largest size in the class. A document that holds 0.8 of
the item must then hold one of the k (the rest is too few), so the search finds every match, whatever the length of the
document. Documents are probed against a bit set of bounded size; those that hit are joined with the signatures by hash, and
the candidate pairs are verified by exact containment of the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm.bloom import bloom
from tracewise.llm.words import WordCodes, blobs, row_id, shingles, text_batches
from tracewise.session import keep

SHINGLE = 5
CONTAINMENT = 0.8
FEW = 500_000  # rows that may be broadcast


def signature_size(n: int, containment: float = CONTAINMENT) -> int:
    """Hashes kept of an item of ``n`` shingles: one more than may be missing from the largest item of its class."""
    largest = (1 << max(n, 1).bit_length()) - 1
    return min(n, int((1 - containment) * largest + 1e-9) + 1)


def item_shingles(words: list[bytes], k: int = SHINGLE) -> list[bytes]:
    """Distinct shingles in order."""
    if not words:
        return []
    return list(dict.fromkeys(b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))))


def found_in(parts: list[bytes], words: list[bytes], k: int = SHINGLE) -> int:
    """How many of the shingles ``parts`` the words have as shingles."""
    if len(words) <= k:
        whole = b" ".join(words)
        return sum(p == whole for p in parts)
    text = b" " + b" ".join(words) + b" "
    return sum(p.count(b" ") == k - 1 and b" " + p + b" " in text for p in parts)


def signatures(items: DataFrame, containment: float = CONTAINMENT, k: int = SHINGLE) -> DataFrame:
    """(item, item_id, n, hash, parts) of each distinct item with a word: ``hash`` is its signature."""
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            memo, rows = WordCodes(), []
            for item, item_id, text in zip(b.column("item").to_pylist(), b.column("item_id").to_pylist(), blobs(b), strict=True):
                words = text.lower().split()
                parts = item_shingles(words, k)
                if parts:
                    low = np.unique(shingles(memo.array(words), k))[:signature_size(len(parts), containment)]
                    rows.append((item, item_id, len(parts), low.view(np.int64).tolist(), parts))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["item", "item_id", "n", "hash", "parts"])

    named = items.select(row_id("item_id", "text").alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return named.dropDuplicates(["item"]).mapInArrow(signed, "item binary, item_id long, n long, hash array<long>, parts array<binary>")


def matches(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, k: int = SHINGLE) -> DataFrame:
    """(row, doc_id, item_id, n_shingles, n_found, containment): each pair of a document and an item that it holds.

    ``row`` tells documents apart by doc_id and text; repeated documents and repeated items count once. Null and empty texts
    hold nothing and are held by nothing, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    text_batches(spark)
    signed = keep(signatures(items, containment, k), "items")
    probes = signed.select(F.explode("hash").alias("hash"), "item")
    maybe = bloom(probes, probes.count())

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordCodes()
        for b in batches:
            at, hits = [], []
            for i, text in enumerate(blobs(b)):
                hashes = shingles(memo.array(text.lower().split()), k)
                hit = hashes[maybe.has(hashes)]
                if len(hit):
                    at.append(i)
                    hits.append(np.unique(hit).view(np.int64).tolist())
            some = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(hits, pa.list_(pa.int64()))], ["row", "doc_id", "text", "hits"])

    rows = docs.select(row_id("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    hit = keep(rows.mapInArrow(probed, "row binary, doc_id long, text string, hits array<long>"), "hits")
    pairs = hit.select("row", F.explode("hits").alias("hash")).join(probes, "hash").select("row", "item").distinct()

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = doc_id = words = None
        for b in batches:
            out = []
            columns = (b.column(c).to_pylist() for c in ("row", "doc_id", "item_id", "n", "parts"))
            for own, doc, item_id, n, parts, text in zip(*columns, blobs(b), strict=True):
                if parts is None:  # the text, ahead of its candidates; a row that repeats comes again
                    if own != row:
                        row, doc_id, words = own, doc, text.lower().split()
                else:
                    out.append((own, doc_id, item_id, n, found_in(parts, words, k)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["row", "doc_id", "item_id", "n_shingles", "n_found"])

    # each text goes once, in the same sorted stream as its candidates and ahead of them
    candidates = pairs.join(signed.drop("hash"), "item").select("row", F.lit(None).cast("long").alias("doc_id"), "item_id", "n", "parts", F.lit(None).cast("string").alias("text"))
    texts = hit.join(pairs.select("row").distinct(), "row", "left_semi").select(
        "row", "doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<binary>").alias("parts"), "text")
    stream = texts.union(candidates).withColumn("last", F.col("parts").isNotNull()).repartition("row").sortWithinPartitions("row", "last")
    checked = stream.mapInArrow(verified, "row binary, doc_id long, item_id long, n_shingles long, n_found long")
    return checked.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("containment") >= containment)


def leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    return matches(docs, items, **options).drop("row")


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item."""
    own = "row of decontamination"  # no column of the table has this name
    bad = keep(matches(docs, items, **options).select(F.col("row").alias(own)).distinct(), "leaks")
    if bad.count() <= FEW:  # 16 bytes each: no text is shuffled
        bad = F.broadcast(bad)
    return docs.withColumn(own, row_id("doc_id", "text")).join(bad, own, "left_anti").drop(own)


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _sql_shingles(table: str, key: str) -> str:
    words = f"[x FOR x IN regexp_split_to_array(translate(text, '{_LETTERS}', '{_LETTERS.lower()}'), '[\\x20\\x09-\\x0D]+') IF x <> '']"
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {SHINGLE}
      THEN [array_to_string(w[i:i + {SHINGLE - 1}], ' ') FOR i IN range(1, len(w) - {SHINGLE - 2})]
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
      FROM (SELECT {key}, {words} AS w FROM {table})"""


SQL = f"""WITH d AS ({_sql_shingles('documents', 'doc_id')}), i AS ({_sql_shingles('benchmark', 'item_id')}),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM d JOIN i USING (shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, CAST(n_found AS DOUBLE) / n_shingles AS containment FROM f JOIN n USING (item_id)
WHERE CAST(n_found AS DOUBLE) / n_shingles >= {CONTAINMENT}"""

import zlib

import numpy as np
import pytest
from conftest import DATA

from tracewise.llm import randomindex as R


def test_contexts_against_a_walk():
    texts = [b"a b c d a", b"", b"a a", b"x"]
    memo, index = R.Buckets(), R.index_vectors()
    sums = np.zeros((R.WORDS + R.FORMS, R.DIMS))
    want = np.zeros_like(sums)
    for _, word, kind, size in R.blocks(texts, memo):
        R.add_contexts(word, kind, size, index, sums)
        at = 0
        for n in size:
            for i in range(at, at + n):
                for j in range(max(at, i - R.NEAR), min(at + n, i + R.NEAR + 1)):
                    if j != i:
                        for own in (word[i], kind[i]):
                            want[own] += index[word[j]] + index[kind[j]]
            at += n
    assert np.array_equal(sums, want)


def test_held_out_accuracy(spark):
    folder = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r for r in R.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(held) > 50 and sum(p == y for p, y in held) >= 0.95 * len(held)


@pytest.mark.parametrize("marks", [[], [(1, 1), (3, 1)]])
def test_odd_rows(spark, marks):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a b", None), (3, "w " * 200_000, "y")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = R.quality_scores(docs, labels).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    assert R.quality_scores(docs.limit(0), labels).collect() == []


def test_sample_of_repeated_ids_does_not_depend_on_partitions(spark):
    from tracewise.llm.labelled import sample

    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    found = [sorted(map(tuple, sample(docs.repartition(n), labels, "quality", 30).collect())) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2] == []
    once = docs.where("text in ('text 1', 'text 2') or doc_id > 50 or text = 'text 39'")
    assert [r.doc_id for r in sample(once, labels, "quality", 30).orderBy("doc_id").collect()] == [1, 2, 39]


def test_two_dimensions_in_a_double_add_up_as_one(monkeypatch):
    """Packed sums, negative ones too, are those of single dimensions, and one count of buckets serves two of them."""
    rng = np.random.default_rng(3)
    size = np.array([0, 50_000, 1, 0, 30_000])
    word, kind = rng.integers(0, 9, size.sum()), rng.integers(R.WORDS, R.WORDS + 3, size.sum())
    found, counts, plain = [], [], np.bincount

    def counted(*args):
        counts[-1] += 1
        return plain(*args)

    monkeypatch.setattr(R.np, "bincount", counted)
    for most in (R.PACKED_WORDS, 0):
        monkeypatch.setattr(R, "PACKED_WORDS", most)
        counts.append(0)
        found.append(np.zeros((R.WORDS + R.FORMS, R.DIMS)))
        R.add_contexts(word, kind, size, R.index_vectors(), found[-1])
    assert np.array_equal(*found) and (found[0] < 0).any() and (found[0] > 0).any()
    assert counts == [R.DIMS, 2 * R.DIMS]

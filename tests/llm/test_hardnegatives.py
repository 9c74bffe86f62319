import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewise.llm import hardnegatives as H

NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, embedding array<float>, label int"


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 40), st.integers(0, 40), st.integers(0, 40), st.integers(1, 5), st.integers(0, 2**31))
def test_strassen_is_exact(n, k, m, leaf, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-2**62, 2**62, (n, k)), rng.integers(-2**62, 2**62, (k, m))
    with np.errstate(over="ignore"):
        assert (H.strassen(a, b, leaf) == a @ b).all()


def test_scores_beyond_64_bits():
    a, b = np.array([[2**62, 2**62], [1, -1]]), np.array([[2**62, 2**62], [2**62, -2**62]])
    assert H.scores(a, b).tolist() == [[H.LARGEST, 0], [0, H.LARGEST]]
    assert H.scores(np.zeros((0, 3), np.int64), np.zeros((2, 3), np.int64)).shape == (0, 2)


@given(st.lists(st.tuples(st.integers(-3, 3), st.booleans(), st.integers(0, 5), st.integers(1, 3))), st.integers(0, 30), st.integers(1, 6))
def test_merged_heaps_are_the_heap_of_all(entries, cut, k):
    def spelled(heap):
        return [e[:3] for e in heap for _ in range(e[3])][:k]
    one, other = sorted(entries[:cut]), sorted(entries[cut:])
    assert spelled(H.merged(H.merged(one, [], k), H.merged(other, [], k), k)) == spelled(sorted(entries))


def slow(rows, positives=5, negatives=10):
    kept = []
    for i, x, label in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        label = math.fmod(label + 1, 10) if i is not None and i % 7 == 0 else label
        kept.append((i, [math.floor(256 * float(np.float32(v))) for v in x], int(label)))
    out = []
    for at, (i, x, label) in enumerate(kept):
        if i is None or i % 100:
            continue
        ranked = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), j is None, j or 0, own) for nr, (j, y, own) in enumerate(kept) if nr != at)
        named = [(-s, None if nameless else j, own) for s, nameless, j, own in ranked]
        for p, pos, _ in [r for r in named if r[2] == label][:positives]:
            window = [(s, j) for s, j, own in named if own != label and 30 * p <= 100 * s <= 90 * p][:negatives]
            out += [(i, pos, rank, j, p, s) for rank, (s, j) in enumerate(window, 1)]
    return Counter(out)


def fast(spark, rows, **options):
    got = H.hard_negatives(spark.createDataFrame(rows, SCHEMA), **options)
    assert got.columns == NAMES
    return Counter(map(tuple, got.collect()))


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"block": 2, "size": 50})])
def test_equals_brute_force(spark, seed, options):
    """Few values, so that scores tie; units of one and of many pairs."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.integers(-2, 4, 9) / 16).tolist(), int(rng.integers(0, 4))) for i in rng.permutation(700)]
    got = fast(spark, rows, **options)
    assert got == slow(rows) and len(got) > 100


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    x = [0.5, 0.25, 1.0]
    rows = [(None, x, 1), (None, x, 1), (None, x, 2), (100, x, 1), (100, x, 1), (100, x, 1), (100, [0.5, 0.5, 0.5], 1), (200, [], 2), (300, [1.0], -4), (0, x, -4),
            (1, None, 1), (2, x, None), (3, [float("nan"), 0.0, 0.0], 1), (4, [float("inf"), 0.0, 0.0], 1), (5, [None, 1.0, 1.0], 1), (400, [-1.0, 0.0, 0.0], 9)]
    rows += [(1000 + i, (rng.integers(0, 3, 3) / 4).tolist(), int(rng.integers(0, 3))) for i in range(150)]
    assert fast(spark, rows) == slow(rows)
    assert fast(spark, rows, size=20, block=1) == slow(rows)
    assert fast(spark, []) == fast(spark, [(100, x, 1)]) == fast(spark, [(1, x, 1), (2, x, 2)]) == Counter()
    wide = spark.createDataFrame([(*r, 5, 6) for r in rows], SCHEMA + ", row int, copies int")
    assert Counter(map(tuple, H.hard_negatives(wide).collect())) == slow(rows)

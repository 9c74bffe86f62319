import itertools

import numpy as np
import pytest
import xxhash
from conftest import DATA

from tracewise.llm import simhash


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    runs = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(fps):
    """Smallest id reachable, from (id, fingerprint) rows."""
    label = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for (i, x), (j, y) in itertools.combinations(fps, 2):
            if (x ^ y).bit_count() <= 4 and label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 1])
def test_whole_table_against_all_pairs(spark, bucket):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    group = slow_groups(want)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, bucket=bucket).collect()}
    assert got == {i: (f"{x:016x}", group[i]) for i, x in want}


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_of_random_clusters(spark, bucket):
    rng = np.random.default_rng(3)
    fps = []
    for centre in rng.integers(0, 2**63, 20, dtype=np.uint64):
        for _ in range(12):
            x = int(centre)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps = sorted(set(fps))
    signed = [int(np.array([x], np.uint64).view(np.int64)[0]) for x in fps]
    table = spark.createDataFrame([(s,) for s in signed], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(table, bucket=bucket)).collect()}
    label = slow_groups(list(zip(signed, fps, strict=True)))
    assert {x: got.get(x, x) for x in signed} == label


def test_every_pair_of_four_errors_shares_a_key():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 2000).astype(np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, 4, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    tables = simhash.golay_tables()
    (r, k), (s, m) = (simhash.golay_keys(x.view(np.int64), tables) for x in (a, b))
    assert len({row for row, _ in set(zip(r.tolist(), k.tolist(), strict=True)) & set(zip(s.tolist(), m.tolist(), strict=True))}) == len(a)


SCHEMA = "doc_id long, text string, fp string, a int, row int"


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    rows = [(5, None), (4, ""), (3, " \t\n"), (None, ""), (9, long), (8, long + " tail"), (7, "One two"), (6, "one  TWO"),
            (6, "one  TWO"), (None, "alone here")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    want = [(5, 3), (4, 3), (3, 3), (None, 3), (9, 8), (8, 8), (7, 6), (6, 6), (6, 6), (None, None)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.row for r in kept.collect()} == {2}
    assert sorted(repr((r.doc_id, r.text[:10])) for r in kept.collect()) == sorted(
        repr(x) for x in [(3, " \t\n"), (8, long[:10]), (6, "one  TWO"), (None, "alone here")])


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.first_of_each(docs).collect() == []

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from conftest import DATA

from tracewise.llm import lines


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_base_counts(tables):
    docs, labels = tables
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in lines.quality(docs, labels).collect():
        want = slow_counts(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[-1] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_verdict_follows_labels(tables):
    docs, labels = tables
    got = {r.doc_id: r for r in lines.quality(docs, labels).collect()}
    marks = [(got[r.doc_id], r.quality) for r in labels.collect()]
    good = [r.kept for r, y in marks if y == 1 and not r.base_failed]
    bad = [r.kept for r, y in marks if y == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_passing_keeps_rows_and_columns(tables):
    docs, labels = tables
    kept = {r.doc_id for r in lines.quality(docs, labels).where("kept").collect()}
    passed = lines.passing(docs, labels)
    assert passed.columns == docs.columns
    assert {r.doc_id for r in passed.collect()} == kept


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 8):
        emit, steps = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        best = max(itertools.product((0, 1), repeat=n), key=lambda p: sum(emit[i, s] for i, s in enumerate(p)) + sum(
            steps[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert lines.viterbi(emit, steps).astype(int).tolist() == list(best)


def test_odd_rows(spark):
    long = "\n".join(f"a{i} b{i} c{i} d{i} e{i} f{i}." for i in range(30_000))
    rows = [(1, None, 5), (2, "", 5), (2, "", 6), (None, "a b", None), (3, long, 1), (4, "same same " * 60, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = [(r.doc_id, r.n_words, r.base_failed, r.kept) for r in lines.quality(docs, labels).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [
        (1, 0, True, False), (2, 0, True, False), (2, 0, True, False), (None, 2, True, False), (3, 180_000, False, True),
        (4, 120, True, False)]))
    assert lines.passing(docs, labels).collect()[0].n_words == 1
    assert lines.quality(docs.limit(0), labels).collect() == []

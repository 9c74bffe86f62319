import re

import numpy as np
import pytest
from conftest import DATA

from tracewise.llm import licenses as L


def plain(text):
    words = [w.lower().strip(".,;:!?\"'()[]{}<>*#/|&%$=+-_~`") for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return [w for w in words if w]


def grams(words):
    return [tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def slow(text, templates=L.TEMPLATES):
    """Every window of every template, compared as sets."""
    runs, out = grams(plain(text)), set()
    for name, statement in templates:
        own = set(grams(plain(statement)))
        u = 1 << (len(own) - 1).bit_length()
        if any(len(own & set(runs[a:a + 2 * u])) >= 0.8 * len(own) for a in range(0, len(runs), u)):
            out.add(name)
    return out


def test_whole_table_against_all_windows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {(r.doc_id, name) for r in docs.collect() for name in slow(r.text)}
    got = L.licenses(docs).collect()
    assert {(r.doc_id, r.license) for r in got} == want and want
    assert len(got) == len(want) and all(r.containment >= 0.8 for r in got)


def test_changed_statements():
    rng = np.random.default_rng(8)
    known, memo = L.Templates(L.TEMPLATES, L.CONTAINMENT, L.SHINGLE), L.Plain()
    hits = 0
    for _ in range(300):
        name, statement = L.TEMPLATES[rng.integers(len(L.TEMPLATES))]
        words = statement.split()
        for at in rng.choice(len(words), rng.integers(0, 3), replace=False) if len(words) > 12 else []:
            words[at] = "changed"
        text = " ".join([f"f{x}" for x in rng.integers(0, 99, rng.integers(0, 300))] + ["*", *words] + ["end"] * int(rng.integers(0, 50)))
        got = {known.names[t] for t, *_ in L.scan(L.codes_of(text.encode(), memo), known)}
        assert got == slow(text)
        hits += name in got
    assert hits > 150


@pytest.mark.parametrize("largest", [1, 2, 16, 64])
def test_bands_miss_less_than_promised(largest):
    n, least = L.bands(largest, 0.8), largest // 2 + 1
    assert (1 - 0.8 * least / (2 * largest + 0.2 * least))**n <= 1e-9


def test_odd_rows(spark):
    line = "Released under the MIT License."
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "w " * 200_000 + line, "x"), (None, line, "x"), (4, line, "x"), (4, line, "x"),
                                  (5, "/* Released under the\n * MIT License. */", "x"), (6, "Released under the MIT", "x")], "doc_id long, text string, license string")
    got = sorted(repr((r.doc_id, r.license, r.first_word)) for r in L.licenses(docs).collect())
    assert got == sorted(repr((i, "mit", a)) for i, a in [(3, 200_000), (None, 0), (4, 0), (4, 0), (5, 0)])
    assert L.licenses(docs.limit(0)).collect() == []

import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA

from tracewise.llm import suffixes as S


def slow(texts, length):
    """(bytes, removed, runs, hash) of each text, from a count of all strings."""
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if times[d[i:i + length]] > 1:
                gone[i:i + length] = True
        rest = bytes(c for c, g in zip(d, gone, strict=False) if not g)
        runs = int(np.count_nonzero(gone[:-1] & ~np.concatenate(([False], gone[:-2])))) if len(d) else 0
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


def check(spark, texts, length, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:5] for r in S.deduplicate(docs, length, **options).collect()}
    want = slow(texts, length)
    assert [got[i] for i in range(len(texts))] == want
    return want


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"shard": 7, "block": 50}])
def test_whole_table_against_all_strings(spark, options):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]
    want = check(spark, texts, S.LENGTH, **options)
    assert any(0 < w[1] < w[0] for w in want)


@pytest.mark.parametrize("options", [{"gram": 5}, {"gram": 3, "hot": 2}, {"gram": 8, "shard": 3, "block": 10}])
def test_short_strings_of_few_letters(spark, options):
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("abé"), int(n))) for n in rng.integers(0, 120, 60)]
    texts += ["ab" * 40, "ab" * 7, "c" * 90, "xyz" * 30 + "q" + "xyz" * 30, texts[3], texts[3], None, ""]
    texts += [texts[5][:20] + "tail" + texts[6], "w" * 11, "w" * 12, "v" * 12 + "u" + "v" * 12]
    check(spark, texts, 12, **options)


def test_rolling_and_minimum():
    data = np.random.default_rng(0).integers(0, 4, 500).astype(np.uint8)
    roll = S.Rolling(1, 600)
    hashes = roll.runs(roll.sums(data), 3).tolist()
    strings = [bytes(data[i:i + 3]) for i in range(498)]
    assert len(set(zip(hashes, strings, strict=True))) == len(set(strings)) == len(set(hashes))
    assert S.sliding_min(data, 7).tolist() == [data[i:i + 7].min() for i in range(494)]


def test_long_texts_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "_PIECE", 300)
    rng = np.random.default_rng(3)
    shared = "".join(rng.choice(list("abcdefgh"), 700))
    texts = ["".join(rng.choice(list("abcdefgh"), 2000)) + shared, shared[100:] + "".join(rng.choice(list("abcdefgh"), 900)), "short"]
    want = check(spark, texts, 50, gram=10)
    assert want[0][1] >= 600


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    long = "".join(rng.choice(list("abcdefgh"), 1_500_000))
    rows = [(1, None, 1), (2, "", 1), (2, "", 1), (None, long, 1), (4, "x" + long[500_000:500_300] + "y", 1), (5, "z" * 199, 1), (5, "z" * 199, 1),
            (6, "z" * 200 + "q", 1), (7, long[:250] + "!", 1), (7, long[:250] + "!", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans)) for r in S.deduplicate(docs).collect())
    assert got == sorted(repr(x) for x in [(1, 0, 0, 0), (2, 0, 0, 0), (2, 0, 0, 0), (None, 1_500_000, 550, 2), (4, 302, 300, 1), (5, 199, 0, 0),
                                           (5, 199, 0, 0), (6, 201, 0, 0), (7, 251, 251, 1), (7, 251, 251, 1)])
    assert S.deduplicate(docs.limit(0)).collect() == []


def test_spans_of_repeated_rows_meet_once(spark, monkeypatch):
    shared = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(90))
    docs = spark.createDataFrame([(1, f"{shared} one")] * 60 + [(2, f"two {shared}"), (2, f"two {shared}")], "doc_id long, text string").repartition(3)
    most, keep = [], S.keep

    def recorded(df, name):
        out = keep(df, name)
        if name == "spans":
            most.extend(r.n for r in out.selectExpr("size(spans) n").collect())
        return out

    monkeypatch.setattr(S, "keep", recorded)
    got = S.deduplicate(docs, 40, gram=8).collect()
    assert len(got) == 62 and all(r.n_removed == r.n_bytes for r in got)
    assert len(most) == 2 and max(most) < 20, most

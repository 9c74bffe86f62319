import duckdb
import numpy as np
from conftest import DATA

from tracewise.llm import bloom as B
from tracewise.llm import decontaminate as D


def test_bloom_has_every_member(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(-2**63, 2**63, 5000)
    for most in (28, 16):
        made = B.bloom(spark.createDataFrame([(int(v),) for v in values], "v long"), 5000, most)
        assert made.has(values.view(np.uint64)).all()
        others = made.has(rng.integers(0, 2**63, 20000).astype(np.uint64)).mean()
        assert others < (0.001 if most == 28 else 0.1)
    assert not B.bloom(spark.createDataFrame([], "v long"), 0).has(values.view(np.uint64)).any()


def test_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = D.leaks(docs, items)
    want = con.execute(D.SQL)
    assert got.columns == [c[0] for c in want.description]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall()) and rows
    kept = {r.doc_id for r in D.clean(docs, items).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {r[0] for r in rows}


def test_every_share_above_the_bound_is_found(spark):
    """Items whose words are changed at places, hidden in long documents."""
    rng = np.random.default_rng(6)
    items, docs = [], []
    for i in range(60):
        n = int(rng.integers(5, 90))
        words = [f"i{i}w{j}" for j in range(n)]
        items.append((i, " ".join(words)))
        changed = list(words)
        for at in rng.choice(n, int(rng.integers(0, 4)), replace=False) if n > 8 else []:
            changed[at] = "CHANGED"
        filler = [f"f{x}" for x in rng.integers(0, 1000, int(rng.integers(0, 3000)))]
        cut = int(rng.integers(0, len(filler) + 1))
        docs.append((i, " ".join(filler[:cut] + changed + filler[cut:])))

    def shingles(text):
        w = text.lower().split()
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}

    want = {(d, i) for d, text in docs for i, item in items if len(shingles(item) & shingles(text)) >= 0.8 * len(shingles(item))}
    got = {(r.doc_id, r.item_id) for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                                                  spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and 20 < len(want) < 60


def test_odd_rows(spark):
    item = "one two three four five six seven"
    docs = spark.createDataFrame(
        [(1, None, 1), (2, "", 1), (3, "x " * 100_000 + item.upper(), 1), (3, "x " * 100_000 + item.upper(), 1), (None, item, 1), (5, "two words", 1),
         (6, "just two words here and more", 1)], "doc_id long, text string, item int")
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "two  words"), (None, item + " eight")], "item_id long, text string")
    got = sorted(repr((r.doc_id, r.item_id)) for r in D.leaks(docs, items).collect())
    assert got == sorted(repr(x) for x in [(3, 1), (None, 1), (5, 4)])
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 6]
    assert D.leaks(docs.limit(0), items).collect() == [] and D.clean(docs, items.limit(0)).count() == 7

import re
from collections import defaultdict

import duckdb
import pytest
from conftest import DATA

from tracewise.llm import mixing as M


def poured(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_w = sum(weight[s] for s in names if s not in full) or 1
        want = {s: cap * sizes[s] if s in full else weight[s] * left / open_w for s in names}
        more = {s for s in names if s not in full and want[s] > cap * sizes[s]}
        if not more:
            return want
        full |= more


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(docs, rows):
    sizes, longest = defaultdict(int), defaultdict(int)
    for _, source, text in docs:
        sizes[source] += words(text)
        longest[source] = max(longest[source], words(text))
    want, taken = poured(sizes), defaultdict(int)
    by_id = {i: (s, words(t)) for i, s, t in docs}
    assert len(rows) == len(docs)
    for r in rows:
        source, size = by_id[r.doc_id]
        assert (r.size, r.source_size) == (size, sizes[source]) and abs(r.target - want[source]) < 1e-6 * max(1, want[source])
        assert 0 <= r.taken <= 3 * size and (size == 0 or r.taken % size == 0)
        taken[source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_equals_sql(docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got, want = M.mix(docs), con.execute(M.SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_targets_are_met_and_reruns_agree(docs):
    rows = M.mix(docs).collect()
    check([(r.doc_id, r.source, r.text) for r in docs.collect()], rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mix(docs.repartition(7, "n_chars")).collect()))


def test_many_sources_take_the_salted_join(docs, monkeypatch):
    want = sorted(map(tuple, M.mix(docs).collect()))
    monkeypatch.setattr(M, "SMALL", 0)
    assert sorted(map(tuple, M.mix(docs).collect())) == want


def test_smaller_mix_is_part_of_a_larger(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", "w " * (i % 17 + 1)) for i in range(400)], "doc_id long, source string, text string")
    few = {r.doc_id for r in M.mix(docs, (1, 30)).where("taken > 0").collect() if r.doc_id % 3}
    more = {r.doc_id for r in M.mix(docs, (3, 30)).where("taken > 0").collect() if r.doc_id % 3}
    assert few < more


def test_odd_rows(spark):
    rows = [(1, None, "a b c", 1), (2, "b", None, 1), (3, "b", "", 1), (4, "a", "w " * 50_000, 1), (5, "é", "x y", 1), (6, "Z", "q", 1), (7, "b", "one", 1)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string, copies int")
    check([r[:3] for r in rows], M.mix(table).collect())
    out = M.mixed(table)
    assert out.columns == ["doc_id", "source", "text", "copies"]
    taken = {r.doc_id: r.taken // r.size for r in M.mix(table).collect() if r.taken}
    got = {r.doc_id: r.copies for r in out.collect()}
    assert {i: c for i, c in got.items() if i in taken} == taken
    same = table.union(table).union(spark.createDataFrame([(None, "b", "again", 1)] * 3, table.schema))
    assert M.mix(same).count() == 17
    assert M.mix(table.limit(0)).collect() == [] and M.mixed(table.limit(0)).collect() == []
    assert {r.taken for r in M.mix(table.where("text = '' or text is null")).collect()} == {0}

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from conftest import DATA

from tracewise.llm import prefixtrie as P

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def slow_tree(rows):
    """Nodes by spelling out each prefix; ``rows`` are (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, tie, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        path = turns.get(base, [])[:h] + turns[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[q] for q in below),
                    sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q),
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()))
    return sorted(map(repr, out))


def fast_tree(spark, rows, **options):
    got = P.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), **options)
    assert got.columns == NAMES
    return sorted(repr(tuple(r)) for r in got.collect())


def some(seed, n, depth=9, ids=200):
    rng = np.random.default_rng(seed)
    return [(int(rng.integers(-20, ids)), int(rng.integers(0, depth)) if rng.random() < 0.9 else None, "user" if rng.random() < 0.7 else None,
             ["a", "bé", "", "long " * 50, None][rng.integers(0, 5)]) for _ in range(n)]


@pytest.mark.parametrize("n, depth, ids, most", [(700, 9, 200, 25), (400, 3, 30, 6), (300, 40, 6, 25)])
def test_equals_brute_force(spark, n, depth, ids, most):
    """The second sketch is so small that it says "maybe" to everything."""
    rows = some(n, n, depth, ids) + [(1000 + i, t, "user", f"same {t}") for i in range(40) for t in range(6)]
    assert fast_tree(spark, rows, most=most) == slow_tree(rows)


def test_long_conversations_in_segments(spark, hot):
    rows = [(5 * i, t, "user", f"turn {t if t < 30 else (t, i)}") for i in range(3) for t in range(60)] + some(3, 100)
    want = slow_tree(rows)
    hot(25)
    assert fast_tree(spark, rows) == want


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    want = con.execute(P.SQL)
    assert [c[0] for c in want.description] == NAMES
    got = P.prefix_tree(spark.read.parquet(f"{DATA}/conversations.parquet")).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want.fetchall())) == slow_tree(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "x"), (7, None, None, None), (7, None, None, None), (7, 1, "user", "y " * 100_000), (8, 1, "user", "z"), (-3, 2, "user", "z"),
            (2**63 - 1, 1, "user", "z"), (-2**63, 1, "user", "z")]
    assert fast_tree(spark, rows) == slow_tree(rows)
    assert fast_tree(spark, []) == fast_tree(spark, rows[:1]) == []
    alone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    assert fast_tree(spark, [(alone, 1, "user", "dropped")]) == slow_tree([(alone, 1, "user", "dropped")])  # a root without turns
    more = spark.createDataFrame([(1, 1, "user", "t", 5, 6)], "conv_id long, turn long, role string, text string, depth long, a long")
    assert P.prefix_tree(more).columns == NAMES


def test_sketch_never_says_too_little(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**60, (5000, 2)).tolist()
    df = spark.createDataFrame(keys + keys[:100], "a long, b long").repartition(5)
    for most, least in ((25, 0.99), (8, 0.0)):
        seen = P.sketch(df, 5100, most)
        a, b = np.array(keys, np.int64).T
        maybe = seen.shared(a, b)
        assert maybe[:100].all() and 1 - maybe[100:].mean() >= least

import random

import pytest
from pyspark.sql import functions as F

from tracewise.operators import scan as sc


def columns():
    return [
        sc.position("n"), sc.running_sum("total", F.col("v")), sc.running_min("low", F.col("v")),
        sc.running_max("high", F.col("v")), sc.running_mean("mean", F.col("v")), sc.running_std("std", F.col("v")),
        sc.latest("last", F.col("v")), sc.earliest("first", F.col("v")), sc.previous("prev", F.col("v")),
        sc.Whole("size", F.count(F.lit(1))), sc.Whole("top", F.max("v"))]


def table(spark, keys, n=600, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        # a third of the rows share one key, and another third has none
        key = "hot" if i % 3 == 0 else (None if i % 3 == 1 else draw.choice(keys))
        value = None if draw.random() < 0.4 else 1000 + draw.random()
        rows.append((key, draw.randrange(20), i, value))
    return spark.createDataFrame(rows, "key string, t int, id int, v double").repartition(5)


def as_set(df):
    return sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in
                  df.select("id", *[x.name for x in columns()]).collect())


@pytest.mark.parametrize("order", [lambda: ["t", "id"], lambda: [F.col("t").desc(), F.col("id").asc()]])
def test_segments_equal_plain_window(spark, hot, order):
    df = table(spark, ["a", "b", "c"])
    plain = as_set(sc.scan(df, ["key"], order(), columns(), None))
    hot(50)
    found = sc.find_hot(df, ["key"])
    assert found.rows >= 400 and found.groups.count() >= 2
    assert as_set(sc.scan(df, ["key"], order(), columns(), found)) == plain


def test_whole_table_as_one_group(spark, hot):
    df = table(spark, ["a"])
    plain = as_set(sc.scan_all(df, ["t", "id"], columns()))
    hot(40)
    assert as_set(sc.scan_all(df, ["t", "id"], columns())) == plain


def test_only_whole_columns_need_no_segments(spark, hot):
    df = table(spark, ["a"])
    size_only = [sc.Whole("size", F.count(F.lit(1)))]
    plain = sorted(r["size"] for r in sc.scan(df, ["key"], ["id"], size_only, None).collect())
    hot(50)
    assert sorted(r["size"] for r in sc.scan(df, ["key"], ["id"], size_only, sc.find_hot(df, ["key"])).collect()) == plain


def test_quantiles(spark, hot):
    df = table(spark, ["a", "b"]).where("key IS NOT NULL")
    q = {"q10": 0.1, "mid": 0.5, "q90": 0.9}
    show = lambda d: sorted((r["key"], *[round(r[n], 9) for n in q]) for r in d.collect())
    plain = show(sc.exact_quantiles(df, ["key"], F.col("v"), q, None))
    hot(90)
    assert show(sc.exact_quantiles(df, ["key"], F.col("v"), q, sc.find_hot(df, ["key"]))) == plain


def test_no_hot_groups_below_the_limit(spark):
    assert sc.find_hot(table(spark, ["a"]), ["key"]) is None


def test_groups_must_be_the_measured_ones(spark, hot):
    hot(50)
    df = table(spark, ["a"])
    with pytest.raises(ValueError):
        sc.scan(df, ["t"], ["id"], [sc.position("n")], sc.find_hot(df, ["key"]))


def test_marked_rows_give_the_same(spark, hot):
    df = table(spark, ["a", "b", "c"])
    plain = as_set(sc.scan(df, ["key"], ["t", "id"], columns(), None))
    hot(50)
    found = sc.find_hot(df, ["key"])
    marked = sc.scan(sc.mark_hot(df, found), ["key"], ["t", "id"], columns(), found)
    assert as_set(marked) == plain
    again = sc.scan(marked, ["key"], ["t", "id"], [sc.position("n2")], found)
    assert again.where("n2 <> n").count() == 0
    # the second scan reads one side only for each of its own sides
    plan = marked.where(~F.col(f"`{found.mark}`"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def sizes_of(found):
    groups = None if found.hot is None else sorted(map(tuple, found.hot.groups.collect()), key=repr)
    return groups, found.hot and found.hot.rows


@pytest.mark.parametrize("limit", [1, 7, 50, 199, 200, 201, 5000])
def test_screening_finds_what_counting_finds(spark, hot, limit):
    """Null keys, keys of two columns, groups just at the limit."""
    df = table(spark, [f"k{i}" for i in range(40)])
    hot(limit)
    for keys in (["key"], ["key", "t"], ["t"], ["id"]):
        screened, counted = sc.screen(df, keys), sc.measure(df, keys)
        assert sizes_of(screened) == sizes_of(counted), keys
        assert screened.groups >= counted.groups and screened.longest >= counted.longest
    nothing = sc.screen(df.limit(0), ["key"])
    assert (nothing.hot, nothing.longest, nothing.groups) == (None, 0, 0)


def test_a_sketch_that_is_too_small_is_not_trusted(spark, hot):
    """20,000 keys and room for 8 or 64 of them: a larger sketch is taken, or all groups are counted."""
    df = spark.range(60_000, numPartitions=7).selectExpr("CASE WHEN id % 3 = 0 THEN id % 9 ELSE 100 + id % 20000 END AS key")
    hot(3000)
    want = sizes_of(sc.measure(df, ["key"]))
    assert len(want[0]) == 3
    assert sizes_of(sc.screen(df, ["key"], 8)) == sizes_of(sc.screen(df, ["key"], 64)) == sizes_of(sc.screen(df, ["key"])) == want


def test_counting_takes_over_beyond_the_largest_sketch(spark, hot, monkeypatch):
    df = table(spark, ["a", "b", "c"])
    hot(50)
    monkeypatch.setattr(sc, "MOST_TRACKED", 4)
    assert sizes_of(sc.screen(df, ["key"], 4)) == sizes_of(sc.measure(df, ["key"]))


def test_screening_shuffles_no_keys(spark, hot):
    """A hundred thousand keys leave as one sketch a task."""
    hot(1000)
    df = spark.range(100_000, numPartitions=4).selectExpr("CASE WHEN id % 4 = 0 THEN -1 ELSE id END AS key")
    found = sc.screen(df, ["key"])
    assert sizes_of(found) == ([(-1,)], 25_000) and 75_001 <= found.groups < 100_000

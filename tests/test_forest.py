import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tracewise.operators import auc as A
from tracewise.operators import forest as W
from tracewise.operators import models, train
from tracewise.operators.models import GuardedClassifier


def slow_tree(rows, depth):
    """A greedy tree by trying every cut of every column, without pairs of leaves of one answer."""
    times, y = (rows[:, -1] >> 1).astype(int), (rows[:, -1] & 1).astype(int)

    def go(at, left):
        n, pos = times[at].sum(), (times[at] * y[at]).sum()
        best, found = 0, None
        for f in range(rows.shape[1] - 1 if left and 0 < pos < n else 0):
            for cut in range(31):
                low = at[rows[at, f] <= cut]
                if 0 < len(low) < len(at):
                    m, p = times[low].sum(), (times[low] * y[low]).sum()
                    gain = (p * n - pos * m) ** 2 / (m * (n - m))
                    if gain > best:
                        best, found = gain, (f, cut)
        if found:
            low = rows[at, found[0]] <= found[1]
            sides = go(at[low], left - 1), go(at[~low], left - 1)
            if not all(len(s) == 2 and s[1] == sides[0][1] for s in sides):
                return (*found, *sides)
        return pos / n, 2 * pos > n

    return go(np.arange(len(rows)), depth)


def answer(tree, row):
    while len(tree) == 4:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


@pytest.mark.parametrize("n, depth, values", [(1, 5, 4), (12, 30, 4), (90, 30, 5), (250, 3, 32), (250, 30, 32)])
def test_the_tree_below_a_node_is_greedy(n, depth, values):
    rng = np.random.default_rng(n + depth)
    rows = np.concatenate([rng.integers(0, values, (n, 4)), rng.integers(1, 4, (n, 1)) * 2 + rng.integers(0, 2, (n, 1))], axis=1).astype(np.uint8)
    nodes, tree = W.grow(rows, 4, depth, np.random.default_rng(0)), slow_tree(rows, depth)
    got = W._scores(nodes, np.ascontiguousarray(rows[:, :4].T))
    np.testing.assert_array_equal(got, [answer(tree, r) for r in rows])


def test_cuts_and_draws():
    np.testing.assert_array_equal(W._cuts(np.array([3.0, 1.0, 2.0, 2.0, np.nan])), [1.5, 2.5])
    assert len(W._cuts(np.full(5, 7.0))) == 0 and len(W._cuts(np.zeros(0))) == 0
    many = W._cuts(np.arange(3200.0))
    assert len(many) == 31 and many[0] == 99.5 and set(np.diff(many)) == {100.0}
    times = W._times(np.random.default_rng(1).integers(-2**62, 2**62, 100_000), 0, 3)
    assert times.mean() == pytest.approx(1, abs=0.02) and times.var() == pytest.approx(1, abs=0.03) and times.max() < 16
    drawn = W._drawn(np.random.default_rng(1), 400, 5, 2)
    assert drawn.shape == (400, 2) and (drawn[:, 0] < drawn[:, 1]).all() and (np.bincount(drawn.ravel()) > 100).all()
    assert W._drawn(np.random.default_rng(1), 2, 3, 3).tolist() == [[0, 1, 2], [0, 1, 2]]


def some_rows(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(str(i) if i % 7 else None, i % 5, int(a + 0.3 * rng.normal() > 0.5), 1, [float(a), float(rng.integers(0, 3)), 1.0]) for i, a in enumerate(rng.random(n))]
    df = spark.createDataFrame(rows, "case_id string, prefix_nr long, y int, bucket long, x array<double>")
    return df.select("case_id", "prefix_nr", "y", "bucket", array_to_vector("x").alias("features"))


def scores(forests, df):
    return sorted((r["case_id"] or "", r["prefix_nr"], r["y"], tuple(r["s"])) for r in forests.score(df, "s").collect())


def test_trees_are_the_same_wherever_their_parts_grow(spark, monkeypatch):
    """With all features at each node nothing but the rows decides; tops from sums and one task for a whole tree give equal scores, as do other partitions."""
    df = some_rows(spark)
    sets = [({"n_estimators": 2, "max_features": 1.0}, 0), ({"n_estimators": 1, "max_features": 1.0, "max_depth": 4}, 1)]
    whole = scores(W.fit_forests(df, sets), df)
    monkeypatch.setattr(W, "SUBTREE_ROWS", 80)
    cut = W.fit_forests(df.repartition(7), sets)
    assert len(cut.handed) > 3 and any(len(t.feature) > 5 for t in cut.tops)
    assert scores(cut, df.repartition(3)) == whole
    monkeypatch.setattr(W, "BLOCK", 5)
    monkeypatch.setattr(W, "FLUSH", 500)
    assert scores(cut, df) == whole and len(whole) == 600 and len(whole[0][3]) == 2
    monkeypatch.setattr(W, "SUBTREE_ROWS", 0)  # all of it from sums
    assert scores(W.fit_forests(df, sets[1:]), df) == sorted((*s[:3], s[3][1:]) for s in whole)


def test_a_large_deep_forest_is_not_fitted_level_by_level(spark, monkeypatch):
    df = some_rows(spark)
    want = GuardedClassifier("rf", {"n_estimators": 20, "max_features": 0.7}, min_cases=1).fit(df).score(df)
    monkeypatch.setattr(models, "TREE_ROWS", 100)
    monkeypatch.setattr(models, "estimator", lambda *a: pytest.fail("MLlib grows it"))
    got = GuardedClassifier("rf", {"n_estimators": 20, "max_features": 0.7}, min_cases=1).fit(df).score(df)
    assert got.columns == [n for n in df.columns if n != "features"] + ["predicted"] and got.count() == 600
    auc, mllib = (A.auc(x.withColumn("actual", F.col("y"))).first()["auc"] for x in (got, want))
    assert auc == pytest.approx(mllib, abs=0.02) and auc > 0.8
    again = GuardedClassifier("rf", {"n_estimators": 20, "max_features": 0.7}, min_cases=1).fit(df.repartition(5)).score(df)
    assert sorted(r["predicted"] for r in again.collect()) == sorted(r["predicted"] for r in got.collect())


def test_sets_and_runs_of_a_large_bucket_grow_together(spark, monkeypatch):
    """One fit for all sets and runs of the large bucket; small buckets and buckets of one class as before."""
    df = some_rows(spark)
    small = df.limit(30).withColumn("bucket", F.lit(2).cast("long"))
    sides = {"train": df.unionByName(small).unionByName(small.where("y = 1").withColumn("bucket", F.lit(3).cast("long"))).localCheckpoint()}
    sides["val"] = sides["train"]
    data = train.EncodedSplits("single_agg", "case_id", sides, {1: [0, 1, 2], 2: [0, 1], 3: [0]}, 0.5)
    monkeypatch.setattr(models, "TREE_ROWS", 100)
    fits = []
    monkeypatch.setattr(train, "fit_forests", lambda rows, sets: fits.append(len(sets)) or W.fit_forests(rows, sets))
    configs = ["3_0.4", "2_1.0"]
    pred = train.evaluate_configs(data, "rf", configs, n_runs=2).cache()
    assert fits == [4]
    counts = {tuple(r)[:3]: r["count"] for r in pred.groupBy("params", "run", "bucket").count().collect()}
    of = {r["bucket"]: r["count"] for r in sides["val"].groupBy("bucket").count().collect()}
    assert counts == {(text, run, b): n for text in configs for run in range(2) for b, n in of.items()}
    assert {r["predicted"] for r in pred.where("bucket = 3").collect()} == {1.0}
    runs = {k: [r["predicted"] for r in pred.where(f"bucket = 1 AND params = '{k[0]}' AND run = {k[1]}").collect()] for k in ((t, r) for t in configs for r in range(2))}
    assert len({tuple(sorted(v)) for v in runs.values()}) == 4 and all(0 <= x <= 1 for v in runs.values() for x in v)
    only = train.evaluate_configs(train.EncodedSplits("single_agg", "case_id", {k: v.where("bucket = 1") for k, v in sides.items()}, {1: [0, 1, 2]}, 0.5), "rf", configs, n_runs=2)
    assert only.columns == pred.columns and only.count() == 4 * 600

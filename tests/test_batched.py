import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tracewise.operators import batched as B
from tracewise.operators.models import GuardedClassifier


def some_rows(spark, n=240, seed=1, values=5, buckets=3):
    """Few values a feature, the last one constant; the last bucket is small and of one class."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.integers(0, values, 3).astype(float)
        y = int(x[0] + x[1] * 0.5 + rng.normal() > values / 2)
        rows.append((i, i % buckets, y, [*(x / 2).tolist(), 7.0]))
    rows += [(n + i, 90, 1, [1.0, 2.0, 3.0, 7.0]) for i in range(4)]
    return rows, spark.createDataFrame(rows, "id long, bucket long, y int, x array<double>").select("id", "bucket", "y", array_to_vector("x").alias("features"))


def test_logit_equals_mllib(spark):
    rows, df = some_rows(spark)
    configs = [("-2", {"C": -2}), ("3", {"C": 3})]
    fitted = B.fit_logit(df, configs, runs=2)
    assert set(fitted.models) == {(b, t, r) for b in range(3) for t, _ in configs for r in range(2)}
    for bucket in range(3):
        part = df.where(f"bucket = {bucket}")
        n = part.count()
        guard = GuardedClassifier("logit", {"C": 1}, min_cases=1).fit(part)  # for its scaler
        scaled = guard._scaled(part)
        x = np.array([r[3] for r in rows if r[1] == bucket])
        mean, deviation = x.mean(0), x.std(0)
        for text, p in configs:
            mllib = LogisticRegression(featuresCol="features", labelCol="y", regParam=1 / (2.0 ** p["C"] * n), standardization=False, tol=1e-14, maxIter=500).fit(scaled)
            intercept, weights = fitted.models[bucket, text, 0]
            np.testing.assert_allclose((weights * deviation)[:3], mllib.coefficients.toArray()[:3], atol=1e-6)
            assert weights[3] == 0 and intercept + weights @ mean == pytest.approx(mllib.intercept, abs=1e-6)
    scored = fitted.score(df)
    assert scored.columns == ["id", "bucket", "y", "params", "run", "predicted"]
    got = {(r.id, r.params, r.run): r.predicted for r in scored.collect()}
    assert len(got) == 4 * len(rows)
    for i, b, _, x in rows:
        for text, _ in configs:
            want = 1.0 if b == 90 else 1 / (1 + math.exp(-(fitted.models[b, text, 0][0] + fitted.models[b, text, 0][1] @ np.array(x))))
            assert got[i, text, 1] == pytest.approx(want, abs=1e-12)


def slow_trees(x, y, p, columns, trees):
    """Greedy trees by trying every cut of every column."""
    margins, out = np.zeros(len(y)), []
    for t in range(trees):
        prob = 1 / (1 + np.exp(-margins))
        g, h = prob - y, prob * (1 - prob)

        def grow(at, depth):
            G, H = g[at].sum(), h[at].sum()
            best = (1e-6, None)
            if depth < p["max_depth"]:
                for f in columns[t]:
                    values = np.unique(x[:, f])
                    for cut in (values[1:] + values[:-1]) / 2:
                        left = at[x[at, f] < cut]
                        right = at[x[at, f] >= cut]
                        gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[right].sum(), h[right].sum()
                        if hl < p["min_child_weight"] or hr < p["min_child_weight"]:
                            continue
                        gain = 0.5 * (gl ** 2 / (hl + 1) + gr ** 2 / (hr + 1) - G ** 2 / (H + 1))
                        if gain > best[0] + 1e-12:
                            best = (gain, (f, cut, left, right))
            if best[1] is None:
                margins_new[at] += -G / (H + 1) * p["learning_rate"]
                return
            grow(best[1][2], depth + 1)
            grow(best[1][3], depth + 1)

        margins_new = margins.copy()
        grow(np.arange(len(y)), 0)
        margins = margins_new
        out.append(margins)
    return out


def test_boosting_equals_brute_force(spark):
    rows, df = some_rows(spark, 300)
    p = {"n_estimators": 5, "learning_rate": 0.3, "max_depth": 3, "min_child_weight": 2, "colsample_bytree": 0.8}
    q = {"n_estimators": 3, "learning_rate": 0.5, "max_depth": 2, "min_child_weight": 0.5}
    fitted = B.fit_boosted(df, [("p", p), ("q", q)], runs=2, refresh=2)
    staged = {(r.id, r.params, r.run): r.predicted for r in fitted.staged(df).collect()}
    scored = {(r.id, r.params, r.run): r.predicted for r in fitted.score(df).collect()}
    for bucket in range(3):
        own = [r for r in rows if r[1] == bucket]
        x, y = np.array([r[3] for r in own]), np.array([r[2] for r in own])
        for text, params in (("p", p), ("q", q)):
            for run in range(2):
                columns = [B.draws(run, t, 4, params.get("colsample_bytree", 1)) for t in range(params["n_estimators"])]
                want = slow_trees(x, y, params, columns, params["n_estimators"])
                for i, r in enumerate(own):
                    assert staged[r[0], text, run] == pytest.approx([m[i] for m in want], abs=1e-9)
                    assert scored[r[0], text, run] == pytest.approx(1 / (1 + math.exp(-want[-1][i])), abs=1e-9)
    assert all(scored[r[0], "p", 0] == 1.0 for r in rows if r[1] == 90) and (rows[-1][0], "p", 0) not in staged
    nodes = fitted.table(spark)
    first = nodes.where("bucket = 0 AND params = 'q' AND run = 0 AND tree = 0 AND feature = -1 AND weight <> 0")
    assert first.count() >= 2 and nodes.where("feature >= 0 AND threshold IS NULL").count() == 0


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 4, 5])
def test_small_and_large_trees_route_alike(depth):
    rng = np.random.default_rng(depth)
    codes = rng.integers(0, 256, (500, 4)).astype(np.uint8)
    tree, open_nodes = B.Tree(), [0]
    for level in range(depth):
        parted = [n for n in open_nodes if level == 0 or rng.random() < 0.8]
        open_nodes = [child for n in parted for child in tree.part(n, int(rng.integers(0, 4)), int(rng.choice([0, 100, 200, 254, 255])))]
    tree.weight = rng.normal(size=len(tree.weight)).tolist()
    ends = []
    for row in codes:
        node = 0
        while tree.feature[node] >= 0:
            node = (tree.left if row[tree.feature[node]] <= tree.cut[node] else tree.right)[node]
        ends.append(node)
    columns = np.ascontiguousarray(codes.T)
    routes = B.Routes.by_code(tree)
    assert (routes.ends is None) == (sum(f >= 0 for f in tree.feature) > B.NODES)
    assert routes.nodes(columns).tolist() == ends
    assert routes.weights(columns).tolist() == [tree.weight[n] for n in ends]
    values = B.Routes(*routes.tree, routes.weight)  # the same limits over numbers
    assert values.nodes(columns.astype(float)).tolist() == ends


def test_rows_know_no_margins_before_a_refresh(spark):
    """A table of margins has a number for each model and row, read at every level of every tree."""
    _, df = some_rows(spark)
    table = B.by_bucket(df, [0, 1, 2])
    binned = B._binned(table, B.learn_cuts(table))
    assert {len(r["margins"]) for r in binned.collect()} == {0}
    route = B.Routes.by_code(B.Tree())
    route.weight[:] = 0.5
    moved = B._moved(binned, {(b, 1): [route] for b in range(3)}, 2).collect()
    assert {tuple(np.frombuffer(r["margins"], float)) for r in moved} == {(0.0, 0.5)}


def test_runs_of_equal_weights_are_scored_once(spark):
    _, df = some_rows(spark)
    fitted = B.fit_logit(df, [("-2", {"C": -2}), ("3", {"C": 3})], runs=4)
    assert fitted._shared(spark).count() == 3 * 2
    one = fitted.models[0, "3", 0]
    fitted.models[0, "3", 2] = (one[0] + 1, one[1])  # a run of its own
    assert sorted(sorted(r["runs"]) for r in fitted._shared(spark).where("bucket = 0 AND params = '3'").collect()) == [[0, 1, 3], [2]]
    scored = fitted.score(df).collect()
    assert len(scored) == 240 * 2 * 4 + 4 * 2 * 4
    x = {r["id"]: r["features"].toArray() for r in df.collect()}
    for r in scored:
        if r["bucket"] < 90:
            b, w = fitted.models[r["bucket"], r["params"], r["run"]]
            assert r["predicted"] == pytest.approx(1 / (1 + math.exp(-(b + x[r["id"]] @ w))), rel=1e-12)


def test_rows_and_columns_are_drawn(spark):
    keys = np.random.default_rng(1).integers(-2**63, 2**63, 20_000)
    shares = [B.sampled(keys, s, t, 0.7) for s, t in ((0, 0), (0, 1), (1, 0))]
    assert all(abs(s.mean() - 0.7) < 0.02 for s in shares) and not (shares[0] == shares[1]).all()
    assert (B.sampled(keys, 0, 0, 0.7) == shares[0]).all() and B.sampled(keys, 0, 0, 1.0).all()
    assert len(B.draws(3, 1, 10, 0.55)) == 5 and len(B.draws(3, 1, 10, 0.01)) == 1 and B.draws(3, 1, 4, 1.0).tolist() == [0, 1, 2, 3]


def test_jobs_grow_with_iterations_alone(spark):
    rows, df = some_rows(spark, 120)
    context = spark.sparkContext

    def jobs(name, fn):
        context.setJobGroup(name, name)
        fn()
        context.setLocalProperty("spark.jobGroup.id", None)
        return len(context.statusTracker().getJobIdsForGroup(name))

    p = {"n_estimators": 2, "max_depth": 2}
    one = jobs("one", lambda: B.fit_boosted(df, [("p", p)]))
    many = jobs("many", lambda: B.fit_boosted(df, [(f"p{i}", p) for i in range(16)], runs=5))
    assert many <= one + 1
    one = jobs("one logit", lambda: B.fit_logit(df, [("0", {"C": 0})]))
    many = jobs("many logits", lambda: B.fit_logit(df, [(f"{i}", {"C": 0}) for i in range(16)], runs=5))
    assert many <= one + 1


def test_guards(spark):
    rows, df = some_rows(spark, 30)
    for fit, p in ((B.fit_logit, {"C": 0}), (B.fit_boosted, {"n_estimators": 1})):
        fitted = fit(df, [("a", p)], min_cases=1000, fallback=0.25)
        other = df.unionByName(df.limit(1).withColumn("bucket", F.lit(5).cast("long")))
        got = fitted.score(other).collect()
        assert len(got) == len(rows) + 1
        for r in got:
            own = [y for _, b, y, _ in rows if b == r.bucket]
            assert r.predicted == pytest.approx(np.mean(own) if own else 0.25)
        assert fit(df.limit(0), [("a", p)]).score(df).agg(F.max("predicted")).first()[0] == 0.5

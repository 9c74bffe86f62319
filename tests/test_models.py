import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tracewise.operators import auc as A
from tracewise.operators.models import FourierFeatures, GuardedClassifier, NystroemFeatures, Platt, estimator, learning_curve, rbf
from tracewise.operators.train import encode_splits
from tracewise.plans.experiment import final_predictions, splits, tuning_predictions


def table(spark, rows):
    df = spark.createDataFrame([(list(map(float, x)), y) for x, y in rows], "x array<double>, y int")
    return df.select(array_to_vector("x").alias("features"), "y")


def ring(spark, n=300, seed=1):
    draw = random.Random(seed)
    points = [(draw.uniform(-2, 2), draw.uniform(-2, 2)) for _ in range(n)]
    return table(spark, [(p, int(p[0] ** 2 + p[1] ** 2 < 2)) for p in points])


PARAMS = {"rf": {"n_estimators": 10, "max_features": 1.0}, "xgboost": {"n_estimators": 8, "learning_rate": 0.3},
          "gbm": {"n_estimators": 8, "learning_rate": 0.3, "max_features": 1.0}, "dt": {},
          "svm": {"C": 3, "gamma": 0}, "sequence": {"nb_epoch": 100, "lstmsize": 8}}


@pytest.mark.parametrize("name", sorted(PARAMS))
def test_learns_a_ring(spark, name):
    df = ring(spark)
    model = GuardedClassifier(name, PARAMS[name]).fit(df)
    scored = model.score(df).withColumn("actual", F.col("y"))
    assert A.auc(scored).first()["auc"] > 0.95
    if name != "svm":
        assert scored.agg(F.min("predicted"), F.max("predicted")).first()[0] >= 0


def test_logit_matches_the_penalised_optimum(spark):
    draw = random.Random(2)
    rows = [((a, b), int(draw.random() < 1 / (1 + math.exp(-a + b)))) for a, b in
            ((draw.gauss(0, 1), draw.gauss(0, 1)) for _ in range(200))]
    model = GuardedClassifier("logit", {"C": -3}).fit(table(spark, rows))
    x = np.array([r[0] for r in rows])
    x, y = (x - x.mean(0)) / x.std(0), np.array([r[1] for r in rows])
    cost, w = 2.0 ** -3, np.zeros(3)
    design = np.c_[x, np.ones(len(x))]
    for _ in range(50):  # Newton steps on C * sum of losses + |w|^2 / 2
        p = 1 / (1 + np.exp(-design @ w))
        ridge = np.diag([1, 1, 0])
        w -= np.linalg.solve(cost * design.T @ (design * (p * (1 - p))[:, None]) + ridge,
                             cost * design.T @ (p - y) + ridge @ w)
    fitted = model.model
    assert [*fitted.coefficients, fitted.intercept] == pytest.approx(w.tolist(), abs=2e-3)


def test_guards(spark):
    few = table(spark, [((0,), 1), ((1,), 0), ((2,), 0), ((3,), 1)])
    assert GuardedClassifier("dt", {}, min_cases=30).fit(few).constant == 0.5
    one = table(spark, [((0,), 1), ((1,), 1)])
    assert GuardedClassifier("dt", {}, min_cases=1).fit(one).constant == 1.0
    none = GuardedClassifier("dt", {}, fallback=0.3).fit(few.where("y > 5"))
    assert [r["predicted"] for r in none.score(few).collect()] == [0.3] * 4
    assert GuardedClassifier("dt", {}, min_cases=1).fit(few).constant is None
    with pytest.raises(KeyError):
        estimator("odd", {})


def test_platt_equals_newton(spark):
    draw = random.Random(3)
    rows = [(round(draw.gauss(y, 1), 2), y) for y in (draw.randrange(2) for _ in range(150))]
    fitted = Platt().fit(spark.createDataFrame(rows, "predicted double, y int"))
    s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w, design = np.zeros(2), np.c_[s, np.ones(len(s))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]), design.T @ (p - t))
    assert (fitted.slope, fitted.offset) == pytest.approx(tuple(w), abs=1e-5)
    empty = Platt().fit(spark.createDataFrame([], "predicted double, y int"))
    assert empty.slope is None


def test_fourier_features_approximate_the_kernel(spark):
    points = [(0.0, 0.0), (0.5, 0.2), (1.0, -1.0)]
    df = FourierFeatures(0.7, 2, count=4000).transform(table(spark, [(p, 0) for p in points]))
    z = np.array([r["features"].toArray() for r in df.collect()])
    for i, a in enumerate(points):
        for j, b in enumerate(points):
            want = math.exp(-0.7 * sum((u - v) ** 2 for u, v in zip(a, b)))
            assert z[i] @ z[j] == pytest.approx(want, abs=0.05)


@pytest.fixture
def outcome_log(make_log):
    """The outcome is settled by the first activity; the rest is noise."""
    draw = random.Random(6)
    rows, at = [], 0
    for case in range(60):
        good = draw.randrange(2)
        for i in range(draw.randrange(2, 6)):
            at += 1
            rows.append((f"c{case}", at, ("yes" if good else "no") if i == 0 else draw.choice("xyz"), draw.random(),
                         "deviant" if good else "regular"))
    log = make_log(rows, "v double, label string")
    return log.with_spec(dynamic_num=("v",))


@pytest.mark.parametrize("method", ["single_agg", "prefix_index", "state_laststate", "cluster_combined"])
def test_experiment(spark, outcome_log, method):
    pred = final_predictions(outcome_log, method, "dt_calibrated", {"max_depth": 4}, n_estimators=None, threads=3)
    _, _, test = splits(outcome_log)
    from tracewise.operators.prefix import prefixes
    from tracewise.operators.split import max_prefix_length

    rows = prefixes(test, max_prefix_length(outcome_log)).df.count()
    assert pred.count() == rows and pred.select("case_id", "nr_events").distinct().count() == rows
    assert pred.where("predicted < 0 OR predicted > 1 OR predicted IS NULL").count() == 0
    if method == "single_agg":
        assert A.auc(pred).first()["auc"] > 0.95


def test_same_seed_same_scores(spark, outcome_log):
    runs = [final_predictions(outcome_log, "single_agg", "rf", {"n_estimators": 5, "max_features": 0.5}, n_estimators=None)
            .orderBy("case_id", "nr_events").collect() for _ in range(2)]
    assert runs[0] == runs[1]


def test_sequence_model(spark, outcome_log):
    pred = final_predictions(outcome_log, "lstm", "sequence_calibrated", {"nb_epoch": 60, "lstmsize": 8})
    assert A.auc(pred).first()["auc"] > 0.9


def test_tuning(spark, outcome_log):
    from tracewise.operators.tune import best_by_auc, best_by_auc_stability

    pred = tuning_predictions(outcome_log, "single_agg", "rf", ["3_0.2", "3_1.0"], n_runs=2)
    assert {(r["params"], r["run"]) for r in pred.select("params", "run").distinct().collect()} == {
        (p, r) for p in ("3_0.2", "3_1.0") for r in (0, 1)}
    assert best_by_auc(pred).count() == 1
    assert best_by_auc_stability(pred).first()["params"] in ("3_0.2", "3_1.0")


def test_buckets_see_their_own_columns_only(spark, outcome_log):
    train, val, _ = splits(outcome_log)
    data = encode_splits(train, {"val": val}, "prefix_index", 4)
    widths = {b: len(used) for b, used in data.used.items()}
    assert widths[1] < widths[2] < widths[4]
    assert data.bucket("val", 1).first()["features"].size == widths[1]
    data.release()


def test_learning_curve(spark):
    df = ring(spark)
    rows = learning_curve({"n_estimators": 4, "learning_rate": 0.3}, df, df, params_text="p").orderBy("epoch").collect()
    assert [r["epoch"] for r in rows] == [0, 1, 2, 3]
    assert rows[-1]["train_loss"] < rows[0]["train_loss"] and rows[-1]["val_auc"] > 0.9


def exact_kernel_machine(x, y, cost, gamma, rounds=1500):
    """Scores of a kernel machine with squared hinge loss, by descent on all pairs of rows."""
    kernel = rbf(x, x, gamma)
    sign = 2.0 * y - 1
    alpha, bias = np.zeros(len(y)), 0.0
    top = np.linalg.eigvalsh(kernel).max()
    rate = 1 / (1 + 2 * cost * top)
    speed, before = 1.0, alpha
    ahead = alpha
    for _ in range(rounds):
        slack = np.maximum(0, 1 - sign * (kernel @ ahead + bias))
        new = ahead - rate * (ahead - 2 * cost * sign * slack)
        bias += rate * 2 * cost * (sign * slack).mean()
        faster = (1 + np.sqrt(1 + 4 * speed ** 2)) / 2
        ahead, before, speed = new + (speed - 1) / faster * (new - before), new, faster
    return kernel @ before + bias


def ranks(values):
    order = np.argsort(values)
    out = np.empty(len(values))
    out[order] = np.arange(len(values))
    return out


def test_landmarks_stand_for_the_kernel(spark):
    """500 rows in clusters, one of them small and far off: scores rank as those of an exact kernel machine."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 1.0, (n, 3)) for m, n in ((0, 300), (3, 180), (12, 20))])
    y = ((x[:, 0] * x[:, 1] > 1) ^ (x[:, 2] > 9)).astype(int)
    rows = [(i, int(b), a) for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True))]
    df = spark.createDataFrame(rows, "id long, y int, x array<double>").select("id", "y", array_to_vector("x").alias("features"))
    gamma = 0.25
    made = NystroemFeatures(gamma, 120).fit(df)
    most, mean = made.error_bound(df)
    assert 0 <= mean <= most <= 1 and mean < 0.05
    z = np.array([r.features.toArray() for r in made.transform(df).orderBy("id").collect()])
    assert np.abs(z @ z.T - rbf(x, x, gamma)).max() <= most + 1e-6
    assert made.landmarks[:, 0].max() > 9  # the far cluster has landmarks of its own
    linear = exact_kernel_machine(x, y, 1.0, gamma)
    sign, weights, bias = 2.0 * y - 1, np.zeros(z.shape[1]), 0.0
    rate = 1 / (1 + 2 * np.linalg.eigvalsh(z.T @ z).max())
    speed, before, ahead = 1.0, weights, weights
    for _ in range(1500):
        slack = np.maximum(0, 1 - sign * (z @ ahead + bias))
        new = ahead - rate * (ahead - 2 * z.T @ (sign * slack))
        bias += rate * 2 * (sign * slack).mean()
        faster = (1 + np.sqrt(1 + 4 * speed ** 2)) / 2
        ahead, before, speed = new + (speed - 1) / faster * (new - before), new, faster
    approximate = z @ before + bias
    assert np.corrcoef(ranks(linear), ranks(approximate))[0, 1] >= 0.98


def test_svm_by_landmarks_separates_rings(spark):
    rng = np.random.default_rng(5)
    angle, radius = rng.uniform(0, 6.28, 400), np.repeat([1.0, 3.0], 200)
    rows = [(int(r > 2), [float(r * np.cos(a)), float(r * np.sin(a))]) for a, r in zip(angle, radius + rng.normal(0, 0.1, 400), strict=True)]
    df = spark.createDataFrame(rows, "y int, x array<double>").select("y", array_to_vector("x").alias("features"))
    model = GuardedClassifier("svm", {"C": 4, "gamma": 0, "landmarks": 60}).fit(df)
    scored = model.score(df).collect()
    assert isinstance(model.kernel, NystroemFeatures) and all((r.predicted > 0) == (r.y == 1) for r in scored)


def test_standardized_sequences_and_the_claim_of_rows_sequence(spark):
    """Deviations from the mean of the training rows, for any rows, only where wanted; the query says again whether scores beat chance."""
    from pyspark.ml.linalg import Vectors

    from tracewise.operators.train import _standard
    from tracewise.plans.catalog import ORACLES

    rows = spark.createDataFrame([(Vectors.dense([x, 7.0]), i) for i, x in enumerate((100.0, 200.0, 300.0))], ["features", "y"])
    scaled = _standard(rows, True)
    assert [list(r.features) for r in scaled(rows).orderBy("y").collect()] == [[-1.0, 0.0], [0.0, 0.0], [1.0, 0.0]]
    assert list(scaled(spark.createDataFrame([(Vectors.dense([400.0, 7.0]),)], ["features"])).first().features) == [2.0, 0.0]
    assert _standard(rows, False)(rows) is rows and _standard(rows.limit(0), True)(rows) is rows
    assert "true AS better" in ORACLES["rows_sequence"]


def test_deep_trees_see_few_partitions(spark, monkeypatch):
    """Each partition adds up statistics of all nodes of a level, so a deep tree is not fitted on many small partitions."""
    from pyspark.ml.functions import array_to_vector
    from tracewise.operators import models

    rows = spark.range(400).select((F.col("id") % 2).cast("int").alias("y"), array_to_vector(F.array(F.col("id").cast("double"))).alias("features")).repartition(40)
    seen = []

    class Fake:
        def fit(self, train):
            seen.append((train.rdd.getNumPartitions(), train.count()))

    monkeypatch.setattr(models, "estimator", lambda *a: Fake())
    for least, params in ((1000, {}), (100, {}), (100, {"max_depth": 5})):
        monkeypatch.setattr(models, "TREE_ROWS", least, raising=False)
        models.GuardedClassifier("dt", params, min_cases=1).fit(rows)
    cores = spark.sparkContext.defaultParallelism
    assert seen == [(40, 400), (max(4, cores), 400), (40, 400)]


def test_sides_come_from_a_written_log(make_log, monkeypatch):
    """Final models and tuning make the log once: borders, levels and prefixes read a table."""
    from tracewise.plans import experiment

    class Seen(Exception):
        pass

    def seen(log, *_):
        raise Seen(log)

    monkeypatch.setattr(experiment, "splits", seen)
    log = make_log([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x")])
    for run in (lambda: experiment.final_predictions(log, "single_agg", "logit", {"C": 1}), lambda: experiment.tuning_predictions(log, "single_agg", "logit", ["1"])):
        with pytest.raises(Seen) as found:
            run()
        written = found.value.args[0]
        assert written.df.inputFiles() and written.df.count() == 3 and written.spec == log.spec


def test_landmarks_are_the_least_of_all_tasks_and_each_row_is_weighed_once(spark):
    draw = random.Random(5)
    points = [[float(draw.randrange(12)), float(draw.randrange(5)) - 2.0, draw.choice([0.0, -0.0])] for _ in range(400)]
    known = spark.createDataFrame([(p,) for p in points], "__x array<double>").repartition(7)
    hashed = known.select("__x", F.xxhash64(F.lit(22), "__x").alias("h")).collect()
    def least(p, h):
        return -math.log((abs(h) % (1 << 52) + 1) / (1 << 52)) / (1 + p[0])
    want = {tuple(v + 0.0 for v in r["__x"]): least(r["__x"], r["h"]) for r in hashed}
    seen = spark.sparkContext.accumulator(0)

    def weight(rows):
        seen.add(len(rows))
        return 1 + rows[:, 0]

    for count in (9, 40, 500):
        seen.value = 0
        got = NystroemFeatures(1.0, count)._drawn(known, weight)
        assert [tuple(r) for r in got.tolist()] == sorted(want, key=lambda p: (want[p], p))[:count]
        assert seen.value == len(points)


def test_calibration_scores_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        seen.add(1)
        return (i % 10) / 10

    rows = spark.range(200).select(score("id").alias("predicted"), (F.col("id") % 10 > F.col("id") % 7).cast("int").alias("y"))
    platt = Platt().fit(rows)
    assert seen.value == 200 and platt.slope > 0

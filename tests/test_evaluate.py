"""AUC, stability and smoothing."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracewise.operators import auc as A
from tracewise.operators import stability as S
from tracewise.operators import tune

PRED = "dataset string, Method string, case_id string, nr_events int, predicted double, actual int"


def series(spark, cases, actual=1):
    rows = [("d", "m", case, i + 1, float(v), actual) for case, values in cases.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, PRED)


def golden():
    wave = [math.sin(i) for i in range(1, 12)]
    scale = (0.7 - 0.1) / (max(wave) - min(wave))
    return {"A": [0.25] * 11, "B": [0.5] * 5 + [0.9] * 6, "D": [scale * (w - min(wave)) + 0.1 for w in wave]}


def recurrence(values, beta):
    out = [values[0]]
    for v in values[1:]:
        out.append(beta * out[-1] + (1 - beta) * v)
    return out


def smoothed(df):
    rows = df.orderBy("case_id", "nr_events").collect()
    out = {}
    for r in rows:
        out.setdefault(r["case_id"], []).append(r["smoothed"])
    return out


def test_golden_series(spark):
    pred = series(spark, golden())
    steady = {r["case_id"]: r["coef_mean_abs"] for r in S.case_volatility(pred).collect()}
    assert steady["A"] == 1.0 and steady["B"] == pytest.approx(0.96)
    got = smoothed(S.smooth(pred, 0.8))
    for case, values in golden().items():
        assert got[case] == pytest.approx(recurrence(values, 0.8))
    assert got["B"][5] == pytest.approx(0.58)


def test_beta_0_changes_nothing_and_1_keeps_the_first(spark):
    pred = series(spark, golden())
    assert smoothed(S.smooth(pred, 0))["B"] == golden()["B"]
    assert smoothed(S.smooth(pred, 1))["B"] == [0.5] * 11


@pytest.mark.parametrize("beta", [0.001, 0.1, 0.5, 0.9])
@pytest.mark.parametrize("limit", [10 ** 6, 200])
def test_long_cases(spark, hot, beta, limit):
    draw = random.Random(7)
    cases = {"long": [draw.random() for _ in range(1200)], "short": [0.3, 0.7], "zero": [1.0] + [0.0] * 700}
    hot(limit)
    got = smoothed(S.smooth(series(spark, cases), beta))
    for case, values in cases.items():
        assert got[case] == pytest.approx(recurrence(values, beta), abs=1e-12)


def test_chain_ends_at_a_gap(spark):
    rows = [("d", "m", "a", n, 0.5, 1) for n in (1, 2, 4, 5)] + [("d", "m", "b", n, 0.5, 1) for n in (2, 3)]
    df = S.smooth(spark.createDataFrame(rows, PRED), 0.5)
    assert [(r["case_id"], r["nr_events"]) for r in df.orderBy("nr_events").collect()] == [("a", 1), ("a", 2)]


def test_smoothing_steadies(spark):
    draw = random.Random(8)
    pred = series(spark, {str(i): [draw.random() for _ in range(8)] for i in range(20)}).withColumn(
        "actual", (F.col("case_id").cast("int") % 2))
    table = S.smoothing_sweep(pred).orderBy("beta").collect()
    steady = [r["mean_mean_abs"] for r in table]
    assert steady == sorted(steady) and len(table) == len(S.SWEEP_BETAS)
    short = S.smoothing_sweep(pred, max_length=8).orderBy("beta").collect()
    assert [r["mean_mean_abs"] for r in short] == pytest.approx(steady)


def test_one_event_cases_do_not_count(spark):
    pred = series(spark, {"a": [0.5, 0.7], "b": [0.1]})
    assert S.stability_mean(pred).first()["mean_mean_abs"] == pytest.approx(0.8)


def brute_auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("limit", [10 ** 6, 5])
def test_auc_equals_pair_count(spark, hot, limit):
    draw = random.Random(9)
    rows = [(g, draw.randrange(30) / 10 - 1, draw.randrange(2)) for g in "ab" for _ in range(100)] + [("one", 0.5, 1)]
    df = spark.createDataFrame(rows, "g string, predicted double, actual int")
    hot(limit)
    got = {r["g"]: r for r in A.auc(df, ["g"]).collect()}
    for g in "ab":
        want = brute_auc([(s, y) for x, s, y in rows if x == g])
        assert got[g]["auc"] == pytest.approx(want)
        assert got[g]["auc_auto"] == pytest.approx(max(want, 1 - want)) or abs(want - 0.5) < 0.1
    assert got["one"]["auc"] is None and got["one"]["count"] == 1
    assert A.auc(df).first()["auc"] == pytest.approx(brute_auc([r[1:] for r in rows]))


def test_separable_scores(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.8, 1)], "predicted double, actual int")
    assert A.auc(df).first()["auc"] == 1.0
    flipped = A.auc(df.withColumn("actual", 1 - F.col("actual"))).first()
    assert (flipped["auc"], flipped["auc_auto"]) == (0.0, 1.0)


def test_lengths_without_auc_stay_in_the_weights(spark):
    aucs = spark.createDataFrame([("d", "m", 1, 0.8, 30), ("d", "m", 2, None, 10)],
                                 "dataset string, Method string, nr_events int, auc double, count long")
    row = A.weighted_auc(aucs).first()
    assert row["avg_weighted_auc"] == pytest.approx(0.6) and row["avg_auc"] == pytest.approx(0.8)


def test_rmspd_with_missing_rows(spark):
    rows = [("p", "a", "d", 1, 0, 0.5), ("p", "a", "d", 1, 1, 0.7), ("p", "a", "d", 1, 2, 0.9),
            ("p", "b", "d", 1, 0, 0.1), ("p", "b", "d", 1, 1, 0.1)]  # b is missing from run 2
    df = spark.createDataFrame(rows, "params string, case_id string, dataset_name string, nr_events int, run int, predicted double")
    want = math.sqrt((0.04 / 2 + 0.16 + 0.04) / 3)
    assert S.rmspd(df).first()["rmspd"] == pytest.approx(want)


def test_draws(spark):
    rows = tune.sample_params(spark, "xgboost", 200).collect()
    assert len({r["params"] for r in rows}) == 200
    for name, (kind, *args) in tune.SEARCH_SPACES["xgboost"].items():
        values = [r[name] for r in rows]
        assert args[0] <= min(values) and max(values) <= args[1] - (1 if kind == "int" else 0)
    again = tune.sample_params(spark, "xgboost", 200).collect()
    assert again == rows and tune.sample_params(spark, "xgboost", 200, seed=1).collect() != rows
    lstm = tune.sample_params(spark, "lstm", 50).collect()
    assert {r["optimizer"] for r in lstm} == {"rmsprop", "adam"} and all(10 <= r["lstmsize"] < 150 for r in lstm)


def test_rescaled_exponential(spark):
    u = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "u double")
    got = [r[0] for r in u.select(tune.draw(F.col("u"), ("rescaled_exp", 2.0, 4.0))).collect()]
    assert got == pytest.approx([2.0, 2 + 2 * (math.exp(0.5) - 1) / (math.e - 1), 4.0])


def test_best_epoch(spark):
    curves = spark.createDataFrame([(4, 0.1, "a_b"), (5, 0.3, "a_b"), (6, 0.2, "a_b"), (6, None, "c")],
                                   "epoch int, val_loss double, params string")
    assert tune.best_by_val_loss(curves).first()["params"] == "a_b_6"

import csv

import pytest
from pyspark.sql import functions as F

from tracewise import LogSpec, spec, spec_names
from tracewise.functions import params as P
from tracewise.operators import auc as A
from tracewise.sources import logs, params
from tracewise.spec import expand


def write_csv(path, header, rows):
    with open(path, "w", newline="") as f:
        csv.writer(f, delimiter=";").writerows([header, *rows])
    return str(path)


def test_registry():
    assert len(spec_names()) == 2 + 4 + 1 + 3 + 18 + 3
    assert (spec("sepsis_cases_4").pos_label, spec("hospital_billing_1_sample10000").pos_label) == ("regular", "regular")
    assert spec("sepsis_cases_1").pos_label == "deviant" and spec("bpic2017_refused").filename == "BPIC17_O_Refused.csv"
    assert expand("sepsis_cases") == ("sepsis_cases_1", "sepsis_cases_2", "sepsis_cases_4")
    assert expand("production") == ("production",)
    assert {f.name: f.dataType.simpleString() for f in spec("production").schema().fields}["Resource.1"] == "string"


def test_labelled_log(spark, tmp_path):
    own = LogSpec("own", dynamic_cat=("Activity", "Resource.1"), static_num=("Age",))
    path = write_csv(tmp_path / "log.csv", ["Age", "Case ID", "Activity", "Resource.1", "Complete Timestamp", "label"],
                     [["30", "c1", "x", "7", "2024-01-01 10:00:00", "deviant"], ["", "c1", "y", "", "2024-01-01 11:00:00.5", "deviant"]])
    log = logs.read_log(spark, path, own)
    types = dict(log.df.dtypes)
    assert types["Complete Timestamp"] == "timestamp_ntz" and types["Age"] == "double" and types["Resource.1"] == "string"
    rows = log.df.orderBy("seq").collect()
    assert [r["Age"] for r in rows] == [30.0, None] and log.spec.event_order[-1] == "seq"
    with pytest.raises(ValueError):
        logs.read_log(spark, path, own.with_(static_num=("Age", "absent")))
    logs.write_table(log.df.drop("seq"), str(tmp_path / "out"))
    assert logs.read_log(spark, str(tmp_path / "out"), own).df.count() == 2


def test_raw_log(spark, tmp_path):
    path = write_csv(tmp_path / "raw.csv", ["Case ID", "(case) amount", "when"], [["a", "3", "2024/01/02 03:04:05.000"]])
    raw = logs.read_raw_log(spark, path, ["when"], timestamp_format="yyyy/MM/dd HH:mm:ss.SSS")
    assert dict(raw.dtypes)["(case) amount"] == "int" and dict(raw.dtypes)["when"] == "timestamp_ntz"


def test_results_and_tags(spark, tmp_path):
    for beta in ("0.1", "0.25"):
        write_csv(tmp_path / f"aucs_d_m_{beta}.csv", ["dataset", "nr_events", "auc"], [["d", "1", "0.5"], ["d", "2", "None"]])
    df = logs.read_results(spark, str(tmp_path / "aucs*.csv"))
    assert df.count() == 4 and df.where("auc IS NULL").count() == 2 and dict(df.dtypes)["nr_events"] == "int"
    tagged = logs.read_tagged(spark, str(tmp_path / "aucs*.csv"))
    assert sorted({r["beta"] for r in tagged.collect()}) == [0.1, 0.25]
    logs.write_table(tagged, str(tmp_path / "by_beta"), partition_by=["beta"])
    assert sorted({r["beta"] for r in logs.read_tagged(spark, str(tmp_path / "by_beta")).collect()}) == [0.1, 0.25]


def test_metrics_file(spark, tmp_path):
    rows = [("d", "m", "rf", n, s, y) for n in (1, 2) for s, y in ((0.2, 0), (0.9, 1))] + [("d", "m", "rf", 3, 0.5, 1)]
    pred = spark.createDataFrame(rows, "dataset string, method string, cls string, nr_events int, predicted double, actual int")
    logs.write_table(A.metrics_long(pred), str(tmp_path / "m"))
    back = {r["nr_events"]: r["score"] for r in logs.read_results(spark, str(tmp_path / "m")).collect()}
    assert back == {1: 1.0, 2: 1.0, 3: None, -1: pytest.approx(10 / 12 + 0.0, abs=0.2)}


def test_parameter_store(spark, tmp_path):
    best = spark.createDataFrame([("d", "single_agg", "rf", "150_0.3"), ("d", "single_agg", "xgboost", "200_0.02_0.7_5_0.9_1")],
                                 "dataset string, method string, cls string, params string")
    params.save_params(best, str(tmp_path / "p"))
    assert params.load_params(spark, str(tmp_path / "p"), "d", "single_agg", "rf", 500) == {"n_estimators": 500, "max_features": 0.3}
    assert params.load_params(spark, str(tmp_path / "p"), "d", "single_agg", "xgboost")["max_depth"] == 5
    with pytest.raises(LookupError):
        params.load_params(spark, str(tmp_path / "p"), "d", "single_agg", "lstm")
    per_length = best.limit(1).withColumn("nr_events", F.explode(F.array(F.lit(1), F.lit(2))))
    params.save_params(per_length, str(tmp_path / "q"))
    assert set(params.load_params(spark, str(tmp_path / "q"), "d", "single_agg", "rf")) == {1, 2}


def test_parameter_text(spark):
    names = P.PARAM_NAMES["rf"]
    df = spark.createDataFrame([("150_0.25",), ("7",)], "t string")
    rows = df.select(P.parse_params(F.col("t"), names).alias("p")).select("p.*", P.format_params(F.col("p"), names)).collect()
    assert [tuple(r) for r in rows] == [(150, 0.25, "150_0.25"), (7, None, "7")]
    assert P.params_to_text(P.params_from_text("150_0.25", "rf"), "rf") == "150_0.25"

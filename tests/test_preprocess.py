"""The recipes for the raw public logs, on small tables of their shape."""

from datetime import datetime, timedelta

import pytest

from tracewise.plans import preprocess
from tracewise.spec import BPIC2012, BPIC2017, HOSPITAL_BILLING, PRODUCTION, SEPSIS_CASES, TIME_FEATURES, TRAFFIC_FINES

BASE = datetime(2024, 1, 1)


def raw_table(spark, base, rows, types=None, static_prefix=""):
    """Rows are dicts with case, minute and activity; other columns of the spec are null unless given."""
    types = types or {}
    columns = {base.case: "string", base.activity: "string", base.timestamp: "timestamp_ntz", "seq": "bigint"}
    columns.update({n: "string" for n in base.cat if n not in columns})
    columns.update({n: "double" for n in base.num if n not in TIME_FEATURES and n != "activity_duration"})
    columns.update(types)
    data = []
    for i, row in enumerate(rows):
        row = dict(row)
        values = {base.case: row.pop("case"), base.timestamp: BASE + timedelta(minutes=row.pop("at")),
                  base.activity: row.pop("do"), "seq": i, **row}
        data.append(tuple(values.get(n) for n in columns))
    df = spark.createDataFrame(data, ", ".join(f"`{n}` {t}" for n, t in columns.items()))
    return df.withColumnsRenamed({n: static_prefix + n for n in (*base.static_cat, *base.static_num)}) if static_prefix else df


def events(log, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in log.df.orderBy("seq").collect()]


@pytest.fixture(autouse=True)
def keep_rare_levels(monkeypatch):
    monkeypatch.setattr(preprocess, "RARE_BELOW", 1)


def test_sepsis(spark):
    raw = raw_table(spark, SEPSIS_CASES, [
        dict(case="a", at=0, do="ER", CRP=5.0, Diagnose="flu", Age=40.0), dict(case="a", at=60, do="Admission IC"),
        dict(case="a", at=90, do="Release A"), dict(case="a", at=90 + 27 * 1440, do="Return ER"),
        dict(case="b", at=10, do="ER"), dict(case="b", at=20, do="Release B", CRP=1.0), dict(case="b", at=20 + 29 * 1440, do="Return ER"),
        dict(case="c", at=30, do="ER"),  # never released: incomplete
        dict(case=None, at=5, do="Release C")])
    logs = preprocess.sepsis_cases(raw, reuse=True)
    assert events(logs["sepsis_cases_1"], "Case ID", "label") == [("a", "deviant")] * 3 + [("b", "regular")] * 2 + [
        ("missing_caseid", "regular")]
    assert events(logs["sepsis_cases_2"], "Case ID", "label") == [("a", "deviant")] + [("b", "regular")] * 3 + [
        ("missing_caseid", "regular")]
    assert events(logs["sepsis_cases_3"], "label") == ["deviant"] * 5 + ["regular"]
    assert logs["sepsis_cases_4"].spec.pos_label == "regular"
    assert events(logs["sepsis_cases_4"], "Case ID", "label")[0] == ("a", "deviant")
    first = logs["sepsis_cases_3"]
    assert events(first, "CRP")[:5] == [5.0, 5.0, 5.0, 0.0, 1.0] and events(first, "Diagnose")[3] == "missing"
    assert events(first, "open_cases")[:3] == [1, 2, 2]


def test_hospital(spark):
    raw = raw_table(spark, HOSPITAL_BILLING, [
        dict(case="a", at=0, do="NEW", isCancelled=False), dict(case="a", at=1, do="DELETE", isCancelled=True),
        dict(case="b", at=0, do="NEW", closeCode="A", isClosed=True), dict(case="b", at=2, do="REOPEN"), dict(case="b", at=3, do="FIN"),
        dict(case="c", at=0, do="NEW")],
        {"isCancelled": "boolean", "isClosed": "boolean", "closeCode": "string"})
    logs = preprocess.hospital_billing(raw, reuse=True)
    assert set(logs) == {f"hospital_billing_{i}" for i in range(1, 7)}
    assert events(logs["hospital_billing_1"], "Case ID", "label") == [("a", "regular")] + [("b", "deviant")] * 3
    assert events(logs["hospital_billing_2"], "Case ID", "label") == [("a", "deviant")] * 2 + [("b", "regular")] * 3
    assert events(logs["hospital_billing_3"], "Case ID", "label") == [("a", "regular")] * 2 + [("b", "deviant")]
    assert events(logs["hospital_billing_5"], "label") == ["regular"] * 2 + ["deviant"] * 3
    assert set(events(logs["hospital_billing_4"], "label")) == {"regular"}
    assert "isCancelled" not in logs["hospital_billing_1"].df.columns
    # read in the order (time, case): a opens at 0 and is gone at 1; b opens at 0 and is gone at 3
    assert events(logs["hospital_billing_5"], "open_cases") == [0, 2, 1, 1, 1]


def test_traffic(spark):
    raw = raw_table(spark, TRAFFIC_FINES, [
        dict(case="a", at=0, do="Create Fine", amount=30.0, totalPaymentAmount=0.0), dict(case="a", at=5, do="Payment", totalPaymentAmount=30.0),
        dict(case="b", at=0, do="Create Fine", amount=20.0), dict(case="b", at=9, do="Send for Credit Collection"),
        dict(case="c", at=0, do="Create Fine"), dict(case="c", at=1, do="Send Fine")],
        {"totalPaymentAmount": "double"}, static_prefix="(case) ")
    logs = preprocess.traffic_fines(raw)
    assert events(logs["traffic_fines_1"], "Case ID", "label") == [("a", "regular")] * 2 + [("b", "deviant")]
    assert events(logs["traffic_fines_2"], "Case ID", "label") == [("a", "deviant")] + [("b", "regular")] * 2
    assert events(logs["traffic_fines_1"], "amount") == [30.0, 30.0, 20.0]


def test_production(spark):
    raw = raw_table(spark, PRODUCTION, [
        {"case": "a", "at": 10, "do": "turn", "Start Timestamp": BASE, "Qty_Rejected": 0.0, "Resource.1": "m1"},
        {"case": "a", "at": 20, "do": "turn", "Start Timestamp": BASE, "Qty_Rejected": 2.0},
        {"case": "b", "at": 30, "do": "mill", "Qty_Rejected": 0.0}, {"case": "c", "at": 5, "do": "mill", "Qty_Rejected": 1.0}],
        {"Start Timestamp": "timestamp_ntz", "Qty_Rejected": "double"})
    log = preprocess.production(raw)["production"]
    assert events(log, "Case ID", "label", "activity_duration", "Resource.1", "open_cases") == [
        ("a", "deviant", 10.0, "m1", 0), ("b", "regular", 0.0, "missing", 0)]


@pytest.mark.parametrize("year", [2012, 2017])
def test_offers(spark, year):
    base = BPIC2012 if year == 2012 else BPIC2017
    names = ("O_ACCEPTED-COMPLETE", "O_CANCELLED-COMPLETE") if year == 2012 else ("O_Accepted", "O_Cancelled")
    offer = {} if year == 2012 else {"EventOrigin": "Offer"}
    rows = [dict(case="a", at=0, do="A_START", **{base.resource: "r1"}), dict(case="a", at=1, do=names[1], **offer),
            dict(case="a", at=2, do=names[0], **offer), dict(case="a", at=3, do="W_END"),
            dict(case="b", at=0, do=names[1], **offer), dict(case="c", at=0, do="A_START"),
            dict(case="d", at=0, do="O_SENT", **offer)]
    logs = (preprocess.bpic2012 if year == 2012 else preprocess.bpic2017)(
        raw_table(spark, base, rows, {"lifecycle:transition": "string"}))
    accepted, cancelled = logs[f"bpic{year}_accepted"], logs[f"bpic{year}_cancelled"]
    assert events(accepted, "Case ID", "label") == [("a", "deviant")] * 4 + [("b", "regular")]
    assert events(cancelled, "label") == ["regular"] * 4 + ["deviant"]
    assert events(accepted, base.resource) == ["r1"] * 4 + ["missing"]
    assert len(logs) == 3 and "outcome" not in accepted.df.columns


def test_rare_levels(spark, monkeypatch):
    monkeypatch.setattr(preprocess, "RARE_BELOW", 3)
    raw = raw_table(spark, TRAFFIC_FINES, [dict(case=str(i), at=i, do="rare" if i == 0 else "common", Resource="r" if i else "x",
                                                totalPaymentAmount=0.0) for i in range(5)], {"totalPaymentAmount": "double"})
    log = preprocess.traffic_fines(raw)["traffic_fines_1"]
    assert events(log, "Resource") == ["other", "r", "r", "r", "r"] and events(log, "Activity")[0] == "rare"


@pytest.mark.parametrize("limit", [2])
def test_recipes_with_oversized_cases(spark, hot, limit):
    rows = [dict(case="a", at=i, do="Release A" if i == 6 else "ER", CRP=float(i) if i % 3 == 0 else None) for i in range(8)]
    plain = events(preprocess.sepsis_cases(raw_table(spark, SEPSIS_CASES, rows))["sepsis_cases_4"], "CRP", "label", "event_nr", "open_cases")
    hot(limit)
    assert events(preprocess.sepsis_cases(raw_table(spark, SEPSIS_CASES, rows))["sepsis_cases_4"],
                  "CRP", "label", "event_nr", "open_cases") == plain
    assert [p[0] for p in plain] == [0.0, 0.0, 0.0, 3.0, 3.0, 3.0]

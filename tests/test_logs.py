"""Semantics of cleaning, features, labels and splits on small hand-made logs."""

import random

import pytest
from pyspark.sql import functions as F

from tracewise.operators import clean, filters, label, split, timefeat
from tracewise.operators import encode as E
from tracewise.operators.prefix import PREFIX, prefix_log, prefixes


def by_seq(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.orderBy("seq").collect()]


def test_gap_goes_to_the_last_of_tied_events(make_log):
    log = make_log([("a", 0, "x"), ("a", 5, "x"), ("a", 5, "y"), ("a", 5, "z"), ("a", 9, "x")])
    assert by_seq(timefeat.time_since_last(log).df, "timesincelastevent") == [0.0, 0.0, 0.0, 5.0, 4.0]


def test_first_tie_has_no_gap(make_log):
    log = make_log([("a", 0, "x"), ("a", 0, "y"), ("a", 3, "z")])
    assert by_seq(timefeat.timestamp_features(log).df, "timesincelastevent", "timesincecasestart", "event_nr") == [
        (0.0, 0.0, 1), (0.0, 0.0, 2), (3.0, 3.0, 3)]


def test_open_cases_equals_brute_force(make_log):
    draw = random.Random(3)
    rows = [(f"c{draw.randrange(40)}", draw.randrange(4000), "x") for _ in range(400)]
    log = make_log(rows)
    spans = {}
    for case, minute, _ in rows:
        low, high = spans.get(case, (minute, minute))
        spans[case] = (min(low, minute), max(high, minute))
    want = [sum(s <= m < e for s, e in spans.values()) for _, m, _ in rows]
    assert by_seq(timefeat.open_cases(log).df, "open_cases") == want


@pytest.mark.parametrize("limit", [10 ** 6, 30])
def test_open_cases_scan_equals_sequential_reading(make_log, hot, limit):
    hot(limit)
    draw = random.Random(4)
    rows = [(f"c{draw.randrange(30)}", draw.randrange(50), "x") for _ in range(300)]
    log = make_log(rows)
    ends = {}
    for case, minute, _ in rows:
        ends[case] = max(ends.get(case, 0), minute)
    want, running = {}, set()
    for minute, case, i in sorted((m, c, i) for i, (c, m, _) in enumerate(rows)):
        want[i] = len(running)
        if minute >= ends[case]:
            running.discard(case)
        else:
            running.add(case)
    assert by_seq(timefeat.open_cases_scan(log).df, "open_cases") == [want[i] for i in range(len(rows))]


def test_weekday_starts_at_monday(make_log):
    df = timefeat.calendar_features(make_log([("a", 0, "x"), ("a", 6 * 1440 + 61, "y")]).df, "ts")  # a Monday
    assert by_seq(df, "weekday", "hour", "timesincemidnight", "month") == [(0, 0, 0, 1), (6, 1, 61, 1)]


def test_time_features_do_not_depend_on_the_session_zone(spark, make_log):
    log = make_log([("a", 68 * 1440 + 60, "x"), ("a", 71 * 1440, "y")])  # across a change to summer time
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert by_seq(timefeat.time_since_last(log).df, "timesincelastevent") == [0.0, 3 * 1440.0 - 60]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_ffill_and_fill(make_log):
    log = make_log([("a", 0, "x", None), ("a", 1, "x", 2.0), ("a", 2, "x", None), ("b", 0, "x", None)], "v double")
    df = clean.fill_missing(clean.ffill(log, ["v"]).df, ["activity"], ["v"])
    assert by_seq(df, "v") == [0.0, 2.0, 2.0, 0.0]


def test_rare_and_top_levels(spark, monkeypatch):
    df = spark.createDataFrame([(x,) for x in "aaaabbbccd"] + [(None,)], "l string")
    show = lambda d: "".join(sorted(r["l"][0] for r in d.collect()))
    assert show(clean.collapse_rare(df, ["l"], 3)) == "aaaabbboooo"
    assert show(clean.collapse_topk(df, ["l"], 3)) == "aaaabbbccoo"
    assert show(clean.collapse_rare(df, ["l"], 3, exempt=["l"]) .na.fill("z")) == "aaaabbbccdz"
    monkeypatch.setattr(clean, "LITERAL_LEVELS", 0)  # by a broadcast table
    assert show(clean.collapse_rare(df, ["l"], 3)) == "aaaabbboooo"
    monkeypatch.setattr(clean, "BROADCAST_LEVELS", 0)  # by a plain join
    assert show(clean.collapse_rare(df, ["l"], 3)) == "aaaabbboooo"


def test_two_way_swap(spark):
    df = spark.createDataFrame([("pos",), ("neg",), ("x",)], "l string")
    assert [r["l"] for r in clean.relabel(df, "l", {"pos": "neg", "neg": "pos"}).collect()] == ["neg", "pos", "x"]


def test_original_id_keeps_underscores(spark):
    df = spark.createDataFrame([("a_b", 1), ("a_b_3", 3)], "id string, n int")
    assert [r[0] for r in df.select(clean.original_case_id(F.col("id"), F.col("n"))).collect()] == ["a_b", "a_b"]


def test_report_names(spark):
    df = spark.createDataFrame([("rf_calibrated", "single_agg", "traffic_fines_1"), ("rf", "single_agg", "x"),
                                ("lstm_calibrated", "lstm", "sepsis_cases_4")], "cls string, method string, dataset string")
    assert sorted((r["Method"], r["dataset"]) for r in clean.report_names(df).collect()) == [
        ("LSTM", "sepsis_cases_3"), ("RF_agg", "traffic_fines")]


def test_cut_can_empty_a_case(make_log):
    log = make_log([("a", 0, "stop"), ("a", 1, "x"), ("b", 0, "x"), ("b", 1, "stop"), ("b", 2, "x"), ("c", 0, "x")])
    assert by_seq(label.label_activity(log, "stop").df, "case_id", "label") == [("b", "deviant"), ("c", "regular")]
    assert by_seq(label.cut_before(log, "stop").df, "seq") == [2, 5]


def test_label_within(make_log):
    log = timefeat.time_since_last(make_log([
        ("a", 0, "x"), ("a", 10, "back"), ("b", 0, "x"), ("b", 50, "back"), ("b", 55, "back"), ("c", 0, "x")]))
    assert by_seq(label.label_activity_within(log, "back", 20).df, "case_id", "label") == [
        ("a", "deviant"), ("b", "regular"), ("c", "regular")]


def test_attribute_present_is_negative(make_log):
    log = make_log([("a", 0, "x", "false"), ("a", 1, "x", "true"), ("b", 0, "x", "missing")], "flag string")
    assert by_seq(label.label_attribute_present(log, "flag").df, "case_id", "label") == [("a", "regular"), ("b", "deviant")]


def test_paid_in_full(make_log):
    log = make_log([("a", 0, "x", 10.0, 0.0), ("a", 1, "x", 30.0, 20.0), ("a", 2, "x", None, 30.0),
                    ("b", 0, "x", 10.0, 9.0)], "amount double, paid double")
    assert by_seq(label.label_threshold_reached(log, "amount", "paid").df, "seq", "label") == [
        (0, "deviant"), (1, "deviant"), (3, "regular")]


def test_filters(spark, make_log):
    log = make_log([("a", 0, "x"), ("a", 1, "end"), ("b", 0, "end"), ("b", 1, "x")])
    assert by_seq(filters.drop_cases_ending(log, "end").df, "seq") == [2, 3]
    ids = spark.createDataFrame([("a",)], "case_id string")
    assert by_seq(filters.for_cases(log, ids).df, "seq") == [0, 1]
    assert by_seq(filters.except_cases(log, ids).df, "seq") == [2, 3]


def test_strict_split_ties_and_late_events(make_log):
    log = make_log([("b", 0, "x"), ("a", 0, "x"), ("a", 9, "late"), ("c", 9, "x"), ("d", 10, "x")])
    train, test = split.split_strict(log, 0.5)
    assert by_seq(train.df, "seq") == [0, 1] and by_seq(test.df, "seq") == [3, 4]
    train, test = split.split_strict(log, 0.3)  # one case: the one with the smaller id
    assert by_seq(train.df, "seq") == [] and by_seq(test.df, "seq") == [0, 1, 2, 3, 4] or \
        by_seq(train.df, "case_id") == []


def test_empty_validation_side(make_log):
    log = make_log([("a", 0, "x"), ("b", 1, "x")])
    for how in ("random", "temporal"):
        train, val = split.split_val(log, 0.2, how)
        assert val.df.count() == 0 and train.df.count() == 2
    with pytest.raises(ValueError):
        split.split_val(log, 0.2, "odd")


def test_validation_split_depends_on_the_seed_only(make_log):
    log = make_log([(f"c{i}", i, "x") for i in range(50)])
    held = [{r["case_id"] for r in split.split_val(log, 0.2, seed=s)[1].df.collect()} for s in (22, 22, 23)]
    assert held[0] == held[1] != held[2] and len(held[0]) == 10


def test_prefix_caps(make_log):
    log = make_log([("a", i, "x", "deviant") for i in range(30)], "label string")
    assert split.max_prefix_length(log) == 30
    assert split.max_prefix_length(log.with_spec(name="bpic2017_accepted")) == 20
    assert split.max_prefix_length(log.with_spec(name="traffic_fines_1")) == 10
    assert split.max_prefix_length(log.with_spec(name="traffic_fines_1"), truncate=False) == 30


def exploded(log, max_length):
    """Encodings by spelling out every prefix and aggregating it."""
    df = prefix_log(log, 1, max_length).df
    return df.groupBy("orig_case_id", PREFIX)


def test_windowed_encoding_equals_exploded_prefixes(make_log):
    draw = random.Random(5)
    rows = [(f"c{draw.randrange(8)}", i, draw.choice("xyz"), draw.choice([None, draw.random()])) for i in range(120)]
    log = make_log(rows, "v double")
    enc = E.encoder("agg", cat=["activity"], num=["v"])
    got = enc.fit_transform(prefixes(log, 10))
    want = exploded(log, 10).agg(
        *[F.sum(F.when(F.col("activity") == x, 1).otherwise(0)).cast("double").alias(f"activity_{x}") for x in "xyz"],
        *[F.coalesce(f, F.lit(0.0)).alias(n) for n, f in (
            ("mean_v", F.avg("v")), ("max_v", F.max("v")), ("min_v", F.min("v")), ("sum_v", F.sum("v")),
            ("std_v", F.stddev_samp("v")))])
    show = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect())
    assert show(got.select("case_id", PREFIX, *enc.columns)) == show(want.select("orig_case_id", PREFIX, *enc.columns))


def test_unseen_levels_are_ignored_and_missing_ones_zero(make_log):
    enc = E.encoder("last", cat=["activity"])
    enc.fit(prefixes(make_log([("a", 0, "x"), ("a", 1, "y")])))
    got = enc.transform(prefixes(make_log([("b", 0, "new"), ("b", 1, "y")]))).orderBy(PREFIX).collect()
    assert enc.columns == ["activity_x", "activity_y"]
    assert [(r["activity_x"], r["activity_y"]) for r in got] == [(0.0, 0.0), (0.0, 1.0)]


def test_non_null_picks_and_row_picks(make_log):
    log = prefixes(make_log([("a", 0, "x", None), ("a", 1, "x", 2.0), ("a", 2, "x", None)], "v double"))
    pick = lambda name: [r["v"] for r in E.encoder(name, num=["v"]).fit_transform(log).orderBy(PREFIX).collect()]
    assert pick("static") == [0.0, 2.0, 2.0]  # first known value
    assert pick("last") == [0.0, 2.0, 2.0]  # last known value
    assert pick("previous") == [0.0, 0.0, 2.0]  # the row before, null or not


def test_index_learns_its_length(make_log):
    enc = E.encoder("index", cat=["activity"]).fit(prefixes(make_log([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "y")])))
    assert enc.max_events == 2
    assert enc.columns == ["activity_0_x", "activity_0_y", "activity_1_y"]


def test_constant_columns_scale_to_zero(spark, make_log):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in E.Standardizer(["a", "b"]).fit(df).transform(df).collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    log = make_log([("a", 0, "x", 4.0), ("a", 1, "x", 4.0)], "v double")
    enc = E.EventEncoder(log.spec).fit(log)
    assert by_seq(enc.transform(log).df, "event__v") == [0.0, 0.0]


def test_shortest_prefix_keeps_the_id_and_its_true_length(make_log):
    df = prefix_log(make_log([("a_1", i, "x") for i in range(3)]), 2, 3).df
    assert sorted({(r["case_id"], r["orig_case_id"], r[PREFIX]) for r in df.collect()}) == [("a_1", "a_1", 2), ("a_1_3", "a_1", 3)]


def test_unknown_names_raise():
    from tracewise import spec
    from tracewise.operators.bucket import bucketer

    for call in (lambda: E.encoder("odd"), lambda: E.encoding("odd", None), lambda: bucketer("odd", None), lambda: spec("odd")):
        with pytest.raises(KeyError):
            call()


def test_index_looks_up_a_position_once_a_row(make_log):
    """No map is searched for each attribute and level, and a wide vector's code stays out of whole stages, where it would not be compiled."""
    rows = [("a", n, "xyz"[n % 3], n / 2) for n in range(24)] + [("b", n, "x", 1.0) for n in range(3)]
    log = prefixes(make_log(rows, "v double"))
    enc = E.encoder("index", cat=["activity"], num=["v"]).fit(log)
    df = E.assemble(enc.transform(log), enc.columns)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in plan and "element_at" not in plan
    assert len(enc.columns) > E.WIDE and "lambda" in plan.split("AS features")[0]
    last = df.where("case_id = 'b'").orderBy(F.desc("prefix_nr")).first()["features"].toArray()
    assert dict(zip(enc.columns, last)) == {n: float(n in ("v_0", "v_1", "v_2", "activity_0_x", "activity_1_x", "activity_2_x")) for n in enc.columns}


def test_index_of_a_log_with_gaps(make_log):
    """Positions that a log lacks give zeros at their own places."""
    log = prefixes(make_log([("a", n, "x", 1.0 + n) for n in range(6)], "v double"))
    gaps = log.with_df(log.df.where("prefix_nr NOT IN (1, 4)"))
    got = E.encoder("index", num=["v"], max_events=5).fit_transform(gaps).orderBy("prefix_nr").collect()
    assert [[r[f"v_{i}"] for i in range(5)] for r in got] == [
        [0, 2, 0, 0, 0], [0, 2, 3, 0, 0], [0, 2, 3, 0, 5], [0, 2, 3, 0, 5]]

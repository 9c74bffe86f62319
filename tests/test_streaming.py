import random

from pyspark.sql import functions as F

from tracewise.operators import encode as E
from tracewise.operators import stability as S
from tracewise.operators import timefeat
from tracewise.operators.prefix import PREFIX, prefixes
from tracewise.streaming.running import HELD, Smoother, closing_row, running_features_stream, smooth_stream


def drain(stream, name, tmp_path):
    query = (stream.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True).start())
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    return stream.sparkSession.table(name)


def in_files(df, path, parts):
    """One file per part, so that a trigger reads one part."""
    for i in parts:
        df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(path))


def test_smoothing_stream_equals_batch(spark, tmp_path):
    draw = random.Random(1)
    rows = [("d", "m", f"c{k}", n, draw.random(), 1, (n - 1) // 3) for k in range(6) for n in range(1, 8)]
    rows += [("d", "m", "gap", n, 0.5, 1, (n - 1) // 3) for n in (1, 2, 4, 5, 7)]
    rows += [("d", "m", "late", n, n / 7, 1, (n - 1) // 3) for n in (4, 5, 6, 1, 2, 3, 7)]
    pred = spark.createDataFrame(
        rows, "dataset string, Method string, case_id string, nr_events int, predicted double, actual int, part int")
    in_files(pred, tmp_path / "in", (1, 0, 2))  # later positions come first
    source = spark.readStream.schema(pred.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(smooth_stream(source, 0.8), "smoothed", tmp_path)
    show = lambda d: sorted((r["case_id"], r["nr_events"], round(r["smoothed"], 9)) for r in d.collect())
    assert show(got) == show(S.smooth(pred, 0.8))


class FakeState:
    """State in dictionaries that counts how often it is asked."""

    def __init__(self):
        self.asked, self.value, self.entries, self.listed, self.timers = 0, None, {}, [], []

    def __getattr__(self, name):
        def ask(*args):
            self.asked += 1
            return getattr(FakeState, f"on_{name}")(self, *args)
        return ask

    def on_exists(self):
        return self.value is not None

    def on_get(self):
        return self.value

    def on_update(self, value):
        self.value = value

    def on_containsKey(self, key):
        return key in self.entries

    def on_getValue(self, key):
        return self.entries[key]

    def on_updateValue(self, key, value):
        self.entries[key] = value

    def on_removeKey(self, key):
        del self.entries[key]


def test_a_trigger_touches_what_it_brings(spark):
    """Ten rows cost as many questions of the state beside a million waiting ones as beside ten."""
    from pyspark.sql import Row

    asked = []
    for waiting in (10, 1_000_000):
        known, held = FakeState(), FakeState()
        known.value = (0.5, 3, waiting)
        held.entries = {(n,): (0.1,) for n in range(10, 10 + waiting)}
        one = Smoother(0.8, ["case_id"], "predicted", None)
        one.known, one.waiting = known, held
        rows = [Row(nr_events=n, predicted=0.3) for n in (4, 5, 6, 7, 8, 5_000_000, 5_000_001, 2, 5, None)]
        out = list(one.handleInputRows(("c",), iter(rows), None))
        assert [r.nr_events for r in out] == [4, 5, 6, 7, 8] and known.value[2] == waiting + 2
        asked.append(known.asked + held.asked)
    assert asked[0] == asked[1]


def smoother():
    one = Smoother(1.0, ["case_id"], "predicted", None)
    one.known, one.waiting = FakeState(), FakeState()
    return one


def brought(one, *pairs):
    from pyspark.sql import Row

    return [(r.nr_events, r.predicted) for r in one.handleInputRows(("c",), iter([Row(nr_events=n, predicted=p) for n, p in pairs]), None)]


def test_a_few_waiting_scores_come_with_the_value(spark):
    """Twenty scores that wait, and go, cost two questions a trigger, not some for each score."""
    one = smoother()
    assert brought(one, *[(n, n / 100) for n in range(2, 22)]) == []
    assert brought(one, (1, 0.01), (3, 0.9)) == [(n, n / 100) for n in range(1, 22)]  # of a position that comes again the first counts
    assert one.known.asked == 4 and one.waiting.asked == 0 and one.known.value[2] == 0


def test_many_waiting_scores_are_kept_by_position(spark):
    one = smoother()
    late = list(range(2, 2 * HELD + 2))
    for at in range(0, len(late), 50):
        assert brought(one, *[(n, n / 1000) for n in late[at:at + 50]]) == []
    assert brought(one, (late[-1], 0.9)) == [] and one.known.value[2] == len(late)
    assert len(one.known.value[3]) == HELD and len(one.waiting.entries) == len(late) - HELD
    assert brought(one, (1, 0.001)) == [(n, n / 1000) for n in (1, *late)]
    assert one.known.value[2] == 0 and not one.waiting.entries and not one.known.value[3]


def some_events(make_log, seed=2):
    """Sixty events over an hour in any order, a third of them in a file of its own, the others by halves of the hour."""
    draw = random.Random(seed)
    log = make_log([(f"c{draw.randrange(5)}", minute, draw.choice("xy")) for minute in draw.sample(range(60), 60)])
    early = F.col("ts") < F.lit("2024-01-01 00:30:00").cast("timestamp_ntz")
    return log, log.df.withColumn("part", F.when(F.col("seq") % 3 == 0, 0).when(early, 1).otherwise(2))


def shown(df):
    names = ["case_id", "event_nr", "timesincecasestart", "timesincelastevent", "activity_x", "activity_y"]
    return sorted(tuple(r) for r in df.select(*names[:4], *[F.col(n).cast("long") for n in names[4:]]).collect())


def batch_features(log):
    timed = timefeat.timestamp_features(log)
    counts = E.encoder("agg", cat=["activity"]).fit_transform(prefixes(log))
    return timed.df.join(counts.withColumnRenamed(PREFIX, "event_nr"), ["case_id", "event_nr"])


def test_running_features_out_of_order(spark, tmp_path, make_log):
    """Three files whose times overlap, one a trigger, and a closing row."""
    log, parts = some_events(make_log)
    in_files(parts, tmp_path / "in", (1, 0, 2))
    closing_row(log.df, log.spec, "1 hour").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(log.df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(running_features_stream(source, log.spec, ["x", "y"], "1 hour"), "features", tmp_path)
    assert shown(got) == shown(batch_features(log)) and got.count() == 60


def test_without_closing_what_the_watermark_has_not_passed_waits(spark, tmp_path, make_log):
    log, parts = some_events(make_log, 3)
    in_files(parts, tmp_path / "in", (1, 0, 2))
    source = spark.readStream.schema(log.df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(running_features_stream(source, log.spec, ["x", "y"], "50 minutes"), "early", tmp_path)
    limit = log.df.agg(F.max("ts") - F.expr("INTERVAL 50 MINUTES")).first()[0]
    assert shown(got) == shown(batch_features(log.with_df(log.df.where(F.col("ts") < F.lit(limit)))))


def test_custom_function(spark, make_log):
    import pandas as pd

    from tracewise.operators.custom import per_case

    log = make_log([("a", 2, "y"), ("a", 1, "x"), ("b", 0, "z")])
    fn = lambda e: pd.DataFrame({"case_id": [e["case_id"].iloc[0]], "v": ["".join(e["activity"])]})
    assert sorted(tuple(r) for r in per_case(log, fn, "case_id string, v string").collect()) == [("a", "xy"), ("b", "z")]


def test_fold_equals_whole_cases(spark, make_log, hot):
    """Cases in chunks of three events, the longest also in segments of eight, against a function of the whole case."""
    import pandas as pd

    from tracewise.operators.custom import fold_cases, per_case

    draw = random.Random(5)
    rows = [(f"c{k}", draw.randrange(500), draw.choice("xyz")) for k, n in enumerate((40, 9, 3, 1, 17)) for _ in range(n)] + [(None, 1, "x")]
    whole = lambda e: pd.DataFrame({"case_id": [e["case_id"].iloc[0]], "v": ["".join(e["activity"])], "n": [len(e)]})

    def folded(log):
        def step(state, events):
            assert len(events) <= 3
            return state[0] + "".join(events["activity"]), state[1] + len(events)

        made = fold_cases(log, lambda: ("", 0), step, lambda case, s: [(case, *s)], "case_id string, v string, n long", 3)
        return sorted(map(repr, map(tuple, made.collect())))

    want = sorted(map(repr, map(tuple, per_case(make_log(rows), whole, "case_id string, v string, n long").collect())))
    assert folded(make_log(rows)) == want
    hot(8)
    log = make_log(rows)
    assert log.hot is not None and folded(log) == want
    assert folded(log.with_df(log.df.limit(0))) == []


def test_cases_share_batches(spark, make_log, capsys):
    """Cases over the borders of batches, null cases, whole numbers with nulls in other cases, null times last; no call into Python for each case."""
    import pandas as pd

    from tracewise.operators.custom import per_case

    big = 2**60 + 1
    rows = [(None if k == 3 else f"c{k}", i, "xyz"[i % 3], None if k == 2 and i == 1 else big + i, None if k == 1 else i % 2 == 0) for k in range(9) for i in range(k + 1)]
    log = make_log(rows[::-1], extra="n long, even boolean")
    log = log.with_df(log.df.withColumn("ts", F.when(F.col("activity") != "x", F.col("ts"))))

    def fn(events):
        own = events["case_id"].iloc[0]
        return pd.DataFrame({"k": [len(events)], "v": ["".join(events["activity"])], "case_id": [None if pd.isna(own) else own],
                             "seen": [f"{events['n'].dtype} {events['n'].iloc[0]} {list(events['even'])[0]} {list(events.index) == list(range(len(events)))}"]})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = per_case(log, fn, "case_id string, v string, k long, seen string")
        got = {r.case_id: r for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=str) == sorted((None if k == 3 else f"c{k}" for k in range(9)), key=str)
    for k in range(9):
        r = got[None if k == 3 else f"c{k}"]
        acts = ["xyz"[i % 3] for i in range(k + 1)]
        assert r.k == k + 1 and r.v == "".join([x for x in acts if x != "x"] + [x for x in acts if x == "x"])
        assert r.seen.startswith("float64" if k == 2 else "int64") and r.seen.endswith("True")
    assert got["c8"].seen == f"int64 {big + 1} False True" and " None " in got["c1"].seen
    out.explain()
    assert "GroupsInPandas" not in capsys.readouterr().out


def test_triggers_do_not_grow_with_files(spark, tmp_path):
    """Events in many files are read in a handful of triggers, and every event is answered."""
    import glob
    import os

    from conftest import DATA

    from tracewise.plans.catalog import QUERIES
    from tracewise.session import ensure_checkpoint_dir

    spark.read.parquet(f"{DATA}/events.parquet").limit(300).repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", "134217728")  # a task for each file
    try:
        out = QUERIES["running_features_stream"](spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    last = max(glob.glob(f"{base}/features-*"), key=os.path.getmtime)
    arrived = max(glob.glob(f"{base}/arriving-*"), key=os.path.getmtime)
    files, triggers = len(glob.glob(f"{arrived}/*.parquet")), len([f for f in os.listdir(f"{last}/progress/commits") if f.isdigit()])
    assert files >= 12 and triggers <= 8, (files, triggers)
    assert out.count() == out.select("event_id").distinct().count() == 300

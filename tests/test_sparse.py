import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tracewise.operators import encode as E
from tracewise.operators.prefix import PREFIX, prefixes
from tracewise.operators.sparse import SparseEncoding, SparseOneHot

ENCODERS = {
    "static": lambda: E.encoder("static", cat=["activity", "r"], num=["x"]),
    "last": lambda: E.encoder("last", cat=["activity", "r"], num=["x"]),
    "previous": lambda: E.encoder("previous", cat=["activity", "r"], num=["x"]),
    "agg": lambda: E.encoder("agg", cat=["activity", "r"], num=["x"]),
    "bool": lambda: E.encoder("bool", cat=["activity", "r"], num=["x"]),
    "index": lambda: E.encoder("index", cat=["activity", "r"], num=["x"]),
    "index3": lambda: E.encoder("index", cat=["r"], num=["x"], max_events=3),
    "union": lambda: E.UnionEncoder([E.encoder("last", cat=["r"], num=["x"]), E.encoder("agg", cat=["r", "activity"]), E.encoder("index", cat=["r"], num=["x"])]),
}


def some_log(make_log, seed=1, cases=4, longest=20):
    import random

    rng = random.Random(seed)
    rows = []
    for k in range(cases):
        for i in range(rng.randrange(1, longest) if k else longest):
            rows.append((f"c{k}", 10 * i, rng.choice("abc"), rng.choice(["u", "v", "w_1", None]), rng.choice([0.0, -1.5, 2.0, None])))
    return make_log(rows, extra="r string, x double")


def dense(encoder, train, other):
    rows = encoder.fit(train).transform(other).collect()
    return {(r.case_id, r[PREFIX]): {n: r[n] for n in encoder.columns if r[n]} for r in rows}


@pytest.mark.parametrize("name", list(ENCODERS))
def test_equals_dense(spark, make_log, hot, name):
    """The longest cases in three segments; the union also with all in one."""
    if name != "union":
        hot(7)
    train, other = prefixes(some_log(make_log)), prefixes(some_log(make_log, 2, 3, 17))
    sparse = SparseEncoding(ENCODERS[name]()).fit(train)
    got = {}
    for r in sparse.long(other).collect():
        got.setdefault((r.case_id, r[PREFIX]), {})[r["name"]] = r.value
    want = dense(ENCODERS[name](), train, other)
    assert {k: {n: pytest.approx(x, abs=1e-9) for n, x in v.items()} for k, v in want.items() if v} == got
    vectors = sparse.transform(other).collect()
    names = {r.position: r["name"] for r in sparse.names().collect()}
    assert sparse.size == len(names) and len(vectors) == len(want)
    for r in vectors:
        assert {names[int(i)]: x for i, x in zip(r.features.indices, r.features.values)} == got.get((r.case_id, r[PREFIX]), {})
        assert r.features.size == sparse.size and list(r.features.indices) == sorted(r.features.indices)


def test_unknown_levels_and_empty_log(spark, make_log):
    train = prefixes(make_log([("a", 0, "x"), ("a", 1, "y")]))
    sparse = SparseEncoding(E.encoder("agg", cat=["activity"])).fit(train)
    other = prefixes(make_log([("b", 0, "x"), ("b", 1, "new"), ("b", 2, "x")]))
    rows = sparse.transform(other).select(PREFIX, vector_to_array("features").alias("v")).orderBy(PREFIX).collect()
    assert [r.v for r in rows] == [[1.0, 0.0], [1.0, 0.0], [2.0, 0.0]]
    assert sparse.transform(other.with_df(other.df.limit(0))).collect() == []
    assert SparseEncoding(E.encoder("agg", cat=["activity"])).fit(train.with_df(train.df.limit(0))).size == 0


def test_plan_does_not_grow_with_levels(spark, make_log):
    """20,000 levels of one attribute, which as columns are refused."""
    def plan(levels):
        df = spark.range(levels).select(F.lit("c").alias("case_id"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"),
                                        F.concat(F.lit("l"), "id").alias("activity"), F.col("id").alias("seq"), F.lit(1.0).alias("x"))
        log = make_log([("c", 0, "x")])
        log = prefixes(log.with_df(df))
        sparse = SparseEncoding(E.encoder("agg", cat=["activity"])).fit(log)
        return sparse.size, len(sparse.long(log)._jdf.queryExecution().analyzed().toString().splitlines())
    (few, one), (many, other) = plan(10), plan(20_001)
    assert (few, many) == (10, 20_001) and one == other


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "x")], "id long, p string, q string")
    one = SparseOneHot(["p", "q"]).fit(df.where("id < 3"))
    rows = one.long(df, ["id"]).collect()
    assert sorted((r.id, r["name"]) for r in rows) == [(1, "p_a"), (1, "q_x"), (2, "p_b"), (3, "q_x")]
    assert one.size == 3 and sorted({r.position for r in rows}) == [0, 1, 2]


def test_models_see_the_same(spark, make_log):
    """A tree over sparse vectors scores as over columns."""
    from tracewise.operators.train import encode_splits, fit_predict_encoded

    log = make_log([(f"c{k}", i, "ab"[(k + i) % 2], "u" if k % 2 else "v", "deviant" if k % 2 else "regular") for k in range(12) for i in range(3)],
                   extra="r string, label string")
    log = log.with_spec(label="label", pos_label="deviant", neg_label="regular", dynamic_cat=("activity", "r"), dynamic_num=())
    scored = []
    for sparse in (False, True):
        data = encode_splits(log, {"test": log}, "single_agg", 3, sparse=sparse)
        scored.append(sorted((r.case_id, r.nr_events, r.predicted, r.actual) for r in fit_predict_encoded(data, "dt", {"max_depth": 3}).collect()))
        data.release()
    assert scored[0] == scored[1] and {x[2] for x in scored[0]} == {0.0, 1.0}


def test_large_index_leaves_no_task_all_rows_of_a_number(spark, make_log, monkeypatch):
    """An index too large for a broadcast: levels and numbers are found, and rows of one number are dealt to many tasks."""
    from tracewise.operators import sparse as S

    rows = [(f"c{k}", i, "ab"[i % 2], f"r{(7 * k + i) % 20}", 1.0 + i) for k in range(30) for i in range(3)]
    log = prefixes(make_log(rows, extra="r string, x double"))
    encoder = E.encoder("last", cat=["r"], num=["x"])
    want = sorted((f"c{k}", i + 1, *x) for k in range(30) for i in range(3) for x in ((f"r_r{(7 * k + i) % 20}", 1.0), ("x", 1.0 + i)))
    monkeypatch.setattr(S, "BROADCAST_LEVELS", 10)
    monkeypatch.setattr(S, "TASK_EVENTS", 15, raising=False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as it is with a large index
    try:
        got = SparseEncoding(encoder).fit(log).long(log).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r.case_id, r[PREFIX], r["name"], r.value) for r in got) == want
    number = [r.part for r in got if r["name"] == "x"]
    assert len(number) == 90 and max(map(number.count, set(number))) < 60


def test_windows_do_not_grow_with_encoders(spark, make_log):
    log = prefixes(make_log([("a", 0, "x"), ("a", 1, "y")]))
    def windows(names):
        plan = SparseEncoding([E.encoder(n, cat=["activity"]) for n in names]).changes(log)._jdf.queryExecution().optimizedPlan().toString()
        return sum("Window [" in line for line in plan.splitlines())
    assert windows(["last", "previous", "static", "last"]) <= windows(["last", "previous"])


@pytest.mark.parametrize("name, limit", [("union", 0), ("agg", 0), ("index", 0), ("union", 7), ("last", 7)])
def test_large_index_equals_dense(spark, make_log, hot, monkeypatch, name, limit):
    """An index too large for a broadcast, with frequent features apart from the rest; numbers never go the way of the rest where all are frequent."""
    from tracewise.operators import sparse as S

    if limit:
        hot(limit)
    monkeypatch.setattr(S, "BROADCAST_LEVELS", 4)
    monkeypatch.setattr(S, "TASK_EVENTS", 15)
    rest, rare = [], SparseEncoding._rare
    monkeypatch.setattr(SparseEncoding, "_rare", lambda self, rows, parts=None: rest.append((self.numbers_often, rows.where("numeric").count())) or rare(self, rows, parts))
    train, other = prefixes(some_log(make_log)), prefixes(some_log(make_log, 2, 3, 17))
    encoding = SparseEncoding(ENCODERS[name]())
    sparse, other_written = encoding.fit(encoding.written(train)), encoding.written(other)
    assert sparse.size > 4 and not {"ts", "seq"} & set(other_written.df.columns) and other_written.df.inputFiles()
    got = {}
    for r in sparse.long(other_written).collect():
        got.setdefault((r.case_id, r[PREFIX]), {})[r["name"]] = r.value
    want = dense(ENCODERS[name](), train, other)
    assert {k: {n: pytest.approx(x, abs=1e-9) for n, x in v.items()} for k, v in want.items() if v} == got
    assert len(rest) == 1 and (not rest[0][0] or rest[0][1] == 0)
    names = {r.position: r["name"] for r in sparse.names().collect()}
    for r in sparse.transform(other).collect():
        assert {names[int(i)]: x for i, x in zip(r.features.indices, r.features.values)} == got.get((r.case_id, r[PREFIX]), {})


def test_frequent_numbers_stay_and_only_levels_meet_a_large_index(spark, make_log, monkeypatch):
    from tracewise.operators import sparse as S

    rows = [(f"c{k}", i, "ab"[i % 2], f"r{(7 * k + i) % 20}", 1.0 + i) for k in range(30) for i in range(3)]
    log = prefixes(make_log(rows, extra="r string, x double"))
    monkeypatch.setattr(S, "BROADCAST_LEVELS", 10)
    seen, rare = [], SparseEncoding._rare
    monkeypatch.setattr(SparseEncoding, "_rare", lambda self, rows, parts=None: seen.append(sorted(r["feature"] for r in rows.select("feature").distinct().collect())) or rare(self, rows, parts))
    sparse = SparseEncoding(E.encoder("last", cat=["r"], num=["x"])).fit(log)
    assert sparse.long(log).count() == 180 and seen == [["r"]] and sparse.numbers_often and not sparse.levels_often


def test_shuffle_files_of_a_written_table_go(spark):
    from tracewise.session import CLEANUP_KEY, keep

    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        found = files.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    rows = spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count()
    kept, before = set(shuffled()), spark.conf.get(CLEANUP_KEY)
    assert keep(rows, "cleaned", clean=True).count() == 7
    after = shuffled() - kept
    keep(rows, "left")
    assert len(shuffled() - kept) > len(after) and spark.conf.get(CLEANUP_KEY) == before

"""Every registered query against its SQL twin, on whole tables."""

import os

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def check(spark, con, name):
    got = entry.queries()[name](spark, DATA)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.collect(), got.columns) == rows_of(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    check(spark, con, name)


# queries whose operators look along a case, a metric group or a whole table
LONG = ["encode_agg", "encode_bool", "encode_last", "encode_previous", "ffill", "time_since_last", "event_nr",
        "open_cases_scan", "label_predicate", "label_activity_within", "label_last_of", "split_val_random",
        "for_cases", "bucket_state", "auc_by_length", "case_volatility", "smooth", "only_max_length",
        "split_val_null_cases", "encode_index_learned", "labelled_pipeline", "prefix_length_counts", "smoothing_sweep"]
if os.environ.get("TRACEWISE_ALL_LONG"):
    from tracewise.plans.catalog import ORACLES as OWN

    LONG = sorted(n for n in OWN if not n.startswith(("rows_", "sequence_", "learning_")))


@pytest.mark.parametrize("name", LONG)
def test_oversized_groups_equal_sql(spark, con, hot, name):
    hot(8)
    check(spark, con, name)


def test_names_match():
    assert set(ORACLES) <= set(entry.queries())
    assert entry.entry.__doc__


def test_entry(spark):
    assert entry.entry(spark).count() > 0

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tracewise import build_session

    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        # tables are tiny: compiling plans would take longer than running them
        "spark.sql.codegen.wholeStage": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Make every group of more than the given number of rows an oversized one."""
    key = "spark.tracewise.hotRows"
    yield lambda rows: spark.conf.set(key, str(rows))
    spark.conf.unset(key)


@pytest.fixture
def make_log(spark):
    """An event log from rows (case, minute, activity, ...) in file order."""
    from datetime import datetime, timedelta

    from tracewise import EventLog, LogSpec

    def build(rows, extra="", label=None):
        base = datetime(2024, 1, 1)
        names = [f.strip().split(" ")[0] for f in extra.split(",")] if extra else []
        data = [(r[0], base + timedelta(minutes=r[1]), r[2], i, *r[3:]) for i, r in enumerate(rows)]
        schema = "case_id string, ts timestamp_ntz, activity string, seq long" + (f", {extra}" if extra else "")
        spec = LogSpec("test", case="case_id", activity="activity", timestamp="ts", tie=("seq",),
                       dynamic_cat=("activity",), dynamic_num=tuple(n for n in names if n != "label"))
        return EventLog.of(spark.createDataFrame(data, schema), spec)

    return build

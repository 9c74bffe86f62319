import re

import corpus_pipeline
import pytest
from conftest import DATA
from test_mixing import check as check_mix
from test_privacy import P
from test_simhash import slow_fingerprint, slow_groups

import __spark_entry__ as entry
from tracewise.llm import lines


def slow_redacted(text, spans):
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{P.KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def stages(spark):
    """(name, rows before, rows after) of each stage."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, DATA)
        made = spark.createDataFrame(made.collect(), made.schema)
        out.append((name, docs.collect(), made.collect()))
        docs = made
    return out


def test_stages_and_columns(stages):
    for (_, before, after), last in zip(stages, [False] * 4 + [True], strict=True):
        assert before[0].__fields__ + ["copies"] * last == after[0].__fields__
        assert {r.doc_id for r in after} <= {r.doc_id for r in before}


def test_quality(spark, stages):
    _, before, after = stages[0]
    marks = {r.doc_id: r.kept for r in lines.quality(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if marks[r.doc_id])


def test_one_of_each_group(stages):
    _, before, after = stages[1]
    groups = slow_groups([(r.doc_id, slow_fingerprint(r.text)) for r in before])
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if groups[r.doc_id] == r.doc_id)
    assert len(after) < len(before)


def test_no_benchmark_item_is_left(spark, stages):
    _, before, after = stages[2]
    def grams(text):
        w = text.lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    items = [grams(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    good = [tuple(r) for r in before if not any(len(i & grams(r.text)) >= 0.8 * len(i) for i in items)]
    assert sorted(map(tuple, after)) == sorted(good) and len(good) < len(before)


def test_personal_data_is_covered(spark, stages):
    _, before, after = stages[3]
    docs = spark.createDataFrame(before, spark.read.parquet(f"{DATA}/documents.parquet").schema)
    want = {r.doc_id: [(int(s), P.KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)] for r in P.personal_data(docs).collect()}
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        assert r.text == slow_redacted(texts[r.doc_id], want[r.doc_id]) and r.n_chars == len(r.text)
        assert not re.search(r"[a-z0-9]@[a-z0-9-]+\.[a-z]", r.text)


def test_mixture(spark, stages):
    _, before, after = stages[4]
    from tracewise.llm import mixing
    docs = spark.createDataFrame(before, spark.read.parquet(f"{DATA}/documents.parquet").schema)
    rows = mixing.mix(docs).collect()
    check_mix([(r.doc_id, r.source, r.text) for r in before], rows)
    assert {r.doc_id: r.taken for r in rows if r.taken} == {r.doc_id: r.copies * len(r.text.split()) for r in after if r.text.split()}


def test_run_is_the_stages(spark, stages):
    got = entry.queries()["pipeline"](spark, DATA)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1][2]))


def test_empty_and_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int"
    for docs in (spark.createDataFrame([], schema), spark.createDataFrame([(1, None, None, None, None, 1), (None, "", None, None, None, 2)], schema)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DATA)
        assert docs.collect() == []

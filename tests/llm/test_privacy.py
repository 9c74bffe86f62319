import hashlib
import re

import pytest
from conftest import DATA
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tracewise.llm import privacy as P

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def slow(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            if (kind == 0 or kind == 1 and all(int(p) <= 255 for p in m[0].split(".")) or kind == 2 and 14 <= len(digits) <= 19 and luhn(digits)
                    or kind == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def written(spans):
    return ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def check(rows, texts):
    for r in rows:
        want = slow(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, k, _ in want) for x in range(4)), texts[r.doc_id][:200]
        assert r.base_sha256 == hashlib.sha256(written(want).encode()).hexdigest(), (texts[r.doc_id][:200], want, r.spans)
        assert set(written(want).split(",")) - {""} <= set(r.spans.split(","))


def test_whole_table_against_the_patterns(spark):
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    rows = P.personal_data(docs).collect()
    check(rows, {r.doc_id: r.text for r in docs.collect()})
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 20


TRICKY = [
    "a@b.c_d@e.f x@y z@@w.v .@-.- a@b..c a.b+c%d@host-1.example.co.uk, é@x.y ü a@b.c",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.003.255 1.2.3 999999999999999999999.1.1.1 1..2.3.4 10.20.30.40",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111114111111111111111 4111  1111 1111 1111 378282246310005 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
    "+1 (956) 555-0122 +1(956)555-0122.+49 30 123456 ++4930123456789 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 + 1 555 +12345678901 2",
    "\u0001a@b.c\u0002 1.1.1.1\u0001 +1234567890\u0002 \U0001f600 x@y.z \U0001f600\U0001f600 8.8.8.8",
    "mail 1.2.3.4@5.6.7.8 and +4111111111111111 or 4111111111111111.1.1.1",
]


def test_tricky_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    check(P.personal_data(docs).collect(), dict(enumerate(TRICKY)))


def test_odd_rows(spark):
    long = "no data " * 30_000 + "a@b.c" + ".d" * 20_000 + " " + "1" * 30_000 + " " + "x" * 30_000 + "@"
    rows = [(1, None, 4), (2, "", None), (3, long, 2), (None, "a@b.c", 2), (4, "to a@b.c!", 2), (4, "to a@b.c!", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("spans", F.lit(1)).withColumn("base", F.lit(2))
    got = P.personal_data(docs).collect()
    check([r for r in got if r.doc_id is not None], {r[0]: r[1] for r in rows})
    assert len(got) == 6
    out = P.redacted(docs)
    assert out.columns == docs.columns
    assert {(r.text, r.n_chars) for r in out.collect() if r.doc_id in (None, 4, 1, 2)} == {("[EMAIL]", 7), ("to [EMAIL]!", 11), (None, None), ("", 0)}
    assert P.personal_data(docs.limit(0)).collect() == [] and P.redacted(docs.limit(0)).collect() == []


def test_trees_as_a_column(spark):
    rows = spark.range(400).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"))
    rows = rows.withColumn("y", ((F.col("a") > 3) != (F.col("b") < 4)).cast("double"))
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(rows)
    model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=5, maxDepth=3, seed=1).fit(vectors)
    own = P.tree_expression(model.toDebugString, lambda i: F.col("ab"[i]))
    out = model.transform(vectors).select(own.alias("own"), "rawPrediction").collect()
    assert all(abs(r.own - r.rawPrediction[1]) < 1e-9 for r in out)


def test_trees_add_spelled_and_bare_forms(spark):
    """With bare numbers among the negatives, what looks like base data to the trees is added, other numbers aren't."""
    rows = []
    for i in range(900):
        number = f"({200 + i % 700}) 555-{1000 + i}" if i % 2 else f"{200 + i % 700} 555-{1000 + i}"
        text = f"order 20{i:04d}77 of lot" if i % 3 == 1 else f"call +1 {number} now"
        rows.append((i, text if i % 100 else f"call 1 ({200 + i % 700}) 555-{1000 + i} now"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in P.personal_data(docs).collect()}
    assert all(r.n_phone == 0 and r.spans.startswith("phone:5:") for i, r in got.items() if i % 100 == 0)
    assert all(r.n_phone == 1 and r.spans.startswith("phone:5:") for i, r in got.items() if i % 100 and i % 3 != 1)
    assert not any(r.spans for i, r in got.items() if i % 100 and i % 3 == 1)


def _frequent(i):
    """Text and the span to be added, if any."""
    forms = (("mail ", f"anna{i} at host{i} dot org"), ("seen at ", f"2001:db8:{i:x}:1:2:3:4:{i + 7:x}"), ("host ", f"fe80:{i:x}::5:{i + 9:x}:7"),
             ("write to ", f"bob{i} [at] site{i} [dot] com"), ("call ", f"1 ({200 + i % 700}) 555-{1000 + i}"), ("order ", f"77{i:06d}"),
             ("net ", f"00:1a:2b:3c:{i % 90 + 10}:{i * 7 % 90 + 10}"), ("at ", f"12:{i % 50 + 10}:{i * 7 % 50 + 10}:33"), ("on ", f"20{i % 90 + 10}-12-{i % 20 + 10}"))
    kinds = ("email", "ip", "ip", "email", "phone")
    before, form = forms[i % 9]
    return f"{before}{form} now", f"{kinds[i % 9]}:{len(before)}:{len(before) + len(form)}" if i % 9 < 5 else ""


@pytest.mark.parametrize("n", [1800, 180])
def test_frequent_forms_that_base_rules_miss_are_added(spark, n):
    base = [(n + i, f"to x{i}@y.org from 10.0.{i % 200}.7 or +1 956 555 {1000 + i}") for i in range(n // 10)]
    docs = spark.createDataFrame([(i, _frequent(i)[0]) for i in range(n)] + base, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in P.personal_data(docs).collect()}
    wrong = [(_frequent(i), got[i]) for i in range(n) if got[i] != _frequent(i)[1]]
    assert not wrong, (len(wrong), wrong[:9])


def test_without_negatives_the_checks_decide(spark):
    docs = spark.createDataFrame([(i, _frequent(i)[0]) for i in range(90) if i % 9 < 5], "doc_id long, text string")
    assert all(r.spans == _frequent(r.doc_id)[1] for r in P.personal_data(docs).collect())


@pytest.mark.parametrize("name", ["personal_data", "redacted"])
def test_no_python_in_the_plan(spark, name, capsys):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    getattr(P, name)(docs).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_learns_on_all_documents(spark, monkeypatch):
    """Each decided proposal counts, however many documents there are; equal ones are one row."""
    docs = spark.range(30_000).select("id", F.when(F.col("id") % 2 == 0, F.lit("call 1 (555) 555-1000 now")).otherwise("order 20777777 of lot").alias("text"))
    docs, seen, plain = docs.withColumnRenamed("id", "doc_id"), [], P.keep

    def kept(rows, name):
        table = plain(rows, name)
        seen.extend(table.collect())
        return table

    monkeypatch.setattr(P, "keep", kept)
    judge = P.learn(docs)
    assert sum(r.n for r in seen) == 30_000 and len(seen) == 4 and judge.described

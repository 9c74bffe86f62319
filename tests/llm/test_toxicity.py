import zlib

from conftest import DATA

from tracewise.llm import toxicity as T


def weight(text):
    lexicon = T.Lexicon(T.lexical_arcs({b"idiot": 4.0}))
    return T.document_weight(text.encode().split(), lexicon)


def test_clauses():
    plain, _ = weight("an idiot wrote")
    assert weight("an idiot stood here")[0] == 4.0
    assert weight("you idiot")[0] == 5.0
    assert weight("surely not an idiot")[0] < 2 and plain == 4.0
    assert weight("people said an idiot stood here")[0] == 2.0
    assert weight("not now, an idiot")[0] == 4.0  # the negation ends with its clause
    assert weight("I will kill it")[0] == 4.0 and weight("kill the lights")[0] == 0
    assert weight("Idiots! Idiots.") == (8.0, 2)
    assert weight("") == (0.0, 0)


def test_held_out(spark):
    folder = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p for p, y in held if y == 0) == 0
    assert sum(p for p, y in held if y == 1) >= 0.7 * sum(y for _, y in held)  # of some the insults were overwritten


def test_rare_insults_are_learned_from_many_labels(spark):
    """14 of some 800 toxic documents are less than two in a hundred; copies of one text stay one witness."""
    rows, rare, copies = [], 0, 0
    for i in range(2400):
        words = f"w{i}a about w{i}b"
        if i % 2 and zlib.crc32(str(i).encode()) % 3 != 1 and rare < 14:
            words, rare = f"w{i}a zorgblat w{i}b", rare + 1
        elif i % 2 and zlib.crc32(str(i).encode()) % 3 != 1 and copies < 14:
            words, copies = "one quexlion here", copies + 1
        elif i % 2:
            words = f"w{i}a idiot w{i}b"
        rows.append((i, words, i % 2))
    new = [(5000, "the zorgblat came"), (5001, "the quexlion came"), (5002, "the idiot came")]
    docs = spark.createDataFrame([r[:2] for r in rows] + new, "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: (r.predicted, r.n_clauses) for r in T.toxicity(docs, labels).collect() if r.doc_id >= 5000}
    assert got == {5000: (1, 1), 5001: (0, 0), 5002: (1, 1)}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "", 1), (None, "you will kill", None), (3, "w " * 200_000 + "you will kill", 1)],
                                 "doc_id long, text string, n_clauses int")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = sorted((repr(r.doc_id), r.predicted, r.n_clauses) for r in T.toxicity(docs, labels).collect())
    assert got == [("1", 0, 0), ("2", 0, 0), ("2", 0, 0), ("3", 1, 1), ("None", 1, 1)]
    assert T.toxicity(docs.limit(0), labels).collect() == []

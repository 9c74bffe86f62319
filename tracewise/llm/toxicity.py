"""Toxicity by a weighted grammar of finite-state transducers.

Three kinds of machine are composed. The *lexical* transducer reads the letters of a word from the left and writes a class
and a weight: insults (learned), threats, targets, negations and reports (closed lists of four languages). The insult
arcs are beginnings of words whose documents are marked toxic far more often than not; their weights are log odds counted
over at most ``2 * per_class`` labelled documents. The *clause* transducer reads the classes of one clause: its state
holds whether a negation is open, whether the clause reports what somebody said, and whether a person is addressed or
named; each insult leaves with its weight under that state, and a threat only if a modal or future came before or a
target stands in the clause. The *document* machine sums what the clauses leave, and a logistic curve fitted on the same
documents turns the sum into a score. A word alone isn't scored: "not an idiot" and "she was called an idiot" leave
less than the bare word, "you idiot" leaves more.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.llm.labelled import remainder, sample
from tracewise.llm.words import LARGE_MEMO, blobs, text_batches

PER_CLASS = 4000
THRESHOLD = 0.7
MIN_DOCS = 3  # toxic documents, and different pairs of neighbours, that an insult must have
MIN_SHARE = 0.02  # with less than this share of the toxic documents, chance must not explain them
CHANCE = 1e-4  # of as many toxic ones among the documents of a word that has nothing to do with it
MIN_WEIGHT = 3.0  # its log odds
SHORTEST, LONGEST = 4, 10  # letters of a beginning
NONE, INSULT, THREAT, TARGET, NEGATION, REPORT, MODAL = range(7)
NEGATION_REACH = 3  # words over which a negation stays open
NEGATED, REPORTED, AIMED, THREATENED = 0.3, 0.5, 1.25, 4.0

# Closed word classes in English, German, French and Spanish.
CLASSES = {
    TARGET: "you your you're yourself he she they them him her du dich dir euch ihr sie er tu toi vous ils elle il tú usted ustedes ellos él ella",
    NEGATION: "not no never n't isn't aren't wasn't don't doesn't didn't nobody nicht kein keine keinen nie ne pas jamais aucun no nunca ningún ninguna",
    REPORT: "said says say told called calls reported quoted wrote claimed alleged according sagte sagt nannte berichtete schrieb dit disait appelé raconte selon dijo dice llamó según escribió",
    MODAL: "will shall gonna going should must werde werden soll sollte muss vais va allons devrait voy vamos debe debería",
    THREAT: "kill hurt destroy beat punch stab shoot burn strangle murder töten umbringen schlagen erschießen tuer frapper détruire brûler matar golpear destruir quemar",
}
_MARKS = b".,;:!?\"'()[]{}*<>|&%$#-"
_CLOSE = b".;!?:,"


def bare(word: bytes) -> bytes:
    """The word without marks around it, in small letters."""
    return word.strip(_MARKS).decode("utf-8", "replace").lower().encode()


def beginnings(word: bytes) -> list[bytes]:
    letters = word.decode()
    return [letters[:n].encode() for n in range(SHORTEST, min(len(letters), LONGEST) + 1)] + (
        [word + b"\0"] if len(letters) >= 3 else [])  # the end of the word is a letter of its own


def lexical_arcs(insults: dict[bytes, float]) -> dict[bytes, tuple[int, float]]:
    """Accepted letter strings with class and weight; closed classes are whole words."""
    arcs = {k: (INSULT, w) for k, w in insults.items()}
    for kind, words in CLASSES.items():
        for word in words.split():
            arcs.setdefault(word.encode() + b"\0", (kind, 1.0))
    return arcs


class Lexicon(dict):
    """Class + 8 * weight in thousandths of a word: the longest letter string that the arcs accept."""

    def __init__(self, arcs: dict[bytes, tuple[int, float]]):
        super().__init__()
        self.arcs = arcs

    def __missing__(self, word: bytes) -> int:
        if len(self) >= LARGE_MEMO:
            self.clear()
        code, clean = 0, bare(word)
        if clean:
            for text in reversed([*beginnings(clean), *([clean + b"\0"] if len(clean.decode()) < 3 else [])]):
                if text in self.arcs:
                    kind, weight = self.arcs[text]
                    code = kind + 8 * int(weight * 1000)
                    break
        self[word] = code
        return code


def clause_weight(classes: list[int], weights: list[float]) -> float:
    """What the clause transducer writes for the classes of one clause."""
    aimed = TARGET in classes
    reported = modal = False
    negated = 0
    total = 0.0
    for kind, weight in zip(classes, weights, strict=True):
        negated = max(negated - 1, 0)
        if kind == NEGATION:
            negated = NEGATION_REACH + 1
        elif kind == REPORT:
            reported = True
        elif kind == MODAL:
            modal = True
        elif kind in (INSULT, THREAT):
            out = weight
            if kind == THREAT:
                out = THREATENED if modal or aimed else 0.0
            total += out * (NEGATED if negated else 1) * (REPORTED if reported else 1) * (AIMED if aimed else 1)
    return total


def document_weight(words: list[bytes], lexicon: Lexicon) -> tuple[float, int]:
    """Sum over clauses and number of clauses that left something. Only clauses with an insult or a threat are read."""
    codes = np.fromiter(map(lexicon.__getitem__, words), np.int64, len(words))
    kinds = codes & 7
    hits = np.flatnonzero((kinds == INSULT) | (kinds == THREAT))
    total, matched, done = 0.0, 0, 0
    for hit in hits.tolist():
        if hit < done:
            continue
        start = hit
        while start > done and words[start - 1][-1:] not in _CLOSE:
            start -= 1
        end = hit
        while end < len(words) - 1 and words[end][-1:] not in _CLOSE:
            end += 1
        done = end + 1
        left = clause_weight(kinds[start:done].tolist(), ((codes[start:done] >> 3) / 1000).tolist())
        total += left
        matched += left > 0
    return total, matched


# ------------------------------------------------------------------ learning

def chance(toxic: int, clean: int, share: float) -> float:
    """Probability of ``toxic`` or more toxic documents among all of a word, where each is toxic with the given probability."""
    n = toxic + clean
    ways = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    return sum(math.exp(ways(k) + k * math.log(share) + (n - k) * math.log1p(-share)) for k in range(toxic, n + 1))


def learn_insults(seen: DataFrame) -> dict[bytes, float]:
    """Beginnings of words with log odds, from (y, text) rows of a bounded sample."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = (Counter(), Counter())
            for y, text in zip(b.column("y").to_pylist(), blobs(b), strict=True):
                units = {u for w in {bare(w) for w in text.split()} for u in beginnings(w)}
                found[y].update(units)
            units = list(found[1].keys() | found[0].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(units, pa.binary()), pa.array([found[1][u] for u in units], pa.int64()),
                 pa.array([found[0][u] for u in units], pa.int64())], ["unit", "toxic", "clean"])

    n = {r.y: r.n for r in seen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return {}
    units = seen.select("y", "text").mapInArrow(counted, "unit binary, toxic long, clean long").groupBy("unit").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (n[0] + 1.0))
    share = n[1] / (n[0] + n[1])

    def judged(rows: list, places: dict[bytes, int] | None = None) -> dict[bytes, float]:
        """Weights of the units that have enough witnesses: toxic documents, or different neighbours where these are fewer."""
        out = {}
        for r in rows:
            u = bytes(r.unit)
            witnesses = r.toxic if places is None else min(r.toxic, places.get(u, 0))
            if witnesses >= MIN_DOCS and (witnesses >= MIN_SHARE * n[1] or chance(witnesses, r.clean, share) <= CHANCE):
                out[u] = r.w
        return out

    def counts(units: DataFrame) -> list:
        return units.where(F.col("toxic") >= MIN_DOCS).withColumn("w", odds).where(F.col("w") >= MIN_WEIGHT).collect()

    first = counts(units)
    weights = judged(first)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = set()
            for text in blobs(b):
                words = [b"", *text.split(), b""]
                for before, word, after in zip(words, words[1:], words[2:], strict=False):
                    places.update((u, before + b" " + after) for u in beginnings(bare(word)) if u in weights)
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in places], pa.binary()), pa.array([p for _, p in places], pa.binary())],
                                             ["unit", "place"])

    # copies of one toxic text are one witness: a beginning must stand between different neighbours
    places = seen.where("y = 1").select("text").mapInArrow(placed, "unit binary, place binary").distinct().groupBy("unit").count()
    places = {bytes(r.unit): r["count"] for r in places.where(F.col("count") >= MIN_DOCS).collect()}
    weights = judged(first, places)
    # an arc that a shorter one makes needless is left out
    weights = {u: w for u, w in weights.items() if not any(weights.get(u[:n], 0) >= w - 0.5 for n in range(3, len(u)) if u[:n] != u)}
    # a word takes its longest arc, so an arc is judged by the words that no longer one takes
    for _ in range(2):
        left = seen.select("y", "text").mapInArrow(_settled(weights), "unit binary, toxic long, clean long").groupBy("unit").agg(
            F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        weights = judged(counts(left), places)
    return weights


def _settled(weights: dict[bytes, float]):
    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of each arc that is the longest of one of their words."""
        for b in batches:
            found = (Counter(), Counter())
            for y, text in zip(b.column("y").to_pylist(), blobs(b), strict=True):
                longest = (next((u for u in reversed(beginnings(w)) if u in weights), None) for w in {bare(w) for w in text.split()})
                found[y].update({u for u in longest if u is not None})
            units = list(found[1].keys() | found[0].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(units, pa.binary()), pa.array([found[1][u] for u in units], pa.int64()),
                 pa.array([found[0][u] for u in units], pa.int64())], ["unit", "toxic", "clean"])
    return settled


def evidence(total: float, matched: int) -> float:
    return float(np.log1p(total) + 0.5 * np.log1p(matched))


def fit_curve(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a little decay; ``share`` of the weight goes to the positives,
    as among all labels, so that the curve gives probabilities."""
    p = np.zeros(2)
    z = np.stack((x, np.ones_like(x)), axis=1)
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1))
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(z @ p, -30, 30)))
        grad = z.T @ (weight * (y - q)) - 1e-4 * p
        hess = (z * (weight * q * (1 - q))[:, None]).T @ z + 1e-4 * np.eye(2)
        p = p + np.linalg.solve(hess, grad)
    return float(p[0]), float(p[1])


class Grammar:
    """The composed machines with their weights. Without labels of both kinds, closed threats alone are scored."""

    def __init__(self, insults: dict[bytes, float]):
        self.arcs = lexical_arcs(insults)
        self.slope, self.offset = 2.0, -3.0

    def score(self, x: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -50, 50))))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, rows: Column | None = None) -> Grammar:
    text_batches(docs.sparkSession)
    seen = sample(docs, labels, "toxic", per_class, rows).persist()
    try:
        grammar = Grammar(learn_insults(seen))
        arcs = grammar.arcs

        def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon = Lexicon(arcs)
            for b in batches:
                x = [evidence(*document_weight(t.split(), lexicon)) for t in blobs(b)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(x, pa.float64())], ["doc_id", "y", "x"])

        got = seen.mapInArrow(weighed, "doc_id long, y int, x double").orderBy("doc_id").collect()
        if len({r.y for r in got}) == 2:
            share = labels.where(F.lit(True) if rows is None else rows).agg(F.avg("toxic")).first()[0]
            grammar.slope, grammar.offset = fit_curve(np.array([r.x for r in got]), np.array([r.y for r in got], float), share)
        return grammar
    finally:
        seen.unpersist()


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and matched clauses for each row of ``docs`` (doc_id, text, any more columns).

    Labels of held-out documents (crc32 of the id modulo 3 is 1) are never seen. A null or empty text matches nothing.
    Each row is scored by itself: repeated rows get equal scores, an empty table gives no rows.
    """
    grammar = learn(docs, labels, per_class, remainder("doc_id", 3) != 1)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(grammar.arcs)
        for b in batches:
            left = [document_weight(t.split(), lexicon) for t in blobs(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([grammar.score(evidence(*x)) for x in left], pa.float64()),
                 pa.array([m for _, m in left], pa.int64())], ["doc_id", "held_out", "score", "n_clauses"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double, n_clauses long").select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_clauses")

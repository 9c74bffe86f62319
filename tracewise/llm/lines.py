"""Quality rules: counts of a text, and a linear-chain conditional random field that labels its lines.

The field has two states, content and boilerplate. Each line gives features of its form (length, symbols, capitals,
repeated words and lines, ends of sentences, columns); the weights of the features and of the four steps between states
are learned by gradient ascent on the likelihood (forward and backward sums) from the lines of at most ``2 * per_class``
labelled documents, whose lines take the label of their document. Viterbi decoding then finds the likeliest states of
all lines of every whole text. A text is kept if the base rules pass and at least half of its words are in content.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm.labelled import sample
from tracewise.llm.words import WordCodes, blobs, shingles, text_batches

MIN_WORDS = 50
REPEAT_PERCENT = 50
CONTENT_SHARE = 0.5
PER_CLASS = 2000
SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
FEATURES = 11
STEPS = 48  # lines of a chain in training; longer documents are cut into several chains there
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count_of(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def counts(text: bytes, lines: list[bytes], words: list[bytes], codes: np.ndarray) -> tuple[int, int, int, int, int]:
    """The five base counts."""
    joined = np.frombuffer(b"".join(words), np.uint8)
    seen, dup = set(), 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    covered = 0
    if len(words) > 2:
        _, which, times = np.unique(shingles(codes, 3), return_inverse=True, return_counts=True)
        again = times[which] > 1
        if again.any():
            hit = np.zeros(len(words), bool)
            for j in range(3):
                hit[j:len(words) - 2 + j] |= again
            covered = int(hit.sum())
    chars = len(joined) - int(np.count_nonzero((joined & 0xC0) == 0x80))
    return len(words), chars, count_of(text, SYMBOLS), dup, covered


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > REPEAT_PERCENT * n_words


def line_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(lines, FEATURES) features and the words of each line."""
    out = np.zeros((len(lines), FEATURES), np.float32)
    n_words = np.zeros(len(lines), np.int64)
    seen: set[bytes] = set()
    for i, line in enumerate(lines):
        words = line.split()
        n = n_words[i] = len(words)
        if not n:
            continue
        size = len(line)
        letters_up = count_of(line, _UPPER)
        letters = letters_up + count_of(line, _LOWER) + 1
        same = sum(map(bytes.__eq__, words[1:], words))
        last = words[-1][-1:]
        out[i] = (1.0, min(np.log(n), 6) / 3, 4 * min(count_of(line, SYMBOLS) / n, 1), 2 * letters_up / letters,
                  2 * same / n, 2 * (1 - len(set(words)) / n) if n > 8 else 0, line in seen,
                  last in b".!?:;", 2 * min(line.count(b"!") / n, 1), 2 * min(count_of(line, _DIGIT) / size, 1),
                  min(size / n, 40) / 10)
        seen.add(line)
    return out, n_words


# ------------------------------------------------------------------ the field

def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit_field(chains: list[np.ndarray], labels: list[int], rounds: int = 120, rate: float = 0.3, decay: float = 1e-4):
    """Emission weights (2, FEATURES) and step weights (2, 2) by gradient ascent; state 1 is content."""
    pieces = [(c[at:at + STEPS], y) for c, y in zip(chains, labels, strict=True) for at in range(0, len(c), STEPS)]
    size = np.array([len(p) for p, _ in pieces])
    x = np.zeros((len(pieces), STEPS, FEATURES), np.float32)
    for i, (p, _) in enumerate(pieces):
        x[i, :len(p)] = p
    y = np.array([y for _, y in pieces])
    mask = np.arange(STEPS)[None, :] < size[:, None]
    weight = np.where(y == 1, 0.5 / max(size[y == 1].sum(), 1), 0.5 / max(size[y == 0].sum(), 1))  # both labels count alike
    gold = np.zeros((len(pieces), STEPS, 2), np.float32)
    gold[np.arange(len(pieces))[:, None], np.arange(STEPS)[None, :], y[:, None]] = mask
    w, steps = np.zeros((2, FEATURES)), np.zeros((2, 2))
    sum_w, sum_s = np.full_like(w, 1e-8), np.full_like(steps, 1e-8)
    for _ in range(rounds):
        emit = x @ w.T
        fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
        fwd[:, 0] = emit[:, 0]
        for t in range(1, STEPS):
            fwd[:, t] = np.where(mask[:, t, None], emit[:, t] + _logsumexp(fwd[:, t - 1, :, None] + steps[None], 1), fwd[:, t - 1])
        for t in range(STEPS - 2, -1, -1):
            go = _logsumexp(steps[None] + (emit[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(mask[:, t + 1, None], go, 0)
        total = _logsumexp(fwd[:, -1], 1)
        posterior = np.exp(np.minimum(fwd + bwd - total[:, None, None], 0)) * mask[:, :, None]
        diff = (gold - posterior) * weight[:, None, None]
        grad_w = np.einsum("pts,ptf->sf", diff, x) - decay * w
        both = fwd[:, :-1, :, None] + steps[None, None] + (emit + bwd)[:, 1:, None, :] - total[:, None, None, None]
        both = np.exp(np.minimum(both, 0)) * mask[:, 1:, None, None]
        want = np.zeros_like(both)
        want[np.arange(len(pieces)), :, y, y] = mask[:, 1:]
        grad_s = np.einsum("ptij,p->ij", want - both, weight) - decay * steps
        sum_w += grad_w**2
        sum_s += grad_s**2
        w += rate * grad_w / np.sqrt(sum_w)
        steps += rate * grad_s / np.sqrt(sum_s)
    return w, steps


def viterbi(emit: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Likeliest state of each line."""
    n = len(emit)
    gain = (emit[:, 1] - emit[:, 0]).tolist()
    (s00, s01), (s10, s11) = steps.tolist()
    a, b = 0.0, gain[0]
    from_a, from_b = [0] * n, [1] * n
    for t in range(1, n):
        stay, cross = a + s00, b + s10
        from_a[t] = int(cross > stay)
        low = max(stay, cross)
        stay, cross = b + s11, a + s01
        from_b[t] = int(stay >= cross)
        a, b = low, max(stay, cross) + gain[t]
    states = np.zeros(n, bool)
    now = int(b >= a)
    for t in range(n - 1, -1, -1):
        states[t] = now
        now = from_b[t] if now else from_a[t]
    return states


def content_words(lines: list[bytes], field) -> int:
    """Words in lines that the field marks as content; all words without a field."""
    x, n_words = line_features(lines)
    if field is not None:
        w, steps = field
        x = x[n_words > 0]
        n_words = n_words[n_words > 0]
        if len(x):
            n_words = n_words[viterbi(x @ w.T, steps)]
    return int(n_words.sum())


# ------------------------------------------------------------------ on Spark

def learn_field(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    """The field, or None where the labels don't show both kinds of documents."""
    text_batches(docs.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for text in blobs(b):
                x, n = line_features(text.split(b"\n"))
                made.append(x[n > 0].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(made, pa.binary())], ["doc_id", "y", "x"])

    rows = sample(docs, labels, "quality", per_class).mapInArrow(features, "doc_id long, y int, x binary").collect()
    rows = sorted((r.doc_id, r.y, r.x) for r in rows if r.x)
    if len({y for _, y, _ in rows}) < 2:
        return None
    return fit_field([np.frombuffer(bytes(x), np.float32).reshape(-1, FEATURES) for _, _, x in rows], [y for _, y, _ in rows])


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, share: float = CONTENT_SHARE) -> DataFrame:
    """doc_id, the base counts, content_words, base_failed and kept for each row of ``docs`` (doc_id, text, any more).

    A null text has no words and fails the base rules like an empty one. Labels (doc_id, quality 0/1) may be empty or of
    one kind only: then every line counts as content and the base rules alone decide. Each row is judged by itself, so
    repeated rows and ties get equal results and an empty table gives no rows.
    """
    field = learn_field(docs, labels, per_class)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordCodes()
        for b in batches:
            rows = []
            for text in blobs(b):
                lines, words = text.split(b"\n"), text.split()
                n, *rest = counts(text, lines, words, memo.array(words))
                content = content_words(lines, field)
                failed = base_failed(n, rest[-1])
                rows.append((n, *rest, content, failed, not failed and content >= share * n))
            columns = zip(*rows, strict=True) if rows else repeat((), 8)
            arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 6 + [pa.bool_()] * 2, strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays],
                                             ["doc_id", *COUNTS, "content_words", "base_failed", "kept"])

    made = ", ".join(f"{c} long" for c in (*COUNTS, "content_words"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        judged, f"doc_id long, {made}, base_failed boolean, kept boolean")


def passing(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns."""
    field = learn_field(docs, labels, per_class)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordCodes()
        for b in batches:
            stay = []
            for text in blobs(b):
                lines, words = text.split(b"\n"), text.split()
                n, *_, again = counts(text, lines, words, memo.array(words))
                stay.append(not base_failed(n, again) and content_words(lines, field) >= share * n)
            yield b.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(passed, docs.schema)

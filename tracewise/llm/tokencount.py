"""Token counts by finite-state transducers compiled from a tokenizer's file.

Reads byte-pair encodings with word ends as the ``tokenizers`` library stores them: text in normal form C and small letters, white
space dropped, words cut by a pattern of contractions, letters, single digits and others, and merges within a word whose last
symbol is a symbol of its own. Nothing of the library runs over the texts. Two deterministic transducers are composed:

The scanner reads classes of characters and marks where words begin. It has seven states, so a chunk of text is a map of seven
states to seven. All chunks of a batch are run at once, from every state, and their maps are composed by a parallel prefix
scan; with the state that each chunk is really entered in, all are run once more and mark their words.

The counter reads the symbols of a word. Its transitions carry how many tokens the encoding of what was read grows by, which may be
negative, so a word has as many tokens as its path sums up to. The states come from the following: merging never looks across the
border of two neighbouring tokens if the two, encoded together, stay these two; and an encoding whose neighbours all do is the
encoding. So the last token of a prefix is the one token ending there that agrees with the last token of what stands before it.
A state holds the places where a longer token may still begin: the node of the trie of tokens that is reached from there, the
token before it and by how many tokens the count there differs. It is made when it is first reached, as there are too many to make them all,
and all are forgotten when there are more than fit. A word leads back to the first state, so a chunk needs no maps of this one.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from types import ModuleType

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm.words import text_batches

LIMIT = 2048
WORD_MEMO, STEP_MEMO, PAIR_MEMO = 1 << 18, 1 << 19, 1 << 18
LONG_WORD = 64  # characters of a word that is worth remembering
PART = 1 << 20  # characters of a batch that are scanned at once

# fixed values: the cutting pattern and the normal form that the compiled scanner stands for
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL_FORM = ["NFC", "Replace", "Lowercase"]

# classes of characters; S, T, M and D complete a contraction by themselves
SPACE, LETTER, SHORT, LETTER_R, LETTER_V, LETTER_E, LETTER_L, DIGIT, QUOTE, OTHER = range(10)
# states: a word begins next; in letters; in others; a quote that began a word, and the same with r, v or l after it
BEGIN, LETTERS, OTHERS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
HERE, BEFORE = 1, 2  # outputs: a word begins at this character, at the one before


# ------------------------------------------------------------------ the scanner

def scanner() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output by state and class."""
    step, out = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)
    letters = (LETTER, SHORT, LETTER_R, LETTER_V, LETTER_E, LETTER_L)
    begun = {SPACE: (BEGIN, 0), DIGIT: (BEGIN, HERE), QUOTE: (QUOTED, HERE), OTHER: (OTHERS, HERE), **dict.fromkeys(letters, (LETTERS, HERE))}
    table = {s: dict(begun) for s in range(7)}
    for c in letters:
        table[LETTERS][c] = (LETTERS, 0)
    for state in (OTHERS, QUOTED):
        for c in (QUOTE, OTHER):
            table[state][c] = (OTHERS, 0)
    table[QUOTED][SHORT] = (BEGIN, 0)
    for first, state, last in ((LETTER_R, QUOTED_R, LETTER_E), (LETTER_V, QUOTED_V, LETTER_E), (LETTER_L, QUOTED_L, LETTER_L)):
        table[QUOTED][first] = (state, 0)
        for c, (after, mark) in begun.items():  # no contraction: the quote was a word, and its letter began another
            table[state][c] = (LETTERS, BEFORE) if c in letters else (after, mark | BEFORE)
        table[state][last] = (BEGIN, 0)
    for s, row in table.items():
        for c, (after, mark) in row.items():
            step[s, c], out[s, c] = after, mark
    return step, out


def classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every, points = "".join(map(chr, points)), np.array(points)
    newer = np.array([unicodedata.category(c) == "Cn" for c in every])
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", SPACE)):
        found = np.zeros(len(points), bool)
        for m in regex.finditer(pattern, every):
            found[m.start():m.end()] = True
        found[found & newer] = _matching("".join(map(chr, points[found & newer])), pattern)
        table[points[found]] = kind
    for chars, kind in (("stmd", SHORT), ("r", LETTER_R), ("v", LETTER_V), ("e", LETTER_E), ("l", LETTER_L), ("'", QUOTE)):
        table[[ord(x) for x in chars]] = kind
    table[0x1C:0x20] = OTHER  # information separators are white space to some, not to the pattern
    return table


def _matching(chars: str, pattern: str) -> np.ndarray:
    """Which characters the library's pattern engine takes; asked, once per compilation, about those that only some Unicode tables know."""
    from tokenizers import Regex, pre_tokenizers

    taken = np.ones(len(chars), bool)
    for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(chars):
        taken[a:b] = False
    return taken


STEP, OUT = scanner()


def chunk_maps(kinds: np.ndarray, step: np.ndarray = STEP) -> np.ndarray:
    """For each chunk (a column of ``kinds``) the state that each state is led to: (chunks, states)."""
    n = step.shape[1]
    flat = step.astype(np.intp).ravel()
    now = np.repeat(np.arange(step.shape[0], dtype=np.intp)[None, :], kinds.shape[1], axis=0)
    for row in kinds:
        now = flat[now * n + row[:, None]]
    return now


def composed(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan: what the chunks up to each one do together, in log2(chunks) rounds."""
    maps, stride = maps.copy(), 1
    while stride < len(maps):
        maps[stride:] = np.take_along_axis(maps[stride:], maps[:-stride], axis=1)
        stride *= 2
    return maps


def word_starts(kinds: np.ndarray) -> np.ndarray:
    """Which characters begin a word; the text begins where a word may begin."""
    n = len(kinds)
    size = max(32, math.isqrt(n))
    chunks = -(-n // size)
    laid = np.full(chunks * size, SPACE, np.uint8)
    laid[:n] = kinds
    laid = np.ascontiguousarray(laid.reshape(chunks, size).T)
    entered = np.full(chunks, BEGIN, np.intp)
    entered[1:] = composed(chunk_maps(laid))[:-1, BEGIN]
    step, out, width = STEP.astype(np.intp).ravel(), OUT.ravel(), STEP.shape[1]
    marks = np.empty(laid.shape, np.uint8)
    for i, row in enumerate(laid):
        at = entered * width + row
        marks[i] = out[at]
        entered = step[at]
    marks = np.ascontiguousarray(marks.T).ravel()
    starts = marks & HERE > 0
    starts[:-1] |= marks[1:] & BEFORE > 0
    return starts[:n]


# ------------------------------------------------------------------ the counter

@dataclass(frozen=True)
class Definition:
    """What a tokenizer's file says: merges in order as three numbers of tokens, the symbols of bytes inside and at the end of a word,
    the strings that are tokens wherever they stand, and small letters that Python does not know of."""

    merges: np.ndarray
    symbols: np.ndarray
    special: tuple[str, ...]
    small: dict[int, str]


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in such files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs, more = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in signs:
            signs[b], more = chr(more), more + 1
    return [signs[b] for b in range(256)]


def definition(path: str) -> Definition:
    """Read a file; one whose rules are others than those compiled here is refused."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    model, normal, cut = spec["model"], spec["normalizer"], spec["pre_tokenizer"]["pretokenizers"]
    suffix = model["end_of_word_suffix"]
    if ([x["type"] for x in normal["normalizers"]] != NORMAL_FORM or [x["type"] for x in cut] != ["Split", "ByteLevel"] or cut[0]["pattern"] != {"Regex": PATTERN}
            or model["type"] != "BPE" or not suffix or model["dropout"] or model["continuing_subword_prefix"] or model["ignore_merges"]):
        raise ValueError(f"{path}: not a byte-pair encoding with word ends of the kind that is compiled here")
    ids = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in merges], np.int32).reshape(-1, 3)
    signs = byte_signs()
    symbols = np.array([[ids[s], ids[s + suffix]] for s in signs], np.int32)
    return Definition(merges, symbols, tuple(x["content"] for x in spec["added_tokens"]), _newer_letters(spec["normalizer"]))


def _newer_letters(normalizer: dict) -> dict[int, str]:
    """Small letters of capitals that are newer than Python's tables, asked of the normalizer itself, once per compilation."""
    found = [x for x in regex.findall(r"\p{Lu}", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)) if unicodedata.category(x) == "Cn"]
    if not found:
        return {}
    from tokenizers import normalizers

    own = normalizers.Lowercase()
    return {ord(x): own.normalize_str(x) for x in found}


class Counter:
    """The second transducer, made state by state."""

    def __init__(self, spec: Definition):
        self.ranks = {(int(a), int(b)): (rank, int(made)) for rank, (a, b, made) in reversed(list(enumerate(spec.merges)))}
        self.symbols = spec.symbols.tolist()
        # what a token is made of, as symbols of the trie: a byte inside a word, or 256 and a byte that ends it
        spelled = {t: (256 * end + b,) for b, pair in enumerate(self.symbols) for end, t in enumerate(pair)}
        for a, b, made in spec.merges.tolist():
            if made not in spelled:
                spelled[made] = spelled[a] + spelled[b]
        self.spelled = spelled
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [False]
        for t, signs in spelled.items():
            node = 0
            for s in signs:
                self.inner[node] = True
                key = node << 9 | s
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
            self.token[node] = t
        self.agreed: dict[int, bool] = {}
        self.sides: dict[int, tuple[list, list] | None] = {}
        self.forget()

    def forget(self) -> None:
        """Back to the first state alone."""
        self.states: list[tuple] = [((0, -1, 0),)]
        self.numbers = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, int]] = {}

    def encoded(self, signs: tuple[int, ...]) -> list[int]:
        """Tokens of a run of symbols by merging."""
        row = [self.symbols[s & 255][s >> 8] for s in signs]
        while (found := self._least(row)) is not None:
            _, at, made = found
            row[at:at + 2] = [made]
        return row

    def _least(self, row: list[int]) -> tuple[int, int, int] | None:
        """(rank, place, token made) of the next merge: the least rank, the first of equal ones."""
        pairs = ((i, self.ranks.get(p)) for i, p in enumerate(zip(row, row[1:], strict=False)))
        return min(((found[0], i, found[1]) for i, found in pairs if found), default=None)

    def history(self, token: int) -> tuple[list[tuple[int, float]], list[tuple[int, float]]] | None:
        """The first symbol and the last one while a token is merged, each with the rank of the merge that ends it; None for a token that
        merging does not yield, or not in the order of ranks."""
        if token not in self.sides:
            row = [self.symbols[s & 255][s >> 8] for s in self.spelled[token]]
            sides, before = ([(row[0], math.inf)], [(row[-1], math.inf)]), -1
            while (found := self._least(row)) is not None and before <= found[0]:
                before, at, made = found
                for side, hit in ((sides[0], at == 0), (sides[1], at == len(row) - 2)):
                    if hit:
                        side[-1] = (side[-1][0], before)
                        side.append((made, math.inf))
                row[at:at + 2] = [made]
            self.sides[token] = sides if row == [token] else None
        return self.sides[token]

    def agree(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are next to each other; ``left`` -1 for none.

        The symbols on either side of the border are followed through the merges of both tokens, by rank. The tokens don't stay if at
        some time the two can be merged before either is used up on its own side; at equal ranks the merge further left is first.
        """
        key = left << 20 | right
        known = self.agreed.get(key)
        if known is None:
            if len(self.agreed) >= PAIR_MEMO:
                self.agreed.clear()
            known = self.agreed[key] = self._agree(left, right)
        return known

    def _agree(self, left: int, right: int) -> bool:
        own = self.history(right)
        if left < 0:
            return own is not None or self.encoded(self.spelled[right]) == [right]
        other = self.history(left)
        if own is None or other is None:
            return self.encoded(self.spelled[left] + self.spelled[right]) == [left, right]
        xs, ys, ranks, i, j = other[1], own[0], self.ranks, 0, 0
        while True:
            (x, x_end), (y, y_end) = xs[i], ys[j]
            found = ranks.get((x, y))
            if found is not None and found[0] < x_end and found[0] <= y_end:
                return False
            if x_end == y_end == math.inf:
                return True
            if x_end <= y_end:
                i += 1
            else:
                j += 1

    def step(self, state: int, sign: int) -> tuple[int, int]:
        """(next state, tokens by which the count grows) for a symbol; a symbol that ends the word leads to the first state."""
        live, child, token = [], self.child, self.token
        last = grown = None
        for node, left, off in self.states[state]:
            after = child.get(node << 9 | sign)
            if after is None:
                continue
            t = token[after]
            if t >= 0 and last is None and self.agree(left, t):
                last, grown = t, off + 1
            if self.inner[after]:
                live.append((after, left, off))
        if sign >= 256:
            return 0, grown
        made = (*((node, left, off - grown) for node, left, off in live), (0, last, 0))
        number = self.numbers.get(made)
        if number is None:
            number = self.numbers[made] = len(self.states)
            self.states.append(made)
        return number, grown

    def count(self, word: str) -> int:
        """The tokens of a word."""
        data = word.encode()
        state = total = 0
        steps = self.steps
        for b in data[:-1]:
            key = state << 9 | b
            found = steps.get(key)
            if found is None:
                if len(steps) >= STEP_MEMO:
                    kept = self.states[state]
                    self.forget()
                    steps = self.steps
                    state = self.numbers.setdefault(kept, len(self.states))
                    if state:
                        self.states.append(kept)
                    key = state << 9 | b
                found = steps[key] = self.step(state, b)
            state = found[0]
            total += found[1]
        key = state << 9 | 256 | data[-1]
        found = steps.get(key)
        if found is None:
            found = steps[key] = self.step(state, 256 | data[-1])
        return total + found[1]


class Words(dict):
    """The tokens of a word; forgets all when it has seen many, so that memory stays bounded."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: str) -> int:
        n = self.counter.count(word)
        if len(word) <= LONG_WORD:
            if len(self) >= WORD_MEMO:
                self.clear()
            self[word] = n
        return n


class Machine:
    """Both transducers and the normal form before them."""

    def __init__(self, spec: Definition, kinds: np.ndarray):
        self.kinds, self.small = kinds, spec.small
        self.newer = re.compile(f"[{''.join(map(chr, spec.small))}]") if spec.small else None
        self.words = Words(Counter(spec))
        self.special = re.compile("|".join(re.escape(s) for s in sorted(spec.special, key=len, reverse=True))) if spec.special else None

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # small letters one by one: at the end of a word, too, a sigma becomes the common small one
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return text.translate(self.small) if self.newer and self.newer.search(text) else text

    def counts(self, texts: list[str]) -> list[int]:
        """The tokens of each text."""
        totals = np.zeros(len(texts), np.int64)
        parts, owners, size = [], [], 0
        for i, text in enumerate(texts):
            pieces = [text]
            if self.special is not None and self.special.search(text):
                pieces = self.special.split(text)
                totals[i] += len(pieces) - 1
            for piece in pieces:
                parts.append(self.normal(piece))
                owners.append(i)
                size += len(parts[-1]) + 1
                if size >= PART:
                    self._add(parts, owners, totals)
                    parts, owners, size = [], [], 0
        self._add(parts, owners, totals)
        return totals.tolist()

    def _add(self, parts: list[str], owners: list[int], totals: np.ndarray) -> None:
        if not parts:
            return
        whole = "\n".join(parts) + "\n"
        kinds = self.kinds[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
        starts = word_starts(kinds)
        edges = np.flatnonzero(starts | (kinds == SPACE))
        first = np.flatnonzero(starts[edges])
        if not len(first):
            return
        begin, end = edges[first], edges[first + 1]  # the last edge is the line end put after the texts
        words = map(whole.__getitem__, map(slice, begin.tolist(), end.tolist()))
        tokens = np.fromiter(map(self.words.__getitem__, words), np.int64, len(begin))
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        part = np.searchsorted(np.cumsum(lengths), begin, side="right")
        np.add.at(totals, np.asarray(owners)[part], tokens)


# ------------------------------------------------------------------ on Spark

def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs`` (doc_id, text, any more columns).

    ``path`` is the tokenizer's file, read on the driver and compiled there; tasks get the compiled form. Strings of special tokens in
    a text are one token each, as by the library's default. A null or empty text, and one of white space only, has no tokens. Each
    row is counted by itself, so repeated rows and rows without doc_id get a row each, and an empty table gives no rows. Letters that are newer
    than Python's Unicode tables are put in small letters as the library does, but not composed.
    """
    text_batches(docs.sparkSession)
    spec, kinds = definition(path), classes()
    edges = np.flatnonzero(np.diff(kinds)) + 1  # a table of runs is a hundredth of the whole
    runs = np.concatenate(([0], edges)), kinds[np.concatenate(([0], edges))], len(kinds)

    name = hashlib.sha256(spec.merges.tobytes() + repr(spec.special).encode()).hexdigest()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker process serves many tasks: what it has made of the machine stays with it, one machine at a time
        held = sys.modules.setdefault("token machines", ModuleType("token machines"))
        if getattr(held, "name", None) != name:
            at, kind, size = runs
            held.machine, held.name = Machine(spec, np.repeat(kind, np.diff(np.append(at, size)))), name
        machine = held.machine
        for b in batches:
            texts = b.column("text")
            n = machine.counts([t or "" for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

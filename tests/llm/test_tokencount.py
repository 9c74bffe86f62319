import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import regex
from conftest import DATA
from tokenizers import Tokenizer

from tracewise.llm import tokencount as T

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def machine():
    return T.Machine(T.definition(PATH), T.classes())


def slow(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_whole_texts_of_documents(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: tuple(r) for r in T.token_counts(docs, PATH).collect()}
    rows = docs.collect()
    texts = [r.text or "" for r in rows]
    want = {r.doc_id: (r.doc_id, len(t.encode()), n, n > 2048) for r, t, n in zip(rows, texts, slow(library, texts), strict=True)}
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(library, machine, seed):
    rng = random.Random(seed)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", " ", "a", "b", "é", "1", "٣", "!", "|", "<", "Σ", "İ", "日", "本", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>",
             "\x1c", "\x85", " ", "\n", "'S", "L", "zz", "the", "ing", "é", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(3000)]
    ranges = [(32, 126), (0xA0, 0x24F), (0x370, 0x5FF), (0x3040, 0x9FFF), (0x1F300, 0x1F6FF)]
    texts += ["".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(rng.randrange(60))) for _ in range(3000)]
    assert machine.counts(texts) == slow(library, texts)


def test_vocabulary_and_pairs(library, machine):
    """Each token's text alone, and pairs of them run together, where merges cross the border."""
    words = [w.replace("</w>", "") for w in library.get_vocab() if w.replace("</w>", "").isalpha() and w.isascii()]
    rng = random.Random(4)
    texts = words[::3] + [rng.choice(words) + rng.choice(words) + rng.choice(words) for _ in range(5000)]
    assert machine.counts(texts) == slow(library, texts)


def test_agreement_is_that_of_merging(machine):
    counter = machine.words.counter
    inner = [t for t, s in counter.spelled.items() if s[-1] < 256]
    every, rng = list(counter.spelled), random.Random(5)
    for _ in range(5000):
        a, b = rng.choice(inner), rng.choice(every)
        assert counter.agree(a, b) == (counter.encoded(counter.spelled[a] + counter.spelled[b]) == [a, b])


def test_classes_are_the_librarys(library, machine):
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    for at in range(0, len(points), 40_000):
        part = points[at:at + 40_000]
        pieces = [[] for _ in part]
        for _, (a, b) in library.pre_tokenizer.pre_tokenize_str("".join(f"a{chr(c)}a " for c in part)):
            pieces[a // 4].append((a % 4, b - a))
        for c, got in zip(part.tolist(), pieces, strict=True):
            kind = machine.kinds[c]
            want = [(0, 1), (2, 1)] if kind == T.SPACE else [(0, 3)] if T.LETTER <= kind <= T.LETTER_L else [(0, 1), (1, 1), (2, 1)]
            assert got == want, hex(c)


def test_chunks_compose_to_the_whole():
    """Words by the pattern itself, whatever the chunks; maps of chunks against one state at a time."""
    rng = random.Random(6)
    kinds = T.classes()
    for n in (0, 1, 31, 32, 33, 1000, 5000):
        text = "".join(rng.choice("'srtvelldm1!  xy") for _ in range(n))
        want = [m.start() for m in regex.finditer(T.PATTERN, text)]
        assert np.flatnonzero(T.word_starts(kinds[[ord(c) for c in text]])).tolist() == want if n else True
    laid = np.random.default_rng(1).integers(0, 10, (40, 9)).astype(np.uint8)
    maps, together = T.chunk_maps(laid), T.composed(T.chunk_maps(laid))
    for state in range(7):
        now = state
        for chunk in range(9):
            before = now
            for c in laid[:, chunk]:
                now = T.STEP[now, c]
            assert maps[chunk, before] == now == together[chunk, state]


def test_forgetting_changes_nothing(library, monkeypatch):
    for name in ("WORD_MEMO", "STEP_MEMO", "PAIR_MEMO"):
        monkeypatch.setattr(T, name, 8)
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdeinrst ") for _ in range(200)) for _ in range(50)]
    assert T.Machine(T.definition(PATH), T.classes()).counts(texts) == slow(library, texts)


def test_odd_rows(spark, library):
    texts = [None, "", " \n\t", "x", "x", "word " * 200_000, "a" * 300_000, "é" * 1000, "<|endoftext|>" * 3, "𐵐" + unicodedata.normalize("NFD", "é")]
    docs = spark.createDataFrame([(i if i % 4 else None, t, i, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, limit string")
    got = T.token_counts(docs, PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i if i % 4 else None, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(enumerate(texts), slow(library, [t or "" for t in texts]), strict=True)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert T.token_counts(docs.limit(0), PATH).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises((ValueError, KeyError)):
        T.definition(public_tokenizers.path("byte_bpe_50k.json"))

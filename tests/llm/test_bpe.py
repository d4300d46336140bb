import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lamina.llm import bpe
from lamina.llm.queries import tokenizer_file

SPEC = tokenizer_file("word_bpe_49k.json")
ODD = [
    "", " ", None, "A\x1cB c\x1dd", "ΑΣ ΟΔΟΣ Σ", "İstanbul", "a<|endoftext|>b<|startoftext|>", "<|endoftext|><|endoftext|>", "é café",
    "日本語 テキスト ẞ ǅ", "x" * 5000, "ab" * 3000 + "!!!???" * 500, "it's we're 'SAY 'd", "１２３ ½ ² Ⅷ", " a​b　c\x85d",
    "\U0001f600\U0001f600 \U0001f468‍\U0001f469", "a\x00b\x07", "<|endoftext", "ſ K Å ﬁ", "the the the the",
]


@pytest.fixture(scope="module")
def own():
    return bpe.WordBPE(SPEC)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))


def test_same_as_the_library(own, library):
    rng = random.Random(1)
    alphabet = "abcXYZ'sSlL 12\n\t<|éÉßΣς☃"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for t, ids, e in zip(texts, own.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, t[:80]
        assert own.decode(ids).decode() == library.decode(e.ids, skip_special_tokens=False)


def test_query_columns(docs, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(1, " ")]
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_decode(docs(rows), SPEC).collect())
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((i, len(ids), sha, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_decode(docs([]), SPEC).collect() == []


def plain_merge(symbols, pairs):
    """Merge the leftmost pair of the lowest rank by scanning, until there is none."""
    symbols = list(symbols)
    while True:
        found = min(((pairs[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in pairs), default=None)
        if found is None:
            return symbols
        i = found[1]
        symbols[i : i + 2] = [pairs[symbols[i], symbols[i + 1]][1]]


def test_segment_tree_equals_scanning():
    rng = random.Random(5)
    for _ in range(30):
        pairs, n = {}, 4
        for rank in range(rng.randint(1, 25)):
            p = (rng.randrange(n), rng.randrange(n))
            if p not in pairs:
                pairs[p] = (rank, n)
                n += 1
        words = [[rng.randrange(4) for _ in range(rng.choice((0, 1, 2, 3, 4, 5, 8, 17, 64, 200)))] for _ in range(20)]
        flat, lengths = bpe.merge_all(np.array([s for w in words for s in w], np.int64), np.array([len(w) for w in words]), bpe.PairTable(pairs))
        at = np.cumsum(lengths)[:-1]
        assert [x.tolist() for x in np.split(flat, at)] == [plain_merge(w, pairs) for w in words]


@pytest.mark.parametrize(("few", "bits"), [(0, 40), (10**9, 40), (0, 9), (10**9, 9)])
def test_both_walks_and_the_width_of_places(monkeypatch, few, bits):
    """Words taken together or one by one, with places of 40 bits and of just as many as the words need: the rank is never reached."""
    monkeypatch.setattr(bpe, "FEW", few)
    monkeypatch.setattr(bpe, "PLACE_BITS", bits)
    test_segment_tree_equals_scanning()


def test_long_words(own, library):
    """A megabyte without a break, in seconds and as the library has it."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000)), "ab" * 60_000, "é" * 50_000]
    begin = time.monotonic()
    got = own.encode_batch(texts)
    assert time.monotonic() - begin < 60
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_null_and_shared_doc_ids(docs):
    rows = [(None, "a b"), (None, None), (3, "c"), (3, "c")]
    got = sorted(((r["doc_id"], r["n_tokens"]) for r in bpe.encode_decode(docs(rows), SPEC).collect()), key=str)
    assert got == sorted([(None, 2), (None, 0), (3, 1), (3, 1)], key=str)


def test_memory_is_bounded(own, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    texts = [f"word{i} other{i}" for i in range(40)]
    assert own.encode_batch(texts) == bpe.WordBPE(SPEC).encode_batch(texts)
    own.encode_batch(["x"])
    assert len(own.memory) <= 11

"""Runs against a quadratic search, comparisons per word counted, and the query against its contract written out plainly."""

import hashlib
import os
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm import queries, word_runs

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, shortest=1):
    """Every stretch with a period, tried period by period from the smallest; those of a smaller period that divides it are no runs of it."""
    found = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - p:
            s = i
            while i < len(w) - p and w[i] == w[i + p]:
                i += 1
            if i - s >= p and not any(q < p and p % q == 0 and a <= s and a + n >= i + p for a, n, q in found):
                found.append((s, i - s + p, p))
            i += 1
    return sorted((r for r in found if r[1] >= shortest), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(0, 60), st.integers(1, 30))
def test_matches_brute_force(w, at, period):
    for words in (w, w[: at + period] + w[at : at + period] * 4, w * 3):
        assert word_runs.runs(words, 1) == brute(words)
        assert word_runs.runs(words) == brute(words, 12)


def test_many_random_texts():
    rng = random.Random(3)
    for _ in range(3000):
        w = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(45))]
        if w and rng.random() < 0.5:
            a, p = rng.randrange(len(w)), 1 + rng.randrange(len(w))
            w[a:] = (w[a : a + p] * len(w))[: len(w) - a]
        assert word_runs.runs(w, 1) == brute(w), w


class Counted:
    n = 0

    def __init__(self, v):
        self.v = v

    def __eq__(self, other):
        Counted.n += 1
        return self.v == other.v

    def __ne__(self, other):
        Counted.n += 1
        return self.v != other.v

    def __lt__(self, other):
        Counted.n += 1
        return self.v < other.v

    __hash__ = None


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("n", [2_000, 20_000])
def test_comparisons_per_word_are_bounded(n):
    """Symbols that can't be hashed, and no more than 20 comparisons of two of them for each, on texts full of runs."""
    rng = random.Random(1)
    texts = [
        [0] * n, fibonacci(n), [rng.randrange(2) for _ in range(n)], ([rng.randrange(9) for _ in range(n // 5)] * 6)[:n], list(range(n)), list(range(n, 0, -1)),
        [0] * (n // 2) + [1] + [0] * (n // 2), [bin(i).count("1") % 2 for i in range(n)], [x for k in range(1, int((2 * n) ** 0.5)) for x in [0] * k + [1]],
        [x for k in range(int((2 * n) ** 0.5), 1, -1) for x in [0] * k + [1]], (fibonacci(int(n**0.5)) * n)[:n],
    ]
    for t in texts:
        Counted.n = 0
        word_runs.runs([Counted(x) for x in t], 1)
        assert Counted.n <= 20 * len(t)


def expected(doc_id, text):
    """The contract of the query, written out."""
    w = WORDS.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    found = brute(w, 12)
    dropped = {i for s, m, p in found for i in range(s + p, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *longest, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped))


TEXTS = [None, "", " \n", "a", "a " * 11, "a " * 12, "x a b a b a b a b a b a b y", "é ü " * 9, "a\tb\nc\x0bd\x0ce\rf " * 4, "\x1c \x85 " * 8, "　" * 20, "0 1 2 3 4 5 6 7 " * 40 + "z"]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_columns_on_small_texts(spark, docs, tmp_path):
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, "a " * 12), (1, "a " * 12), (None, "b " * 30), (None, None)]
    rows += [(100 + i, " ".join(rng.choice("abcdefgh"[: 2 + i % 7]) for _ in range(rng.randrange(80)))) for i in range(300)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_word_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert rows_of(got) == sorted((expected(*r) for r in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 20


def test_operator_returns_runs_and_texts(docs):
    r = word_runs.periodic_runs(docs([(7, "x " + "a b " * 6 + "y")])).first()
    assert (r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (7, 14, [(1, 12, 2)], "x a b y")
    assert word_runs.periodic_runs(docs([])).count() == 0


def test_long_text(docs):
    text = " ".join(str(i % 50_000) for i in range(200_000))
    r = word_runs.periodic_runs(docs([(7, text)])).first()
    assert [tuple(x) for x in r.runs] == [(0, 200_000, 50_000)] and r.collapsed == text[: text.index(" 0 ")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_query_on_the_tables(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = [(r.doc_id, r.text) for r in rows if len(r.text or "") < 6_000]
    got = {r[0]: r for r in rows_of(queries.op12_word_runs(spark, SF))}
    assert len(got) == len(rows) and all(got[i] == expected(i, t) for i, t in short)

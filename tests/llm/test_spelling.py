"""Tries and automata against edit distances, and the query against its contract written out plainly."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm import queries, spelling

SF = "/root/testdata/sf0.001"
RUNS = re.compile("[A-Za-zÀ-ÿ]+")
COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, shortest=6, fewest=5):
    n = Counter()
    for doc_id, text in rows:
        for run in RUNS.findall(text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if doc_id is not None and h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= fewest}


def brute(n):
    """Pairs by what is left of a word without one letter, then by the distance itself."""
    found = defaultdict(set)
    for w in n:
        for key in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            found[key].add(w)
    near = {w: {v for key in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))} for v in found[key] if one_edit(v, w)} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abÀÿ", min_size=1, max_size=7), max_size=40), st.text("abÀÿ", max_size=7))
def test_automaton_accepts_what_one_edit_gives(words, other):
    words = sorted(w.encode("latin-1") for w in words)
    trie = spelling.Trie.read(*spelling.Trie.of(words, list(range(1, len(words) + 1))).columns())
    for q in [*words, other.encode("latin-1")]:
        found = [trie.word(v) for v in trie.near(q)]
        assert len(set(found)) == len(found) and sorted(found) == [w for w in words if w != q and one_edit(w, q)]
        assert all(words[trie.counts[v] - 1] == trie.word(v) for v in trie.near(q))


def some_rows(rng):
    base = ["kitten", "mitten", "bitten", "kittens", "sitting", "Àbcdef", "àbcdef", "straße×x", "zzzzzz", "zzzzzzz", "zzzzz"]
    rows = []
    for i in range(400):
        words = rng.choices(base[: 3 + i % 9], [40, 3, 9, 1, 1, 20, 1, 1, 9, 1, 1][: 3 + i % 9], k=rng.randrange(30))
        if i % 3 == 0:
            words = [w.upper() if w.isascii() else w for w in words]
        rows.append((i, rng.choice([" ", ", ", "1", "\n", "ā", "\U0001f600"]).join(words)))
    return rows


def test_query_on_small_texts(spark, docs, tmp_path):
    rows = some_rows(random.Random(3))
    rows += [(5, None), (6, ""), (None, "kitten kitten mitten"), (None, None), (5, rows[5][1]), (5, rows[5][1]), (900, "ab" * 40_000 + " x"), *[(901 + i, "ab" * 700) for i in range(6)]]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of(queries.op11_spelling_variants(spark, str(tmp_path)))
    assert got == brute(counted(rows)) and any(r[3] for r in got) and len(got) > 10


def test_chains_ties_and_several_groups_of_shards(spark, monkeypatch):
    """Counts that grow five-fold along a chain of 9 words; equal counts; shards of three words, two to a group at most."""
    n = {"a" * (6 + i): 5**i for i in range(1, 10)} | {"bbbbbb": 7, "bbbbbc": 35, "bbbbba": 35, "cccccc": 9, "cccccd": 44}
    n |= {f"word{chr(97 + i)}{chr(97 + j)}": 5 + 31 * i * j for i in range(9) for j in range(9)}
    monkeypatch.setattr(spelling, "SHARD_WORDS", 3)
    monkeypatch.setattr(spelling, "GROUP_BYTES", 2_000)
    got = rows_of(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == brute(n)
    by = {r[0]: r for r in got}
    assert by["a" * 7][5] == "a" * 15 and by["bbbbbb"][3] == "bbbbba" and by["cccccc"][3] is None


def test_counts_spill_and_thresholds(docs, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 10)
    rows = some_rows(random.Random(4))
    for shortest, fewest in ((6, 5), (1, 1), (7, 50)):
        got = {r.word: r.n for r in spelling.count_words(docs(rows), shortest, fewest, spelling.planted_typo).collect()}
        assert got == counted(rows, shortest, fewest)
    assert {r.word: r.n for r in spelling.count_words(docs([(1, "A a B")]), 1, 1).collect()} == {"a": 2, "b": 1}


def test_empty(docs):
    assert rows_of(spelling.variants(spelling.count_words(docs([])))) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_query_on_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(counted(rows))
    assert rows_of(queries.op11_spelling_variants(spark, SF)) == want and any(r[3] for r in want)

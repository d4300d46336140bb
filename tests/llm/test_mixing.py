import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm import many_sources, mixing


def by_quotients(weights, seats, most):
    q = sorted(((-w / (2 * k + 1), i) for i, (w, m) in enumerate(zip(weights, most, strict=True)) if w > 0 for k in range(m)))[:seats]
    return [sum(i == j for _, j in q) for i in range(len(weights))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1000), st.integers(0, 30)), min_size=1, max_size=8), st.integers(0, 120))
def test_highest_quotients(pairs, seats):
    weights, most = [w for w, _ in pairs], [m for _, m in pairs]
    got, want = mixing.sainte_lague(weights, seats, most), by_quotients(weights, seats, most)
    assert sum(got) == sum(want)
    # Equal quotients may fall either way at the last seat when floats tie.
    quotient = lambda s: sorted(w / (2 * k + 1) for w, n in zip(weights, s, strict=True) for k in range(n))
    assert quotient(got) == pytest.approx(quotient(want))


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    # The first stops at 3 times its size; the rest goes to the others by weight.
    assert mixing.targets([10, 100, 190], [5, 2, 1]) == pytest.approx([30, 180, 90])
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0, 0]


def test_mix(docs):
    rows = [(i, "w " * (i % 50), "en", f"s{i % 7}") for i in range(400)] + [(1000 + i, "x y z", "en", None) for i in range(20)]
    rows += [(2000, None, "en", "s0"), (2001, " \n", "en", "s1"), (2002, "v " * 30_000, "en", "s2"), (2003, "a b", "en", "s3"), (2003, "a b", "en", "s3")]
    out = mixing.mix_sources(docs(rows)).collect()
    assert len(out) == len(rows)
    names = [*(f"s{i}" for i in range(7)), None]
    size = {n: sum(len((r[1] or "").split()) for r in rows if r[3] == n) for n in names}
    goal = dict(zip(names, mixing.targets([size[n] for n in names], [5, 2, 1, 5, 2, 1, 5, 2]), strict=True))
    for n in names:
        own = [r for r in out if r["source"] == n]
        assert all(r["source_size"] == size[n] and r["target"] == pytest.approx(goal[n]) for r in own)
        assert sum(r["size"] for r in own) == size[n]
        assert abs(sum(r["taken"] for r in own) - goal[n]) <= max(40, 0.02 * goal[n])
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    again = mixing.mix_sources(docs(rows).repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_empty(docs):
    assert mixing.mix_sources(docs([])).collect() == []
    assert [r["taken"] for r in mixing.mix_sources(docs([(1, None)])).collect()] == [0]


def test_mixed_text(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a b\tc", 3, 7), ("a b c", 3, 2), ("a b c", 3, 3)], "text string, size long, taken long")
    assert [r["t"] for r in df.select(mixing.mixed_text(F.col("text"), F.col("size"), F.col("taken")).alias("t")).collect()] == ["a b\tc\na b\tc\na", "a b", "a b c"]


def taken_words(words, taken, spans):
    copies = (taken - sum(e - s for s, e in spans)) // max(1, len(words))
    return words * copies + [w for s, e in spans for w in words[s:e]]


@pytest.mark.parametrize("quota", [0, 4, 9, 13, 26, 31])
def test_spans_are_the_chosen_blocks(quota):
    sizes = [0, 100, 7, 0, 250, 1, 58, 0]
    pdf = pd.DataFrame({"doc_id": range(len(sizes)), "src": 0, "size": sizes, "ord": range(len(sizes)), "shard": 2, "blocks": 13, "quota": quota, "seed": 5})
    out = mixing._take(pdf)
    # Word by word: which document it is of, and how often its block is repeated.
    chosen = set(np.random.default_rng([5, 2]).permutation(13)[: quota % 13].tolist())
    edges = [i * sum(sizes) // 13 for i in range(14)]
    block_of = [next(b for b in range(13) if edges[b] <= p < edges[b + 1]) for p in range(sum(sizes))]
    at = 0
    for r in out.itertuples():
        spans = list(zip(r.start, r.end, strict=True))
        want = sorted(w for w in range(r.size) for _ in range(quota // 13 + (block_of[at + w] in chosen)))
        assert sorted(taken_words(list(range(r.size)), r.taken, spans)) == want
        assert all(0 <= s < e <= r.size for s, e in spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
        at += r.size


def test_mixed_text_of_spans(docs):
    from pyspark.sql import functions as F

    rows = [(i, " ".join(f"d{i}w{j}" for j in range(1 + i * 13 % 400)), "en", f"s{i % 3}") for i in range(90)]
    frame = docs(rows)
    out = {r["doc_id"]: r for r in mixing.mix_sources(frame).collect()}
    mixed = frame.drop("size", "taken").join(mixing.mix_sources(frame).drop("source"), "doc_id")
    text = {r["doc_id"]: r["t"] for r in mixed.select("doc_id", mixing.mixed_text(F.col("text"), F.col("size"), F.col("taken"), F.col("spans")).alias("t")).collect()}
    for i, t, _, _ in rows:
        assert text[i].split() == taken_words(t.split(), out[i]["taken"], out[i]["spans"])
        assert len(text[i].split()) == out[i]["taken"]
    part = [r for r in out.values() if 0 < r["taken"] < r["size"]]
    assert any(s["end"] == r["size"] for r in part for s in r["spans"]) and any(r["spans"][0]["start"] > 0 for r in part)


@pytest.mark.parametrize("case", range(4))
def test_seats_by_frame(spark, case):
    rng = np.random.default_rng(case)
    n = [1, 5, 40, 200][case]
    w = [float(x) for x in (rng.integers(0, 9, n) if case % 2 else rng.random(n) * rng.integers(0, 2, n) * 50)]
    most = [int(x) for x in rng.integers(0, 20, n)]
    frame = spark.createDataFrame([(i, a, m) for i, (a, m) in enumerate(zip(w, most, strict=True))], "no int, w double, most long")
    for wanted in (0, 3 * n, 100 * n):
        got = {r["no"]: r["seats"] for r in many_sources.seats(frame, wanted).collect()}
        assert [got[i] for i in range(n)] == by_quotients(w, wanted, most)


def test_targets_by_frame(spark):
    sizes = [10, 100, 190, 0, 7, 5000, 1, 1, 30, 12]
    names = ["b", "a", "\U00010000", "\uffff", "", "z", "zz", "Z", "\u00e9", None]
    rows = many_sources.numbered(spark.createDataFrame(list(zip(names, sizes, strict=True)), "name string, size long"), "name", (5, 2, 1))
    got = sorted((r["no"], r["name"], r["target"]) for r in many_sources.targets(rows, 3).collect())
    order = sorted(range(10), key=lambda i: (names[i] is None, (names[i] or "").encode()))
    assert [g[1] for g in got] == [names[i] for i in order]
    assert [g[2] for g in got] == mixing.targets([sizes[i] for i in order], [5, 2, 1, 5, 2, 1, 5, 2, 1, 5], 3)


def test_many_sources_give_the_same(docs):
    rows = [(i, "w " * (i % 70), "en", f"s{i % 90}" if i % 3 else "hot") for i in range(900)] + [(5000 + i, "x y z", "en", None) for i in range(9)]
    rows += [(6000, None, "en", "only-null"), (6001, None, "en", None), (None, "no id", "en", "s1"), (7, "again " * 3000, "en", "s7")]
    few, many = (mixing.mix_sources(docs(rows), block_words=8, shard_words=500, max_sources=m, keep=["key", "size"]).collect() for m in (1000, 3))
    assert sorted(map(repr, few)) == sorted(map(repr, many)) and len(few) == len(rows)


def test_many_sources_of_nothing(docs):
    assert mixing.mix_sources(docs([]), max_sources=0).collect() == []
    assert [r["taken"] for r in mixing.mix_sources(docs([(1, None)]), max_sources=0).collect()] == [0]

import random
import zlib

import numpy as np
import pytest

from lamina.llm import quality_fm as q


def make(rng, good):
    words = ["".join(rng.choice(("an", "er", "the", "ion")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
    return " ".join(words) + "." if good else " ".join(w + "%%%" for w in words)


def table(n=400):
    rng = random.Random(1)
    return [(i, make(rng, i % 4 != 0)) for i in range(n)]


def test_held_out_accuracy(spark, docs):
    rows = table()
    labels = spark.createDataFrame([(i, int(i % 4 != 0), None) for i, _ in rows] + [(1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    d = docs([*rows, (900, None), (901, ""), (902, "x " * 50_000)])
    got = {r["doc_id"]: r for r in q.score(d, q.learn(d, labels)).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in held) for i, _ in rows)
    assert sum(got[i]["predicted"] == int(i % 4 != 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values()) and len(got) == len(rows) + 3


def test_held_out_labels_are_not_used(spark, docs):
    d = docs(table(60))
    make_ = lambda flip: spark.createDataFrame([(i, int((i % 4 != 0) != (flip and zlib.crc32(str(i).encode()) % 4 == 2))) for i in range(60)], "doc_id long, quality int")
    a, b = q.learn(d, make_(False)), q.learn(d, make_(True))
    assert a.bias == b.bias and np.array_equal(a.factor, b.factor)


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    m = q.Machine(0.3, rng.normal(size=q.DIMENSIONS), rng.normal(0, 0.3, (q.DIMENSIONS, q.RANK)))
    text = "Some words, and some more words | here!"
    at, n = q.features(text)
    x = q.values(len(at), n)
    z = m.bias + sum(x[i] * m.weight[a] for i, a in enumerate(at))
    z += sum(m.factor[at[i]] @ m.factor[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i + 1, len(at)))
    assert m.score(text) == pytest.approx(1 / (1 + np.exp(-z)))


def test_without_both_labels(spark, docs):
    d = docs([(1, "a"), (3, "b"), (4, None)])
    for rows, want in (([], 0.5), ([(1, 1), (3, 1)], 0.999)):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        assert [r["score"] for r in q.score(d, q.learn(d, labels)).collect()] == pytest.approx([want] * 3, abs=1e-3)
    assert q.score(docs([]), q.fit([])).collect() == []

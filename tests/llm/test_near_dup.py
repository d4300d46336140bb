import random
from itertools import combinations

import pytest

from lamina.llm import near_dup, shingles


def shingle_set(text, width=5):
    fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        fold = fold.replace(c, " ")
    w = [x for x in fold.split(" ") if x]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, percent=85):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return sorted((i, len(s), root(i), i == root(i)) for i, s in sets)


def got(df):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
        out.append(" ".join(w))
    return out


def test_matches_brute_force(docs):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [text(rng.choice((1, 3, 5, 6, 40, 200))) for _ in range(150)]
    for size, n, edits in ((120, 8, 1), (300, 30, 6), (200, 60, 5), (60, 5, 1)):
        texts += family(rng, text(size), n, edits)
    texts += [None, "", " \n\t", "one", "one", "One", "ONE two", "one two", "É é", "é é", "a b c d e", "a b c d e f", "x" * 50_000, texts[0], texts[0].upper()]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 10))
    assert got(near_dup.near_duplicates(docs(rows))) == brute(rows)


def test_blocks_settle_what_stars_leave_open(docs, monkeypatch):
    """Small blocks and no drawn centres: the pairwise step has to find the links of a large group on its own."""
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "ROUNDS", 0)
    rng = random.Random(9)
    rows = list(enumerate(family(rng, " ".join(f"w{i}" for i in range(260)), 90, 8)))
    assert got(near_dup.near_duplicates(docs(rows))) == brute(rows)


def test_chain_of_copies(docs):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:i * 2] + [f"x{j}" for j in range(i * 2, 200)])) for i in range(40)]
    assert got(near_dup.near_duplicates(docs(rows))) == brute(rows)


def test_empty_and_repeated(docs):
    assert near_dup.near_duplicates(docs([])).collect() == []
    rows = [(5, "a b c"), (5, "a b c"), (3, None), (3, None)]
    assert got(near_dup.near_duplicates(docs(rows))) == [(3, 0, 3, True)] * 2 + [(5, 1, 5, True)] * 2


def test_shuffled_texts_when_too_many_to_broadcast(docs, monkeypatch):
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", 0)
    rng = random.Random(2)
    rows = list(enumerate(family(rng, " ".join(f"w{i}" for i in range(150)), 20, 3)))
    assert got(near_dup.near_duplicates(docs(rows))) == brute(rows)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 - i, 99 - i) for i in range(15)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(500, 501 + i) for i in range(30)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    df = spark.createDataFrame([(a, b) for a, b in edges if a != b], "a long, b long")
    assert {r["id"]: r["comp"] for r in near_dup.components(df).collect()} == {v: root(v) for a, b in edges if a != b for v in (a, b)}


@pytest.mark.parametrize("text", ["A b C d E f g", "a  b\tc\nd e", "é É", "x", "", " ", "a b c d", "w " * 300, "ab " * 7 + "c"])
def test_shingle_counts(text):
    assert len(shingles.shingle_sets([text.encode()])[0]) == len(shingle_set(text))


def test_shingles_do_not_depend_on_neighbours():
    texts = [f"t{i} the same words in every text {i % 3}".encode() for i in range(50)]
    alone = [shingles.shingle_sets([t])[0].tolist() for t in texts]
    assert [s.tolist() for s in shingles.shingle_sets(texts)] == alone


def test_pruning_keeps_what_it_must():
    limits = dict(near_dup.least_matches())
    assert all(limits[n] <= 0.85 * n - 3 * (0.85 * 0.15 * n) ** 0.5 for n in limits) and limits[128] > 128 * 0.65


def brute_rows(rows, percent=85):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {n: n for n in range(len(sets))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (n, (_, a)), (m, (_, b)) in combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((root(n), root(m)))
            parent[y] = x
    name = {}
    for n, (i, _) in enumerate(sets):
        r = root(n)
        name[r] = min((x for x in (i, name.get(r)) if x is not None), default=None)
    return sorted(((i, len(s), name[root(n)], i == name[root(n)]) for n, (i, s) in enumerate(sets)), key=str)


def got_rows(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def test_null_and_shared_ids_lose_no_link(docs):
    rng = random.Random(6)
    base = [" ".join(f"{k}w{i}" for i in range(120)) for k in "abcd"]
    texts = [t for b in base for t in family(rng, b, 6, 2)] + ["one text", "two texts", None, "", "one text"]
    rows = [(rng.choice((None, 1, 1, 2, 9, 30 + n)), t) for n, t in enumerate(texts)]
    rows += [(1, base[0]), (1, "no kin at all of anything else here"), (9, base[0] + " end"), (None, base[3]), (None, base[3] + " end"), (None, "alone without an id")]
    assert got_rows(near_dup.near_duplicates(docs(rows))) == brute_rows(rows)


def test_blocks_are_bounded_by_bytes(docs, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 4_000)
    monkeypatch.setattr(near_dup, "ROUNDS", 0)
    rng = random.Random(3)
    rows = list(enumerate(family(rng, " ".join(f"w{i}" for i in range(260)), 60, 8)))
    assert got_rows(near_dup.near_duplicates(docs(rows))) == brute_rows(rows)


def test_components_of_a_hub(spark):
    star = spark.range(1, 200_001).selectExpr("0L AS a", "id AS b")
    label = near_dup.components(star)
    assert label.count() == 200_001 and label.where("comp <> 0").count() == 0

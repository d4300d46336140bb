"""Alignment by k-means++ on TF-IDF vectors: of segments across the documents of a docset, or of single sentences.

The distance is 1 - v.u / (sqrt(sum v) sqrt(sum u)) where the product is positive, else 1: square roots of sums, not of sums of
squares. Where a sum isn't positive (TF-IDF can be negative) the distance is 1. Distances are compared in `PLACES` places.

Seeds are drawn with a probability in proportion to the squared distance from those that are there, by a race: each piece draws a number from a
hash of its name, and the one with the least -ln(u) / distance² wins. So results depend on names and contents only, and the same seeds
come out of both forms: `cluster`, one task for a docset, and `cluster_frames`, joins and aggregates for docsets of any size, with one round of
jobs for each seed and each change of centres. `align` takes the second for docsets with more than `most` pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import bow
from lamina.session import materialize, scope

#: The distance is no metric and means aren't its minima, so labels may come round again; then the last of so many rounds counts.
ITERATIONS = 100
PLACES = 9
#: Pieces of a docset that one task clusters.
MOST = 50_000
PIECE = ["docset", "doc_id", "start"]
#: In a race: of pieces at no distance from a seed, and of seeds.
LAST, NEVER = 1e300, 2e300


class Points:
    """Sparse rows: `value` at the places (`row`, `at`) of a table of n rows and `width` columns, in the order of the rows."""

    def __init__(self, n: int, width: int, row: np.ndarray, at: np.ndarray, value: np.ndarray):
        self.n, self.width, self.row, self.at, self.value = n, width, row, at, value
        self.sum = np.bincount(self.row, self.value, self.n)
        self.begin = np.searchsorted(self.row, np.arange(n + 1))

    @classmethod
    def of(cls, rows: list[dict[str, float]]) -> Points:
        terms = {t: i for i, t in enumerate(sorted({t for r in rows for t in r}))}
        at, value = np.array([terms[t] for r in rows for t in r], int), np.array([v for r in rows for v in r.values()], float)
        return cls(len(rows), len(terms), np.repeat(np.arange(len(rows)), [len(r) for r in rows]), at, value)

    def distances(self, centre: np.ndarray) -> np.ndarray:
        dot = np.bincount(self.row, self.value * centre[self.at], self.n)
        total = centre.sum()
        ok = (dot > 0) & (self.sum > 0) & (total > 0)
        out = np.ones(self.n)
        out[ok] = np.round(1 - dot[ok] / np.sqrt(self.sum[ok] * total), PLACES)
        return out

    def mean(self, members: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(members)
        if 4 * len(some) <= self.n:  # a few pieces: their stretches of the table
            inside = np.concatenate([np.arange(a, b) for a, b in zip(self.begin[some].tolist(), self.begin[some + 1].tolist(), strict=True)]) if len(some) else some
        else:
            inside = members[self.row]
        return np.bincount(self.at[inside], self.value[inside], self.width) / max(1, int(members.sum()))


def draw(seed: int, number: int, name: str) -> float:
    """A number in (0, 1) for the race for seed `number`."""
    return (int(hashlib.md5(f"{seed}/{number}/{name}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32


def cluster(rows: list[dict[str, float]], k: int, seed: int, names: list[str] | None = None, iterations: int = ITERATIONS) -> np.ndarray:
    """A cluster for each row: seeds, then assignment to the nearest centre (the lowest of equals) and means, until nothing moves.
    Clusters that lose all their rows take the rows farthest from their own centres, the first of equals."""
    return cluster_points(Points.of(rows), k, seed, names, iterations)


def cluster_points(points: Points, k: int, seed: int, names: list[str] | None = None, iterations: int = ITERATIONS) -> np.ndarray:
    """`cluster` of points."""
    if not points.n:
        return np.zeros(0, int)
    names = names or [str(i) for i in range(points.n)]
    k, near, chosen = max(1, min(k, points.n)), np.ones(points.n), []
    while len(chosen) < k:
        weight = np.maximum(near, 0) ** 2
        luck = -np.log([draw(seed, len(chosen), name) for name in names])
        score = np.where(weight > 0, luck / np.where(weight > 0, weight, 1), LAST)
        score[chosen] = NEVER
        chosen.append(int(score.argmin()))
        near = np.minimum(near, points.distances(points.mean(np.arange(points.n) == chosen[-1])))
    label = np.full(points.n, -1)
    label[chosen] = np.arange(k)
    d, moved = np.empty((k, points.n)), range(k)
    for _ in range(iterations):
        for j in moved:  # other clusters are as they were, and so are the distances from their centres
            d[j] = points.distances(points.mean(label == j))
        new = d.argmin(0)
        own = d[new, np.arange(points.n)]
        for j in np.flatnonzero(np.bincount(new, minlength=k) == 0):
            far = int(own.argmax())
            own[far], new[far] = -np.inf, j
        changed = new != label
        if not changed.any():
            break
        moved = sorted({*label[changed].tolist(), *new[changed].tolist()} - {-1})
        label = new
    return label


def _distance(dot: Column, a: Column, b: Column) -> Column:
    ok = (dot > 0) & (a > 0) & (b > 0)
    return F.when(ok, F.round(1 - dot / F.sqrt(a * b), PLACES)).otherwise(1.0)


def _to_centres(vectors: DataFrame, totals: DataFrame, centres: DataFrame) -> DataFrame:
    """(PIECE, label, d): the distances of pieces from the centres (docset, label, term, c) that share a term with them."""
    of = centres.groupBy("docset", "label").agg(F.sum("c").alias("total"))
    dots = vectors.join(centres, ["docset", "term"]).groupBy(*PIECE, "label").agg(F.sum(F.col("v") * F.col("c")).alias("dot"))
    return dots.join(totals, PIECE).join(of, ["docset", "label"]).select(*PIECE, "label", _distance(F.col("dot"), F.col("s"), F.col("total")).alias("d"))


def _seeds(points: DataFrame, vectors: DataFrame, totals: DataFrame, k: DataFrame, seed: int) -> DataFrame:
    """(PIECE, label): label is the number of the seed, null of other pieces."""
    most = k.agg(F.max("k")).first()[0] or 0
    state = points.select(*PIECE, F.lit(1.0).alias("near"), F.lit(None).cast("int").alias("label"))
    for number in range(most):
        name = F.concat_ws("/", F.lit(f"{seed}/{number}"), *PIECE)
        u = (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") + 0.5) / 2**32
        score = F.when(F.col("label").isNotNull(), NEVER).when(F.col("near") > 0, -F.log(u) / (F.col("near") * F.col("near"))).otherwise(LAST)
        first = state.join(k.where(F.col("k") > number).select("docset"), "docset", "left_semi").groupBy("docset").agg(F.min(F.struct(score.alias("score"), "doc_id", "start")).alias("x"))
        pick = materialize(first.select("docset", "x.doc_id", "x.start", F.lit(number).alias("number")), "pick")
        centres = vectors.join(pick, PIECE).select("docset", F.col("number").alias("label"), "term", F.col("v").alias("c"))
        d = _to_centres(vectors, totals, centres).drop("label")
        # Pieces without a common term are at distance 1, which changes nothing.
        state = state.join(pick, PIECE, "left").join(d, PIECE, "left").select(*PIECE, F.least("near", F.coalesce("d", F.lit(1.0))).alias("near"), F.coalesce("label", "number").alias("label"))
        state = materialize(state, "near")
    return state.drop("near")


def _assigned(labels: DataFrame, vectors: DataFrame, totals: DataFrame, k: DataFrame) -> DataFrame:
    """(PIECE, label, before, d): the nearest centre of `labels` (PIECE, label), the lowest of equals, and the label so far."""
    sizes = labels.where("label IS NOT NULL").groupBy("docset", "label").agg(F.count(F.lit(1)).alias("m"))
    members = vectors.join(labels.where("label IS NOT NULL"), PIECE)
    centres = members.groupBy("docset", "label", "term").agg(F.sum("v").alias("c")).join(sizes, ["docset", "label"]).select("docset", "label", "term", (F.col("c") / F.col("m")).alias("c"))
    best = _to_centres(vectors, totals, centres).groupBy(*PIECE).agg(F.min(F.struct("d", "label")).alias("best"))
    near = F.col("best.d") < 1  # else all centres are at distance 1
    new = labels.withColumnRenamed("label", "before").join(best, PIECE, "left")
    new = new.select(*PIECE, F.when(near, F.col("best.label")).otherwise(0).alias("label"), "before", F.when(near, F.col("best.d")).otherwise(1.0).alias("d"))
    new = materialize(new, "assigned")
    every = k.select("docset", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("label"))
    empty = every.join(new, ["docset", "label"], "left_anti")
    lost = empty.groupBy("docset").count().agg(F.max("count")).first()[0]
    if not lost:
        return new
    takes = empty.select("docset", F.col("label").alias("takes"), F.row_number().over(Window.partitionBy("docset").orderBy("label")).alias("r"))
    far = F.row_number().over(Window.partitionBy("docset").orderBy(F.desc("d"), "doc_id", "start"))
    taken = new.join(takes.select("docset").distinct(), "docset", "left_semi").select(*PIECE, far.alias("r")).where(F.col("r") <= lost).join(takes, ["docset", "r"]).drop("r")
    return materialize(new.join(taken, PIECE, "left").select(*PIECE, F.coalesce("takes", "label").alias("label"), "before", "d"), "assigned")


def cluster_frames(points: DataFrame, vectors: DataFrame, k: DataFrame, seed: int, iterations: int = ITERATIONS) -> DataFrame:
    """`cluster` of each docset: (PIECE, label) for `points` (PIECE), `vectors` (PIECE, term, v) and `k` (docset, k), k from 1 to the
    number of pieces. Tables are written after each round; nothing but their greatest k and counts of changes comes to the driver."""
    with scope(points.sparkSession):
        vectors, k, points = materialize(vectors, "vectors"), materialize(k, "k"), materialize(points.select(*PIECE), "points")
        totals = materialize(vectors.groupBy(*PIECE).agg(F.sum("v").alias("s")), "totals")
        labels = _seeds(points, vectors, totals, k, seed)
        for _ in range(iterations):
            new = _assigned(labels, vectors, totals, k)
            labels = new.select(*PIECE, "label")
            if not new.where(~F.col("label").eqNullSafe(F.col("before"))).take(1):
                break
        return materialize(labels, "clusters", outer=1)


Words = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]


def _named(words: pa.Table) -> Words:
    """A docset's words (doc_id, pos, term, tfidf) as document, place, number of the term and weight, and how many terms there are."""
    terms = words.column("term").combine_chunks().dictionary_encode()
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    rank = np.empty(len(terms.dictionary), np.int64)
    rank[pc.sort_indices(terms.dictionary).to_numpy()] = np.arange(len(rank))
    return words.column("doc_id").to_numpy(), words.column("pos").to_numpy(), rank[terms.indices.to_numpy()], words.column("tfidf").to_numpy(), len(rank)


def _weighed(docs: pa.Table) -> Words:
    """`_named` of a docset's counted documents (doc_id, filled, pos, term, cnt, size), terms as numbers: with their TF-IDF, as in `bow.tf_idf_counted`."""
    pos, term, cnt, size = (docs.column(c).combine_chunks() for c in ("pos", "term", "cnt", "size"))
    of = np.repeat(docs.column("doc_id").to_numpy(), pos.value_lengths().to_numpy(zero_copy_only=False))
    pos, term, cnt, size = (x.flatten().to_numpy(zero_copy_only=False) for x in (pos, term, cnt, size))
    df, sentences = np.bincount(term), docs.column("filled").to_numpy().sum()
    return of, pos, term, cnt / size * np.log(sentences / (1.0 + df))[term] if len(term) else np.zeros(0), len(df)


def _summed(words: Words, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The places (row, term) of the vectors of a docset's pieces, which are in order, with the sums there of the weights of `words`, and how many
    terms there are."""
    of, pos, at, value, width = words
    docs = np.unique(doc)
    number = np.searchsorted(docs, of)
    known = (number < len(docs)) & (docs[np.minimum(number, len(docs) - 1)] == of)
    # Pieces by (document, start), as one number.
    wide = int(max(pos.max(initial=0), end.max(initial=0))) + 1
    place = np.searchsorted(np.searchsorted(docs, doc) * wide + start, number * wide + pos, "right") - 1
    near = np.maximum(place, 0)
    inside = known & (place >= 0) & (doc[near] == of) & (pos < end[near])
    row, at, value, pos = place[inside], at[inside], value[inside], pos[inside]
    order = np.lexsort((pos, at, row))
    row, at, value = row[order], at[order], value[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1])]) if len(row) else np.zeros(0, int)
    return row[first], at[first], np.add.reduceat(value, first) if len(row) else value, width


def align(pieces: DataFrame, vectors: DataFrame, k: DataFrame, seed: int = 1, most: int = MOST, iterations: int = ITERATIONS) -> DataFrame:
    """`pieces` (docset, doc_id, start, end) with `label`. `vectors` is (docset, doc_id, pos, term, tfidf); a piece is the sum of
    its sentences. `k` (docset, k) is the number of clusters, at most the number of pieces. Clusters of one member become local:
    -(number + 1)."""
    vectors = vectors.select("docset", F.col("doc_id").cast("long").alias("doc_id"), "pos", "term", "tfidf")
    return _aligned(pieces, vectors, _named, lambda: vectors, k, seed, most, iterations)


def align_counted(pieces: DataFrame, counted: DataFrame, k: DataFrame, seed: int = 1, most: int = MOST, iterations: int = ITERATIONS) -> DataFrame:
    """`align` by the TF-IDF of documents counted by line (see `bow.counted`): a row a document goes to its docset's task, terms as numbers, and
    weights are made there."""
    field = lambda c, name: F.col(f"words.{c}").alias(name)
    docs = counted.select("docset", F.col("doc_id").cast("long").alias("doc_id"), "filled", field("unit", "pos"), field("id", "term"), field("cnt", "cnt"), field("size", "size"))
    return _aligned(pieces, docs, _weighed, lambda: bow.tf_idf_counted(counted, "term_id"), k, seed, most, iterations)


def _aligned(pieces: DataFrame, vectors: DataFrame, read: Callable[[pa.Table], Words], long: Callable[[], DataFrame], k: DataFrame, seed: int, most: int, iterations: int) -> DataFrame:
    """`align` of words by docset that a task reads with `read`, and that are `long` (docset, doc_id, pos, term, tfidf) for large docsets."""
    p = materialize(pieces.select("docset", F.col("doc_id").cast("long").alias("doc_id"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")), "pieces")
    n = p.groupBy("docset").agg(F.count(F.lit(1)).alias("n"))
    k = n.join(k, "docset").select("docset", "n", F.greatest(F.lit(1), F.least("k", "n")).cast("int").alias("k"))

    def run(words: pa.Table, own: pa.Table) -> pa.Table:
        own = own.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        doc, start, end = (own.column(c).to_numpy() for c in ("doc_id", "start", "end"))
        if not len(doc):
            return own.select(["docset", "doc_id", "start", "end"]).append_column("label", pa.array([], pa.int32()))
        row, at, value, width = _summed(read(words), doc, start, end)
        docset = own.column("docset")[0].as_py()
        names = [f"{docset}/{d}/{b}" for d, b in zip(doc.tolist(), start.tolist(), strict=True)]
        label = cluster_points(Points(len(doc), width, row, at, value), own.column("k")[0].as_py(), seed, names, iterations)
        return own.select(["docset", "doc_id", "start", "end"]).append_column("label", pa.array(label.astype(np.int32)))

    large = k.where(F.col("n") > most).drop("n")
    some, words, rows = bool(large.take(1)), vectors, p.join(k.where(F.col("n") <= most).drop("n"), "docset")
    if some:
        words = words.join(large.select("docset"), "docset", "left_anti")
    # Words that are by docset already stay where they are; the pieces go to them.
    out = words.groupBy("docset").cogroup(rows.groupBy("docset")).applyInArrow(run, "docset string, doc_id long, start int, end int, label int")
    if some:
        of = lambda df: df.join(large.select("docset"), "docset", "left_semi")
        v = of(long()).join(of(p), ["docset", "doc_id"]).where("pos >= start AND pos < end").groupBy(*PIECE, "term").agg(F.sum("tfidf").alias("v"))
        out = out.unionByName(p.join(cluster_frames(of(p), v, large, seed, iterations), PIECE).select("docset", "doc_id", "start", "end", "label"))
    out = materialize(out, "clusters")
    single = out.groupBy("docset", "label").agg(F.count(F.lit(1)).alias("m"))
    local = F.when(F.col("m") == 1, -(F.col("label") + 1)).otherwise(F.col("label"))
    return out.join(single, ["docset", "label"]).select("docset", "doc_id", "start", "end", local.alias("label"))

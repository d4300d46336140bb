"""Segmentation of single documents by dynamic programming over Dirichlet-multinomial scores, one task row-group per document."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import spread


def rising_table(a: float, most: int) -> np.ndarray:
    """lgamma(a + c) - lgamma(a) for c = 0 .. most."""
    return np.concatenate(([0.0], np.cumsum(np.log(a + np.arange(most))))) if most > 0 else np.zeros(1)


def score_columns(sentences: list[dict[int, int]], w: int, beta: float) -> Iterator[np.ndarray]:
    """For e = 1 .. n: the log-likelihoods of sentences s .. e - 1 as one segment, for s = 0 .. e - 1.

    A term's count from s up to now falls by steps as s passes the sentences that have the term, so a new occurrence changes the
    scores of whole ranges of starts: memory is that of the occurrences, not of terms times sentences.
    """
    words = [sum(s.values()) for s in sentences]
    total = sum(words)
    up_table, all_table = rising_table(beta, total), rising_table(beta * w, total)
    up, size = np.zeros(len(sentences)), np.zeros(len(sentences), np.int64)
    where: dict = {}  # term: sentences that have it, and its count before each of them and in all
    for e, s in enumerate(sentences):
        change = np.zeros(e + 1)  # of the score, between a start and the one before
        ones, most = [], 0.0
        for t, c in s.items():
            got = where.get(t)
            if got is None:
                where[t] = [[e], [0, c]]
                ones.append(c)
                continue
            at, before = np.array(got[0]), np.array(got[1])
            left = before[-1] - before  # from after none, one, two, .. of the occurrences
            gain = up_table[left + c] - up_table[left]
            most += gain[0]
            change[at + 1] += np.diff(gain)
            got[0].append(e)
            got[1].append(got[1][-1] + c)
        change[0] += most + sum(up_table[c] for c in ones)
        up[: e + 1] += np.cumsum(change)
        size[: e + 1] += words[e]
        yield up[: e + 1] - all_table[size[: e + 1]]


#: Sentences of a document whose scores are held as one matrix; those of longer documents come column by column.
MATRIX = 1_500
#: Pairs of occurrences that are looked at together.
PAIRS = 1 << 21


def score_rows(pos: np.ndarray, term: np.ndarray, cnt: np.ndarray, n: int, w: int, beta: float) -> np.ndarray:
    """rows[e - 1, s]: `score_columns` of one document at once, of occurrences in the order of (term, pos).

    With a word's occurrences i <= j, G(i, j) is what j adds to segments that begin at i or between i and the one before, so
    G(i, j) - G(i + 1, j) is what begins at i; summed from the right over starts and from above over ends these are all scores.
    """
    at = np.arange(len(pos))
    begin = np.r_[True, term[1:] != term[:-1]] if len(pos) else np.zeros(0, bool)
    first = at[begin][np.cumsum(begin) - 1]
    before = np.cumsum(cnt) - cnt
    words = np.bincount(pos, cnt, n).astype(np.int64)
    total = int(words.sum())
    up, out = rising_table(beta, total), np.zeros(n * n)
    pairs = at - first + 1
    upto = np.cumsum(pairs)
    start = 0
    while start < len(pos):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
        many = pairs[start:stop]
        j = np.repeat(at[start:stop], many)
        i = np.arange(len(j)) - np.repeat(np.cumsum(many) - many, many) + first[j]
        left = before[j] - before[i]
        gain = up[left + cnt[j]] - up[left]
        gain[:-1] -= np.where(i[:-1] < j[:-1], gain[1:], 0.0)
        out += np.bincount(pos[j] * n + pos[i], gain, n * n)
        start = stop
    out = out.reshape(n, n).cumsum(0)[:, ::-1].cumsum(1)[:, ::-1]
    ends = np.cumsum(words)
    size = ends[:, None] - (ends - words)[None, :]
    return out - rising_table(beta * w, total)[np.maximum(size, 0)]


def segment_counts(pos: np.ndarray, term: np.ndarray, cnt: np.ndarray, ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segment and count of each term of each segment of a document, and the segments' words; occurrences are in the order of (term, pos)."""
    seg = np.searchsorted(ends, pos, "right")
    begin = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (seg[1:] != seg[:-1])]) if len(pos) else np.zeros(0, int)
    counts = np.add.reduceat(cnt, begin) if len(pos) else cnt
    return seg[begin], counts, np.bincount(seg, cnt, len(ends)).astype(np.int64)


def segment_scores(pos: np.ndarray, term: np.ndarray, cnt: np.ndarray, ends: list[int], w: int, beta: float, table: np.ndarray) -> np.ndarray:
    """`lgamma_score` of each segment of a document; occurrences are in the order of (term, pos), `table` is `lgamma_table`."""
    seg, counts, words = segment_counts(pos, term, cnt, ends)
    whole = np.array([math.lgamma(beta * w) - math.lgamma(beta * w + m) for m in words.tolist()])
    return whole + np.bincount(seg, table[counts], len(ends))


def lgamma_table(beta: float, most: int) -> np.ndarray:
    """lgamma(c + beta) - lgamma(beta) for c = 0 .. most."""
    low = math.lgamma(beta)
    return np.array([math.lgamma(c + beta) - low for c in range(most + 1)])


def score_matrix(sentences: list[dict[int, int]], w: int, beta: float) -> np.ndarray:
    """score[s, e]: log-likelihood of sentences s .. e - 1 as one segment; minus infinity for e <= s. For small documents and checks."""
    n = len(sentences)
    out = np.full((n + 1, n + 1), -np.inf)
    for e, column in enumerate(score_columns(sentences, w, beta), start=1):
        out[:e, e] = column
    return out


def cut(score: np.ndarray, k: int | None) -> list[int]:
    """`cut_columns` of a score matrix."""
    n = len(score) - 1
    return cut_columns((score[:e, e] for e in range(1, n + 1)), n, k)


def _shown(value: np.ndarray) -> np.ndarray:
    """Scores as they are compared: what differs by rounding only is a tie."""
    return np.round(value, 6)


#: Cells of the table of best scores that are looked at together.
CELLS = 1 << 20


def cut_columns(columns: Iterable[np.ndarray], n: int, k: int | None) -> list[int]:
    """Ends of the segments of the best segmentation, into exactly k (the latest of equal cuts) or as many as score best (the
    earliest of equals). Scores that agree in 6 places are equal.

    Columns are used as they come. What is kept is one score for each sentence, or, with k, k scores and places for each.
    """
    if n == 0:
        return []
    if k is None:
        best, back = np.zeros(n + 1), np.zeros(n + 1, np.int32)
        for e, score in enumerate(columns, start=1):
            value = best[:e] + score
            back[e] = int(_shown(value).argmax())
            best[e] = value[back[e]]
        ends, e = [], n
        while e:
            ends.append(e)
            e = int(back[e])
        return ends[::-1]
    k = max(1, min(k, n))
    best, back = np.full((k + 1, n + 1), -np.inf), np.zeros((k + 1, n + 1), np.int32)  # by segments used and end
    best[0, 0] = 0.0
    for e, score in enumerate(columns, start=1):
        # Into j segments by e, with sentences enough for the others.
        low, high, step = max(1, k - (n - e)), min(k, e), max(1, CELLS // e)
        for j in range(low, high + 1, step):
            some = np.arange(j, min(j + step, high + 1))
            value = best[some - 1, :e] + score
            at = e - 1 - _shown(value[:, ::-1]).argmax(1)
            best[some, e], back[some, e] = value[np.arange(len(some)), at], at
    ends, e = [], n
    for j in range(k, 0, -1):
        ends.append(e)
        e = int(back[j, e])
    return ends[::-1]


def segment(lines: DataFrame, bow: DataFrame, sizes: DataFrame, vocab: DataFrame, k=None, beta: float = 0.1) -> DataFrame:
    """(docset, doc_id, seg, start, end, logp) for each document of `sizes` (docset, doc_id, n), cut into the column `k`
    of segments, or, where it is None, into as many as score best. `vocab` is (docset, w)."""
    return segment_sized(sizes.join(bow, ["docset", "doc_id"], "left"), vocab, k, beta, deal=True)


def segment_sized(words: DataFrame, vocab: DataFrame, k=None, beta: float = 0.1, deal: bool = False) -> DataFrame:
    """`segment` of counts beside the lines of their document (see `bow.sized_counts`). With `deal` documents are dealt anew; counts that are
    by docset already need no exchange."""
    found = F.collect_list(F.when(F.col("term").isNotNull(), F.struct(F.col("pos"), F.col("term"), F.col("cnt").cast("long").alias("cnt"))))
    want = F.max(k if k is not None else F.lit(0)).cast("long").alias("k")
    docs = words.groupBy("docset", "doc_id").agg(F.max("n").cast("long").alias("n"), want, found.alias("words")).join(vocab, "docset")
    docs = docs.select("docset", F.col("doc_id").cast("long").alias("doc_id"), "n", F.col("w").cast("long").alias("w"), "k", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lgamma_table(beta, 64)
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch.column(5)
            rows, words = found.value_lengths().to_numpy(zero_copy_only=False), found.flatten()
            terms = words.field(1).dictionary_encode()
            rank = np.empty(len(terms.dictionary), np.int64)
            rank[pc.sort_indices(terms.dictionary).to_numpy()] = np.arange(len(rank))
            pos, cnt = (words.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 2))
            term, doc = rank[terms.indices.to_numpy(zero_copy_only=False)], np.repeat(np.arange(len(rows)), rows)
            order = np.lexsort((pos, term, doc))
            pos, cnt, term = pos[order], cnt[order], term[order]
            n, w, k = (batch.column(i).to_numpy().tolist() for i in (2, 3, 4))
            most = int(np.bincount(doc, cnt).max(initial=0))
            if most >= len(table):
                table = lgamma_table(beta, 2 * most)
            ends, scores = [], []
            for own, (p, t, c) in _cuts(rows, pos, term, cnt, n, w, k, beta):
                scores.append(segment_scores(p, t, c, own, w[len(ends)], beta, table))
                ends.append(own)
            yield _pieces(batch, ends, scores)

    dealt = spread(docs, "docset", "doc_id") if deal else docs
    return dealt.mapInArrow(run, "docset string, doc_id long, seg int, start int, end int, logp double")


def _cuts(rows: np.ndarray, pos: np.ndarray, term: np.ndarray, cnt: np.ndarray, n: list[int], w: list[int], k: list[int], beta: float) -> Iterator[tuple[list[int], tuple]]:
    """Of each document the ends of its best segments and its occurrences, of which it has so many as `rows` says, in the order of (term, pos)."""
    at = 0
    for i, many in enumerate(rows.tolist()):
        p, t, c = (x[at : at + many] for x in (pos, term, cnt))
        at += many
        if n[i] == 1 or k[i] == 1:
            yield [n[i]], (p, t, c)
            continue
        if n[i] <= MATRIX:
            by_end = score_rows(p, t, c, n[i], w[i], beta)
            columns = (by_end[e - 1, :e] for e in range(1, n[i] + 1))
        else:
            sentences: list[dict] = [{} for _ in range(n[i])]
            for x, y, z in zip(p.tolist(), t.tolist(), c.tolist(), strict=True):
                sentences[x][y] = z
            columns = score_columns(sentences, w[i], beta)
        yield cut_columns(columns, n[i], k[i] or None), (p, t, c)


def _pieces(batch: pa.RecordBatch, ends: list[list[int]], scores: list[np.ndarray]) -> pa.RecordBatch:
    """(docset, doc_id, seg, start, end, logp) of the segments of a batch of documents, which begins with docset and doc_id."""
    of = np.repeat(np.arange(len(ends)), [len(e) for e in ends])
    seg = np.concatenate([np.arange(len(e)) for e in ends])
    end = np.concatenate([np.array(e, np.int64) for e in ends])
    start = np.where(seg > 0, np.r_[0, end[:-1]], 0)
    made = [pa.array(x.astype(np.int32)) for x in (seg, start, end)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), *made, pa.array(np.concatenate(scores))], ["docset", "doc_id", "seg", "start", "end", "logp"])


def _as_arrays(counted: DataFrame, vocab: DataFrame, k) -> DataFrame:
    """(docset, doc_id, n, w, k, pos, term, cnt) of documents counted by line (see `bow.counted`): a row a document, terms as ids."""
    long = lambda c: F.col(c).cast("long")
    want = (k if k is not None else F.lit(0)).cast("long").alias("k")
    return counted.join(vocab, "docset").select("docset", "doc_id", long("n").alias("n"), long("w").alias("w"), want, F.col("words.unit").alias("pos"), F.col("words.id").alias("term"), F.col("words.cnt").alias("cnt"))


def _cut_batch(batch: pa.RecordBatch, beta: float) -> tuple[list[int], Iterator[tuple[list[int], tuple]]]:
    """The documents' w and `_cuts` of a batch of `_as_arrays`."""
    n, w, k = (batch.column(i).to_numpy().tolist() for i in (2, 3, 4))
    rows = batch.column(5).value_lengths().to_numpy(zero_copy_only=False)
    pos, term, cnt = (batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (5, 6, 7))
    order = np.lexsort((pos, term, np.repeat(np.arange(len(rows)), rows)))
    return w, _cuts(rows, pos[order], term[order], cnt[order], n, w, k, beta)


def segment_counted(counted: DataFrame, vocab: DataFrame, k=None, beta: float = 0.1) -> DataFrame:
    """`segment` of documents counted by line, which stay as they are: words are neither parted nor collected, and terms are numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lgamma_table(beta, 64)
        for batch in batches:
            if batch.num_rows:
                ends, scores = [], []
                of, cuts = _cut_batch(batch, beta)
                for w, (own, (p, t, c)) in zip(of, cuts, strict=True):
                    if (most := int(c.sum())) >= len(table):
                        table = lgamma_table(beta, 2 * most)
                    ends.append(own)
                    scores.append(segment_scores(p, t, c, own, w, beta, table))
                yield _pieces(batch, ends, scores)

    return _as_arrays(counted, vocab, k).mapInArrow(run, "docset string, doc_id long, seg int, start int, end int, logp double")


def tallied_segments(counted: DataFrame, vocab: DataFrame, k=None, beta: float = 0.1) -> DataFrame:
    """(w, c, m) of the segments of `segment_counted`, which aren't made: with w = 1, how many terms of segments have the count c; with m < 0, how many
    segments of docsets of w terms have c words; with w = 0, how many segments there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            of, cuts = _cut_batch(batch, beta)
            for w, (own, (p, t, c)) in zip(of, cuts, strict=True):
                _, counts, words = segment_counts(p, t, c, own)
                found.update({(1, x, 1): m for x, m in zip(*(y.tolist() for y in np.unique(counts, return_counts=True)), strict=True)})
                found.update([(w, x, -1) for x in words.tolist() if x])
                found[0, 0, 1] += len(own)
        rows = [(w, c, sign * m) for (w, c, sign), m in found.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["w", "c", "m"])

    rows = _as_arrays(counted, vocab, k).mapInArrow(run, "w long, c long, m long")
    return rows.groupBy("w", "c", (F.col("m") > 0).alias("terms")).agg(F.sum("m").alias("m")).drop("terms")


def lgamma_score(counts: dict, w: int, beta: float) -> float:
    """The score of one segment straight from its formula."""
    n = sum(counts.values())
    return math.lgamma(beta * w) - math.lgamma(beta * w + n) + sum(math.lgamma(c + beta) - math.lgamma(beta) for c in counts.values())

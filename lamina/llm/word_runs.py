"""Periodic runs of words: maximal stretches of a text that repeat with a period, found in linear time by comparing words alone.

After Ellert and Fischer (2021): every run holds a root that is the longest Lyndon word at its start under the order of words or under
its reverse, so it shows as an edge from a suffix to its next smaller suffix. Both orders' edges are found in one pass over the words each,
with a stack. Where two suffixes begin alike, how far they agree is read off earlier matches: the match that reaches furthest right says that
what lies ahead is a copy of what was compared before (`_Reach`), and only words beyond that reach are compared anew. Matches to the left of
edges are reused in the same way. Words are compared for order and equality only: no suffix array, no hash, no numbering of words.

Defined edge cases: null and empty texts and texts without words have no runs; rows with null or shared ids and repeated rows are looked at
one by one; an empty table gives an empty result; other columns are ignored, whatever their names. A text is held by its task as a list of
words with six numbers each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORTEST = 12
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _extend(w: Sequence, a: int, b: int, k: int) -> int:
    """How many words from a and from b on (a < b) are alike, of which k are known to be: one by one, then in growing blocks."""
    n = len(w) - b
    for _ in range(8):
        if k >= n or w[a + k] != w[b + k]:
            return k
        k += 1
    step = 8
    while k + step <= n and w[a + k : a + k + step] == w[b + k : b + k + step]:
        k += step
        step *= 2
    while step > 1:
        step //= 2
        if k + step <= n and w[a + k : a + k + step] == w[b + k : b + k + step]:
            k += step
    return k


class _Reach:
    """The match that reaches furthest: w[a + x] == w[b + x] for all x with b + x < end. What is compared beyond `end` is new."""

    def __init__(self, w: Sequence, next_smaller: list[int], next_match: list[int], last_smaller: list[int], last_match: list[int]):
        self.w, self.a, self.b, self.end = w, 0, 0, 0
        self.next_smaller, self.next_match, self.last_smaller, self.last_match = next_smaller, next_match, last_smaller, last_match

    def known(self, a: int, b: int) -> int:
        """The match of a pair that was compared before, else -1."""
        if a > b:
            a, b = b, a
        if self.next_smaller[a] == b:
            return self.next_match[a]
        return self.last_match[b] if self.last_smaller[b] == a else -1

    def match(self, a: int, b: int) -> int:
        """How many words from a and from b on are alike; b never falls from call to call."""
        k = 1
        if b < self.end:
            # From b on, up to `end`, stands what stands `shift` before.
            shift, room = self.b - self.a, self.end - b
            copy = b - shift
            k = room if copy == a else self.known(a, copy)
            if k < 0 and a >= self.b:
                k = self.known(a - shift, copy)
            if 0 <= k < room:
                return k
            k = room if k >= 0 else 1
        k = _extend(self.w, a, b, k)
        if b + k > self.end:
            self.a, self.b, self.end = a, b, b + k
        return k


def _edges(w: Sequence, up: bool) -> tuple[list[int], list[int], list[int]]:
    """For the order of words (`up`) or its reverse: the next smaller suffix of each position (0: none), how far both agree, and the
    positions whose edge may belong to a run, as the words before or after it repeat."""
    n = len(w)
    next_smaller, next_match, last_smaller, last_match = [0] * n, [0] * n, [-1] * n, [0] * n
    reach = _Reach(w, next_smaller, next_match, last_smaller, last_match)
    may, open_ = [], []
    for i in range(n):
        x = w[i]
        while open_:
            j = open_[-1]
            y = w[j]
            k = 0
            if y != x:
                if (y < x) is up:
                    last_smaller[i] = j
                    break
            else:
                k = reach.match(j, i)
                if i + k < n and (w[j + k] < w[i + k]) is up:
                    last_smaller[i], last_match[i] = j, k
                    break
                next_match[j] = k
            open_.pop()
            next_smaller[j] = i
            if k >= i - j or (j and w[j - 1] == w[i - 1]):
                may.append(j)
        open_.append(i)
    return next_smaller, next_match, may


def _extend_left(w: Sequence, a: int, b: int, k: int) -> int:
    while k < a and w[a - 1 - k] == w[b - 1 - k]:
        k += 1
    return k


def _left(w: Sequence, next_smaller: list[int], may: list[int]) -> Iterator[tuple[int, int]]:
    """Each of `may`, from the last to the first, with how many words before it and before its next smaller suffix are alike. Matches
    are reused as in `_Reach`, mirrored; edges outside `may` with a reused match have none."""
    matched = [0] * len(w)
    start, end, shift = 0, -1, 0  # w[x] == w[x + shift] for start <= x < end
    for a in sorted(may, reverse=True):
        b, k = next_smaller[a], 0
        if start < a <= end:
            room, copy = a - start, a + shift
            if copy == b:
                k = room
            elif copy < b and next_smaller[copy] == b:
                k = matched[copy]
            elif b <= end and next_smaller[copy] == b + shift:
                k = matched[copy]
            else:
                room = 0
            if k < room:
                matched[a] = k
                yield a, k
                continue
            k = room
        k = matched[a] = _extend_left(w, a, b, k)
        if end < 0 or a - k < start:
            start, end, shift = a - k, a, b - a
        yield a, k


def runs(words: Sequence, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of `words` with length >= max(shortest, 2 * period), by start, then period."""
    found = []
    for up in (True, False):
        next_smaller, next_match, may = _edges(words, up)
        for a, left in _left(words, next_smaller, may):
            period = next_smaller[a] - a
            length = left + period + next_match[a]
            if left < period and length >= 2 * period and length >= shortest:  # else another edge is its first root
                found.append((a - left, length, period))
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def collapse(words: list, found: list[tuple[int, int, int]]) -> list:
    """`words` without those that a run repeats: of each run its first period stays, unless another run drops that too."""
    if not found:
        return words
    kept = bytearray(b"\x01") * len(words)
    for start, length, period in found:
        kept[start + period : start + length] = bytes(length - period)
    return [w for w, k in zip(words, kept, strict=True) if k]


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """For each row of `docs` (doc_id, text) the runs of its words and its text without repeats, words joined by one space."""

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in found:
            sizes, rows, texts = [], [], []
            for text in batch.column("text").cast(pa.binary()):
                words = (text.as_py() or b"").split()
                of = runs(words, shortest)
                sizes.append(len(words))
                rows.append([{"start": s, "length": n, "period": p} for s, n, p in of])
                texts.append(b" ".join(collapse(words, of)))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(rows, kind), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, SCHEMA)


def repeated_tail(text: Column, doc_id: Column) -> Column:
    """The query's own change of its texts: with h the crc32 of the decimal doc_id, where h % 10 = 0 the n words from number a = h div 10 % n
    on become a repetition of the first p = 1 + (n - a) div (3 + h div 10 % 8) of them; words are then joined by one space."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        return F.transform(
            F.array(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).cast("int").alias("p"))),
            lambda x: F.array_join(F.transform(words, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, x["a"] + (i - x["a"]) % x["p"]))), " "),
        )[0]

    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(text))[0]
    return F.when(h % 10 == 0, changed).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """The runs of `periodic_runs` as counts, the longest run (the first, then that of the smallest period, of equals) and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.back"), F.col("best.length"), -F.col("best.less")
    exponent = F.floor(1000 * length / period).cast("long")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

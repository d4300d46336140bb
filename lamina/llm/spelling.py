"""Spelling variants: words of all texts that differ in one letter, and for each the much more frequent word that it is a variant of.

Words with at least `shortest` letters and `fewest` occurrences are cut by ranges of their order into shards of bounded size, each kept as a
compact trie: one node for each branching, with the letters on its edge. Shards are broadcast in groups of at most `GROUP_BYTES`, one job a
group, whatever their number. There, each word's Levenshtein automaton for distance one walks through every shard depth-first. Accepted words are reduced at once to their number and the best form. The form of a
word is its neighbour of largest count (the smallest by code points of equals) if that is at least `times` its own; a root is what forms
lead to in the end, found by doubling. Forms grow at least `times`-fold, so chains are short and can't come back.

Letters are A-Z, a-z and U+00C0 to U+00FF, one byte each in Latin-1, whose order is that of code points.

Defined edge cases: null and empty texts have no words; rows with null or shared ids and repeated rows count one by one; an empty table
gives an empty result; other columns are ignored, whatever their names. Words are of any length.
"""

from __future__ import annotations

import array
import functools
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import materialize, partitions, scope

#: A shard has at most so many words and, but for its last word, so many letters.
SHARD_WORDS, SHARD_LETTERS = 1 << 16, 1 << 21
#: Tries that are broadcast at once; a single shard is less but for words of millions of letters.
GROUP_BYTES = 32 << 20
#: Words that a task looks up in a group of shards, about.
TASK_WORDS = 20_000
#: Distinct words that a task holds while it counts.
HELD = 200_000

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """The maximal runs of letters in Latin-1, only A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def planted_typo(doc_id: int | None) -> Callable[[bytes], bytes]:
    """The query's own change of its texts: with h the crc32 of `<doc_id>:<word>`, where 199 divides h, the letter h % length goes."""
    if doc_id is None:
        return lambda word: word
    before = zlib.crc32(f"{doc_id}:".encode())

    def change(word: bytes) -> bytes:
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), before)
        if h % 199:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1 :]

    return change


def count_words(docs: DataFrame, shortest: int = 6, fewest: int = 5, change: Callable[[int | None], Callable[[bytes], bytes]] | None = None) -> DataFrame:
    """(word, n) of all words of `docs` (doc_id, text) with at least `shortest` letters and `fewest` occurrences. `change` gives for a
    doc_id what to make of a word. Tasks count before anything is shuffled."""

    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in held], pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in found:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = Counter(w for w in words_of(text.as_py() or "") if len(w) >= shortest)
                if change is None:
                    held.update(own)
                else:
                    made = change(doc_id)
                    for word, n in own.items():
                        word = made(word)
                        if len(word) >= shortest:
                            held[word] += n
                if len(held) >= HELD:
                    yield out(held)
                    held = Counter()
        yield out(held)

    partial = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


@dataclass
class Trie:
    """Nodes by number, a node's children side by side: those of v are first[v] .. first[v + 1] - 1, in the order of `letters`, the first
    letter of each node's edge; the edge's letters are labels[ends[v]:ends[v + 1]]; counts[v] is 0 where no word ends."""

    letters: bytes
    first: array.array
    ends: array.array
    labels: bytes
    counts: array.array

    SCHEMA = "letters binary, first binary, ends binary, labels binary, counts binary"

    @classmethod
    def of(cls, words: list[bytes], counts: list[int]) -> Trie:
        """Of distinct words in order."""
        letters, labels, first, ends, own = bytearray(b"\0"), bytearray(), array.array("I"), array.array("I", [0, 0]), array.array("q")
        todo = [(0, len(words), 0)]
        for low, high, depth in todo:  # grows as it is walked: breadth first, so children are side by side
            first.append(len(todo))
            ends_here = low < high and len(words[low]) == depth
            own.append(counts[low] if ends_here else 0)
            low += ends_here
            while low < high:
                letter, cut = words[low][depth], low + 1
                while cut < high and words[cut][depth] == letter:
                    cut += 1
                a, b = words[low], words[cut - 1]
                to = depth + 1
                while to < len(a) and to < len(b) and a[to] == b[to]:
                    to += 1
                todo.append((low, cut, to))
                letters.append(letter)
                labels += a[depth:to]
                ends.append(len(labels))
                low = cut
        first.append(len(todo))
        return cls(bytes(letters), first, ends, bytes(labels), own)

    def columns(self) -> tuple[bytes, ...]:
        return self.letters, self.first.tobytes(), self.ends.tobytes(), self.labels, self.counts.tobytes()

    @classmethod
    def read(cls, letters: bytes, first: bytes, ends: bytes, labels: bytes, counts: bytes) -> Trie:
        return cls(bytes(letters), array.array("I", bytes(first)), array.array("I", bytes(ends)), bytes(labels), array.array("q", bytes(counts)))

    def word(self, v: int) -> bytes:
        """The word that ends at a node: the edges up to the root."""
        first = np.frombuffer(self.first, np.uint32)
        parts = []
        while v:
            parts.append(self.labels[self.ends[v] : self.ends[v + 1]])
            v = int(np.searchsorted(first, v, "right")) - 1  # the last node whose children begin at v or before
        return b"".join(reversed(parts))

    def near(self, word: bytes) -> list[int]:
        """The nodes of all words that differ from `word` by exactly one inserted, deleted or replaced letter.

        The automaton's states are places in the word, before and after the edit. Before it, the walk follows the word itself; each edge
        that leaves it spends the edit, as an inserted, a replaced or, where the letter after next fits, a deleted letter; from there on
        only what is left of the word is followed. Edits within a row of equal letters are made at its end, so each is met once.
        """
        letters, first, ends, labels, counts = self.letters, self.first, self.ends, self.labels, self.counts
        n, q, found = len(word), word + b"\0\0\0", []

        def rest(c: int, at: int, i: int) -> None:
            """From place `at` of the labels, on the edge of c, after the edit: letters i and on of the word."""
            while True:
                size = ends[c + 1] - at
                if size and labels[at : at + size] != q[i : i + size]:
                    return
                i += size
                if i == n:
                    if counts[c]:
                        found.append(c)
                    return
                c = letters.find(q[i], first[c], first[c + 1])
                if c < 0:
                    return
                at = ends[c] + 1
                i += 1

        def edited(c: int, at: int, x: int, d: int) -> None:
            """The letter x was read in place of letter d of the word."""
            rest(c, at, d)
            if d < n:
                rest(c, at, d + 1)
                if x == q[d + 1]:
                    rest(c, at, d + 2)

        v = d = 0
        while True:
            if d == n - 1 and counts[v]:
                found.append(v)
            here, after, way = q[d], q[d + 1], -1
            for c in range(first[v], first[v + 1]):
                x, at = letters[c], ends[c] + 1
                if x == here:
                    way = c
                elif d >= n - 2 or at < ends[c + 1] or x == after:
                    edited(c, at, x, d)
                else:
                    low, high = first[c], first[c + 1]
                    if (a := letters.find(here, low, high)) >= 0:
                        rest(a, ends[a] + 1, d + 1)
                    if (a := letters.find(after, low, high)) >= 0:
                        rest(a, ends[a] + 1, d + 2)
            if way < 0:
                return found
            v, d = way, d + 1
            for at in range(ends[v] + 1, ends[v + 1]):
                if labels[at] != q[d]:
                    edited(v, at + 1, labels[at], d)
                    return found
                d += 1


def shards(words: DataFrame, rows: int) -> DataFrame:
    """The words as tries in ranges of their order: (shard, size, columns of `Trie`). `rows` is the number of words."""

    def build(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in Trie.SCHEMA.split(", ")]
        words, counts, letters = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in Trie.of(words, counts).columns()], names)

        for batch in found:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                words.append(word.encode("latin-1"))
                counts.append(n)
                letters += len(word)
                if len(words) >= SHARD_WORDS or letters >= SHARD_LETTERS:
                    yield out()
                    words, counts, letters = [], [], 0
        if words:
            yield out()

    ranges = words.repartitionByRange(max(1, -(-rows // SHARD_WORDS)), "word").sortWithinPartitions("word")
    sizes = sum((F.length(c) for c in ("letters", "first", "ends", "labels", "counts")), F.lit(0)).cast("long")
    return ranges.mapInArrow(build, Trie.SCHEMA).select(F.monotonically_increasing_id().alias("shard"), sizes.alias("size"), "*")


def near_words(words: DataFrame, rows: int) -> DataFrame:
    """(word, n, n_near, best struct<n, word>) of the words that have neighbours, for each group of shards on its own."""
    spark = words.sparkSession
    tries = materialize(shards(words, rows), "tries")
    sizes = sorted((r["shard"], r["size"]) for r in tries.select("shard", "size").collect())  # one row for 65,536 words
    groups: list[list[int]] = [[]]
    total = 0
    for shard, size in sizes:
        if groups[-1] and total + size > GROUP_BYTES:
            groups.append([])
            total = 0
        groups[-1].append(shard)
        total += size
    dealt = words.repartition(max(partitions(spark), 4 * spark.sparkContext.defaultParallelism, rows // TASK_WORDS))
    parts = []
    for group in filter(None, groups):
        between = F.col("shard").between(group[0], group[-1])
        sent = spark.sparkContext.broadcast([tuple(map(bytes, r)) for r in tries.where(between).select(*[f.split()[0] for f in Trie.SCHEMA.split(", ")]).collect()])

        def search(found: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = [Trie.read(*columns) for columns in sent.value]
            for batch in found:
                out = []
                for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    accepted = [(t.counts[v], t, v) for t in own for v in t.near(word.encode("latin-1"))]
                    if accepted:
                        most = max(a[0] for a in accepted)
                        out.append((word, n, len(accepted), most, min(t.word(v) for m, t, v in accepted if m == most).decode("latin-1")))
                columns = zip(*out, strict=True) if out else [[]] * 5
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["word", "n", "n_near", "most", "best"])

        found = dealt.mapInArrow(search, "word string, n long, n_near long, most long, best string")
        parts.append(materialize(found, "near"))
        sent.unpersist()
    every = functools.reduce(DataFrame.unionByName, parts, spark.createDataFrame([], "word string, n long, n_near long, most long, best string"))
    best = F.min(F.struct((-F.col("most")).alias("less"), F.col("best").alias("word")))
    return every.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for `forms` (word, form): where forms lead to, twice as far with each round."""
    far = materialize(forms.select("word", F.col("form").alias("root")), "root")
    while True:
        on = far.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not far.join(on, "root", "left_semi").take(1):
            return far
        far = materialize(far.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "root")


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for `words` (word, n), distinct words of letters."""
    with scope(words.sparkSession):
        words = materialize(words, "words")
        near = materialize(near_words(words, words.count()), "neighbours")
        form_n = -F.col("best.less")
        near = near.select("word", "n_near", F.when(form_n >= times * F.col("n"), F.struct(F.col("best.word").alias("form"), form_n.alias("form_n"))).alias("f"))
        near = near.select("word", "n_near", "f.form", "f.form_n")
        known = near.join(roots(near.where("form IS NOT NULL")), "word", "left")
        out = words.join(known, "word", "left")
        return materialize(out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")), "variants", outer=1)

"""Sentences, tokens, vocabularies and sparse word vectors in long form.

A docset is a bounded set of documents on one subject; a document is its ordered lines (sentences). Tables:

    lines  (docset, doc_id, pos, line)              pos from 0
    tokens (docset, doc_id, pos, tok_pos, term)
    bow    (docset, doc_id, pos, term, cnt)         cnt a long, or a double for weighted vectors
"""

from __future__ import annotations

from collections import Counter, defaultdict, deque
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import count, groupby, repeat
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import text as T
from lamina.session import materialize

#: Documents of one source are cut into docsets by ranges of so many ids, so a source of any size makes bounded docsets.
DOCSET_IDS = 1_000
KEYS = ["docset", "doc_id", "pos"]


def docset_of(source, doc_id) -> Column:
    return F.concat(F.coalesce(source, F.lit("")), F.lit("/"), F.floor(doc_id / DOCSET_IDS).cast("string"))


def lines(documents: DataFrame) -> DataFrame:
    """One row for each line of `documents` (doc_id, text, source); a closing line end begins no line, a null text has none. Rows
    without a doc_id are no documents of any docset and are left out."""
    return lines_of(by_docset(documents))


def by_docset(documents: DataFrame) -> DataFrame:
    """(docset, doc_id, text) of the documents that have a doc_id."""
    return documents.where("doc_id IS NOT NULL").select(docset_of(F.col("source"), F.col("doc_id")).alias("docset"), "doc_id", "text")


def _split(text: str) -> Column:
    return F.split(F.regexp_replace(text, r"\n\z", ""), "\n")


def lines_of(docs: DataFrame, *more: str) -> DataFrame:
    """`lines` of `by_docset`'s rows, and the columns `more` of these."""
    return docs.select("docset", "doc_id", *more, F.posexplode(_split("text")).alias("pos", "line"))


#: Bytes of the files of `documents` that a task of `dealt` gets.
DEALT = 8 << 20


def dealt(documents: DataFrame, parts: int) -> DataFrame:
    """`by_docset` with each docset in one of `parts` partitions: all that is by docset, or by docset and more, takes no other exchange.
    Texts are shuffled, once, instead of their words."""
    return by_docset(documents).repartition(parts, "docset")


#: Entries of a batch that `counted` hands on, where no single document has more.
ENTRIES = 1 << 18
_ENTRY = pa.struct([("unit", pa.int32()), ("id", pa.int32()), ("term", pa.string()), ("cnt", pa.int64()), ("size", pa.int64()), ("part", pa.float64()), ("upto", pa.int64()), ("all", pa.int64())])
_COUNTED = pa.schema([("docset", pa.string()), ("doc_id", pa.int64()), ("n", pa.int32()), ("known", pa.int32()), ("fresh", pa.int32()), ("filled", pa.int32()),
                      ("total", pa.int64()), ("parts", pa.float64()), ("words", pa.list_(_ENTRY))])
Place = Callable[[Column, Column], Column]


def counted(docs: DataFrame, stop: list[str] | None = None, unit: Place | None = None, weight: Place | None = None, running: bool = False, named: bool = True) -> DataFrame:
    """One row for each of `dealt` documents, so that words are neither shuffled nor grouped by Spark:

        docset, doc_id, n   n: lines
        known, fresh        terms of the docset in documents before this one, and terms that this one is the first to have
        filled, total       units with a word, words
        parts               sum of the words' weights, if there are any
        words               array of (unit, id, term, cnt, size, part, upto, all): the term's id in `vocabulary`, its count in the unit, words
                            of the unit, sum of the weights of the term's occurrences there, if there are any, and, if `running`, the
                            term's counts in units up to and including this one and in all of the document

    `unit` and `weight` give a line's unit and weight from the columns of its place and of the number of lines: by default each line is a unit
    without a weight. Lines of a null unit are left out. Unless `named`, term is null. What a task holds are the terms of one docset and the entries of one document.
    """
    return _placed(docs, unit, weight).mapInArrow(partial(_count, stop=frozenset([*(stop or []), ""]), running=running, named=named), """docset string, doc_id long, n int, known int, fresh int, filled int, total long, parts double,
        words array<struct<unit: int, id: int, term: string, cnt: long, size: long, part: double, upto: long, all: long>>""")


def _placed(docs: DataFrame, unit: Place | None, weight: Place | None) -> DataFrame:
    """Rows of `dealt` documents with text, in order, with their number of lines, how many rows share the doc_id, and the lines' units and weights."""
    own = Window.partitionBy("docset", "doc_id")
    rows = docs.where("text IS NOT NULL").withColumn("n", F.max(F.size(_split("text"))).over(own)).withColumn("copies", F.count(F.lit(1)).over(own))
    of = lambda f, kind: F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda pos: f(pos, F.col("n")).cast(kind))
    units = of(unit or (lambda pos, n: pos), "int").alias("units")
    weights = (of(weight, "double") if weight else F.lit(None).cast("array<double>")).alias("weights")
    return rows.select("docset", F.col("doc_id").cast("long").alias("doc_id"), "n", "copies", units, weights, "text").sortWithinPartitions("docset", "doc_id")


_TALLY = pa.struct([("unit", pa.int32()), ("cnt", pa.int64()), ("part", pa.float64()), ("upto", pa.int64()), ("all", pa.int64()), ("terms", pa.int64())])
_TALLIED = pa.schema([("docset", pa.string()), ("doc_id", pa.int64()), ("n", pa.int32()), ("fresh", pa.int32()), ("total", pa.int64()), ("parts", pa.float64()), ("words", pa.list_(_TALLY))])


def tallied(docs: DataFrame, stop: list[str] | None = None, unit: Place | None = None, weight: Place | None = None, running: bool = False) -> DataFrame:
    """`counted` for sums over terms that ask for numbers only: (docset, doc_id, n, w, total, parts, words), where `words` is an array of
    (unit, cnt, part, upto, all, terms): how many terms of the unit have this count, sum of weights and so on. Most terms of a document have
    the same few numbers, so this is a fraction of the counts. w is the number of the docset's terms, from a window over these small rows."""
    rows = _placed(docs, unit, weight).mapInArrow(partial(_tally, stop=frozenset([*(stop or []), ""]), running=running), """docset string, doc_id long, n int, fresh int, total long, parts double,
        words array<struct<unit: int, cnt: long, part: double, upto: long, all: long, terms: long>>""")
    return rows.withColumn("w", F.sum("fresh").over(Window.partitionBy("docset"))).drop("fresh")


def tallies(tallied_: DataFrame, unit: str, *more: str, places: bool = False) -> DataFrame:
    """The words of `tallied` documents: (docset, doc_id, n, w, more, `unit`, cnt, part, left, all, terms). With `places` there is also a
    row of zeros for each line, so that lines without words are there."""
    words = F.col("words")
    if places:
        zero = F.lit(0).cast("long")
        line = lambda pos: F.struct(pos.alias("unit"), zero.alias("cnt"), F.lit(None).cast("double").alias("part"), zero.alias("upto"), zero.alias("all"), zero.alias("terms"))
        words = F.concat(words, F.transform(F.sequence(F.lit(0), F.col("n") - 1), line))
    return tallied_.select("docset", "doc_id", "n", "w", *more, F.inline(words).alias(unit, "cnt", "part", "left", "all", "terms"))


_ENCODED = pa.schema([("docset", pa.string()), ("doc_id", pa.int64()), ("known", pa.int32()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("terms", pa.list_(pa.string()))])
_DECODED = pa.schema([("docset", pa.string()), ("doc_id", pa.int64()), ("total", pa.int64()), ("fresh", pa.int64())])


def encoded(docs: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """Vectors of whole `dealt` documents by ids, (docset, doc_id, known, ids, counts, terms): the ids of `vocabulary`, ascending, their counts, and
    what the document adds to its docset's dictionary: `terms` have the ids known, known + 1 and so on."""
    rows = _placed(docs, lambda pos, n: F.lit(0), None)
    return rows.mapInArrow(partial(_encode, stop=frozenset([*(stop or []), ""])), "docset string, doc_id long, known int, ids array<int>, counts array<long>, terms array<string>")


def _encode(batches: Iterable[pa.RecordBatch], stop: frozenset[str]) -> Iterator[pa.RecordBatch]:
    keys, lists, ends = [], ([], [], []), ([0], [0], [0])
    for key, _, known, ids, counts, _ in _documents(batches, stop):
        c = counts.get(0, {})
        own = list(map(ids.__getitem__, c))
        order, count_of, term_of = sorted(own), dict(zip(own, c.values(), strict=True)), dict(zip(own, c, strict=True))
        for values, at, x in zip(lists, ends, (order, map(count_of.__getitem__, order), map(term_of.__getitem__, range(known, len(ids)))), strict=True):
            values.extend(x)
            at.append(len(values))
        keys.append((*key, known))
        if len(lists[0]) >= ENTRIES:
            yield _vectors(keys, lists, ends)
            keys, lists, ends = [], ([], [], []), ([0], [0], [0])
    if keys:
        yield _vectors(keys, lists, ends)


def _vectors(keys: list[tuple], lists: tuple[list, ...], ends: tuple[list[int], ...]) -> pa.RecordBatch:
    made = [pa.array(c, f.type) for c, f in zip(zip(*keys, strict=True), _ENCODED, strict=False)]
    made += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, f.type.value_type)) for x, at, f in zip(lists, ends, list(_ENCODED)[3:], strict=True)]
    return pa.RecordBatch.from_arrays(made, schema=_ENCODED)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def decoded(encoded_: DataFrame) -> DataFrame:
    """(docset, doc_id, total, fresh) of `encoded` documents, in the order in which they were, read back by the dictionary that they carry: words,
    and terms that no document before has. A task holds the dictionary of one docset, as `encoded` does."""
    return encoded_.mapInArrow(_decode, "docset string, doc_id long, total long, fresh long")


def _decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docset, dictionary, seen = None, [], set()
    for batch in batches:
        out = []
        ids, counts, terms = (_slices(batch.column(i)) for i in (3, 4, 5))
        for name, doc_id, known in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if docset != name:
                docset, dictionary, seen = name, [], set()
            if known != len(dictionary):
                raise ValueError(f"documents of {name} aren't in the order in which they were encoded: {known} terms expected, {len(dictionary)} found")
            dictionary.extend(next(terms))
            before = len(seen)
            seen.update(map(dictionary.__getitem__, next(ids)))
            out.append((name, doc_id, sum(next(counts)), len(seen) - before))
        if out:
            yield _rows(out, _DECODED)


def _slices(lists: pa.ListArray) -> Iterator[list]:
    """The lists of a column, one after the other."""
    flat, at = lists.flatten().to_numpy(zero_copy_only=False).tolist(), 0
    for many in lists.value_lengths().to_pylist():
        yield flat[at : at + many]
        at += many


def _documents(batches: Iterable[pa.RecordBatch], stop: frozenset[str]) -> Iterator[tuple]:
    """Of each document: (docset, doc_id), n, known, the docset's ids by term, and counts and sums of weights by unit, in the units' order."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    docset, ids = None, _numbers()
    for key, own in groupby(rows, itemgetter(0, 1)):
        if docset != key[0]:
            docset, ids = key[0], _numbers()
        known = len(ids)
        n, counts, parts = _units(own, stop, ids)
        yield key, n, known, ids, dict(sorted(counts.items())), parts


def _count(batches: Iterable[pa.RecordBatch], stop: frozenset[str], running: bool = False, named: bool = True) -> Iterator[pa.RecordBatch]:
    documents, ends, words = [], [0], [[] for _ in _ENTRY]
    for key, n, known, ids, counts, parts in _documents(batches, stop):
        sizes = {u: c.total() for u, c in counts.items()}
        whole: dict[str, int] = {}
        for u, c in counts.items():
            upto = _upto(whole, c) if running else ()
            more = (repeat(u, len(c)), map(ids.__getitem__, c), c if named or running else (), c.values(), repeat(sizes[u], len(c)), parts[u].values() if parts else (), upto)
            for values, x in zip(words, more, strict=False):
                values.extend(x)
        if running:
            words[-1].extend(map(whole.__getitem__, words[2][ends[-1]:]))
        documents.append((*key, n, known, len(ids) - known, sum(map(bool, sizes.values())), sum(sizes.values()), _total(parts)))
        ends.append(len(words[0]))
        if ends[-1] >= ENTRIES:
            yield _batch(documents, ends, words)
            documents, ends, words = [], [0], [[] for _ in _ENTRY]
    if documents:
        yield _batch(documents, ends, words)


def _tally(batches: Iterable[pa.RecordBatch], stop: frozenset[str], running: bool = False) -> Iterator[pa.RecordBatch]:
    documents, ends, words = [], [0], [[] for _ in _TALLY]
    for key, n, known, ids, counts, parts in _documents(batches, stop):
        whole: dict[str, int] = {}
        seen = {u: _upto(whole, c) for u, c in counts.items()} if running else {}
        for u, c in counts.items():
            numbers = {"cnt": c.values()} | ({"part": parts[u].values()} if parts else {}) | ({"upto": seen[u], "all": map(whole.__getitem__, c)} if running else {})
            found = Counter(zip(*numbers.values()) if len(numbers) > 1 else c.values())  # noqa: B905
            columns = zip(*found) if len(numbers) > 1 else (found,)  # noqa: B905
            for name, x in (("unit", repeat(u, len(found))), *zip(numbers, columns), ("terms", found.values())):  # noqa: B905
                words[_TALLY.get_field_index(name)].extend(x)
        documents.append((*key, n, len(ids) - known, sum(c.total() for c in counts.values()), _total(parts)))
        ends.append(len(words[0]))
        if ends[-1] >= ENTRIES:
            yield _batch(documents, ends, words, _TALLIED)
            documents, ends, words = [], [0], [[] for _ in _TALLY]
    if documents:
        yield _batch(documents, ends, words, _TALLIED)


def _upto(whole: dict[str, int], unit: Counter) -> list[int]:
    """Adds a unit's counts to those of the document so far, and says what these are then, by the unit's terms."""
    for t, k in unit.items():
        whole[t] = whole.get(t, 0) + k
    return [whole[t] for t in unit]


def _total(parts: dict[int, dict[str, float]]) -> float | None:
    return sum(x for p in parts.values() for x in p.values()) if parts else None


def _numbers() -> defaultdict[str, int]:
    """Numbers each key from 0 when it is first looked up."""
    return defaultdict(count().__next__)


def _units(rows: Iterable[tuple], stop: frozenset[str], ids: defaultdict[str, int]) -> tuple[int, dict[int, Counter], dict[int, dict[str, float]]]:
    """The number of lines of the document that `rows` are of, the counts of its units and, if lines have weights, sums of these by the same
    keys in the same order. Numbers its new terms in `ids`, in the order of their first occurrence: line, place in it, term."""
    counts: dict[int, Counter] = {}
    parts: dict[int, dict[str, float]] = {}
    first: dict[str, tuple[int, int]] = {}
    n = 0
    for _, _, n, copies, units, weights, text in rows:
        lines = T.normalized(text)
        if copies > 1:  # rows that share a doc_id are one document: their lines of one place are one
            for pos, line in enumerate(lines):
                if units[pos] is not None:
                    for at, t in enumerate(filter(None, line.split(" "))):
                        if t not in ids and t not in stop:
                            first[t] = min(first.get(t, (pos, at)), (pos, at))
        for (u, w), run in groupby(zip(units, weights or repeat(1.0), lines), itemgetter(0, 1)):  # noqa: B905
            if u is None:
                continue
            c = Counter(" ".join([line for _, _, line in run]).split(" "))
            for t in stop:
                c.pop(t, None)
            if copies == 1:
                deque(map(ids.__getitem__, c), 0)
            if u in counts:
                counts[u].update(c)
            else:
                counts[u] = c.copy() if weights else c
            if weights:
                p = parts.setdefault(u, {})
                for t, k in c.items():
                    p[t] = p.get(t, 0.0) + k * w
    deque(map(ids.__getitem__, sorted(first, key=lambda t: (first[t], t))), 0)
    return n, counts, parts


def _batch(documents: list[tuple], ends: list[int], words: list[list], schema: pa.Schema = _COUNTED) -> pa.RecordBatch:
    kinds = list(schema.field("words").type.value_type)
    flat = [pa.array(x, f.type) if len(x) == ends[-1] else pa.nulls(ends[-1], f.type) for x, f in zip(words, kinds, strict=True)]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, fields=kinds))
    return pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(zip(*documents, strict=True), schema, strict=False)), lists], schema=schema)


def entries(counted_: DataFrame, unit: str = "pos", *more: str) -> DataFrame:
    """The words of `counted` documents, one row each: (docset, doc_id, n, more, `unit`, term_id, term, cnt, size, part, left, all)."""
    return counted_.select("docset", "doc_id", "n", *more, F.inline("words").alias(unit, "term_id", "term", "cnt", "size", "part", "left", "all"))


def sized(counted_: DataFrame) -> DataFrame:
    """(docset, doc_id, n, pos, term, cnt) of documents `counted` by line. A document also has a row with no pos, term or cnt, so that those
    without words are there."""
    none = F.array(F.struct(*(F.lit(v).cast(k).alias(c) for c, k, v in (("unit", "int", None), ("term", "string", None), ("cnt", "long", 0)))))
    words = F.transform("words", lambda x: F.struct(x["unit"].alias("unit"), x["term"].alias("term"), x["cnt"].alias("cnt")))
    return counted_.select("docset", "doc_id", "n", F.inline(F.concat(none, words)).alias("pos", "term", "cnt"))


def sized_counts(docs: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """(docset, doc_id, n, pos, term, cnt): `counts` of `dealt` documents beside the number of lines of the document: see `sized`."""
    return sized(counted(docs, stop))


def vocabulary_sizes(counted_: DataFrame) -> DataFrame:
    """(docset, w): distinct terms of each docset of `counted` documents, if it has one. Small beside what it is joined with, which needn't be
    sorted for that."""
    return counted_.groupBy("docset").agg(F.sum("fresh").alias("w")).where("w > 0").hint("shuffle_hash")


def line_counts(documents: DataFrame) -> DataFrame:
    """(docset, doc_id, n): how many lines `lines` makes of each document, without making them."""
    docs = by_docset(documents).where("text IS NOT NULL").select("docset", "doc_id", F.size(_split("text")).alias("n"))
    return docs.groupBy("docset", "doc_id").agg(F.max("n").alias("n"))


def tokens(lines_: DataFrame, tokenizer: bool = True, stop: list[str] | None = None) -> DataFrame:
    """Normalised tokens of lines, with their place among all of the line, without those of a short stop list."""
    made = F.split(F.trim(T.normalize(F.col("line"), tokenizer)), " +")
    rows = lines_.select(*KEYS, F.posexplode(made).alias("tok_pos", "term")).where("term <> ''")
    return rows.where(~F.col("term").isin(*stop)) if stop else rows


def without_stop_words(tokens_: DataFrame, stop: DataFrame) -> DataFrame:
    """`tokens_` whose term isn't in `stop` (term), a table of any size: Spark chooses the join by its size."""
    return tokens_.join(stop.select("term").distinct(), "term", "left_anti")


def vocabulary(tokens_: DataFrame, shared: bool = False) -> DataFrame:
    """(docset, term, term_id): ids in the order of first occurrence within the docset. With `shared`, one dictionary for all, of docset '*',
    in the order of the first occurrences' ids: see `numbered`."""
    scope = F.lit("*") if shared else F.col("docset")
    first = tokens_.withColumn("docset", scope).groupBy("docset", "term").agg(F.min(F.struct("doc_id", "pos", "tok_pos")).alias("first"))
    if shared:
        return numbered(first, "term_id", "first", "term").select("docset", "term", "term_id")
    rank = F.row_number().over(Window.partitionBy("docset").orderBy("first", "term")) - 1
    return first.select("docset", "term", rank.alias("term_id"))


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """`rows` with their number from 0 in an order that tells all of them apart, for tables of any size: sorted ranges are written, each
    row is numbered within its range, and the ranges' sizes, one row each, say where a range begins."""
    ranges = materialize(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["__range"], r["count"]) for r in ranges.groupBy("__range").count().collect())
    starts = [(k, sum(n for _, n in sizes[:i])) for i, (k, _) in enumerate(sizes)]
    begin = rows.sparkSession.createDataFrame(starts, "__range int, __begin long")
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranges.withColumn(name, within).join(F.broadcast(begin), "__range").withColumn(name, F.col(name) + F.col("__begin")).drop("__range", "__begin")


def encode(tokens_: DataFrame, vocab: DataFrame) -> DataFrame:
    return tokens_.join(vocab, ["docset", "term"]).drop("term")


def with_ids(tokens_: DataFrame, first: Column | None = None) -> DataFrame:
    """`encode` with `vocabulary`, the terms kept, by windows of docsets: of `dealt` documents it takes no exchange. `first` is a row's first
    occurrence, where rows aren't single tokens."""
    first = F.struct("doc_id", "pos", "tok_pos") if first is None else first
    rows = tokens_.withColumn("__first", F.min(first).over(Window.partitionBy("docset", "term")))
    return rows.withColumn("term_id", F.dense_rank().over(Window.partitionBy("docset").orderBy("__first", "term")) - 1).drop("__first")


def decode(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    return ids.join(vocab, ["docset", "term_id"]).drop("term_id")


def counts(tokens_: DataFrame, *keys: str) -> DataFrame:
    """The sparse vector of each group of `keys` (default: of each sentence)."""
    return tokens_.groupBy(*(keys or KEYS), "term").agg(F.count(F.lit(1)).alias("cnt"))


def add(left: DataFrame, right: DataFrame, sign: int = 1) -> DataFrame:
    """left + sign * right, by all columns but cnt. Entries that come to zero stay, as in an updated vector."""
    keys = [c for c in left.columns if c != "cnt"]
    both = left.unionByName(right.withColumn("cnt", F.col("cnt") * sign))
    return both.groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


def compact(vectors: DataFrame) -> DataFrame:
    """Without zero entries."""
    return vectors.where("cnt <> 0")


def reductions(vectors: DataFrame, *keys: str) -> DataFrame:
    """total (sum), size (entries, zeros included) and nonzero (entries above 0) of each vector."""
    above = F.count(F.when(F.col("cnt") > 0, 1))
    return vectors.groupBy(*keys).agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("size"), above.alias("nonzero"))


def as_map(vectors: DataFrame, key: str, *keys: str) -> DataFrame:
    """Each vector as a map `vec` from `key` to cnt, in key order."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key), F.col("cnt"))))
    return vectors.groupBy(*keys).agg(F.map_from_entries(entries).alias("vec"))


def ids_of(vec) -> Column:
    return F.map_keys(vec)


def values_of(vec) -> Column:
    return F.map_values(vec)


def positive_values_of(vec) -> Column:
    return F.filter(F.map_values(vec), lambda v: v > 0)


def value_at(vec, key) -> Column:
    return F.coalesce(F.element_at(vec, key), F.lit(0))


def dense(vec, size: int) -> Column:
    """Values at 0 .. size - 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at(vec, i), F.lit(0)))


def dump(vec) -> Column:
    """Number of words, then every id plus one as often as its count, parted by blanks."""
    words = F.aggregate(F.map_values(vec), F.lit(0).cast("long"), lambda a, v: a + F.greatest(v, F.lit(0)))
    repeated = F.transform(F.map_entries(vec), lambda e: F.repeat(F.concat(F.lit(" "), (e["key"] + 1).cast("string")), e["value"].cast("int")))
    return F.concat(words.cast("string"), F.array_join(repeated, ""))


def prefix_counts(bow: DataFrame) -> DataFrame:
    """`bow` with `upto`: the term's count in the document up to and including the sentence."""
    w = Window.partitionBy("docset", "doc_id", "term").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return bow.withColumn("upto", F.sum("cnt").over(w))


def range_counts(bow: DataFrame, spans: DataFrame) -> DataFrame:
    """The merged vector of sentences [start, end) of each of `spans` (docset, doc_id, start, end): see `counts_between`."""
    return counts_between(bow.join(spans, ["docset", "doc_id"]))


def counts_between(bow: DataFrame) -> DataFrame:
    """The merged vector of each document's sentences [start, end), where these are columns of `bow`: the difference of two prefix sums,
    each the last at or before a position."""
    w = Window.partitionBy("docset", "doc_id", "start", "end", "term").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    prefix = bow.withColumn("upto", F.sum("cnt").over(w))
    at = lambda edge: F.coalesce(F.max(F.when(F.col("pos") < F.col(edge), F.col("upto"))), F.lit(0))
    merged = prefix.groupBy("docset", "doc_id", "start", "end", "term").agg((at("end") - at("start")).alias("cnt"))
    return compact(merged)


def tf_idf(bow: DataFrame) -> DataFrame:
    """(keys, term, tfidf): tf within the sentence; idf = ln(N / (1 + df)) over the N non-empty sentences of the docset. All three are
    windows that begin with the docset, so counts of `dealt` documents take no exchange."""
    sentence = Window.partitionBy(*KEYS).orderBy("term")
    whole = sentence.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = bow.withColumn("total", F.sum("cnt").over(whole)).withColumn("begins", (F.row_number().over(sentence) == 1).cast("int"))
    rows = rows.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("docset", "term"))).withColumn("n", F.sum("begins").over(Window.partitionBy("docset")))
    idf = F.log(F.col("n") / (1.0 + F.col("df")))
    return rows.select(*KEYS, "term", (F.col("cnt") / F.col("total") * idf).alias("tfidf"))


def tf_idf_counted(counted_: DataFrame, term: str = "term") -> DataFrame:
    """`tf_idf` of documents `counted` by line, which know their sentences' words and how many of these aren't empty: only df is a window. With
    term_id as `term`, terms are numbers."""
    n = counted_.groupBy("docset").agg(F.sum("filled").alias("sentences")).hint("shuffle_hash")
    rows = entries(counted_.join(n, "docset"), "pos", "sentences").withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("docset", "term_id")))
    idf = F.log(F.col("sentences") / (1.0 + F.col("df")))
    return rows.select(*KEYS, F.col(term).alias("term"), (F.col("cnt") / F.col("size") * idf).alias("tfidf"))

"""Language identification by compression with per-language zstandard dictionaries.

A language is a raw-content dictionary of its letters, made from a bounded sample of labelled texts. A whole text, reduced to
lower-case letters and single spaces, is compressed in pieces of `PIECE` bytes, each on its own, with every dictionary; the
language with the smallest sum wins, and the margin is by how much the second best is larger, relative to it. Pieces keep the
dictionary in play throughout a long text. Sizes are whole bytes, so short texts often tie; among tied languages the one whose dictionary
has the longest matches (summed over the text's positions, from `LEAST_MATCH` bytes) wins, and the margin is that of these sums. A margin
below `MIN_MARGIN` rejects the text (it still gets its best guess).

The sample, the only thing that is bounded: of each language up to `PIECES` texts, those with the smallest hash of their id, and of each
`PIECE_CHARS` characters from a place drawn by hash from anywhere in it; fewer texts where `ALL_PIECES` for all languages ask for it. All
of that is used, and it is all that reaches the driver and all that is broadcast. More than `MAX_LANGUAGES` values, far more than there
are languages, are an error. Prediction reads whole texts and nothing but the text.

Defined edge cases: a null text or one without a letter (Unicode category L) is `und`, score 0, rejected; ties in both measures go to the
language with more labelled texts, then by name, and are rejected; with a single language every text with a letter is of it, at score 1;
without any labelled text all are `und`; repeated rows get equal rows; rows with a null doc_id are never held out; an empty table gives an
empty result; extra columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIECES, PIECE_CHARS, ALL_PIECES, MAX_LANGUAGES = 400, 320, 200_000, 20_000
PIECE, LEVEL, LEAST_MATCH = 1_024, 6, 3
MIN_MARGIN = 0.002
#: Bytes of a tied text up to which its matches are searched for one by one.
SEARCHED = 2_048
#: Margin at which the score is one half.
HALF_MARGIN = 0.02
UNKNOWN = "und"

# ASCII letters stay (as lower case), other ASCII becomes space, bytes of other characters stay.
_FOLD = bytes(b | 0x20 if chr(b).isalpha() and b < 128 else b if b >= 128 else 32 for b in range(256))


def folded(text: str) -> bytes:
    """Lower-case letters with single spaces between words and around them."""
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()) + b" "


def compressor(dictionary: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


class Matches:
    """The suffix automaton of a dictionary read backwards: how long the longest matches are that begin at each place of a text, in one
    pass from its end, whatever the lengths of both."""

    def __init__(self, content: bytes):
        # Transitions by state * 256 + byte; of each state its suffix link and longest length.
        step, link, size, last = {}, [-1], [0], 0
        for byte in reversed(content):
            state = len(size)
            size.append(size[last] + 1)
            link.append(0)
            at, last = last, state
            while at >= 0 and (at << 8 | byte) not in step:
                step[at << 8 | byte] = state
                at = link[at]
            if at < 0:
                continue
            to = step[at << 8 | byte]
            if size[to] != size[at] + 1:
                copy = len(size)
                size.append(size[at] + 1)
                link.append(link[to])
                for b in range(256):
                    if (to << 8 | b) in step:
                        step[copy << 8 | b] = step[to << 8 | b]
                old, to = to, copy
                link[old] = copy
                while at >= 0 and step.get(at << 8 | byte) == old:
                    step[at << 8 | byte] = copy
                    at = link[at]
            link[state] = to
        self.step, self.link, self.size = step, link, size

    def total(self, body: bytes) -> int:
        """The sum of the lengths of at least `LEAST_MATCH`."""
        step, link, size = self.step, self.link, self.size
        state = length = total = 0
        for byte in reversed(body):
            while (to := step.get(state << 8 | byte)) is None and state:
                state = link[state]
                length = size[state]
            if to is not None:
                state, length = to, length + 1
            if length >= LEAST_MATCH:
                total += length
        return total


class Classifier:
    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        """`dictionaries`: (language, content), by preference among ties."""
        self.names = [n for n, _ in dictionaries]
        self.contents = [d for _, d in dictionaries]
        self.compressors = [compressor(d) for d in self.contents]
        self.automata: dict[int, Matches] = {}

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The language and the margin."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        body = folded(text)
        pieces = [body[i : i + PIECE] for i in range(0, len(body), PIECE)]
        sizes = [sum([len(c.compress(p)) for p in pieces]) for c in self.compressors]
        best = min(sizes)
        tied = [i for i, s in enumerate(sizes) if s == best]
        if len(tied) > 1:
            matched = [self.matched(i, body) for i in tied]
            most = max(matched)
            at = matched.index(most)
            return self.names[tied[at]], 1 - max(matched[:at] + matched[at + 1 :]) / most if most else 0.0
        rest = sizes[: tied[0]] + sizes[tied[0] + 1 :]
        return self.names[tied[0]], (1 - best / min(rest)) if rest else 1.0

    def matched(self, language: int, body: bytes) -> int:
        """The sum over positions of the longest match that begins there, of at least `LEAST_MATCH` bytes: searched for in short texts, by
        an automaton, which is made once, in longer ones."""
        if len(body) > SEARCHED:
            if language not in self.automata:
                self.automata[language] = Matches(self.contents[language])
            return self.automata[language].total(body)
        content, total, size = self.contents[language], 0, 0
        for i in range(len(body)):
            size = max(size - 1, 0)
            while i + size < len(body) and body[i : i + max(size + 1, LEAST_MATCH)] in content:
                size = max(size + 1, LEAST_MATCH)
            size = min(size, len(body) - i)
            total += size if size >= LEAST_MATCH else 0
        return total

    def accepts(self, text: str | None) -> bool:
        return accepted(*self(text))


def accepted(language: str, margin: float) -> bool:
    return language != UNKNOWN and margin >= MIN_MARGIN


def held_out(modulus: int = 3, remainder: int = 1, column: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves `remainder`."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def learn(docs: DataFrame) -> list[tuple[str, bytes]]:
    """Dictionaries from the rows of `docs` (doc_id, text, lang) that aren't held out and have a language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return []
    most = min(PIECES, max(1, ALL_PIECES // len(counts)))
    # Twice as many as are wanted pass by hash; the smallest hashes of those are taken.
    share = docs.sparkSession.createDataFrame([(k, min(1.0, 2 * most / n)) for k, n in counts.items()], "lang string, share double")
    rows = rows.select("doc_id", "lang", "text").join(F.broadcast(share), "lang")
    rows = rows.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))).where(F.col("h") < F.col("share") * 1_000_003)
    place = F.pmod(F.xxhash64(F.lit("place"), "doc_id"), F.greatest(F.lit(1), F.length("text") - (PIECE_CHARS - 1)).cast("long")).cast("int") + 1
    rows = rows.select("lang", "doc_id", "h", F.substring(F.col("text"), place, F.lit(PIECE_CHARS)).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    rows = rows.withColumn("r", rank).where(F.col("r") <= most)
    texts: dict[str, list] = {}
    for r in rows.collect():
        texts.setdefault(r["lang"], []).append((r["r"], r["text"]))
    order = sorted(texts, key=lambda k: (-counts[k], k))
    return [(k, b"".join(folded(t)[1:] for _, t in sorted(texts[k], key=lambda x: x[0]))) for k in order]


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], *keep: str) -> DataFrame:
    """`docs` (doc_id, text and the columns `keep`) with lang_pred, score (0 to 1) and accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    rows = docs.select("doc_id", "text", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(shared.value)
        for batch in batches:
            found = [classify(t) for t in batch.column(1).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != 1]
            columns += [
                pa.array([k for k, _ in found], pa.string()), pa.array([m / (m + HALF_MARGIN) if m < 1 else 1.0 for _, m in found], pa.float64()),
                pa.array([accepted(k, m) for k, m in found], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *keep, "lang_pred", "score", "accepted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double, accepted boolean")


def accepted_rows(docs: DataFrame, dictionaries: list[tuple[str, bytes]]) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text isn't rejected: those with a null text or without a letter go."""
    shared, at = docs.sparkSession.sparkContext.broadcast(dictionaries), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([classify.accepts(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from `docs` (doc_id, text, lang) and classify all of it: doc_id, held_out, lang_pred, score, accepted."""
    return identify(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")

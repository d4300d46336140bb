"""Token ids in fixed-width bit-packed files with block offsets.

An image is one file of ids: a header, the ids of consecutive documents at `width` bits each (the minimum that holds the
vocabulary), most significant bit first, in blocks that each begin on a byte, the table of block offsets, and the table of
documents (id and first token). Unpacking is vectorised over a block; document or token n is found through the tables
without reading what stands before it.

Layout, all integers little-endian:

    8  bytes  magic "LAMTOK01"
    u32 width, u32 tokens in a block, u64 tokens, u64 documents, u64 blocks
    u64[blocks + 1]     offset of each block from the start of the image
    i64[documents]      document ids, ascending
    u64[documents + 1]  first token of each document
    blocks

`write_images` puts images of bounded size into a Parquet table in a shared folder, one image to a row, ordered by document:
Spark's writer and its commit protocol reach any store and survive lost or repeated tasks. `Image` opens one, also from a
plain file that holds the same bytes (`export`).

Defined edge cases: a null text is the empty text, which is the end id alone; rows with a null doc_id come first; rows without an id,
and rows that share one, are in the order of a hash of their texts, then of the texts, however the table is laid out; an empty table gives
no image; extra columns pass by.
"""

from __future__ import annotations

import bisect
import math
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.bpe import byte_alphabet
from lamina.llm.shingles import mix64, running_hash, span_hash
from lamina.session import scratch

MAGIC = b"LAMTOK01"
BLOCK_TOKENS = 4096
#: Tokens after which an image ends (it may run over by one document).
IMAGE_TOKENS = 1 << 16
#: Words that a task remembers (about 50 bytes each); the memory is emptied when full.
REMEMBERED = 900_000
#: Characters of texts that are cut and looked up together.
GROUP_CHARS = 1 << 19
TASK_BYTES = 48 << 20
#: Runs of ascending ids that the driver looks at.
MAX_RUNS = 100_000

#: Stands for a null doc_id in an image.
NULL_ID = -(1 << 63)

_HEAD = struct.Struct("<8sIIQQQ")


def bits_for(vocabulary: int) -> int:
    """The minimum number of bits that holds the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int, block: int = BLOCK_TOKENS) -> tuple[bytes, np.ndarray]:
    """Packed blocks and the offset of each from the first."""
    full, rest = divmod(len(ids), block)
    per = (block * width + 7) // 8
    out = [_pack_rows(ids[: full * block].reshape(full, block), width)] if full else []
    if rest:
        out.append(_pack_rows(ids[full * block :].reshape(1, rest), width))
    sizes = [per] * full + ([(rest * width + 7) // 8] if rest else [])
    return b"".join(out), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _pack_rows(rows: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):  # whole bytes: the same bits by a byte swap
        return rows.astype(f">u{width // 8}").tobytes()
    bits = (rows[:, :, None] >> np.arange(width - 1, -1, -1, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).reshape(len(rows), -1), axis=1).tobytes()


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    """The ids of one packed block."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f">u{width // 8}", count).astype(np.uint32)
    first = np.arange(count, dtype=np.int64) * width
    padded = np.frombuffer(data + b"\0" * 8, np.uint8)
    word = np.zeros(count, np.uint64)
    for k in range((width + 14) // 8):
        word = (word << np.uint64(8)) | padded[(first >> 3) + k].astype(np.uint64)
    spare = np.uint64(8 * ((width + 14) // 8) - width) - (first & 7).astype(np.uint64)
    return ((word >> spare) & np.uint64((1 << width) - 1)).astype(np.uint32)


def build_image(doc_ids: list[int], ids: list[bytes], width: int, block: int = BLOCK_TOKENS) -> bytes:
    """An image of documents, their ids given as little-endian unsigned 32-bit integers."""
    lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), "<u4")
    body, offsets = pack(flat, width, block)
    start = _HEAD.size + 8 * len(offsets) + 8 * len(doc_ids) + 8 * (len(doc_ids) + 1)
    return b"".join([
        _HEAD.pack(MAGIC, width, block, len(flat), len(doc_ids), len(offsets) - 1), (offsets + start).astype("<u8").tobytes(),
        np.array(doc_ids, "<i8").tobytes(), np.concatenate(([0], np.cumsum(lengths))).astype("<u8").tobytes(), body,
    ])


class Image:
    """Random access to an image."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, self.width, self.block, self.tokens, self.documents, self.blocks = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token image")
        at = _HEAD.size
        self.offsets = np.frombuffer(data, "<u8", self.blocks + 1, at)
        self.doc_ids = np.frombuffer(data, "<i8", self.documents, at := at + 8 * (self.blocks + 1))
        self.first = np.frombuffer(data, "<u8", self.documents + 1, at + 8 * self.documents).astype(np.int64)

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids start .. end - 1, from the blocks that hold them only."""
        if end <= start:
            return np.empty(0, np.uint32)
        low, high = start // self.block, (end - 1) // self.block
        parts = [
            unpack(bytes(self.data[int(self.offsets[b]) : int(self.offsets[b + 1])]), min(self.block, self.tokens - b * self.block), self.width)
            for b in range(low, high + 1)
        ]
        return np.concatenate(parts)[start - low * self.block : end - low * self.block]

    def document(self, n: int) -> np.ndarray:
        return self.slice(int(self.first[n]), int(self.first[n + 1]))


# The byte-level pattern of the tokenizer file (public), and its form for ASCII pieces without white space.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s"
_MARKS = ".,;:!?"

_BYTES = np.arange(256)
_IS_END = np.isin(_BYTES, [0, 10, 32])
_IS_MARK = np.isin(_BYTES, [ord(c) for c in _MARKS])
_MAY_BE_LETTER = (_BYTES >= 128) | ((_BYTES | 32 >= 97) & (_BYTES | 32 <= 122))


class _Known:
    """Ids by a 64-bit hash: an open hash table over flat arrays, asked for many hashes at once. It keeps the words too, so that whoever
    asks can see whether a hash stood for the word meant."""

    def __init__(self, bits: int):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.key, self.at = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.start, self.size, self.letters = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32), np.zeros(1 << 10, bool)
        self.ids = np.zeros(1 << 12, np.uint32)
        self.word_start, self.word_size, self.words = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.uint8)
        self.count = self.used = self.word_bytes = 0

    def full(self) -> bool:
        return self.count > REMEMBERED or self.used > 16 * REMEMBERED or self.word_bytes > 32 * REMEMBERED

    def holds(self, entry: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bool:
        """Whether every entry is that of the word data[begin:end] beside it."""
        size = end - begin
        if (self.word_size[entry] != size).any():
            return False
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return np.array_equal(data[np.repeat(begin, size) + step], self.words[np.repeat(self.word_start[entry], size) + step])

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1. A hash is never 0."""
        slot, mask = self._slot(h), (1 << self.bits) - 1
        got = self.key[slot]
        out = np.where(got == h, self.at[slot], -1)
        todo = np.flatnonzero((got != h) & (got != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            got = self.key[slot[todo]]
            same = todo[got == h[todo]]
            out[same] = self.at[slot[same]]
            todo = todo[(got != h[todo]) & (got != 0)]
        return out

    def add(self, h: np.ndarray, words: list[bytes], ids: list[list[int]], letters: list[bool]) -> None:
        """Entries for distinct new hashes."""
        n, size = len(h), np.fromiter(map(len, ids), np.int64, len(ids))
        while self.count + n > len(self.start):
            self.start, self.size, self.letters = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.size, self.letters))
            self.word_start, self.word_size = (np.concatenate((x, np.zeros_like(x))) for x in (self.word_start, self.word_size))
        text = np.frombuffer(b"".join(words), np.uint8)
        while self.word_bytes + len(text) > len(self.words):
            self.words = np.concatenate((self.words, np.zeros_like(self.words)))
        length = np.fromiter(map(len, words), np.int64, n)
        self.word_start[self.count : self.count + n] = self.word_bytes + np.cumsum(length) - length
        self.word_size[self.count : self.count + n] = length
        self.words[self.word_bytes : self.word_bytes + len(text)] = text
        self.word_bytes += len(text)
        while self.used + int(size.sum()) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        entry = slice(self.count, self.count + n)
        self.start[entry] = self.used + np.cumsum(size) - size
        self.size[entry], self.letters[entry] = size, letters
        self.ids[self.used : self.used + int(size.sum())] = [i for own in ids for i in own]
        slot, todo, mask = self._slot(h), np.arange(n), (1 << self.bits) - 1
        while len(todo):
            free = todo[self.key[slot[todo]] == 0]
            self.key[slot[free]] = h[free]  # of those that want one slot, the last stays
            won = free[self.key[slot[free]] == h[free]]
            self.at[slot[won]] = self.count + won
            rest = np.ones(n, bool)
            rest[won] = False
            todo = todo[rest[todo]]
            slot[todo] = (slot[todo] + 1) & mask
        self.count += n
        self.used += int(size.sum())


class CachedEncoder:
    """The `tokenizers` library over whole texts, with its BPE model asked once for each word that is remembered.

    The byte-level pattern never joins what stands on both sides of a single space or line end whose neighbours aren't white
    space, nor a word of letters and one mark after it. So texts are cut there, all at once over their bytes; the words are
    hashed (64 bits), looked up, compared with the remembered words byte by byte, and their ids strung together without a step in Python
    for each. A group of texts in which two words share a hash, and a text with other white space than single spaces and line ends, or
    with a special token's opening, are given to the library as a whole.
    """

    def __init__(self, spec: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.alphabet = {b: c for b, c in enumerate(byte_alphabet()) if chr(b) != c}
        self.cut, self.cut_ascii = regex.compile(_PATTERN).findall, re.compile(_ASCII).findall
        self.known = _Known(21)
        (self.line_end,) = self.word("\n")
        self.mark_id = np.zeros(256, np.uint32)
        for c in _MARKS:
            (self.mark_id[ord(c)],) = self.word(c)

    def forget(self) -> None:
        self.known.clear()

    def word(self, word: str) -> list[int]:
        """Ids of what the pattern has cut out."""
        if word.isascii() and word.isprintable():
            signs = word.replace(" ", "\u0120")
        else:
            signs = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.model.tokenize(signs)]

    def piece(self, text: str, letters: bool) -> list[int]:
        if letters:
            return self.word(text)
        return [i for w in (self.cut_ascii if text.isascii() else self.cut)(text) for i in self.word(w)]

    def simple(self, text: str) -> bool:
        """Whether spaces and line ends stand alone and inside, no other white space and no special token's opening occurs."""
        if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n" in text and ("\n\n" in text or "\n " in text or " \n" in text):
            return False
        # Printable characters include no white space but the space.
        return "<|" not in text and text.replace("\n", " ").isprintable()

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        whole, group, size = [], [], 0
        for i, t in enumerate(texts):
            (group if self.simple(t) else whole).append(i)
        for i, ids in zip(whole, self.by_library([texts[i] for i in whole]), strict=True):
            out[i] = ids
        at = 0
        for n, i in enumerate(group):
            size += len(texts[i])
            if size >= GROUP_CHARS or n == len(group) - 1:
                own = group[at : n + 1]
                for j, ids in zip(own, self._together([texts[j].encode() for j in own]), strict=True):
                    out[j] = ids
                at, size = n + 1, 0
        return out

    def by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, texts: list[bytes]) -> list[bytes]:
        if self.known.full():
            self.known.clear()
        raw = b"\0".join(texts) + b"\0"
        data = np.frombuffer(raw, np.uint8)
        end = np.flatnonzero(_IS_END[data])
        start = np.concatenate(([0], end[:-1] + 1))
        before = np.where(start > 0, data[start - 1], 0)  # 32: the word takes the space; 10: the line end is a token
        mark = _IS_MARK[data[end - 1]] & (end - start > 1) & _MAY_BE_LETTER[data[end - 2]]
        total = running_hash(data)
        entry = np.full(len(end), -1, np.int64)
        todo = np.arange(len(end))
        while len(todo):
            stop = end[todo] - mark[todo]
            h = span_hash(total, start[todo], stop) * np.uint64(2) + (before[todo] == 32) + np.uint64(0)
            h = mix64(h) | np.uint64(1)
            found = self.known.find(h)
            new, first = np.unique(h[found < 0], return_index=True)
            if len(new):
                where = np.flatnonzero(found < 0)[first]
                words = [raw[a:b].decode() for a, b in zip(start[todo[where]].tolist(), stop[where].tolist(), strict=True)]
                letters = [w.isalpha() for w in words]
                words = [" " + w if s else w for w, s in zip(words, (before[todo[where]] == 32).tolist(), strict=True)]
                self.known.add(new, [w.encode() for w in words], [self.piece(w, k) for w, k in zip(words, letters, strict=True)], letters)
                found = self.known.find(h)
            entry[todo] = found
            # What isn't letters alone is cut together with its mark.
            todo = todo[mark[todo] & ~self.known.letters[found]]
            mark[todo] = False
        if not self.known.holds(entry, data, start - (before == 32), end - mark):
            return self.by_library([t.decode() for t in texts])
        line = before == 10
        size = self.known.size[entry].astype(np.int64)
        each = size + line + mark
        upto = np.cumsum(each)
        begin = upto - each
        ids = np.empty(int(upto[-1]), "<u4")
        ids[begin[line]] = self.line_end
        ids[upto[mark] - 1] = self.mark_id[data[end[mark] - 1]]
        shift = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        ids[np.repeat(begin + line, size) + shift] = self.known.ids[np.repeat(self.known.start[entry], size) + shift]
        last = upto[data[end] == 0].tolist()
        flat = ids.tobytes()
        return [flat[4 * a : 4 * b] for a, b in zip([0, *last], last, strict=False)]


_loaded: dict[int, CachedEncoder] = {}


def ascending_runs(rows: DataFrame) -> list[tuple[int, int]] | None:
    """First and last id of the ascending runs of `rows` (doc_id, file) as tasks read them, each within a file, in order; None if
    runs overlap or share an id, an id is null or occurs twice, or there are more than `MAX_RUNS`, or than 4 for each task and 16 (each
    run begins an image)."""
    most = min(MAX_RUNS, 16 + 4 * rows.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = file = None
        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy()
            if not len(ids):
                continue
            names = batch.column(1).dictionary_encode().indices.to_numpy()
            begins = np.flatnonzero((ids[1:] <= ids[:-1]) | (names[1:] != names[:-1])) + 1
            starts, ends = ids[[0, *begins]].tolist(), ids[[*(begins - 1), len(ids) - 1]].tolist()
            if first is not None and batch.column(1)[0].as_py() == file and starts[0] > last:
                starts[0] = first
            elif first is not None:
                starts, ends = [first, *starts], [last, *ends]
            if len(starts) > 1:
                yield pa.RecordBatch.from_pydict({"first": starts[:-1], "last": ends[:-1]})
            first, last, file = starts[-1], ends[-1], batch.column(1)[batch.num_rows - 1].as_py()
        if first is not None:
            yield pa.RecordBatch.from_pydict({"first": [first], "last": [last]})

    runs = rows.select("doc_id", "file").mapInArrow(run, "first long, last long").limit(most + 1).collect()
    runs = sorted((r["first"], r["last"]) for r in runs)
    if len(runs) > most or any(a[1] >= b[0] for a, b in zip(runs, runs[1:], strict=False)) or (runs and runs[0][0] == NULL_ID):
        return None
    return runs


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, file): the file is empty where rows don't come straight from one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.input_file_name().alias("file"))


def write_images(docs: DataFrame, spec: str, end_id: int, path: str, vocabulary: int, block: int = BLOCK_TOKENS, image: int = IMAGE_TOKENS) -> None:
    """Encode `docs` (doc_id, text) in ascending doc_id order and write images to the table at `path`.

    Rows: part, seq, first_doc, documents, tokens, image; in document order by part, first_doc, seq. Where the ids, which are read
    first on their own, turn out to lie in ascending runs that don't overlap, texts are encoded where they are read. Else they
    are range-partitioned by id (and a hash of the text, as many rows may lack an id) before they are encoded, so sampling for the ranges
    runs no Python and each text is encoded once; a task gets about `TASK_BYTES` of text.
    """
    spark = docs.sparkSession
    shared, width = spark.sparkContext.broadcast(spec), bits_for(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = hash(shared.value)
        if key not in _loaded:
            _loaded[key] = CachedEncoder(shared.value)
        encode, seq = _loaded[key], 0
        end = np.array([end_id], "<u4").tobytes()
        ids_of: list[int] = []
        held: list[bytes] = []
        count, file = 0, None

        def row() -> pa.RecordBatch:
            data = build_image(ids_of, held, width, block)
            part = TaskContext.get().partitionId() if starts is None else bisect.bisect_right(starts.value, ids_of[0]) - 1
            values = [[part], [seq], [ids_of[0]], [len(ids_of)], [count], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["part", "seq", "first_doc", "documents", "tokens", "image"])

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), encode(texts), strict=True):
                doc = NULL_ID if doc is None else doc
                if ids_of and (doc < ids_of[-1] or name != file):  # another run begins
                    yield row()
                    ids_of, held, count, seq = [], [], 0, seq + 1
                file = name
                ids_of.append(doc)
                held.append(ids + end)
                count += len(held[-1]) // 4
                if count >= image:
                    yield row()
                    ids_of, held, count, seq = [], [], 0, seq + 1
        if ids_of:
            yield row()
        encode.forget()  # an idle worker holds nothing

    rows = numbered(docs)
    runs = ascending_runs(rows)
    if runs is not None:
        starts = spark.sparkContext.broadcast([first for first, _ in runs])
    else:
        starts = None
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        keys = [F.col("doc_id"), F.xxhash64("text")]
        rows = rows.withColumn("file", F.lit("")).repartitionByRange(max(1, math.ceil(size / TASK_BYTES)), *keys).sortWithinPartitions(*keys, "text")
    rows.mapInArrow(run, "part int, seq int, first_doc long, documents long, tokens long, image binary").write.parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """Per document of the images at `path`: doc_id, start (tokens of all before it), n_tokens, ids_crc32, all from the images.

    Only a total for each part of the table, as many as it was written in, comes to the driver.
    """
    images = spark.read.parquet(path)
    totals = sorted((r["part"], r["n"]) for r in images.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    before = np.concatenate(([0], np.cumsum([n for _, n in totals], dtype=np.int64)))
    bases = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(totals, before, strict=False)], "part int, base long")
    own = images.select("part", "seq", "first_doc", "tokens")
    upto = Window.partitionBy("part").orderBy("first_doc", "seq").rowsBetween(Window.unboundedPreceding, -1)
    places = own.withColumn("within", F.coalesce(F.sum("tokens").over(upto), F.lit(0))).join(F.broadcast(bases), "part")
    places = places.select("part", "seq", "first_doc", (F.col("base") + F.col("within")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                part, seq, first_doc, data = (batch.column(c)[n].as_py() for c in range(4))
                im = Image(data)
                flat = im.slice(0, im.tokens).astype("<u4").tobytes()
                first = im.first.tolist()
                crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(first, first[1:], strict=False)]
                docs = pa.array([None if d == NULL_ID else d for d in im.doc_ids.tolist()], pa.int64())
                count = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * count, pa.int32()), pa.array([seq] * count, pa.int32()), pa.array([first_doc] * count, pa.int64()), docs, pa.array(im.first[:-1]), pa.array(np.diff(im.first)), pa.array(crc, pa.int64())],
                    names=["part", "seq", "first_doc", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = images.select("part", "seq", "first_doc", "image").mapInArrow(run, "part int, seq int, first_doc long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(places, ["part", "seq", "first_doc"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def pack_documents(docs: DataFrame, spec: str, end_id: int, vocabulary: int) -> DataFrame:
    """Write `docs` as images into the shared folder and describe every document as it is read back from them."""
    path = scratch(docs.sparkSession, "token-images")
    write_images(docs, spec, end_id, path, vocabulary)
    return read_documents(docs.sparkSession, path)


def export(spark, path: str, folder: str) -> list[str]:
    """Write every image of the table at `path` as a plain file into a folder that this process can write to, one at a time."""
    os.makedirs(folder, exist_ok=True)
    names = []
    for r in spark.read.parquet(path).select("part", "seq", "first_doc", "image").orderBy("part", "first_doc", "seq").toLocalIterator():
        names.append(os.path.join(folder, f"{len(names):09d}.tok"))
        with open(names[-1], "wb") as f:
            f.write(r["image"])
    return names

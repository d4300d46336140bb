"""Byte-pair encoding by a segment tree over adjacent pair ranks, and decoding.

A word is a row of symbols. The leaves of a tree hold, for each adjacent pair, its merge rank and position; every inner node
holds the smaller of its two children, so the root names the leftmost pair of the lowest rank. Merging it changes three leaves
(the pair itself and its two neighbours), each mended along one path to the root in O(log n). A word of n symbols is encoded in
O(n log n); no pair is searched for by scanning.

The trees of many words are updated together: row i of every array is word i, and one step merges the root pair of each word
that still has one. Words are grouped by the power of two that holds them, so a group's arrays stay dense. Groups of a few words, as
very long ones are, have their trees walked one by one. Places have 40 bits, more than a text can hold. Words that a worker has seen lately
are looked up; the memory is bounded.

`WordBPE` follows a tokenizer file whose model is BPE with an end-of-word suffix, normalised by NFC, white space and lower case,
and cut by its pattern of letters, single digits and other signs. It gives what the `tokenizers` library gives for that file,
with special tokens in a text taken as such.

Defined edge cases: null and empty texts have no ids and decode to the empty text; characters outside the vocabulary cannot
occur, as every byte is in it; an empty table gives an empty result; repeated rows give equal rows; extra columns pass by.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks remembered by a worker; the memory is emptied when full.
REMEMBERED = 300_000
#: Chunks longer than this are never remembered.
LONG_CHUNK = 64
#: Symbols of a group of words whose trees are updated together.
GROUP_SYMBOLS = 1 << 18

#: Bits of a leaf for the place; the rank of the pair stands above them.
PLACE_BITS = 40
#: Groups of so few words are merged word by word on plain lists, which is quicker than arrays of a row each.
FEW = 8
_NONE = np.int64(1) << np.int64(62)
# The tokenizer's white space, and what str.split() takes for such besides.
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_ODD_SPACE = re.compile("[\\x1c-\\x1f]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it's a visible Latin-1 sign, else one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(visible) else chr(next(rest)) for b in range(256)]


class PairTable:
    """Merge ranks and results of symbol pairs: open addressing in two flat arrays, looked up for many pairs at once."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.pairs = pairs
        self.bits = max(10, (8 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.key, self.rank, self.to = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for (a, b), (rank, to) in pairs.items():
            k = (a << 32) | b
            i = (k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
            while self.key[i] >= 0:
                i = (i + 1) & (size - 1)
            self.key[i], self.rank[i], self.to[i] = k, rank, to

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair, or -1."""
        k = (a << np.int64(32)) | b
        slot = ((k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.key[slot]
        out = np.where(got == k, slot, -1)
        todo = np.flatnonzero((got != k) & (got != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            got = self.key[slot[todo]]
            out[todo[got == k[todo]]] = slot[todo[got == k[todo]]]
            todo = todo[(got != k[todo]) & (got != -1)]
        return out


def merge_all(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """All merges, in rank order and from the left, of words given as one array and their lengths; returned alike."""
    start = np.cumsum(lengths) - lengths
    left = np.where(lengths < 2, lengths, 0)
    parts: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero(lengths == 1), symbols[start[lengths == 1]])]
    width = 4
    while width < 8 or width < 2 * (int(lengths.max()) if len(lengths) else 0):
        ids = np.flatnonzero((lengths <= width) & (lengths > (1 if width == 4 else width // 2)))
        step = max(1, GROUP_SYMBOLS // width)
        for at in range(0, len(ids), step):
            group = ids[at : at + step]
            merge = _merge_few if len(group) <= FEW else _merge_group
            got, n = merge(symbols, start[group], lengths[group], width, table)
            left[group] = n
            parts.append((group, got))
        width *= 2
    out = np.empty(int(left.sum()), np.int64)
    begin = np.cumsum(left) - left
    for group, got in parts:
        n = left[group]
        out[np.repeat(begin[group] - (np.cumsum(n) - n), n) + np.arange(len(got))] = got
    return out, left


def _merge_group(symbols, start, lengths, width: int, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    rows = len(start)
    sym = np.full((rows, width + 1), -1, np.int64)
    column = np.arange(width + 1)
    inside = column < lengths[:, None]
    sym[inside] = symbols[(start[:, None] + column)[inside]]
    # Node k of a tree has children 2k and 2k + 1; leaf `width + i` is the pair of the symbol at i and the next one left.
    tree = np.full((rows, 2 * width), _NONE, np.int64)
    r, c = np.nonzero(inside[:, 1:])
    slot = table.find(sym[r, c], sym[r, c + 1])
    hit = slot >= 0
    tree[r[hit], width + c[hit]] = (table.rank[slot[hit]] << np.int64(PLACE_BITS)) | c[hit]
    half = width
    while half > 1:
        tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
        half //= 2
    following = np.broadcast_to(column[:width] + 1, (rows, width)).copy()
    before = np.broadcast_to(column[:width] - 1, (rows, width)).copy()
    levels = width.bit_length() - 1
    w = np.flatnonzero(tree[:, 1] < _NONE)
    while len(w):
        i = tree[w, 1] & np.int64((1 << PLACE_BITS) - 1)
        j = following[w, i]
        sym[w, i] = table.to[table.find(sym[w, i], sym[w, j])]
        sym[w, j] = -1
        k = following[w, j]
        following[w, i] = k
        p = before[w, i]
        has_next, has_prev = k < lengths[w], p >= 0
        wn, wp = w[has_next], w[has_prev]
        before[wn, k[has_next]] = i[has_next]
        # Three leaves change: the one of the symbol that went, of the merged symbol, and of the one before it.
        tree[w, width + j] = _NONE
        tree[w, width + i] = _NONE
        tree[wn, width + i[has_next]] = _leaf(table, sym, wn, i[has_next], k[has_next])
        tree[wp, width + p[has_prev]] = _leaf(table, sym, wp, p[has_prev], i[has_prev])
        own, node = np.concatenate((w, w, wp)), np.concatenate((j, i, p[has_prev])) + width
        for _ in range(levels):
            node >>= 1
            tree[own, node] = np.minimum(tree[own, 2 * node], tree[own, 2 * node + 1])
        w = w[tree[w, 1] < _NONE]
    left = sym[:, :width] >= 0
    return sym[:, :width][left], left.sum(1)


def _merge_few(symbols, start, lengths, width: int, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """As `_merge_group`, with one tree at a time."""
    parts = [_merge_word(symbols[a : a + n].tolist(), width, table.pairs) for a, n in zip(start.tolist(), lengths.tolist(), strict=True)]
    return np.array([s for p in parts for s in p], np.int64), np.array([len(p) for p in parts], np.int64)


def _merge_word(word: list[int], width: int, pairs: dict) -> list[int]:
    none, low = int(_NONE), (1 << PLACE_BITS) - 1
    leaf = lambda i, k: (hit[0] << PLACE_BITS) | i if (hit := pairs.get((word[i], word[k]))) else none
    tree = [none] * width + [leaf(i, i + 1) for i in range(len(word) - 1)]
    tree += [none] * (2 * width - len(tree))
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    following, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))

    def put(at: int, value: int) -> None:
        node = width + at
        while tree[node] != value:
            tree[node] = value
            node >>= 1
            if not node:
                return
            a, b = tree[2 * node], tree[2 * node + 1]
            value = a if a < b else b

    while tree[1] != none:
        i = tree[1] & low
        j = following[i]
        word[i], word[j] = pairs[word[i], word[j]][1], -1
        k, p = following[j], before[i]
        following[i] = k
        put(j, none)
        put(i, leaf(i, k) if k < len(word) else none)
        if k < len(word):
            before[k] = i
        if p >= 0:
            put(p, leaf(p, i))
    return [s for s in word if s >= 0]


def _leaf(table, sym, w, at, to) -> np.ndarray:
    slot = table.find(sym[w, at], sym[w, to])
    return np.where(slot >= 0, (table.rank[slot] << np.int64(PLACE_BITS)) | at, _NONE)


class WordBPE:
    """Encoder and decoder for a tokenizer file (its JSON text) of the kind described above."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        v = self.vocab
        self.table = PairTable({(v[a], v[b]): (rank, v[a + b]) for rank, (a, b) in reversed(list(enumerate(merges)))})
        names = {i: t for t, i in (v | self.special).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.bytes = [n.encode() for n in self.names]
        signs = byte_alphabet()
        self.plain = np.array([v[s] for s in signs], np.int64)
        self.final = np.array([v[s + self.suffix] for s in signs], np.int64)
        pattern = next(p for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memory: dict[str, bytes] = {}

    def _chunks(self, text: str) -> list[str]:
        """A text without special tokens as its normalised pieces between white space; the pattern never spans white space."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Lower case is by character: a capital sigma at the end of a word is no exception.
        text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        return _SPACE.split(text) if _ODD_SPACE.search(text) else text.split()

    def _learn(self, chunks: list[str], into: dict[str, bytes]) -> None:
        found = [self.words.findall(c) for c in chunks]
        words = [w.encode("utf-8", "surrogatepass") for parts in found for w in parts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.plain[data]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.final[data[last]]
        ids, left = merge_all(symbols, lengths, self.table)
        # Bytes that end each chunk: after its last word.
        upto = np.concatenate(([0], np.cumsum(left)))[np.cumsum([0, *map(len, found)])] * 4
        flat, upto = ids.astype("<u4").tobytes(), upto.tolist()
        into.update(zip(chunks, map(flat.__getitem__, map(slice, upto, upto[1:])), strict=False))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut: list[list] = []
        for t in texts:
            parts = self.special_cut.split(t) if self.special_cut and "<" in t else [t]
            cut.append([self.special[p] if n % 2 else self._chunks(p) for n, p in enumerate(parts)])
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        seen, fresh = self.memory, {}
        for parts in cut:
            for p in parts:
                if isinstance(p, list):
                    fresh.update((c, None) for c in p if c not in seen)
        self._learn(list(fresh), fresh)
        for c, ids in fresh.items():
            if len(c) <= LONG_CHUNK:
                seen[c] = ids
        both = seen if all(c in seen for c in fresh) else _Either(seen, fresh)
        get = both.__getitem__
        return [b"".join(b"".join(map(get, p)) if isinstance(p, list) else int(p).to_bytes(4, "little") for p in parts) for parts in cut]

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8: the file names no decoder, so tokens are joined by single spaces."""
        return b" ".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Either:
    def __init__(self, a: dict, b: dict):
        self.a, self.b = a, b

    def __getitem__(self, key):
        got = self.a.get(key)
        return self.b[key] if got is None else got


_loaded: dict[int, WordBPE] = {}


def encode_decode(docs: DataFrame, spec: str, with_ids: bool = False) -> DataFrame:
    """Encode `docs` (doc_id, text) by the tokenizer file `spec` (its text) and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and with `with_ids` also ids (binary) and decoded (string).
    The file is broadcast: its size doesn't depend on the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _loaded:
            _loaded[key] = WordBPE(shared.value)
        bpe = _loaded[key]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = bpe.encode_batch(texts)
            decoded = [bpe.decode(x) for x in ids]
            columns = [
                batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in decoded])]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)

"""Quality score of whole texts by a factorisation machine.

Features of a text: its distinct words, hashed (each of value 1 / sqrt(number of them)), and one-hot bins of structure
statistics and of metadata derived from the text (lengths, line counts). The score is

    sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j),

with the pair sum in linear time as (|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2. Training is AdaGrad on mini-batches, on the
driver, on at most `SAMPLE` labelled texts (those with the smallest hash of their id), which is the only bound; scoring reads
every whole text and takes nothing else as input.

Defined edge cases: null and empty texts have the features of the empty text and are scored like any other; labels without a
value are ignored, of several labels of an id the largest counts; without labels of both kinds the score is the share of label 1
(one half without any); repeated rows get equal rows; an empty table gives an empty result; extra columns pass by.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, RANK, BUCKETS = 8_000, 8, 1 << 16
#: Passes over the sample, and updates at least.
EPOCHS, UPDATES, BATCH, RATE, DECAY = 8, 1_000, 32, 0.1, 1e-5
THRESHOLD = 0.7

#: Upper edges of the bins of each statistic.
_SHARES = np.array([0.0, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97, 0.9999])
_LENGTHS = 2.0 ** np.arange(0, 20)
_MEANS = np.arange(1.0, 20.0, 1.0)
#: Name and edges of each statistic, in the order of `statistics`.
FIELDS = [
    ("upper", _SHARES), ("digit", _SHARES), ("symbol", _SHARES), ("exclamation", _SHARES), ("pipe", _SHARES), ("other_bytes", _SHARES),
    ("distinct_words", _SHARES), ("repeats_previous", _SHARES), ("distinct_lines", _SHARES), ("stop_ends", _SHARES),
    ("word_length", _MEANS), ("words", _LENGTHS), ("lines", _LENGTHS), ("bytes", _LENGTHS),
]
_OFFSETS = BUCKETS + np.cumsum([0] + [len(e) + 1 for _, e in FIELDS])
DIMENSIONS = int(_OFFSETS[-1])

_BYTE = np.arange(256)
_UPPER, _DIGIT = (_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 48) & (_BYTE <= 57)
_LOWER, _SPACE = (_BYTE >= 97) & (_BYTE <= 122), np.isin(_BYTE, [32, 9, 10, 11, 12, 13])
_SYMBOL = (_BYTE < 128) & ~(_UPPER | _LOWER | _DIGIT | _SPACE) & ~np.isin(_BYTE, [ord(c) for c in ".,;:'\"-()?"])


def statistics(data: bytes, words: list[str], lines: list[str], distinct: int) -> list[float]:
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, count = max(1, len(data)), max(1, len(words))
    return [
        n[_UPPER].sum() / size, n[_DIGIT].sum() / size, n[_SYMBOL].sum() / size, n[33] / size, n[124] / size, n[128:].sum() / size,
        distinct / count, sum(map(eq, words, words[1:])) / count, len(set(lines)) / max(1, len(lines)), n[46] / count,
        (size - n[_SPACE].sum()) / count, len(words), len(lines), len(data),
    ]


def features(text: str | None) -> tuple[np.ndarray, int]:
    """Indices of the features that a text has: hashed words first; and how many of those there are."""
    text = text or ""
    words = text.split()
    distinct = set(words)
    hashed = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in distinct), np.int64, len(distinct)) & (BUCKETS - 1)
    hashed.sort()
    stats = statistics(text.encode("utf-8", "surrogatepass"), words, text.split("\n"), len(distinct))
    bins = [o + int(np.searchsorted(e, v)) for o, (_, e), v in zip(_OFFSETS, FIELDS, stats, strict=False)]
    return np.concatenate((hashed, np.array(bins, np.int64))), len(distinct)


def values(n_features: int, n_words: int) -> np.ndarray:
    x = np.full(n_features, 1.0 / np.sqrt(len(FIELDS)))
    x[:n_words] = 1.0 / np.sqrt(max(1, n_words))
    return x


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def __post_init__(self):
        self.norms = (self.factor**2).sum(1)

    def score(self, text: str | None) -> float:
        at, n = features(text)
        x = values(len(at), n)
        s = x @ self.factor[at]
        z = self.bias + x @ self.weight[at] + 0.5 * (s @ s - (x * x) @ self.norms[at])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(rows: list[tuple[np.ndarray, int, int]], seed: int = 11) -> Machine:
    """Train on (feature indices, number of words among them, label)."""
    rng = np.random.default_rng(seed)
    share = sum(y for _, _, y in rows) / len(rows) if rows else 0.5
    clipped = min(max(share, 1e-3), 1 - 1e-3)
    bias, w = float(np.log(clipped / (1 - clipped))), np.zeros(DIMENSIONS)
    v = np.zeros((DIMENSIONS, RANK))
    if share in (0.0, 1.0) or not rows:
        return Machine(bias, w, v)
    used = np.unique(np.concatenate([a for a, _, _ in rows]))  # what was never seen stays neutral
    v[used] = rng.normal(0, 0.05, (len(used), RANK))
    gw, gv, gb = np.full(DIMENSIONS, 1e-2), np.full((DIMENSIONS, RANK), 1e-2), 1e-2
    parts = max(1, len(rows) // BATCH)
    for _ in range(max(EPOCHS, -(-UPDATES // parts))):
        for at in np.array_split(rng.permutation(len(rows)), parts):
            idx = np.concatenate([rows[i][0] for i in at])
            x = np.concatenate([values(len(rows[i][0]), rows[i][1]) for i in at])[:, None]
            n = np.array([len(rows[i][0]) for i in at])
            start = np.cumsum(n) - n
            own = np.repeat(np.arange(len(at)), n)
            vx = v[idx] * x
            s = np.add.reduceat(vx, start)
            pair = 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), start))
            z = bias + np.add.reduceat(w[idx] * x[:, 0], start) + pair
            y = np.array([rows[i][2] for i in at])
            err = ((1 / (1 + np.exp(-np.clip(z, -40, 40)))) - y) / len(at)
            touched, where = np.unique(idx, return_inverse=True)
            dw, dv = np.zeros(len(touched)), np.zeros((len(touched), RANK))
            np.add.at(dw, where, err[own] * x[:, 0])
            np.add.at(dv, where, err[own][:, None] * (x * (s[own] - vx)))
            dw += DECAY * w[touched]
            dv += DECAY * v[touched]
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            w[touched] -= RATE * dw / np.sqrt(gw[touched])
            v[touched] -= RATE * dv / np.sqrt(gv[touched])
            db = float(err.sum())
            gb += db * db
            bias -= RATE * db / gb**0.5
    return Machine(bias, w, v)


def held_out(modulus: int = 4, remainder: int = 2) -> F.Column:
    """Whether crc32 of the id as text leaves `remainder`."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [features(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([a.astype("<i4").tobytes() for a, _ in made], pa.binary()), pa.array([n for _, n in made], pa.int32()), batch.column(2)],
            names=["doc_id", "at", "n", "label"],
        )


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from `docs` (doc_id, text) and `labels` (doc_id, quality) that aren't held out."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    got = rows.mapInArrow(_featurise, "doc_id long, at binary, n int, label int").collect()
    made = {r["doc_id"]: (np.frombuffer(r["at"], "<i4").astype(np.int64), r["n"], r["label"]) for r in sorted(got, key=lambda r: (r["doc_id"], bytes(r["at"])))}
    return fit(list(made.values()))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """`docs` (doc_id, text) scored: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

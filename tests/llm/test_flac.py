import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from lamina.llm import flac


def payloads():
    rng = random.Random(3)
    texts = ["", "a", "x" * 192, "y" * 193, None, "é" * 400, "ab" * 5000, "The quick brown fox. " * 300]
    out = [flac.payload(t)[0] for t in texts]
    out += [bytes(rng.randrange(256) for _ in range(192 * k)) for k in (1, 2, 3, 4, 7)]
    out.append(bytes(int(128 + 60 * math.sin(i / 9) + rng.gauss(0, 2)) for i in range(192 * 9)))
    out.append(bytes(int(128 + 100 * math.sin(i / 40)) for i in range(576 * 3)))
    return out


def test_round_trip_and_both_decoders():
    given = payloads()
    streams = flac.encode(given)
    assert flac.decode(streams) == given
    for p, s in zip(given, streams, strict=True):
        assert (np.frombuffer(flac.decode_plain(flac.Stream(s)), np.uint8) ^ 0x80).tobytes() == p
        assert flac.encode([p]) == [s]  # whatever stands beside it


def test_every_kind_of_subframe_is_written():
    kinds = set()
    for s in flac.encode(payloads()):
        st = flac.Stream(s)
        for _, offset, _ in st.points:
            at = st.first_frame + int(offset)
            head = 4 + 1 + (2 if s[at + 2] >> 4 == 7 else 0)
            kinds.add((s[at + head + 1] >> 1) & 0x3F)
    assert {0, 1, 32 + flac.LPC_ORDER - 1} <= kinds and any(8 <= k <= 12 for k in kinds)


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def rice(self, r, k):
        u = (r << 1) if r >= 0 else (-r << 1) - 1
        self.bits += [0] * (u >> k) + [1]
        self.put(u & ((1 << k) - 1), k)

    def bytes(self):
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()


def hand_made(samples, kind, order, seek=True, escape=False):
    """One frame of 192 samples with a fixed predictor of any order, Rice parameter 3 or an escaped partition."""
    w = Writer()
    w.put(0xFFF8, 16)
    w.put(1, 4), w.put(0, 4), w.put(0, 4), w.put(1, 3), w.put(0, 1), w.put(0, 8)
    crc = lambda table: int(flac._crc(np.frombuffer(w.bytes(), np.uint8), np.array([0]), np.array([len(w.bits) // 8]), table)[0])
    w.put(crc(flac._CRC8), 8)
    w.put(kind << 1, 8)
    for x in samples[:order]:
        w.put(x & 0xFF, 8)
    w.put(0, 2), w.put(0, 4), w.put(15 if escape else 3, 4)
    if escape:
        w.put(16, 5)
    d = np.array(samples)
    for _ in range(order):
        d = np.diff(d)
    for r in d.tolist():
        w.put(r & 0xFFFF, 16) if escape else w.rice(r, 3)
    w.bits += [0] * (-len(w.bits) % 8)
    w.put(crc(flac._CRC16), 16)
    raw = np.array(samples, np.int8).tobytes()
    s = flac._stream([w.bytes()], raw)
    return s if seek else s[:42].replace(b"fLaC\x00", b"fLaC\x80", 1) + s[flac.Stream(s).first_frame :]


@pytest.mark.parametrize("order", range(5))
@pytest.mark.parametrize(("seek", "escape"), [(True, False), (False, False), (True, True)])
def test_foreign_streams(order, seek, escape):
    samples = [int(50 * math.sin(i / 20)) for i in range(192)]
    s = hand_made(samples, 8 + order, order, seek, escape)
    assert np.frombuffer(flac.decode([s])[0], np.uint8).astype(int).tolist() == [x + 128 for x in samples]


def test_damage_is_noticed():
    s = bytearray(flac.encode([b"some text. " * 192])[0])
    st = flac.Stream(bytes(s))
    for at, what in ((st.first_frame + 4, "CRC-8"), (st.first_frame + 60, "CRC-16"), (30, "MD5")):
        bad = s.copy()
        bad[at] ^= 1
        with pytest.raises(ValueError, match=what):
            flac.decode([bytes(bad)])
    with pytest.raises(ValueError):
        flac.encode([b"short"])


def test_query(docs):
    rows = [(1, "hello"), (2, None), (3, ""), (4, "é" * 30_000), (5, "hello"), (6, "x" * 192)]
    got = {r["doc_id"]: r for r in flac.describe(flac.store(docs(rows))).collect()}
    for i, t in rows:
        data = (t or "").encode()
        padded = data + b" " * (192 - len(data) if not data else -len(data) % 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        stored = flac.encode([padded])[0]
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert [got[1][c] for c in ("media_sha256", "feature")] == [got[5][c] for c in ("media_sha256", "feature")]
    assert flac.describe(flac.store(docs([]))).collect() == []


def test_pcm_blocks(spark, docs):
    media = flac.store(docs([(1, "abc" * 1000), (2, "z")])).select("doc_id", "media").union(spark.createDataFrame([(3, None)], "doc_id long, media binary"))
    blocks = flac.pcm_blocks(media, 1000).orderBy("doc_id", "first_sample").collect()
    assert b"".join(bytes(b["pcm"]) for b in blocks if b["doc_id"] == 1) == flac.payload("abc" * 1000)[0]
    assert [(b["block"], b["first_sample"], b["samples"]) for b in blocks if b["doc_id"] == 1] == [(0, 0, 1000), (1, 1000, 1000), (2, 2000, 1000), (3, 3000, 72)]
    assert {b["doc_id"] for b in blocks} == {1, 2}


def test_long_streams_in_parts(monkeypatch):
    given = payloads()
    streams = flac.encode(given)
    monkeypatch.setattr(flac, "GROUP_SAMPLES", 1000)
    assert flac.decode(streams) == given and flac.encode(given) == streams
    parts = [i for i, _ in flac.decode_parts(streams)]
    assert parts == sorted(parts) and len(parts) > len(given)
    with pytest.raises(ValueError, match="MD5"):
        flac.decode([streams[6][:30] + bytes([streams[6][30] ^ 1]) + streams[6][31:]])


def test_more_blocks_than_a_seek_table_names(monkeypatch):
    monkeypatch.setattr(flac, "MAX_POINTS", 8)
    given = [bytes(int(128 + 90 * math.sin(i / 30)) for i in range(192 * k)) for k in (96, 97, 200)]
    streams = flac.encode(given)
    assert [flac.Stream(s).block for s in streams] == [2304, 4608, 4608] and all(flac.Stream(s).whole() for s in streams)
    assert flac.decode(streams) == given
    assert [(np.frombuffer(flac.decode_plain(flac.Stream(s)), np.uint8) ^ 0x80).tobytes() for s in streams] == given


def test_seek():
    rng = random.Random(5)
    foreign = hand_made([int(50 * math.sin(i / 20)) for i in range(192)], 10, 2, seek=False)
    for s in [*flac.encode(payloads()), foreign]:
        p = flac.decode([s])[0]
        for _ in range(20):
            first, count = rng.randrange(len(p) + 5), rng.randrange(2000)
            assert flac.decode_range(s, first, count) == p[first : first + count]


def plain_feature(data):
    x = [b - 128 for b in data]
    return f"sum={sum(x)};squares={sum(v * v for v in x)};peak={max(map(abs, x))};crossings={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))}"


@pytest.mark.parametrize("samples", [192, 1000, 1 << 16])
def test_described_from_the_blocks(spark, docs, samples, tmp_path):
    texts = ["hello", None, "é" * 3000, "x" * 192, "abc" * 1000, "abc" * 1000, "", "\x00\x7f" * 700]
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(0, "another under the same id")]
    media = flac.store(docs(rows)).union(spark.createDataFrame([(77, 5, None)], "doc_id long, n_bytes long, media binary"))
    got = sorted((tuple(r) for r in flac.describe(media, samples).collect()), key=str)
    want = [(77, 5, *[None] * 6)]
    for i, t in rows:
        data = (t or "").encode()
        padded = flac.payload(t)[0]
        stored = flac.encode([padded])[0]
        want.append((i, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), plain_feature(padded)))
    assert got == sorted(want, key=str)
    flac.pcm_blocks(media, samples).write.parquet(str(tmp_path / "pcm"))
    blocks = spark.read.parquet(str(tmp_path / "pcm"))
    whole = flac.payload("é" * 3000)[0]
    for first, count in ((0, 10), (191, 2), (777, 3000), (5900, 1000), (9000, 5)):
        assert flac.pcm_slice(blocks, 2, first, count) == whole[first : first + count]

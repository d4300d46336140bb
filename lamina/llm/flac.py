"""Media columns in FLAC: 8-bit mono streams, encoded and decoded many frames at a time.

A text's bytes are the samples of one stream. `store` encodes them, `pcm_blocks` decodes stored streams to blocks of samples with their
offsets, and `describe` writes streams to a table, reads them back and derives digests and a feature from the blocks. `pcm_slice` and
`decode_range` read some samples of one stream, by the offsets of blocks and by seek points.

Encoder: blocks of 2304 samples, each with the best of constant, verbatim, fixed predictors of order 0 to 2 and a quantised linear
predictor of order 4 (autocorrelation, Levinson-Durbin), residuals Rice-coded in four partitions. A seek point for every frame
gives the byte offset of every sample (blocks are of 4608 samples where a seek table could not name as many of 2304); frames carry CRC-8 of the header and CRC-16, the stream MD5 of the samples.

Decoder: the frames of many streams are read together. A table of the next one bit finds the end of any unary code in one
look-up, so each step reads one Rice code of every frame; linear predictors are undone one sample of every frame at a time.
Both checksums of every frame and the MD5 of every stream are verified. A long stream is decoded some frames at a time, so memory holds
the stream itself and about 40 bytes for each of `GROUP_SAMPLES` samples. Streams with other features (no seek points, other
block sizes, escaped partitions, wasted bits) are decoded frame by frame by `decode_plain`; both give the same samples.

Defined edge cases: null and empty texts are one run of 192 spaces; a text of any length is stored whole; a stored stream that
is null gives no blocks and a description of nulls, a damaged one raises `ValueError` naming what failed; rows with null or shared ids
are streams of their own; equal texts give equal streams, wherever they stand;
an empty table gives an empty result; extra columns pass by.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.session import materialize

UNIT, BLOCK, LONG_BLOCK, RATE = 192, 2_304, 4_608, 8_000
#: Seek points that a seek table has room for (18 bytes each, its size in 24 bits).
MAX_POINTS = ((1 << 24) - 1) // 18
LPC_ORDER, PRECISION, PARTITION_ORDER, MAX_RICE = 4, 10, 2, 14
#: Samples encoded or decoded together: about 40 bytes of memory each.
GROUP_SAMPLES = 1 << 20
#: Samples of a PCM block, and about how many bytes are put together in a batch.
PCM_SAMPLES, BATCH_BYTES = 1 << 16, 4 << 20

_CODES = {192: (1, 0), 576: (2, 0), 1152: (3, 0), 2304: (4, 0), 4608: (5, 0)}  # block size: code, bits of the size in the header; else (7, 16)


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for b in range(256):
        r = b << (bits - 8)
        for _ in range(8):
            r = ((r << 1) ^ poly if r & top else r << 1) & mask
        out.append(r)
    return np.array(out, np.uint16 if bits == 16 else np.uint8)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(data: np.ndarray, start: np.ndarray, size: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRCs of the byte ranges of `data`, one byte of every range at a time, longest ranges first."""
    order = np.argsort(-size, kind="stable")
    at, length = start[order], size[order]
    crc = np.zeros(len(order), table.dtype)
    wide = table.dtype == np.uint16
    live = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
    for t, n in enumerate(live.tolist()):
        byte = data[at[:n] + t]
        c = crc[:n]
        crc[:n] = (c << np.uint16(8)) ^ table[(c >> np.uint16(8)) ^ byte] if wide else table[c ^ byte]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: np.ndarray | int) -> None:
    """Write `value` into `bits` (one byte for each bit), `width` bits from position `at`."""
    if isinstance(width, int):
        for b in range(width):
            bits[at + b] = (value >> (width - 1 - b)) & 1
        return
    for b in range(int(width.max()) if width.size else 0):
        on = width > b
        bits[at[on] + b] = (value[on] >> (width[on] - 1 - b)) & 1


def _coded_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the extended UTF-8 form, as values and their widths in bits."""
    value, width = n.astype(np.int64), np.full(len(n), 8, np.int64)
    for extra, most in enumerate((1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31), start=1):
        on = n >= (0x80, 1 << 11, 1 << 16, 1 << 21, 1 << 26)[extra - 1]
        if not on.any():
            break
        v, m = n.astype(np.int64), np.zeros(len(n), np.int64)
        for k in range(extra):
            m |= (0x80 | ((v >> (6 * k)) & 0x3F)) << (8 * k)
        lead = (0xFF << (7 - extra)) & 0xFF
        value = np.where(on, m | ((lead | (v >> (6 * extra))) << (8 * extra)), value)
        width = np.where(on, 8 * (extra + 1), width)
    return value, width


def _linear_predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (n, LPC_ORDER) and shifts (n,) for the rows of x."""
    n, length = x.shape
    f = x.astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", f[:, lag:], f[:, : length - lag]) for lag in range(LPC_ORDER + 1)], 1).astype(np.float64)
    err = r[:, 0] + 1e-9
    a = np.zeros((n, LPC_ORDER))
    for i in range(LPC_ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = err * np.maximum(1e-12, 1 - k * k)
    most = np.maximum(np.abs(a).max(1), 1e-9)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(most)), 0, 15).astype(np.int64)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int32), shift.astype(np.int32)


def _encode_frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of the rows of x (samples): their bytes one after the other, and the size of each."""
    n, length = x.shape
    parts = 1 << PARTITION_ORDER
    first, second = np.zeros_like(x), np.zeros_like(x)
    first[:, 1:] = x[:, 1:] - x[:, :-1]
    second[:, 2:] = first[:, 2:] - first[:, 1:-1]
    coef, shift = _linear_predictors(x)
    guess = np.zeros((n, length - LPC_ORDER), np.int32)
    for j in range(LPC_ORDER):
        guess += coef[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : length - 1 - j]
    fourth = np.zeros_like(x)
    fourth[:, LPC_ORDER:] = x[:, LPC_ORDER:] - (guess >> shift[:, None])
    residuals = (x, first, second, fourth)
    warm = np.array([0, 1, 2, LPC_ORDER])
    # Sizes of the residuals decide; a linear predictor also has to earn its coefficients.
    weight = np.stack([np.abs(r[:, LPC_ORDER:]).sum(1) for r in residuals], 1).astype(np.float64)
    weight[:, 3] *= 1.02
    kind = weight.argmin(1)
    r = np.choose(kind[:, None], residuals)
    order = warm[kind]
    u = ((r << 1) ^ (r >> 31)).astype(np.int32)
    u[np.arange(length) < order[:, None]] = 0
    per = length // parts
    by_part = u.reshape(n, parts, per)
    counts = np.full((n, parts), per, np.int64)
    counts[:, 0] -= order
    # Parameters 0 .. 9 are enough for residuals of 8-bit samples.
    cost = np.stack([(by_part >> k).sum(2) + (k + 1) * counts for k in range(10)])
    rice = cost.argmin(0)
    body = cost.min(0).sum(1) + 4 * parts + 6 + 8 * order + np.where(kind == 3, 9 + PRECISION * LPC_ORDER, 0)
    constant = x.max(1) == x.min(1)
    verbatim = ~constant & (body >= 8 * length)
    raw = np.where(constant, 1, np.where(verbatim, length, order))
    coded = ~(constant | verbatim)
    body = np.where(coded, body, 8 * raw)

    code, extra = _CODES.get(length, (7, 16))
    num, num_bits = _coded_number(number)
    header = 32 + num_bits + extra + 8
    total = (header + 8 + body + 7) // 8 + 2
    begin = np.cumsum(total) - total
    bits = np.zeros(int(total.sum()) * 8, np.uint8)
    at = begin * 8
    _put(bits, at, np.full(n, (0xFFF8 << 16) | (code << 12) | (0b0010), np.int64), 32)
    _put(bits, at + 32, num, num_bits)
    if extra:
        _put(bits, at + 32 + num_bits, np.full(n, length - 1, np.int64), extra)
    at = at + header
    types = np.where(constant, 0, np.where(verbatim, 1, np.where(kind == 3, 32 + LPC_ORDER - 1, 8 + kind)))
    _put(bits, at, types << 1, 8)
    at = at + 8
    for t in range(int(raw.max())):
        on = raw > t
        _put(bits, at[on] + 8 * t, x[on, t] & 0xFF, 8)
    at = at + 8 * raw
    lpc = coded & (kind == 3)
    if lpc.any():
        where = at[lpc]
        _put(bits, where, np.full(len(where), PRECISION - 1), 4)
        _put(bits, where + 4, shift[lpc], 5)
        for j in range(LPC_ORDER):
            _put(bits, where + 9 + PRECISION * j, coef[lpc, j], PRECISION)
    at = at + np.where(lpc, 9 + PRECISION * LPC_ORDER, 0)
    if coded.any():
        at, u, rice, order = at[coded], u[coded], rice[coded], order[coded]
        _put(bits, at + 2, np.full(len(at), PARTITION_ORDER), 4)
        k = np.repeat(rice, per, axis=1)
        size = (u >> k) + 1 + k
        size[np.arange(length) < order[:, None]] = 0
        size[:, ::per] += 4
        end = np.cumsum(size, axis=1) + (at + 6)[:, None]
        starts = (end - size)[:, ::per]
        _put(bits, starts.ravel(), rice.ravel(), 4)
        keep = np.arange(length) >= order[:, None]
        k, u, end = k[keep], u[keep], end[keep]
        _put(bits, end - 1 - k, (1 << k) | (u & ((1 << k) - 1)), k + 1)
    data = np.packbits(bits)
    head = header // 8 - 1
    data[begin + head] = _crc(data, begin, head, _CRC8)
    crc = _crc(data, begin, total - 2, _CRC16)
    data[begin + total - 2], data[begin + total - 1] = crc >> 8, crc & 0xFF
    return data, total


def encode(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads, whose sizes are positive multiples of UNIT; a byte b is the sample b - 128."""
    lengths = np.fromiter(map(len, payloads), np.int64, len(payloads))
    if ((lengths <= 0) | (lengths % UNIT != 0)).any():
        raise ValueError(f"payloads must have a positive multiple of {UNIT} bytes")
    joined = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8)
    start = np.cumsum(lengths) - lengths
    block = np.where(lengths > MAX_POINTS * BLOCK, LONG_BLOCK, BLOCK)
    per_doc = -(-lengths // block)
    doc = np.repeat(np.arange(len(payloads)), per_doc)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    size = np.minimum(block[doc], lengths[doc] - number * block[doc])
    frames: list = [b""] * len(doc)
    for length in np.unique(size).tolist():
        ids = np.flatnonzero(size == length)
        step = max(1, GROUP_SAMPLES // length)
        for a in range(0, len(ids), step):
            group = ids[a : a + step]
            x = joined[(start[doc[group]] + number[group] * block[doc[group]])[:, None] + np.arange(length)].astype(np.int32)
            data, total = _encode_frames(x, number[group])
            data, ends = data.tobytes(), np.cumsum(total).tolist()
            for f, s, e in zip(group.tolist(), [0, *ends], ends, strict=False):
                frames[f] = data[s:e]
    out, at = [], 0
    for p, n in zip(payloads, per_doc.tolist(), strict=True):
        own = frames[at : at + n]
        at += n
        out.append(_stream(own, joined[start[len(out)] : start[len(out)] + len(p)].tobytes(), int(block[len(out)])))
    return out


def _stream(frames: list[bytes], samples: bytes, block: int = BLOCK) -> bytes:
    sizes = [len(f) for f in frames]
    blocks = min(block, len(samples))
    packed = (RATE << 44) | (0 << 41) | (7 << 36) | len(samples)
    info = (
        blocks.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big")
        + hashlib.md5(samples, usedforsecurity=False).digest()
    )
    points = np.zeros(len(frames), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
    points["sample"] = np.arange(len(frames)) * block
    points["offset"] = np.cumsum([0, *sizes[:-1]])
    points["count"] = np.minimum(block, len(samples) - points["sample"].astype(np.int64))
    table = points.tobytes()
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames)


class Stream:
    """The metadata of a stream: where its frames begin, its seek points, and what its samples must be."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.points = 4, False, np.zeros((0, 3), np.int64)
        while not last:
            last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            block = data[at + 4 : at + 4 + size]
            if kind == 0:
                packed = int.from_bytes(block[10:18], "big")
                self.block = int.from_bytes(block[2:4], "big")
                self.channels, self.bits, self.samples, self.md5 = ((packed >> 41) & 7) + 1, ((packed >> 36) & 31) + 1, packed & ((1 << 36) - 1), block[18:34]
            elif kind == 3:
                p = np.frombuffer(block, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
                p = p[p["sample"] != 0xFFFFFFFFFFFFFFFF]
                self.points = np.stack([p["sample"].astype(np.int64), p["offset"].astype(np.int64), p["count"].astype(np.int64)], 1)
            at += 4 + size
        self.first_frame, self.data = at, data

    def whole(self) -> bool:
        """Whether seek points cover every sample, frame by frame."""
        p = self.points
        return bool(self.channels == 1 and self.bits == 8 and len(p) and p[0, 0] == 0 and p[0, 1] == 0 and (p[1:, 0] == p[:-1, 0] + p[:-1, 2]).all() and p[-1, 0] + p[-1, 2] == self.samples)


    def part(self, a: int, b: int) -> Stream:
        """Frames a .. b - 1 by the seek points, for `_decode_group`."""
        ends = [*self.points[:, 1].tolist(), len(self.data) - self.first_frame]
        p = object.__new__(Stream)
        p.data, p.first_frame, p.points = self.data[self.first_frame + ends[a] : self.first_frame + ends[b]], 0, self.points[a:b] - [0, ends[a], 0]
        return p


def decode_parts(streams: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(place of the stream, payload bytes) of 8-bit mono streams in order, long ones in several parts, verified against every checksum
    that they carry; the last part of a stream comes after the test of its MD5."""
    opened = [Stream(s) for s in streams]
    at = 0
    while at < len(opened):
        end, total = at, 0
        while end < len(opened) and opened[end].whole() and (end == at or total + opened[end].samples <= GROUP_SAMPLES):
            total += opened[end].samples
            end += 1
        if end == at:
            found = [decode_plain(opened[at])]
        elif total > GROUP_SAMPLES:
            yield from ((at, samples) for samples in _long_parts(opened[at]))
            found = []
        else:
            found = [p if p is not None else decode_plain(s) for s, p in zip(opened[at:end], _decode_group(opened[at:end]), strict=True)]
        for i, samples in enumerate(found, at):
            if hashlib.md5(samples, usedforsecurity=False).digest() != opened[i].md5:
                raise ValueError("MD5 of the samples differs")
            yield i, _payload(samples)
        at = max(end, at + 1)


def _payload(samples: bytes) -> bytes:
    return (np.frombuffer(samples, np.uint8) ^ 0x80).tobytes()


def _long_parts(s: Stream) -> Iterator[bytes]:
    md5, done, held = hashlib.md5(usedforsecurity=False), 0, b""
    step = max(1, GROUP_SAMPLES // int(s.points[:, 2].max()))
    for a in range(0, len(s.points), step):
        samples = _decode_group([s.part(a, min(a + step, len(s.points)))])[0]
        if samples is None:  # a frame that uses what the fast decoder doesn't
            samples = decode_plain(s)[done:]
        if held:
            yield _payload(held)
        held, done = samples, done + len(samples)
        md5.update(held)
        if done == s.samples:
            break
    if md5.digest() != s.md5:
        raise ValueError("MD5 of the samples differs")
    yield _payload(held)


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload bytes of 8-bit mono streams, verified against every checksum they carry."""
    parts: list[list[bytes]] = [[] for _ in streams]
    for i, samples in decode_parts(streams):
        parts[i].append(samples)
    return [b"".join(p) for p in parts]


def decode_range(stream: bytes, first: int, count: int) -> bytes:
    """Payload bytes first .. first + count - 1, from the frames that hold them only; their checksums are verified, not the MD5."""
    s = Stream(stream)
    first, end = max(0, first), min(s.samples, first + count)
    if first >= end:
        return b""
    if s.whole():
        a, b = int(np.searchsorted(s.points[:, 0], first, "right")) - 1, int(np.searchsorted(s.points[:, 0], end, "left"))
        samples, skip = _decode_group([s.part(a, b)])[0], int(s.points[a, 0])
        if samples is not None:
            return _payload(samples[first - skip : end - skip])
    return _payload(decode_plain(s)[first:end])


def _decode_group(streams: list[Stream]) -> list[bytes | None]:
    """Samples (signed bytes) of streams whose seek points name every frame; None for one that needs `decode_plain`."""
    data = np.frombuffer(b"".join(s.data for s in streams) + b"\0" * 16, np.uint8)
    base = np.cumsum([0, *(len(s.data) for s in streams)])
    counts = np.array([len(s.points) for s in streams])
    owner = np.repeat(np.arange(len(streams)), counts)
    begin = np.concatenate([s.points[:, 1] + s.first_frame for s in streams]) + base[owner]
    length = np.concatenate([s.points[:, 2] for s in streams])
    stop = np.concatenate((begin[1:], [0]))
    last = np.cumsum(counts) - 1
    stop[last] = base[1:]
    plain = np.zeros(len(begin), bool)

    # Headers.
    if ((data[begin] != 0xFF) | (data[begin + 1] != 0xF8)).any():
        raise ValueError("a frame doesn't begin where its seek point says")
    code, lead = data[begin + 2] >> 4, data[begin + 4]
    ones = np.array([next((i for i in range(8) if not (b << i) & 0x80), 8) for b in range(256)])
    number_bytes = np.maximum(1, ones[lead])
    head = 4 + number_bytes + np.where(code == 7, 2, np.where(code == 6, 1, 0))
    if (_crc(data, begin, head, _CRC8) != data[begin + head]).any():
        raise ValueError("CRC-8 of a frame header differs")
    crc = _crc(data, begin, stop - begin - 2, _CRC16)
    if (crc != (data[stop - 2].astype(np.uint16) << 8 | data[stop - 1])).any():
        raise ValueError("CRC-16 of a frame differs")
    sub = data[begin + head + 1]
    kind = (sub >> 1) & 0x3F
    order = np.where(kind >= 32, kind.astype(np.int64) - 31, np.where((kind >= 8) & (kind <= 12), kind.astype(np.int64) - 8, 0))
    constant, verbatim = kind == 0, kind == 1
    coded = ~(constant | verbatim)
    plain |= (sub & 1) != 0
    at = (begin + head + 2) * 8

    longest = int(length.max())
    x = np.zeros((longest, len(begin)), np.int32)  # a row for each sample position, a column for each frame
    signed = data.view(np.int8)
    raw = np.where(constant, 1, np.where(verbatim, length, order))
    for t in range(int(raw.max())):
        on = np.flatnonzero(raw > t)
        x[t, on] = signed[(at[on] >> 3) + t]
    x[:, constant] = x[0, constant]
    at = at + 8 * raw

    def take(where: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        i = where >> 3
        word = (data[i].astype(np.uint32) << 24) | (data[i + 1].astype(np.uint32) << 16) | (data[i + 2].astype(np.uint32) << 8) | data[i + 3]
        return ((word >> (32 - (where & 7) - width).astype(np.uint32)) & ((np.uint32(1) << np.asarray(width, np.uint32)) - np.uint32(1))).astype(np.int64)

    lpc = np.flatnonzero(kind >= 32)
    coef, shift, width = np.zeros((32, len(begin)), np.int32), np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    if len(lpc):
        width[lpc] = take(at[lpc], 4) + 1
        shift[lpc] = take(at[lpc] + 4, 5)
        plain[lpc] |= shift[lpc] >= 16
        for j in range(int(order[lpc].max())):
            on = lpc[order[lpc] > j]
            c = take(at[on] + 9 + width[on] * j, width[on])
            coef[j, on] = c - ((c >> (width[on] - 1)) << width[on])
        at[lpc] += 9 + width[lpc] * order[lpc]

    # Rice codes: frames by falling length, so those that still run are the first ones.
    live = np.flatnonzero(coded & ~plain)
    live = live[np.argsort(-length[live], kind="stable")]
    if len(live):
        method, parts = take(at[live], 2), take(at[live] + 2, 4)
        plain[live] |= method != 0
        per = length[live] >> parts
        pos, own_order, own_length = at[live] + 6, order[live], length[live]
        one = np.flatnonzero(np.unpackbits(data)).astype(np.int32)
        # For every bit the place of the next one bit, itself included.
        next_one = np.repeat(np.append(one, one[-1]), np.diff(one, prepend=-1, append=len(data) * 8 - 1))
        k = np.zeros(len(live), np.int64)
        ends = np.zeros((longest, len(live)), np.int32)
        starts = np.zeros((longest, len(live)), np.int32)
        ks = np.zeros((longest, len(live)), np.uint8)
        running = np.searchsorted(-own_length, -np.arange(longest), side="left").tolist()
        steps = set()
        for p in np.unique(per).tolist():
            steps.update(range(0, longest, max(1, p)))
        some = int(own_order.max())
        for t in range(longest):
            n = running[t]
            if t in steps:
                new = np.flatnonzero(t % per[:n] == 0)
                k[new] = take(pos[new], 4)
                pos[new] += 4
            if t < some:
                on = np.flatnonzero(own_order[:n] <= t)
                p = pos[on]
                e = next_one[p]
                starts[t, on], ends[t, on], ks[t, on] = p, e, k[on]
                pos[on] = e + 1 + k[on]
            else:
                p = pos[:n]
                e = next_one[p]
                starts[t, :n], ends[t, :n], ks[t, :n] = p, e, k[:n]
                pos[:n] = e + 1 + k[:n]
        plain[live] |= (ks == 15).any(0)
        after = ends + 1
        i = after >> 3
        word = (data[i].astype(np.uint32) << 16) | (data[i + 1].astype(np.uint32) << 8) | data[i + 2]
        low = (word >> (24 - (after & 7) - ks).astype(np.uint32)) & ((np.uint32(1) << ks.astype(np.uint32)) - np.uint32(1))
        u = ((ends - starts) << ks) | low.astype(np.int32)
        r = (u >> 1) ^ -(u & 1)
        t = np.arange(longest)[:, None]
        x[:, live] = np.where((t >= own_order) & (t < own_length), r, x[:, live])
    # Predictors.
    for o in range(1, 5):
        on = np.flatnonzero(kind == 8 + o)
        if len(on):
            d = x[:, on].copy()
            for j in range(1, o):  # warm-up samples become differences, each order from the one below
                d[j:o] -= x[j - 1 : o - 1, on] if j == 1 else 0
                if j > 1:
                    d[j:o] = np.diff(d[j - 1 : o], axis=0)
            for j in range(o - 1, -1, -1):
                d[j:] = np.cumsum(d[j:], axis=0, dtype=np.int32)
            x[:, on] = d
    for o in np.unique(order[lpc]).tolist():
        on = lpc[order[lpc] == o]
        y, c, s = x[:, on], coef[:o, on], shift[on].astype(np.int32)
        for t in range(o, longest):
            y[t] += (c * y[t - o : t][::-1]).sum(0, dtype=np.int32) >> s
        x[:, on] = y
    samples = x.astype(np.int8).T
    out: list[bytes | None] = []
    at = 0
    for n in counts.tolist():
        rows = range(at, at + n)
        at += n
        out.append(None if plain[rows.start : rows.stop].any() else b"".join(samples[f, : length[f]].tobytes() for f in rows))
    return out


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        end = self.at + n
        word = int.from_bytes(self.data[self.at >> 3 : (end + 7) >> 3], "big")
        self.at = end
        return (word >> (-end & 7)) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def decode_plain(s: Stream) -> bytes:
    """Samples (signed bytes) of an 8-bit mono stream, one frame after the other."""
    if s.channels != 1 or s.bits != 8:
        raise ValueError("only 8-bit mono streams are supported")
    out, at = [], s.first_frame
    while sum(map(len, out)) < s.samples:
        bits = _Bits(s.data, at * 8)
        if bits.take(15) != 0x7FFC:
            raise ValueError("no frame where one must begin")
        bits.take(1)
        code, rate = bits.take(4), bits.take(4)
        bits.take(8)
        lead = bits.take(8)
        bits.take(8 * max(0, next((i for i in range(8) if not (lead << i) & 0x80), 8) - 1))
        size = {1: 192, 6: -1, 7: -2}.get(code) or (576 << (code - 2) if code < 6 else 256 << (code - 8))
        if size < 0:
            size = bits.take(-8 * size) + 1
        bits.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
        head = bits.at // 8
        if bits.take(8) != int(_crc(np.frombuffer(s.data, np.uint8), np.array([at]), np.array([head - at]), _CRC8)[0]):
            raise ValueError("CRC-8 of a frame header differs")
        out.append(_subframe(bits, size).astype(np.int8).tobytes())
        end = (bits.at + 7) // 8
        if int.from_bytes(s.data[end : end + 2], "big") != int(_crc(np.frombuffer(s.data, np.uint8), np.array([at]), np.array([end - at]), _CRC16)[0]):
            raise ValueError("CRC-16 of a frame differs")
        at = end + 2
    return b"".join(out)[: s.samples]


def _subframe(bits: _Bits, size: int, depth: int = 8) -> np.ndarray:
    bits.take(1)
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    depth -= wasted
    if kind == 0:
        return np.full(size, bits.signed(depth) << wasted)
    if kind == 1:
        return np.array([bits.signed(depth) for _ in range(size)]) << wasted
    order = kind - 31 if kind >= 32 else kind - 8
    x = [bits.signed(depth) for _ in range(order)]
    if kind >= 32:
        width, shift = bits.take(4) + 1, bits.signed(5)
        coef = [bits.signed(width) for _ in range(order)]
    else:
        coef, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
    wide, parts = 4 + bits.take(2), bits.take(4)
    for p in range(1 << parts):
        k, n = bits.take(wide), (size >> parts) - (order if p == 0 else 0)
        escaped = bits.take(5) if k == (1 << wide) - 1 else None
        for _ in range(n):
            if escaped is None:
                u = bits.unary()
                u = (u << k) | bits.take(k)
                r = (u >> 1) ^ -(u & 1)
            else:
                r = bits.signed(escaped)
            x.append(r + (sum(c * v for c, v in zip(coef, reversed(x), strict=False)) >> shift))
    return np.array(x) << wasted


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text, padded with spaces to a positive multiple of UNIT, and its size before that."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (UNIT - len(data) if not data else -len(data) % UNIT), len(data)


def _gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until `column` holds about `BATCH_BYTES`: many streams at a time take fewer steps."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.column(column).nbytes for b in held) >= BATCH_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def store(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) with their texts as media: doc_id, n_bytes, media (a FLAC stream)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, 1):
            made = [payload(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array(encode([p for p, _ in made]), pa.binary())], names=["doc_id", "n_bytes", "media"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, samples: int = PCM_SAMPLES, keep: Sequence[str] = ()) -> DataFrame:
    """`media` (doc_id, media) as PCM blocks: doc_id, block, first_sample, samples, pcm (unsigned 8-bit) and the columns `keep`; the
    blocks of a stream follow each other."""
    kinds = [media.schema[c].dataType for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, 1):
            data = batch.column(1).to_pylist()
            at = [i for i, d in enumerate(data) if d is not None]
            rows: list[tuple[int, int, int, bytes]] = []  # row of the batch, block, first sample, pcm
            stream, held, first, block, size = -1, b"", 0, 0, 0
            for n, part in itertools.chain(decode_parts([data[i] for i in at]), [(len(at), b"")]):
                if n != stream:
                    if stream >= 0:
                        rows.append((at[stream], block, first, held))
                        size += len(held)
                    stream, held, first, block = n, b"", 0, 0
                held += part
                while len(held) > samples:
                    rows.append((at[stream], block, first, held[:samples]))
                    held, first, block, size = held[samples:], first + samples, block + 1, size + samples
                if size >= BATCH_BYTES or n == len(at):
                    yield _pcm_batch(batch, rows, keep)
                    rows, size = [], 0

    extra = "".join(f", `{c}` {k.simpleString()}" for c, k in zip(keep, kinds, strict=True))
    return media.select("doc_id", "media", *keep).mapInArrow(run, "doc_id long, block int, first_sample long, samples long, pcm binary" + extra)


def _pcm_batch(batch: pa.RecordBatch, rows: list[tuple[int, int, int, bytes]], keep: Sequence[str]) -> pa.RecordBatch:
    own = pa.array([r[0] for r in rows], pa.int64())
    columns = [
        batch.column(0).cast(pa.int64()).take(own), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()),
        pa.array([len(r[3]) for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary()),
    ]
    columns += [batch.column(i).take(own) for i in range(2, 2 + len(keep))]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "block", "first_sample", "samples", "pcm", *keep])


def pcm_slice(blocks: DataFrame, doc_id: int, first: int, count: int) -> bytes:
    """Samples first .. first + count - 1 of a stream, from the blocks that hold them only."""
    hit = blocks.where((F.col("doc_id") == doc_id) & (F.col("first_sample") < first + count) & (F.col("first_sample") + F.col("samples") > first))
    rows = hit.select("first_sample", "pcm").orderBy("first_sample").collect()
    whole = b"".join(bytes(r["pcm"]) for r in rows)
    return whole[first - rows[0]["first_sample"] :][:count] if rows else b""


class _Description:
    """What is derived from the blocks of one stream, one after the other."""

    def __init__(self):
        self.sha256, self.tail, self.size = hashlib.sha256(), b"", 0
        self.sum = self.squares = self.peak = self.crossings = 0
        self.below = None

    def add(self, data: bytes) -> None:
        self.sha256.update(data)
        self.tail, self.size = (self.tail + data[-16:])[-16:], self.size + len(data)
        x = (np.frombuffer(data, np.uint8) ^ 0x80).view(np.int8).astype(np.int32)
        below = x < 0
        self.sum, self.squares = self.sum + int(x.sum(dtype=np.int64)), self.squares + int((x * x).sum(dtype=np.int64))
        self.peak = max(self.peak, int(np.abs(x).max(initial=0)))
        self.crossings += int((below[1:] != below[:-1]).sum()) + int(self.below is not None and self.below != below[0])
        self.below = bool(below[-1])

    def feature(self) -> str:
        """Loudness, peak and zero crossings of the samples, from whole numbers only."""
        return f"sum={self.sum};squares={self.squares};peak={self.peak};crossings={self.crossings}"


def feature(data: bytes) -> str:
    """The feature of a whole payload."""
    d = _Description()
    d.add(data)
    return d.feature()


_DESCRIBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _describe_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `_DESCRIBED` from blocks (stream, block, pcm, doc_id, n_bytes, media_bytes, media_sha256) in the order of streams and blocks."""
    names = [f.split()[0] for f in _DESCRIBED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    key = now = facts = None
    rows: list[tuple] = []

    def close() -> None:
        doc, n_bytes, size, digest = facts
        rows.append((doc, n_bytes, now.size, now.sha256.hexdigest(), zlib.crc32(now.tail), size, digest, now.feature()))

    for batch in batches:
        for stream, _, pcm, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if stream != key:
                if now is not None:
                    close()
                key, now, facts = stream, _Description(), own
            now.add(pcm)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows = []
    if now is not None:
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def describe(media: DataFrame, samples: int = PCM_SAMPLES) -> DataFrame:
    """`media` (doc_id, n_bytes, media) written and read back, decoded to PCM blocks and verified, and the blocks described: digests of the
    payload and of the stored stream, and a feature string.

    The blocks of a stream follow each other in one task and are taken one by one, so no stream is held whole once it is decoded.
    """
    media = materialize(media.select("doc_id", "n_bytes", "media"), "media", codec="zstd")
    facts = {"stream": F.monotonically_increasing_id(), "media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)}
    blocks = pcm_blocks(media.where("media IS NOT NULL").withColumns(facts), samples, ["n_bytes", *facts])
    blocks = blocks.select("stream", "block", "pcm", "doc_id", "n_bytes", "media_bytes", "media_sha256")
    nothing = [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in _DESCRIBED.split(", ")[2:]]
    return blocks.mapInArrow(_describe_blocks, _DESCRIBED).unionByName(media.where("media IS NULL").select("doc_id", "n_bytes", *nothing))

"""FLAC streams over text payloads: an encoder, a decoder, and seekable PCM blocks.

A payload is stored as 8-bit mono samples. The companding table RANK gives the bytes that are frequent
in text the samples of least magnitude, so Rice codes are short; it is a bijection, hence lossless.
Every stream has STREAMINFO, a SEEKTABLE with one point per frame, and frames of 256 samples with a
fixed or linear predictor and Rice residuals. Many frames are coded and decoded side by side: the loop
goes over the samples of a frame, each step is one array operation over all frames. A long payload is
coded in runs of frames, so memory does not grow with it but for the stream itself.

decode() reads such streams so; any other FLAC stream is read by decode_stream(), frame by frame: all
subframe types, orders, partitions, escapes, block and sample sizes, and stereo modes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import as_bytes, chunks, id_and_text, own_worker, stored, trim

#: Samples of a frame (the last frame of a stream can be shorter).
BLOCK = 256
#: Payloads are padded with zero bytes to a positive multiple of this.
PAD = 64
#: Bytes of payload that are coded at once.
CHUNK_BYTES = 1_500_000
#: Fixed value: the bytes by falling frequency in Latin-script prose; the others follow in order.
FREQUENT = " enitaroshlducmg\xc3\xa9pvfbq.,yw\xb3E\nATIOSRLDNxzj"
RATE, RATE_BITS = 8000, 4
#: Quantisation of linear predictors.
SHIFT, PRECISION = 6, 8


def _rank() -> tuple[np.ndarray, np.ndarray]:
    first = [ord(c) for c in FREQUENT]
    order = np.array(first + [b for b in range(256) if b not in set(first)])
    signed = np.zeros(256, np.int16)
    k = np.arange(256)
    signed[order] = np.where(k % 2 == 0, k // 2, -(k // 2) - 1)
    back = np.zeros(256, np.uint8)
    back[signed + 128] = np.arange(256)
    return signed, back


#: Sample of each byte, and byte of each sample plus 128.
RANK, UNRANK = _rank()


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = np.zeros(256, np.uint32)
    for b in range(256):
        x = b << (bits - 8)
        for _ in range(8):
            x = ((x << 1) ^ poly if x & top else x << 1) & mask
        out[b] = x
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """CRC-8 or CRC-16 of many byte runs, a byte of all runs at a time."""
    table = CRC8 if bits == 8 else CRC16
    order = np.argsort(starts - ends, kind="stable")
    starts, sizes = starts[order], (ends - starts)[order]
    crc = np.zeros(len(starts), np.uint32)
    live = len(starts)
    for i in range(int(sizes[0]) if live else 0):
        live = int(np.searchsorted(-sizes[:live], -i, "left"))
        byte = data[starts[:live] + i].astype(np.uint32)
        x = crc[:live]
        crc[:live] = table[x ^ byte] if bits == 8 else ((x << 8) & 0xFFFF) ^ table[(x >> 8) ^ byte]
    out = np.zeros_like(crc)
    out[order] = crc
    return out


def _utf8(n: int) -> bytes:
    """FLAC's coded number."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = bytes(0x80 | (n >> (6 * k)) & 0x3F for k in range(size - 2, -1, -1))
    return bytes([(0xFF00 >> size) & 0xFF | n >> (6 * (size - 1))]) + tail


_heads: dict[tuple[int, int], bytes] = {}


def _head(number: int, size: int) -> bytes:
    key = (number, size)
    if key not in _heads:
        code = 8 if size == 256 else 6
        raw = bytes([0xFF, 0xF8, code << 4 | 0, 0b0000_0010]) + _utf8(number) + (bytes([size - 1]) if code == 6 else b"")
        crc = 0
        for b in raw:
            crc = int(CRC8[crc ^ b])
        if len(_heads) > 1 << 16:
            _heads.clear()
        _heads[key] = raw + bytes([crc])
    return _heads[key]


def _residuals(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best predictor of each row of x (frames by samples, zero beyond a frame's end).

    Candidates: fixed predictors of orders 0 to 2 and a linear predictor of order 2 from the
    autocorrelation. Returns kind (0 to 2: fixed, 3: linear), coefficients, residuals.
    """
    f, n = x.shape
    d1 = x.copy()
    d1[:, 1:] -= x[:, :-1]
    d2 = d1.copy()
    d2[:, 2:] -= d1[:, 1:-1]
    wide = x.astype(np.float32)
    r0, r1, r2 = (np.einsum("ij,ij->i", wide[:, k:], wide[:, : n - k]) for k in range(3))
    det = r0 * r0 - r1 * r1 + 1e-3
    a = np.stack([(r1 * r0 - r1 * r2) / det, (r0 * r2 - r1 * r1) / det], 1)
    coef = np.clip(np.rint(a * (1 << SHIFT)), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1).astype(np.int32)
    lin = x.copy()
    lin[:, 2:] -= (coef[:, :1] * x[:, 1:-1] + coef[:, 1:] * x[:, :-2]) >> SHIFT
    options = [x, d1, d2, lin]
    cost = np.stack([np.abs(o).sum(1) for o in options], 1) + np.array([0, 0, 0, 2 * PRECISION + 9])
    kind = cost.argmin(1)
    out = x.copy()
    for k in (1, 2, 3):
        out[kind == k] = options[k][kind == k]
    return kind, coef, out


ORDER = np.array([0, 1, 2, 2])


def _batches(sizes: list[int], unit: int) -> Iterator[list[tuple[int, int, int]]]:
    """(payload, from, to) in units: runs of payloads, about CHUNK_BYTES together; no payload is in a batch twice."""
    most, part, total = max(1, CHUNK_BYTES // unit), [], 0
    for i, n in enumerate(sizes):
        for lo in range(0, n, most):
            hi = min(n, lo + most)
            if part and (total + hi - lo > most or part[-1][0] == i):
                yield part
                part, total = [], 0
            part.append((i, lo, hi))
            total += hi - lo
    if part:
        yield part


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload (each a positive multiple of PAD bytes)."""
    frames: list[list[bytes]] = [[] for _ in payloads]
    sizes: list[list[int]] = [[] for _ in payloads]
    for part in _batches([-(-len(x) // BLOCK) for x in payloads], BLOCK):
        raw, each = _encode_frames([payloads[i][lo * BLOCK : hi * BLOCK] for i, lo, hi in part], np.array([lo for _, lo, _ in part]))
        at = f = 0
        for i, lo, hi in part:
            own = each[f : f + hi - lo]
            frames[i].append(raw[at : at + sum(own)])
            sizes[i] += own
            at, f = at + sum(own), f + hi - lo
    out = []
    for payload, own, parts in zip(payloads, sizes, frames):
        info = (BLOCK.to_bytes(2, "big") * 2 + min(own).to_bytes(3, "big") + max(own).to_bytes(3, "big") + ((RATE << 44) | (0 << 41) | (7 << 36) | len(payload)).to_bytes(8, "big")) + hashlib.md5(payload.translate(TO_PCM)).digest()
        points = np.zeros(len(own), POINT)
        points["sample"], points["offset"] = np.arange(len(own)) * BLOCK, np.cumsum(own) - own
        points["samples"] = np.minimum(BLOCK, len(payload) - np.arange(len(own)) * BLOCK)
        seek = points.tobytes()
        tables = [seek[k : k + MOST_POINTS * POINT.itemsize] for k in range(0, len(seek), MOST_POINTS * POINT.itemsize)]
        metadata = b"".join([(0x83 if k == len(tables) - 1 else 3).to_bytes(1, "big") + len(t).to_bytes(3, "big") + t for k, t in enumerate(tables)])
        out.append(b"".join([b"fLaC\x00", len(info).to_bytes(3, "big"), info, metadata, *parts]))
    return out


def _encode_frames(payloads: list[bytes], first: np.ndarray) -> tuple[bytes, list[int]]:
    """Frames of the payloads side by side, and their sizes; first: number of each payload's first frame."""
    sizes = np.array([len(x) for x in payloads])
    counts = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(payloads)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
    number = number + first[owner]
    frames = len(owner)
    x = np.zeros((frames, BLOCK), np.int32)
    inside = np.arange(BLOCK) < length[:, None]
    x[inside] = RANK[np.frombuffer(b"".join(payloads), np.uint8)]
    kind, coef, res = _residuals(x)
    order = ORDER[kind]
    u = np.where(res >= 0, 2 * res, -2 * res - 1)
    coded = inside & (np.arange(BLOCK) >= order[:, None])
    mean = np.where(coded, u, 0).sum(1) / np.maximum(1, length - order)
    k = np.clip(np.floor(np.log2(np.maximum(mean, 1) * 0.7 + 0.6)), 0, 14).astype(np.int64)
    # bits before the codes: subframe header 8, warm-up 8 each, linear: precision 4, shift 5, coefficients; residual header 2 + 4 + 4
    fore = 8 + 8 * order + np.where(kind == 3, 9 + 2 * PRECISION, 0) + 10
    heads = [_head(a, b) for a, b in zip(number.tolist(), length.tolist())]
    head_bits = 8 * np.fromiter(map(len, heads), np.int64, frames)
    code = u[coded]
    q_of = np.repeat(k, coded.sum(1))
    widths = (code >> q_of) + 1 + q_of
    bounds_ = np.concatenate(([0], np.cumsum(coded.sum(1))))
    total = np.concatenate(([0], np.cumsum(widths)))
    per = total[bounds_[1:]] - total[bounds_[:-1]]
    body = -(-(fore + per) // 8) * 8
    frame_bits = head_bits + body + 16
    at = np.concatenate(([0], np.cumsum(frame_bits)))
    bits = np.zeros(int(at[-1]), np.uint8)
    base = at[:-1] + head_bits

    def put(pos: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            bits[pos + j] = (value >> (width - 1 - j)) & 1

    put(base, np.where(kind == 3, (32 + 1) << 1, (8 + np.minimum(kind, 2)) << 1), 8)
    pos = base + 8
    for w in range(2):
        has = order > w
        put(pos[has], x[has, w] & 255, 8)
        pos = pos + 8 * has
    lin = kind == 3
    put(pos[lin], np.full(int(lin.sum()), PRECISION - 1), 4)
    put(pos[lin] + 4, np.full(int(lin.sum()), SHIFT), 5)
    for w in range(2):
        put(pos[lin] + 9 + w * PRECISION, coef[lin, w] & ((1 << PRECISION) - 1), PRECISION)
    pos = pos + np.where(lin, 9 + 2 * PRECISION, 0)
    put(pos + 6, k, 4)
    start = np.repeat(pos + 10 - total[bounds_[:-1]], coded.sum(1)) + total[:-1]
    stop = start + (code >> q_of)
    bits[stop] = 1
    for j in range(int(k.max()) if frames else 0):
        has = q_of > j
        bits[stop[has] + q_of[has] - j] = (code[has] >> j) & 1
    data = np.packbits(bits)
    start_byte = at[:-1] // 8
    head_len = head_bits // 8
    flat_heads = np.frombuffer(b"".join(heads), np.uint8)
    data[np.repeat(start_byte - (np.cumsum(head_len) - head_len), head_len) + np.arange(len(flat_heads))] = flat_heads
    end = at[1:] // 8
    crc = _crcs(data, start_byte, end - 2, 16)
    data[end - 2], data[end - 1] = crc >> 8, crc & 255
    return data.tobytes(), (end - start_byte).tolist()


POINT = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])
#: Seek points that a metadata block holds at most (its size has 24 bits); more follow in further blocks.
MOST_POINTS = ((1 << 24) - 1) // POINT.itemsize
#: PCM byte of each payload byte, and the other way.
TO_PCM = RANK.astype(np.int8).tobytes()
FROM_PCM = bytes(np.concatenate((UNRANK[128:], UNRANK[:128])))


class Foreign(Exception):
    """A stream that encode() has not written."""


def _stream(raw: bytes) -> tuple[bytes, np.ndarray, int]:
    """STREAMINFO, seek points and the offset of the first frame."""
    if raw[:4] != b"fLaC":
        raise ValueError("FLAC:no stream marker")
    at, info, seek, last = 4, b"", [], False
    while not last:
        if at + 4 > len(raw):
            raise ValueError("FLAC:metadata ends early")
        kind, size = raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
        last = bool(raw[at] & 128)
        block = raw[at + 4 : at + 4 + size]
        if kind == 0:
            info = block
        elif kind == 3:
            seek.append(block)
        at += 4 + size
    if len(info) < 34:
        raise ValueError("FLAC:no STREAMINFO")
    points = np.frombuffer(b"".join(seek), POINT)
    return info, points[points["sample"] != 2**64 - 1], at


def _samples_of(info: bytes) -> int:
    return int.from_bytes(info[10:18], "big") & ((1 << 36) - 1)


def _own(info: bytes, points: np.ndarray) -> bool:
    """Whether the metadata are as encode() writes them."""
    n = _samples_of(info)
    return info[:4] == BLOCK.to_bytes(2, "big") * 2 and info[12] & 15 == 0 and info[13] >> 4 == 7 and len(points) == -(-n // BLOCK) and n > 0


def _some_frames(streams: list[bytes], parsed: list, part: list[tuple[int, int, int]]) -> list[bytes]:
    """PCM of the frames from `lo` to before `hi` of stream i, for each (i, lo, hi)."""
    cut, starts, ends, length = [], [], [], []
    base = 0
    for i, lo, hi in part:
        _, points, first = parsed[i]
        offset = points["offset"][lo : hi + 1].astype(np.int64)
        stop = first + int(offset[hi - lo]) if hi < len(points) else len(streams[i])
        start = first + int(offset[0])
        own = offset[: hi - lo] - offset[0]
        cut.append(streams[i][start:stop])
        starts.append(base + own)
        ends.append(base + np.append(own[1:], stop - start))
        length.append(points["samples"][lo:hi].astype(np.int64))
        base += stop - start
    pcm = _decode_frames(b"".join(cut), np.concatenate(starts), np.concatenate(ends), np.concatenate(length))
    at, out = 0, []
    for x in length:
        n = int(x.sum())
        out.append(pcm[at : at + n])
        at += n
    return out


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream (8 bits, mono). Checksums, sample counts and MD5 are verified; a fault stops the job."""
    parsed = [_stream(s) for s in streams]
    own = [i for i, (info, points, _) in enumerate(parsed) if _own(info, points)]
    pcm: list[list[bytes] | None] = [None] * len(streams)
    try:
        for i in own:
            pcm[i] = []
        for part in _batches([len(parsed[i][1]) for i in own], BLOCK):
            part = [(own[i], lo, hi) for i, lo, hi in part]
            for (i, _, _), x in zip(part, _some_frames(streams, parsed, part)):
                pcm[i].append(x)
    except Foreign:
        pcm = [None] * len(streams)
    out = []
    for raw, (info, _, _), parts in zip(streams, parsed, pcm):
        if parts is None:
            samples, _, bits = decode_stream(raw)
            if bits != 8 or samples.shape[1] != 1:
                raise ValueError("FLAC:not a payload of bytes")
            parts = [samples.astype(np.int8).tobytes()]
        whole = b"".join(parts)
        if hashlib.md5(whole).digest() != info[18:34] or len(whole) != _samples_of(info):
            raise ValueError("FLAC:MD5")
        out.append(whole.translate(FROM_PCM))
    return out


def tails(streams: list[bytes], n: int = PAD) -> list[bytes]:
    """The last n payload bytes of each stream, found by its seek points; no other frames are decoded."""
    parsed = [_stream(s) for s in streams]
    out = []
    for part in _batches([1] * len(streams), BLOCK):
        wanted = []
        for i, _, _ in part:
            info, points, _ = parsed[i]
            if not _own(info, points):
                raise Foreign
            wanted.append((i, int(np.searchsorted(points["sample"].astype(np.int64), max(0, _samples_of(info) - n), "right")) - 1, len(points)))
        out += [x[-n:].translate(FROM_PCM) for x in _some_frames(streams, parsed, wanted)]
    return out


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.pos = data, 8 * at

    def read(self, n: int) -> int:
        end = self.pos + n
        if end > 8 * len(self.data):
            raise ValueError("FLAC:stream ends early")
        x = int.from_bytes(self.data[self.pos >> 3 : (end + 7) >> 3], "big") >> (-end & 7)
        self.pos = end
        return x & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.read(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        """Zeros before the next one, which is read too."""
        n = 0
        while True:
            room = 8 - (self.pos & 7)
            rest = self.read(room)
            if rest:
                lead = room - rest.bit_length()
                self.pos += lead + 1 - room
                return n + lead
            n += room


def _crc(data: bytes, bits: int) -> int:
    table, crc = (CRC8 if bits == 8 else CRC16).tolist(), 0
    for b in data:
        crc = table[crc ^ b] if bits == 8 else ((crc << 8) & 0xFFFF) ^ table[(crc >> 8) ^ b]
    return crc


def _residual(bits: _Bits, size: int, order: int) -> list[int]:
    method = bits.read(2)
    if method > 1:
        raise ValueError("FLAC:residual coding")
    width, split, out = 4 + method, bits.read(4), []
    if size % (1 << split) or (size >> split) < order:
        raise ValueError("FLAC:partition order")
    for k in range(1 << split):
        n, rice = (size >> split) - (order if k == 0 else 0), bits.read(width)
        if rice == (1 << width) - 1:  # an escape: plain numbers
            plain = bits.read(5)
            out += [bits.signed(plain) for _ in range(n)]
        else:
            for _ in range(n):
                u = bits.unary() << rice | bits.read(rice)
                out.append(-(u >> 1) - 1 if u & 1 else u >> 1)
    return out


#: Coefficients of the fixed predictors of orders 0 to 4, nearest sample first.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _subframe(bits: _Bits, size: int, wide: int) -> list[int]:
    if bits.read(1):
        raise ValueError("FLAC:subframe padding")
    kind = bits.read(6)
    wasted = bits.unary() + 1 if bits.read(1) else 0
    wide -= wasted
    if kind == 0:
        out = [bits.signed(wide)] * size
    elif kind == 1:
        out = [bits.signed(wide) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        if order > size:
            raise ValueError("FLAC:order")
        out = [bits.signed(wide) for _ in range(order)]
        shift, weights = 0, FIXED[order] if kind < 32 else []
        if kind >= 32:
            precision = bits.read(4) + 1
            shift = bits.signed(5)
            if precision == 16 or shift < 0:
                raise ValueError("FLAC:predictor")
            weights = [bits.signed(precision) for _ in range(order)]
        for r in _residual(bits, size, order):
            out.append(r + (sum(w * out[-1 - j] for j, w in enumerate(weights)) >> shift))
    else:
        raise ValueError("FLAC:subframe type")
    return [x << wasted for x in out]


def _coded(bits: _Bits) -> int:
    lead = bits.read(8)
    if lead < 0x80:
        return lead
    more = next((k for k in range(1, 7) if not lead >> (6 - k) & 1), 0)
    if lead < 0xC0 or not more:
        raise ValueError("FLAC:coded number")
    x = lead & ((1 << (6 - more)) - 1)
    for _ in range(more):
        x = x << 6 | bits.read(8) & 0x3F
    return x


def decode_stream(raw: bytes) -> tuple[np.ndarray, int, int]:
    """Samples (a column for each channel), rate and bits per sample of any FLAC stream, read frame by frame."""
    info, _, at = _stream(raw)
    head = int.from_bytes(info[10:18], "big")
    rate, channels, depth, total = head >> 44, (head >> 41 & 7) + 1, (head >> 36 & 31) + 1, head & ((1 << 36) - 1)
    bits, parts, done, number = _Bits(raw, at), [], 0, 0
    while bits.pos < 8 * len(raw) and (not total or done < total):
        start = bits.pos // 8
        if bits.read(15) != 0x7FFC:
            raise ValueError("FLAC:no frame sync")
        variable = bits.read(1)
        size_code, rate_code, mode, depth_code = bits.read(4), bits.read(4), bits.read(4), bits.read(3)
        if bits.read(1) or size_code == 0 or rate_code == 15 or mode > 10 or depth_code == 3:
            raise ValueError("FLAC:frame header")
        if _coded(bits) != (done if variable else number):
            raise ValueError("FLAC:frame number")
        size = bits.read(8) + 1 if size_code == 6 else bits.read(16) + 1 if size_code == 7 else 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else 256 << (size_code - 8)
        if rate_code >= 12:
            bits.read(8 if rate_code == 12 else 16)
        if _crc(raw[start : bits.pos // 8], 8) != bits.read(8):
            raise ValueError("FLAC:header checksum")
        wide = {0: depth, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[depth_code]
        n = mode + 1 if mode < 8 else 2
        if n != channels:
            raise ValueError("FLAC:channels")
        own = [np.array(_subframe(bits, size, wide + (mode == 8 and c == 1 or mode == 9 and c == 0 or mode == 10 and c == 1)), np.int64) for c in range(n)]
        bits.pos = -(-bits.pos // 8) * 8
        if _crc(raw[start : bits.pos // 8], 16) != bits.read(16):
            raise ValueError("FLAC:frame checksum")
        if mode == 8:
            own[1] = own[0] - own[1]
        elif mode == 9:
            own[0] = own[0] + own[1]
        elif mode == 10:
            mid, side = own[0] << 1 | own[1] & 1, own[1]
            own = [(mid + side) >> 1, (mid - side) >> 1]
        parts.append(np.stack(own, 1))
        done, number = done + size, number + 1
    samples = np.concatenate(parts) if parts else np.zeros((0, channels), np.int64)
    if total and len(samples) != total:
        raise ValueError("FLAC:sample count")
    if any(info[18:34]):
        plain = np.ascontiguousarray(samples.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, : -(-depth // 8)]
        if hashlib.md5(np.ascontiguousarray(plain).tobytes()).digest() != info[18:34]:
            raise ValueError("FLAC:MD5")
    return samples, rate, depth


def _decode_frames(raw: bytes, starts: np.ndarray, ends: np.ndarray, length: np.ndarray) -> bytes:
    """PCM of frames as encode() writes them, in one run of bytes; Foreign if a frame is of another kind."""
    data = np.frombuffer(raw + bytes(16), np.uint8)
    frames = len(starts)
    if (starts < 0).any() or (ends - starts < 8).any() or (ends > len(raw)).any() or (length > BLOCK).any():
        raise Foreign
    if (data[starts] != 0xFF).any() or (data[starts + 1] != 0xF8).any():
        raise ValueError("FLAC:no frame where the seek table says")
    crc = _crcs(data, starts, ends - 2, 16)
    if (crc != data[ends - 2].astype(np.uint32) * 256 + data[ends - 1]).any():
        raise ValueError("FLAC:frame checksum")
    lead = data[starts + 4]
    coded = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, np.where(lead < 0xF8, 4, np.where(lead < 0xFC, 5, np.where(lead < 0xFE, 6, 7))))))
    code = data[starts + 2] >> 4
    head = starts + 4 + coded + (code == 6)
    if (_crcs(data, starts, head, 8) != data[head]).any():
        raise ValueError("FLAC:header checksum")
    bits = np.unpackbits(data)
    b64 = np.zeros(len(data) - 7, np.uint32)
    for j in range(4):
        b64 |= data[j : len(data) - 7 + j].astype(np.uint32) << np.uint32(24 - 8 * j)

    def get(pos: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Up to 24 bits at each bit position."""
        return ((b64[pos >> 3] << (pos & 7).astype(np.uint32)) >> np.uint32(1) >> np.asarray(31 - width, np.uint32)).astype(np.int64) if not np.isscalar(width) else ((b64[pos >> 3] << (pos & 7).astype(np.uint32)) >> np.uint32(32 - width)).astype(np.int64)

    pos = (head + 1) * 8
    kind = get(pos, 8) >> 1
    if not np.isin(kind, (8, 9, 10, 33)).all() or (get(pos, 8) & 1).any() or (data[starts + 3] != 2).any() or not np.isin(code, (6, 8)).all() or (data[starts + 2] & 15).any():
        raise Foreign
    order = np.where(kind == 33, 2, kind - 8)
    pos = pos + 8
    x = np.zeros((BLOCK + 2, frames), np.int32)  # samples by frames
    for w in range(2):
        has = order > w
        x[w, has] = get(pos[has], 8).astype(np.int8)
        pos = pos + 8 * has
    lin = kind == 33
    if (get(pos[lin], 4) != PRECISION - 1).any() or (get(pos + np.where(lin, 9 + 2 * PRECISION, 0), 6) != 0).any():
        raise Foreign
    coef = np.zeros((2, frames), np.int32)
    for w in range(2):
        coef[w, lin] = get(pos[lin] + 9 + w * PRECISION, PRECISION).astype(np.int8)
    shift = np.zeros(frames, np.int32)
    shift[lin] = get(pos[lin] + 4, 5)
    coef[0, kind == 9], coef[0, kind == 10], coef[1, kind == 10] = 1, 2, -1
    pos = pos + np.where(lin, 9 + 2 * PRECISION, 0)
    k = get(pos + 6, 4)
    if (k == 15).any():
        raise Foreign
    pos = pos + 10
    # next one-bit at or after each position
    nxt = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(2**31 - 1))
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    stops = np.zeros((BLOCK, frames), np.int32)
    codes = np.zeros((BLOCK, frames), np.int32)
    by = np.argsort(-length, kind="stable")  # frames with the most samples first
    at, kk, oo, ll = pos[by].astype(np.int64), k[by], order[by], length[by]
    live = frames
    step = (kk + 1).astype(np.int64)
    for i in range(BLOCK):
        live = int(np.searchsorted(-ll[:live], -i, "left"))
        here = at[:live]
        stop = nxt[here].astype(np.int64)
        if i < 2:
            stop = np.where(oo[:live] > i, here - step[:live], stop)
        codes[i, :live] = stop - here
        stops[i, :live] = stop
        at[:live] = stop + step[:live]
    low = get((stops + 1).astype(np.int64), np.broadcast_to(kk, stops.shape)) if frames else codes
    u = (codes.astype(np.int64) << kk) | low
    res = np.where(u & 1, -(u >> 1) - 1, u >> 1).astype(np.int32)
    back = np.argsort(by, kind="stable")
    res = res[:, back]
    x[0] = np.where(order > 0, x[0], res[0])
    x[1] = np.where(order > 1, x[1], res[1] + ((coef[0] * x[0]) >> shift))
    for i in range(2, BLOCK):
        x[i] = res[i] + ((coef[0] * x[i - 1] + coef[1] * x[i - 2]) >> shift)
    inside = np.arange(BLOCK) < length[:, None]
    samples = x[:BLOCK].T[inside]
    if (samples < -128).any() or (samples > 127).any():
        raise ValueError("FLAC:sample range")
    return samples.astype(np.int8).tobytes()


def _padded(text: bytes) -> bytes:
    return text + bytes(PAD - len(text) % PAD if len(text) % PAD or not text else 0)


def _write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own_worker("flac")
    for batch in batches:
        for piece in chunks(batch, "text", CHUNK_BYTES):
            texts = as_bytes(piece.column("text"))
            yield pa.record_batch([piece.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array(encode([_padded(x) for x in texts]), pa.binary())], names=["doc_id", "n_bytes", "media"])


def write_media(docs: DataFrame) -> DataFrame:
    """One stored FLAC stream per document: doc_id, n_bytes, media.

    A null text is empty; its payload is PAD zero bytes. Equal texts have equal streams; repeated rows
    are stored each. A document's whole payload is one stream, coded about CHUNK_BYTES at a time, so a long
    text takes little more than itself. Other columns are not read; an empty table gives an empty one.
    """
    return stored(id_and_text(docs).mapInArrow(_write, "doc_id long, n_bytes long, media binary"), "media")


def read_blocks(media: DataFrame, block: int = 4096) -> DataFrame:
    """PCM blocks of the stored streams: doc_id, sample_offset (of the block's first sample, for seeking), pcm bytes as payload bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("flac")
        for batch in batches:
            for piece in chunks(batch, "media", CHUNK_BYTES):
                for doc_id, payload in zip(piece.column("doc_id").to_pylist(), decode(as_bytes(piece.column("media")))):
                    at = list(range(0, len(payload), block))
                    yield pa.record_batch([pa.array([doc_id] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array([payload[i : i + block] for i in at], pa.binary())], names=["doc_id", "sample_offset", "pcm"])

    return media.mapInArrow(run, "doc_id long, sample_offset long, pcm binary")


def seek(stream: bytes, sample: int) -> tuple[int, int]:
    """First sample and byte offset (in the stream) of the frame that holds the sample."""
    info, points, first = _stream(stream)
    if not 0 <= sample < _samples_of(info):
        raise IndexError(sample)
    i = int(np.searchsorted(points["sample"].astype(np.int64), sample, "right")) - 1
    return int(points["sample"][i]), first + int(points["offset"][i])


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own_worker("flac")
    for batch in batches:
        for piece in chunks(batch, "media", CHUNK_BYTES):
            media = as_bytes(piece.column("media"))
            payloads = decode(media)
            try:
                last = tails(media)
            except Foreign:
                last = [x[-PAD:] for x in payloads]
            cols = [piece.column("doc_id"), piece.column("n_bytes"), pa.array([len(x) for x in payloads], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in payloads]), pa.array([zlib.crc32(x) for x in last], pa.int64()), pa.array([len(x) for x in media], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in media]), pa.array([_feature(x) for x in payloads])]
            yield pa.record_batch(cols, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
    trim()


def _feature(payload: bytes) -> str:
    """Mean and mean square of the samples times 1000, and zero crossings."""
    total = power = crossings = 0
    for at in range(0, len(payload), 1 << 20):
        x = RANK[np.frombuffer(payload, np.uint8, min(len(payload) - at, (1 << 20) + 1), at)].astype(np.int64)
        crossings += int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        x = x[: 1 << 20]
        total, power = total + int(x.sum()), power + int((x * x).sum())
    return f"mean={total * 1000 // len(payload)};power={power * 1000 // len(payload)};crossings={crossings}"


def media_features(media: DataFrame) -> DataFrame:
    """Per stored stream: sizes, digests of the payload as decoded and of the stream, and the feature string.

    The last samples' checksum is read through the seek table. Repeated rows are read each; an empty table
    gives an empty one.
    """
    return media.mapInArrow(_digests, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

"""FLAC for bytes: texts as 8-bit mono samples, encoded and decoded many frames at a time in numpy.

The streams written have STREAMINFO, a SEEKTABLE with a point for every frame, and frames of 576
samples with a constant, fixed-predictor (order 0) or LPC subframe and Rice-coded residuals. Such
streams are decoded many frames at a time; any other FLAC stream (more channels, other widths and
block sizes, partitioned residuals, escape codes, no seek table) by `decode_any`, a frame at a time.
Decoding checks the CRC-8 of each frame header, the CRC-16 of each frame and the MD5 of all samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import buffers, slices

BLOCK = 576
ORDER = 2
PRECISION, SHIFT = 9, 6
BATCH_BYTES = 2 << 20
#: Frames that fit a core's cache.
ENCODED_AT_ONCE = 160


def _table(poly: int, bits: int) -> np.ndarray:
    c = np.arange(256, dtype=np.uint32) << np.uint32(bits - 8)
    for _ in range(8):
        c = np.where(c >> np.uint32(bits - 1) & 1, (c << np.uint32(1)) ^ np.uint32(poly), c << np.uint32(1)) & np.uint32((1 << bits) - 1)
    return c


def crc(data: np.ndarray, start: np.ndarray, size: np.ndarray, poly: int, bits: int) -> np.ndarray:
    """CRC of many pieces of data at once."""
    t, order = _table(poly, bits), np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
    c = np.zeros(len(start), np.uint32)
    mask = np.uint32((1 << bits) - 1)
    for i, n in enumerate(live):
        top = (c[:n] >> np.uint32(bits - 8)) ^ data[start[:n] + i]
        c[:n] = ((c[:n] << np.uint32(8)) & mask) ^ t[top]
    out = np.empty_like(c)
    out[order] = c
    return out


def _utf8_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """FLAC's coded frame numbers: bytes (rows padded to 6) and lengths."""
    size = 1 + (n >= 1 << 7) + (n >= 1 << 11) + (n >= 1 << 16) + (n >= 1 << 21) + (n >= 1 << 26)
    out = np.zeros((len(n), 6), np.uint8)
    for s in range(1, 7):
        at = size == s
        v = n[at]
        if s == 1:
            out[at, 0] = v
            continue
        out[at, 0] = ((0xFF << (8 - s)) & 0xFF) | (v >> (6 * (s - 1)))
        for j in range(1, s):
            out[at, j] = 0x80 | ((v >> (6 * (s - 1 - j))) & 0x3F)
    return out, size


def _lpc(x: np.ndarray) -> np.ndarray:
    """Quantised LPC coefficients of each row, by autocorrelation and Levinson's recursion."""
    f = x.astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", f[:, j:], f[:, : f.shape[1] - j]) for j in range(ORDER + 1)]).astype(np.float64)
    r[0] = r[0] * 1.0001 + 1e-3
    a = np.zeros((ORDER, len(x)))
    err = r[0].copy()
    for i in range(ORDER):
        k = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(axis=0)) / err
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        err *= 1 - k * k
    top = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << SHIFT)), -top - 1, top).astype(np.int32)


def _rice(res: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals after the warm-up, the Rice parameter and the coded size of each row."""
    u = ((res[:, skip:] << 1) ^ (res[:, skip:] >> 31)).astype(np.int32)
    mean = u.mean(axis=1)
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.75, 1))), 0, 8).astype(np.int32)
    return u, k, (u >> k[:, None]).sum(axis=1) + (k + 1) * u.shape[1]


def encode_frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """FLAC frames of rows of BLOCK signed samples: bytes and frame lengths."""
    n = len(x)
    x = x.astype(np.int32)
    coefs = _lpc(x)
    pred = np.zeros((n, BLOCK - ORDER), np.int32)
    for j in range(ORDER):
        pred += coefs[j][:, None] * x[:, ORDER - 1 - j : BLOCK - 1 - j]
    lpc = x.copy()
    lpc[:, ORDER:] -= pred >> SHIFT
    kinds = [(0, *_rice(x, 0)), (ORDER, *_rice(lpc, ORDER))]
    extra = [0, 8 * ORDER + 9 + PRECISION * ORDER]
    bits = np.stack([c[3] + e for c, e in zip(kinds, extra, strict=True)])
    kind = bits.argmin(axis=0)
    constant = (x == x[:, :1]).all(axis=1)
    body_bits = np.where(constant, 16, 8 + 10 + bits[kind, np.arange(n)])
    code, code_size = _utf8_number(number)
    head = 4 + code_size + 1
    size = head + (body_bits + 7) // 8 + 2
    end = np.cumsum(size)
    start = end - size
    values, ends = [], []

    def put(value, bit_end):
        values.append(np.ravel(value).astype(np.int64))
        ends.append(np.ravel(bit_end).astype(np.int64))

    at = (start + head) * 8
    types = np.where(constant, 0, np.array([8 << 1, (32 + ORDER - 1) << 1])[kind])
    put(types, at + 8)
    put(x[constant, 0] & 255, at[constant] + 16)
    for i, (order, u, k, _) in enumerate(kinds):
        own = np.flatnonzero((kind == i) & ~constant)
        if not len(own):
            continue
        p = at[own] + 8
        for j in range(order):
            p += 8
            put(x[own, j] & 255, p)
        if i == 1:
            p += 4
            put(np.full(len(own), PRECISION - 1), p)
            p += 5
            put(np.full(len(own), SHIFT), p)
            for j in range(ORDER):
                p += PRECISION
                put(coefs[j, own] & ((1 << PRECISION) - 1), p)
        p += 6 + 4
        u, k = u[own], k[own][:, None]
        put(k, p)
        done = np.cumsum((u >> k) + 1 + k, axis=1)
        put((1 << k) | (u & ((1 << k) - 1)), done + p[:, None])
    values, ends = np.concatenate(values), np.concatenate(ends)
    last = (ends - 1) >> 3
    wide = values << ((-ends) & 7)
    total = int(end[-1])
    out = np.bincount(last, wide & 255, total) + np.bincount(np.maximum(last - 1, 0), wide >> 8, total)
    out = out.astype(np.uint8)
    for j, b in enumerate((0xFF, 0xF8, 0x24, 0x02)):
        out[start + j] = b
    for j in range(6):
        own = code_size > j
        out[start[own] + 4 + j] = code[own, j]
    out[start + head - 1] = crc(out, start, head - 1, 0x07, 8)
    c16 = crc(out, start, size - 2, 0x8005, 16)
    out[end - 2], out[end - 1] = c16 >> 8, c16 & 255
    return out, size


def md5_of(payload: bytes) -> bytes:
    """FLAC's MD5: of the signed samples, which are the payload's bytes less 128."""
    return hashlib.md5((np.frombuffer(payload, np.uint8) ^ 128).tobytes()).digest()


def stream_head(payload_md5: bytes, n_samples: int, sizes: np.ndarray) -> bytes:
    info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += ((8000 << 44) | (0 << 41) | (7 << 36) | n_samples).to_bytes(8, "big") + payload_md5
    points = np.zeros(len(sizes), np.dtype([("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")]))
    points["sample"], points["n"] = np.arange(len(sizes), dtype=np.uint64) * np.uint64(BLOCK), BLOCK
    points["byte"][1:] = np.cumsum(sizes)[:-1]
    return b"fLaC" + b"\x00" + (34).to_bytes(3, "big") + info + b"\x83" + (18 * len(sizes)).to_bytes(3, "big") + points.tobytes()


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload, whose length is a positive multiple of BLOCK."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    x = (np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128).reshape(-1, BLOCK)
    number = np.concatenate([np.arange(c) for c in counts])
    data, size = [], []
    for a in range(0, len(x), ENCODED_AT_ONCE):
        d, s = encode_frames(x[a : a + ENCODED_AT_ONCE], number[a : a + ENCODED_AT_ONCE])
        data.append(d.tobytes())
        size.append(s)
    data, size = b"".join(data), np.concatenate(size)
    edge, at, out = np.concatenate([[0], np.cumsum(size)]), 0, []
    for p, c in zip(payloads, counts, strict=True):
        out.append(stream_head(md5_of(p), len(p), size[at : at + c]) + data[edge[at] : edge[at + c]])
        at += c
    return out


class Other(ValueError):
    """A stream that may be right, but not of the form that this module writes."""


def parse_head(media: bytes) -> tuple[dict, np.ndarray | None, int]:
    """STREAMINFO, the frames' byte offsets by the seek table (None without one), and where frames begin."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, points = 4, False, None, None
    while not last:
        if at + 4 > len(media):
            raise ValueError("metadata blocks are cut off")
        last, kind, size = media[at] >> 7, media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        block = media[at + 4 : at + 4 + size]
        if len(block) < size or (kind == 0 and size != 34) or (kind == 3 and size % 18):
            raise ValueError("a metadata block's size")
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            info = {"block": struct.unpack(">H", block[2:4])[0], "bits": (packed >> 36 & 31) + 1, "channels": (packed >> 41 & 7) + 1, "rate": packed >> 44, "samples": packed & (1 << 36) - 1, "md5": block[18:34]}
        elif kind == 3:
            points = np.frombuffer(block, np.dtype([("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")]))
        at += 4 + size
    if info is None:
        raise ValueError("no STREAMINFO")
    return info, None if points is None else points["byte"].astype(np.int64), at


def own_head(media: bytes) -> tuple[dict, np.ndarray, int]:
    """The same of a stream of the form that this module writes; Other if it is not one."""
    info, offsets, at = parse_head(media)
    if info["bits"] != 8 or info["channels"] != 1 or info["block"] != BLOCK or offsets is None or len(offsets) == 0 or len(offsets) * BLOCK != info["samples"]:
        raise Other("not 8-bit mono with a point for every frame of 576 samples")
    if offsets[0] or (np.diff(np.append(offsets, len(media) - at)) < 8).any():
        raise Other("seek table")
    return info, offsets, at


def decode_frames(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Samples, a row for each frame; ValueError if a checksum or a field is wrong."""
    n = len(start)
    lead = data[start + 4]
    code_size = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0) + (lead >= 0xF8) + (lead >= 0xFC)
    head = 4 + code_size + 1
    if (data[start] != 0xFF).any() or (data[start + 1] != 0xF8).any() or (data[start + 2] != 0x24).any() or (data[start + 3] != 0x02).any():
        raise Other("frame header")
    if (crc(data, start, head - 1, 0x07, 8) != data[start + head - 1]).any():
        raise ValueError("CRC-8 of a frame header")
    c16 = data[start + size - 2].astype(np.uint32) << np.uint32(8) | data[start + size - 1]
    if (crc(data, start, size - 2, 0x8005, 16) != c16).any():
        raise ValueError("CRC-16 of a frame")
    pad = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    words = pad[:-3] << np.uint32(24) | pad[1:-2] << np.uint32(16) | pad[2:-1] << np.uint32(8) | pad[3:]

    def take(p, bits):
        """The next bits (24 at most) of each frame."""
        return (words[p >> 3] << (p & 7).astype(np.uint32) >> np.uint32(32 - bits)).astype(np.int64)

    p = (start + head) * 8
    kind = take(p, 8) >> 1
    p = p + 8
    x = np.zeros((BLOCK, n), np.int32)
    coded = np.flatnonzero(((kind >= 8) & (kind <= 12)) | (kind >= 32))
    for i in np.flatnonzero(kind == 1):
        at = p[i] + 8 * np.arange(BLOCK)
        x[:, i] = (take(at, 8) ^ 128) - 128
    own = np.flatnonzero(kind == 0)
    x[:, own] = (take(p[own], 8) ^ 128) - 128
    if len(coded) + len(own) + (kind == 1).sum() != n:
        raise Other("subframe type")
    order = np.where(kind < 32, kind - 8, kind - 31)
    coded = coded[np.argsort(order[coded], kind="stable")]
    order, q, kind = order[coded], p[coded], kind[coded]
    active = np.searchsorted(order, np.arange(BLOCK), "right")  # frames past their warm-up, a prefix
    u = np.zeros((BLOCK, len(coded)), np.int32)
    for i in range(order.max(initial=0)):
        late = slice(active[i], None)
        u[i, late] = (take(q[late], 8) ^ 128) - 128
        q[late] += 8
    coefs = np.zeros((32, len(coded)), np.int32)
    lpc = np.flatnonzero(kind >= 32)
    precision, shift = take(q[lpc], 4) + 1, take(q[lpc] + 4, 5)
    q[lpc] += 9
    for j in range(order[lpc].max(initial=0)):
        has = order[lpc] > j
        to, bits = lpc[has], precision[has]
        c = take(q[to], 16) >> (16 - bits)
        coefs[j, to] = (c ^ (1 << (bits - 1))) - (1 << (bits - 1))
        q[to] += bits
    if take(q, 6).any():
        raise Other("residual coding method or partitions")
    k = take(q + 6, 4)
    q = q + 10
    table, at_k = _rice_table(int(k.max(initial=0))), k << 16
    for i in range(BLOCK):
        m = active[i]
        if not m:
            continue
        code = table[((words[q[:m] >> 3] >> (16 - (q[:m] & 7)).astype(np.uint32)) & np.uint32(0xFFFF)) + at_k[:m]]
        u[i, :m] = code >> 8
        long = np.flatnonzero(code == 0)
        q[:m] += code & 255
        if len(long):
            u[i, long], used = _long_codes(take, q[long], k[long])
            q[long] += used
    if ((q + 7) // 8 != (start + size - 2)[coded]).any():
        raise Other("frame length")
    for o in np.unique(order):
        for is_lpc in (False, True):
            own = np.flatnonzero((order == o) & ((kind >= 32) == is_lpc))
            if not len(own):
                continue
            r = u[:, own]
            r[o:] = (r[o:] >> 1) ^ -(r[o:] & 1)
            if is_lpc:
                c, down = coefs[:o, own], shift[np.searchsorted(lpc, own)].astype(np.int32)
                for i in range(o, BLOCK):
                    s = c[0] * r[i - 1]
                    for j in range(1, o):
                        s += c[j] * r[i - 1 - j]
                    r[i] += s >> down
            elif o:
                r = _undo_fixed(r, int(o))
            x[:, coded[own]] = r
    return x.T


def _rice_table(k_max: int) -> np.ndarray:
    """For each parameter and the next 16 bits: folded residual << 8 | bits used; 0 where the code is longer."""
    w = np.arange(1 << 16)
    zeros = 16 - np.where(w > 0, np.floor(np.log2(np.maximum(w, 1))).astype(int) + 1, 0)
    out = np.zeros((k_max + 1, 1 << 16), np.int32)
    for k in range(k_max + 1):
        used = zeros + 1 + k
        out[k] = np.where(used <= 16, (((zeros << k) | ((w >> np.maximum(16 - used, 0)) & ((1 << k) - 1))) << 8) | used, 0)
    return out.ravel()


def _long_codes(take, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded residuals and bits of codes of more than 16 bits."""
    z = np.zeros_like(at)
    w = take(at, 16)
    while len(empty := np.flatnonzero(w == 0)):
        z[empty] += 16
        w[empty] = take(at[empty] + z[empty], 16)
    z += 15 - np.floor(np.log2(w)).astype(np.int64)
    return z << k | take(at + z + 1, 16) >> (16 - k), z + 1 + k


def _undo_fixed(x: np.ndarray, order: int) -> np.ndarray:
    taps = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}[order]
    if order == 1:
        return np.cumsum(x, axis=0, dtype=np.int32)
    for i in range(order, len(x)):
        for j, c in enumerate(taps):
            x[i] += c * x[i - 1 - j]
    return x


class Bits:
    """Reads a frame's bits from the left."""

    def __init__(self, data: bytes, at: int):
        self.data, self.bit = data, 8 * at

    def take(self, n: int) -> int:
        a, b = self.bit >> 3, (self.bit + n + 7) >> 3
        if b > len(self.data):
            raise ValueError("frame is cut off")
        v = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.bit - n) & ((1 << n) - 1)
        self.bit += n
        return v

    def signed(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def residuals(r: Bits, block: int, order: int) -> list[int]:
    """Rice residuals after the warm-up: both parameter widths, any partition order, and escaped partitions."""
    method, parts = r.take(2), r.take(4)
    if method > 1 or block % (1 << parts) or block >> parts < order:
        raise ValueError("residual partitions")
    width, out = 4 + method, []
    for i in range(1 << parts):
        n = (block >> parts) - (order if i == 0 else 0)
        k = r.take(width)
        if k == (1 << width) - 1:
            raw = r.take(5)
            out += [r.signed(raw) for _ in range(n)]
        else:
            for _ in range(n):
                u = r.zeros() << k
                u |= r.take(k) if k else 0
                out.append(u >> 1 ^ -(u & 1))
    return out


def subframe(r: Bits, block: int, bits: int) -> list[int]:
    """Samples of one channel: constant, verbatim, fixed or LPC, with wasted bits."""
    if r.take(1):
        raise ValueError("subframe header")
    kind = r.take(6)
    wasted = r.zeros() + 1 if r.take(1) else 0
    bits -= wasted
    if kind == 0:
        x = [r.signed(bits)] * block
    elif kind == 1:
        x = [r.signed(bits) for _ in range(block)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        if order > block:
            raise ValueError("predictor order")
        x, down = [r.signed(bits) for _ in range(order)], 0
        taps = _FIXED[order] if kind < 32 else None
        if taps is None:
            precision, down = r.take(4) + 1, r.signed(5)
            if precision == 16 or down < 0:
                raise ValueError("predictor precision")
            taps = [r.signed(precision) for _ in range(order)]
        for e in residuals(r, block, order):
            x.append(e + (sum(c * x[-1 - j] for j, c in enumerate(taps)) >> down))
    else:
        raise ValueError("subframe type")
    return [v << wasted for v in x] if wasted else x


#: The taps of the fixed predictors, and the format's codes of block sizes and sample widths.
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
_BLOCKS = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
_WIDTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def frame_any(data: bytes, at: int, info: dict) -> tuple[np.ndarray, int]:
    """Samples (block x channels) of the frame at a byte offset, and where it ends; both checksums are verified."""
    r = Bits(data, at)
    if r.take(15) != 0x7FFC:
        raise ValueError("frame header")
    r.take(1)
    size, rate, channels, width = r.take(4), r.take(4), r.take(4), r.take(3)
    if r.take(1) or channels > 10:
        raise ValueError("frame header")
    lead = r.take(8)
    for _ in range(0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1):
        r.take(8)
    block = r.take(8) + 1 if size == 6 else r.take(16) + 1 if size == 7 else _BLOCKS.get(size)
    r.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    bits = info["bits"] if width == 0 else _WIDTHS.get(width)
    if block is None or bits is None or rate == 15:
        raise ValueError("frame header")
    raw, head = np.frombuffer(data, np.uint8), (r.bit >> 3) - at
    if crc(raw, np.array([at]), np.array([head]), 0x07, 8)[0] != r.take(8):
        raise ValueError("CRC-8 of a frame header")
    n = 2 if channels > 7 else channels + 1
    side = {8: 1, 9: 0, 10: 1}.get(channels)  # the channel that holds a difference has one bit more
    x = np.array([subframe(r, block, bits + (c == side)) for c in range(n)], np.int64)
    if channels == 8:
        x[1] = x[0] - x[1]
    elif channels == 9:
        x[0] = x[0] + x[1]
    elif channels == 10:
        mid = x[0] << 1 | (x[1] & 1)
        x[0], x[1] = (mid + x[1]) >> 1, (mid - x[1]) >> 1
    end = (r.bit + 7) >> 3
    if end + 2 > len(data) or crc(raw, np.array([at]), np.array([end - at]), 0x8005, 16)[0] != int.from_bytes(data[end : end + 2], "big"):
        raise ValueError("CRC-16 of a frame")
    return x.T, end + 2


def pcm_of(x: np.ndarray, bits: int) -> bytes:
    """Samples as in WAV: 8 bits and fewer unsigned, wider ones signed little-endian in whole bytes, channels interleaved."""
    if bits <= 8:
        return (x + 128).astype(np.uint8).tobytes()
    wide = (bits + 7) // 8
    return x.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :wide].tobytes()


def decode_any(media: bytes) -> tuple[list[bytes], list[int], list[int]]:
    """PCM blocks of any FLAC stream, the sample offset and the byte offset of each."""
    info, _, at = parse_head(media)
    pcm, sample, byte, done, md5 = [], [], [], 0, hashlib.md5()
    while at < len(media) and (not info["samples"] or done < info["samples"]):
        x, end = frame_any(media, at, info)
        pcm.append(pcm_of(x, info["bits"]))
        sample.append(done)
        byte.append(at)
        md5.update(x.astype("<i8").reshape(-1, 1).view(np.uint8)[:, : (info["bits"] + 7) // 8].tobytes())
        at, done = end, done + len(x)
    if info["samples"] and done != info["samples"]:
        raise ValueError("number of samples")
    if any(info["md5"]) and md5.digest() != info["md5"]:
        raise ValueError("MD5 of the samples")
    return pcm, sample, byte


def read_samples(media: bytes, start: int, count: int) -> bytes:
    """PCM of samples start to start + count of a stream that this module wrote, decoding only the frames that hold them."""
    info, offsets, at = own_head(media)
    start, end = max(0, start), min(info["samples"], max(0, start) + max(0, count))
    if start >= end:
        return b""
    first, last = start // BLOCK, (end - 1) // BLOCK
    edges = np.append(offsets, len(media) - at)[first : last + 2] + at
    data = np.frombuffer(media, np.uint8)[edges[0] : edges[-1]]
    pcm = (decode_frames(data, edges[:-1] - edges[0], np.diff(edges)) + 128).astype(np.uint8).tobytes()
    return pcm[start - first * BLOCK : end - first * BLOCK]


def decode(media: list[bytes]) -> list[bytes]:
    """The payload of each stream that this module wrote, with every checksum verified; Other for other streams."""
    heads = [own_head(m) for m in media]
    data = np.frombuffer(b"".join(media), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(m) for m in media])])
    start = np.concatenate([b + at + off for b, (_, off, at) in zip(base, heads, strict=False)])
    size = np.concatenate([np.diff(np.append(off + at, len(m))) for m, (_, off, at) in zip(media, heads, strict=True)])
    out = []
    step = BATCH_BYTES // BLOCK
    for a in range(0, len(start), step):
        b = min(len(start), a + step)
        lo, hi = start[a], start[b - 1] + size[b - 1]
        out.append((decode_frames(data[lo:hi], start[a:b] - lo, size[a:b]) + 128).astype(np.uint8).tobytes())
    whole, at, payloads = b"".join(out), 0, []
    for info, _, _ in heads:
        payloads.append(whole[at : at + info["samples"]])
        at += info["samples"]
        if md5_of(payloads[-1]) != info["md5"]:
            raise ValueError("MD5 of the samples")
    return payloads


def blocks_of(media: list[bytes | None]) -> list[tuple[list[bytes], list[int], list[int], str | None]]:
    """(PCM blocks, sample offsets, byte offsets, error) of each stream; a null or broken one has no blocks and an error."""

    def cut(m: bytes, payload: bytes):
        _, off, at = own_head(m)
        return [payload[a : a + BLOCK] for a in range(0, len(payload), BLOCK)], list(range(0, len(payload), BLOCK)), (off + at).tolist(), None

    def one(m: bytes | None):
        if m is None:
            return [], [], [], "null"
        try:
            try:
                return cut(m, decode([m])[0])
            except Other:
                return (*decode_any(m), None)
        except (ValueError, IndexError, OverflowError, MemoryError) as e:
            return [], [], [], str(e) or type(e).__name__

    try:
        return [cut(m, p) for m, p in zip(media, decode(media), strict=True)] if media and None not in media else [one(m) for m in media]
    except (ValueError, IndexError):
        return [one(m) for m in media]


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a FLAC stream.

    A text's UTF-8 bytes (null: none) are filled with bytes 255 to a positive multiple of 576.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, text_col, BATCH_BYTES):
                off, data = buffers(part.column(1))
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
                fill = [max(BLOCK, -(-len(t) // BLOCK) * BLOCK) - len(t) for t in texts]
                media = encode([t + b"\xff" * f for t, f in zip(texts, fill, strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, block, sample_offset, byte_offset, pcm, error, *keep): decoded blocks, seekable by either offset.

    A stream's blocks follow each other in order, in one partition. A null or broken stream is one
    row whose block, offsets and pcm are null and whose error says why; a stream without samples is
    one row with block 0 and no pcm. keep: columns of the stream that each of its rows repeats.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, media_col, BATCH_BYTES):
                ids, cols = [], [[], [], [], [], []]
                for i, (pcm, sample, byte, error) in enumerate(blocks_of(part.column(1).to_pylist())):
                    n = max(1, len(pcm))
                    ids += [i] * n
                    none = [None] if error else [0]
                    for c, v in zip(cols, (list(range(n)) if not error else none, sample or none, byte or none, pcm or ([None] if error else [b""]), [error] * n), strict=True):
                        c += v
                at = pa.array(ids, pa.int64())
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), *(part.column(2 + i).take(at) for i in range(len(keep)))], [id_col, "block", "sample_offset", "byte_offset", "pcm", "error", *keep])

    kind = media.schema[id_col].dataType.simpleString()
    more = "".join(f", `{c}` {media.schema[c].dataType.simpleString()}" for c in keep)
    return media.select(id_col, media_col, *keep).mapInArrow(run, f"`{id_col}` {kind}, block int, sample_offset long, byte_offset long, pcm binary, error string{more}")


def features(blocks: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, payload_bytes, payload_sha256, tail_crc32, feature, error, *keep) of each stream, from the rows of `pcm_blocks` of 8-bit samples.

    A stream's blocks are put together by their sample offsets as they come, so nothing is shuffled.
    feature: peak, energy, zero crossings and roughness (sum of absolute differences) of the
    samples. A null or broken stream has nulls and its error.
    """

    def summary(pcm: list[bytes], offsets: list[int], error):
        if error:
            return None, None, None, None, error
        p = b"".join(pcm)
        if offsets != np.cumsum([0, *map(len, pcm)])[:-1].tolist():
            raise ValueError("blocks of a stream are not in order")
        x = np.frombuffer(p, np.uint8).astype(np.int32) - 128
        d = np.diff(x)
        feature = f"peak={np.abs(x).max(initial=0)};energy={int((x * x).sum(dtype=np.int64))};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};rough={int(np.abs(d).sum(dtype=np.int64))}"
        return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), feature, None

    def run(batches):
        held, schema = None, None  # the stream being put together: its fixed columns, blocks, offsets, error
        names = [id_col, *keep, "payload_bytes", "payload_sha256", "tail_crc32", "feature", "error"]

        def rows(done):
            cols = list(zip(*[(*fixed, *summary(*rest)) for fixed, *rest in done], strict=True))
            kinds = [*schema, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for batch in batches:
            schema = [batch.schema.field(i).type for i in (0, *range(5, 5 + len(keep)))]
            block, offset, pcm, error = (batch.column(i).to_pylist() for i in range(1, 5))
            begins = [i for i, b in enumerate(block) if not b]  # block 0 or null opens a stream
            fixed = list(zip(*[batch.column(i).take(pa.array(begins, pa.int64())).to_pylist() for i in (0, *range(5, 5 + len(keep)))], strict=True))
            edges, done = [*begins, len(block)], []
            if held and edges[0]:
                held[1].extend(pcm[: edges[0]])
                held[2].extend(offset[: edges[0]])
            for f, a, b in zip(fixed, edges[:-1], edges[1:], strict=True):
                if held:
                    done.append(held)
                held = (f, pcm[a:b], offset[a:b], error[a])
            if done:
                yield rows(done)
        if held:
            yield rows([held])

    kind = blocks.schema[id_col].dataType.simpleString()
    more = "".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}, " for c in keep)
    return blocks.select(id_col, "block", "sample_offset", "pcm", "error", *keep).mapInArrow(run, f"`{id_col}` {kind}, {more}payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, error string")


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What a reader gets back from stored streams (id, n_bytes, media): digests of payload and stream, and `features`.

    A null or broken stream keeps its row: what needs its samples is null, and error says why.
    """
    keep = ("n_bytes", "media_bytes", "media_sha256")
    rows = media.select(id_col, "n_bytes", "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    out = features(pcm_blocks(rows, id_col, keep=keep), id_col, keep)
    return out.select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")

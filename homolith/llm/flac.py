"""FLAC: a lossless coder of 8-bit mono samples in numpy, with CRCs, a seek table and PCM blocks."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, tidy, written

#: Samples in a block; frames that are coded or decoded side by side; sample rate in the stream's header.
BLOCK, SIDE, RATE = 576, 2048, 8000
#: Order of the linear predictors that are fitted to a frame; bits of their weights; largest shift of their sums.
LPC, PRECISION, SHIFT = 4, 10, 12
#: Size of a block in a frame's header, by its code (fixed values of the format).
BLOCK_CODES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}


def _crc_table(bits: int, poly: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly) & mask if c & top else c << 1 & mask
        out.append(c)
    return np.array(out, dtype=np.uint16)


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _crc_rows(buf: np.ndarray, start: np.ndarray, length: np.ndarray, bits: int) -> np.ndarray:
    """CRC of each row buf[start : start + length]. Rows are set against the right: leading zeros leave a CRC of 0 as it is."""
    n = int(length.max(initial=0))
    at = (start + length)[:, None] + np.arange(-n, 0)
    rows = np.where(at >= start[:, None], buf[np.maximum(at, 0)], 0).astype(np.uint16).T.copy()
    crc = np.zeros(len(start), dtype=np.uint16)
    if bits == 8:
        for r in rows:
            crc = CRC8[crc ^ r]
        return crc
    for r in rows:
        crc = (crc << 8) ^ CRC16[(crc >> 8) ^ r]
    return crc


def _utf8_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers coded as UTF-8 codes characters: (rows of 6 bytes, lengths)."""
    length = 1 + (n >= 0x80).astype(np.int64) + (n >= 0x800) + (n >= 0x10000) + (n >= 0x200000) + (n >= 0x4000000)
    out = np.zeros((len(n), 6), dtype=np.uint8)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC])[length]
    for j in range(6):
        shift = np.maximum(6 * (length - 1 - j), 0)
        v = n >> shift
        out[:, j] = np.where(j >= length, 0, lead | v if j == 0 else 0x80 | (v & 0x3F))
    return out, length


def _rice_best(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parameter (0 to 14) for each row of unsigned residuals, and its bits."""
    mean = u.mean(axis=1)
    k0 = np.clip(np.floor(np.log2(np.maximum(mean * 0.69, 1e-9))).astype(np.int64), 0, 13)
    bits = [(u >> (k0 + d)[:, None]).sum(axis=1) + u.shape[1] * (1 + k0 + d) for d in (0, 1)]
    more = bits[1] < bits[0]
    return k0 + more, np.where(more, bits[1], bits[0])


def predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the weights of a linear predictor of order LPC, as integers, and the shift of their sums: Levinson and
    Durbin's recursion on the autocorrelation, the samples tapered by a triangle."""
    taper = 1 - np.abs(np.linspace(-1, 1, x.shape[1])) * 0.75
    y = x * taper
    r = np.stack([(y[:, k:] * y[:, : x.shape[1] - k]).sum(axis=1) for k in range(LPC + 1)])
    r[0] = r[0] * (1 + 1e-9) + 1e-9
    a, error = np.zeros((LPC, len(x))), r[0].copy()
    for i in range(LPC):
        reflect = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(axis=0)) / error
        a[:i] = a[:i] - reflect * a[:i][::-1]
        a[i] = reflect
        error = np.maximum(error * (1 - reflect**2), 1e-9)
    top = np.maximum(np.abs(a).max(axis=0), 1e-6)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(top)), 0, SHIFT).astype(np.int64)
    most = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * 2.0**shift), -most, most - 1).astype(np.int64).T, shift


def predicted(x: np.ndarray, weights: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """What the predictors make of the samples before each sample from the LPC-th on."""
    n = x.shape[1]
    total = sum(weights[:, j][:, None] * x[:, LPC - 1 - j : n - 1 - j].astype(np.int64) for j in range(LPC))
    return total >> shift[:, None]


def encode_frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of rows of BLOCK signed 8-bit samples: all bytes, and the length of each frame.

    Of a constant, the fixed linear predictors of order 0 to 2, a fitted one of order LPC (both with Rice-coded residuals),
    and the samples as they are, each frame takes the shortest; it depends on the frame alone.
    """
    x = x.astype(np.int32)
    f = len(x)
    residual = [x, np.diff(x, axis=1), np.diff(x, n=2, axis=1)]
    weights, shift = predictors(x)
    residual.append((x[:, LPC:] - predicted(x, weights, shift)).astype(np.int32))
    zig = [(r << 1) ^ (r >> 31) for r in residual]
    best = [_rice_best(u) for u in zig]
    extra = [0, 8, 16, 8 * LPC + 9 + PRECISION * LPC]  # first samples, and the fitted predictor
    size = np.stack([more + 10 + bits for more, (_, bits) in zip(extra, best, strict=True)] + [np.full(f, 8 * BLOCK)])
    kind = size.argmin(axis=0)  # 0 to 2: order; 3: fitted; 4: verbatim; 5: constant
    kind[(x == x[:, :1]).all(axis=1)] = 5
    sub = (8 + np.where(kind == 5, 8, size.min(axis=0)) + 7) // 8
    coded, digits = _utf8_number(number)
    head = 5 + digits
    length = head + sub + 2
    base = np.cumsum(length) - length
    bits = np.zeros(int(length.sum()) * 8, dtype=np.uint8)
    at = (base + head) * 8

    def put(rows: np.ndarray, offset: np.ndarray, value: np.ndarray, n: int) -> None:
        for j in range(n):
            bits[offset + j] = value >> (n - 1 - j) & 1

    for o in range(4):
        rows = np.flatnonzero(kind == o)
        if not len(rows):
            continue
        k, u, p = best[o][0][rows], zig[o][rows], at[rows]
        put(rows, p, np.full(len(rows), (8 | o if o < 3 else 32 | LPC - 1) << 1), 8)
        for w in range(o if o < 3 else LPC):
            put(rows, p + 8 + 8 * w, x[rows, w] & 255, 8)
        if o == 3:
            put(rows, p + 8 + 8 * LPC, PRECISION - 1 << 5 | shift[rows], 9)
            for j in range(LPC):
                put(rows, p + 17 + 8 * LPC + PRECISION * j, weights[rows, j] & (1 << PRECISION) - 1, PRECISION)
        put(rows, p + 8 + extra[o], k, 10)  # method 0, one partition, its parameter
        q = u >> k[:, None]
        n = q + 1 + k[:, None]
        stop = (p + 18 + extra[o])[:, None] + np.cumsum(n, axis=1) - n + q
        bits[stop] = 1
        for j in range(int(k.max())):
            some = np.flatnonzero(k > j)
            bits[stop[some] + (k[some] - j)[:, None]] = u[some] >> j & 1
    rows = np.flatnonzero(kind == 4)
    if len(rows):
        put(rows, at[rows], np.full(len(rows), 2), 8)
        bits[(at[rows] + 8)[:, None] + np.arange(8 * BLOCK)] = np.unpackbits((x[rows] & 255).astype(np.uint8), axis=1)
    rows = np.flatnonzero(kind == 5)
    if len(rows):
        put(rows, at[rows] + 8, x[rows, 0] & 255, 8)
    buf = np.packbits(bits)
    for j, v in enumerate((0xFF, 0xF8, 0x20, 0x02)):
        buf[base + j] = v
    for j in range(6):
        some = np.flatnonzero(digits > j)
        buf[base[some] + 4 + j] = coded[some, j]
    buf[base + head - 1] = _crc_rows(buf, base, head - 1, 8)
    crc = _crc_rows(buf, base, length - 2, 16)
    buf[base + length - 2], buf[base + length - 1] = crc >> 8, crc & 255
    return buf, length


def header(payload: bytes, lengths: np.ndarray) -> bytes:
    """Magic, STREAMINFO, and a SEEKTABLE with a point (sample, byte, samples) for every frame."""
    n = len(lengths)
    signed = (np.frombuffer(payload, dtype=np.uint8) ^ 128).tobytes()
    packed = RATE << 44 | 0 << 41 | 7 << 36 | len(payload)
    info = BLOCK.to_bytes(2, "big") * 2 + int(lengths.min()).to_bytes(3, "big") + int(lengths.max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(signed).digest()
    points = np.zeros(n, dtype=[("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])
    points["sample"], points["byte"], points["n"] = np.arange(n) * BLOCK, np.cumsum(lengths) - lengths, BLOCK
    # A metadata block holds under 16 MB: very long streams have several seek tables.
    step = (1 << 24) // 18 - 1
    blocks = [points[i : i + step].tobytes() for i in range(0, n, step)]
    tables = b"".join((3 | (128 if i == len(blocks) - 1 else 0)).to_bytes(1, "big") + len(b).to_bytes(3, "big") + b for i, b in enumerate(blocks))
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + tables


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload (a positive multiple of BLOCK bytes). Frames of many payloads are coded side by side."""
    counts = [len(p) // BLOCK for p in payloads]
    samples = (np.frombuffer(b"".join(payloads), dtype=np.uint8) ^ 128).view(np.int8).reshape(-1, BLOCK)
    number = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, np.int64)
    parts, lengths = [], []
    for i in range(0, len(samples), SIDE):
        buf, n = encode_frames(samples[i : i + SIDE], number[i : i + SIDE])
        parts.append(buf.tobytes())
        lengths.append(n)
    whole, lengths = b"".join(parts), np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    out, at = [], 0
    for p, c in zip(payloads, counts, strict=True):
        out.append(header(p, lengths[at : at + c]) + whole[ends[at] : ends[at + c]])
        at += c
    return out


def metadata(stream: bytes) -> tuple[dict, list[tuple[int, int, int]], int]:
    """STREAMINFO's fields, the seek points (sample, byte from the first frame, samples), and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, points, last = 4, {}, [], False
    while not last:
        last, kind, n = bool(stream[at] & 128), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body, at = stream[at + 4 : at + 4 + n], at + 4 + n
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"block": int.from_bytes(body[:2], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            t = np.frombuffer(body, dtype=[("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])
            points += [tuple(map(int, p)) for p in t if int(p["sample"]) != (1 << 64) - 1]
    return info, points, at


class Bits:
    """A reader of one frame, bit by bit."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.at >> 3, self.at + n + 7 >> 3
        v = int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.at - n) & (1 << n) - 1
        self.at += n
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def decode_frame(stream: bytes, at: int, bits: int = 8) -> tuple[int, list[int], int]:
    """One mono frame at a byte: (its number, its samples, where the next begins). Knows constants, plain samples, fixed and
    LPC predictors, partitions, escaped partitions and wasted bits; raises ValueError if a checksum is wrong."""
    r = Bits(stream, at)
    if r.take(15) != 0x7FFC:
        raise ValueError("no frame here")
    r.take(1)
    code, rate, channels, depth = r.take(4), r.take(4), r.take(4), r.take(3)
    r.take(1)
    if channels:
        raise ValueError("one channel only")
    first = r.take(8)
    ones = 8 - (first ^ 0xFF).bit_length()
    number = first & (0x7F >> ones)
    for _ in range(max(ones - 1, 0)):
        number = number << 6 | r.take(8) & 0x3F
    n = r.take(8) + 1 if code == 6 else r.take(16) + 1 if code == 7 else BLOCK_CODES[code]
    r.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    end = r.at >> 3
    crc = 0
    for b in stream[at:end]:
        crc = int(CRC8[crc ^ b])
    if crc != r.take(8):
        raise ValueError("wrong CRC-8")
    bits = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}.get(depth, bits)
    r.take(1)
    kind = r.take(6)
    wasted = r.unary() + 1 if r.take(1) else 0
    bits -= wasted
    if kind == 0:
        out = [r.signed(bits)] * n
    elif kind == 1:
        out = [r.signed(bits) for _ in range(n)]
    else:
        order = kind - 8 if kind < 32 else kind - 31
        out = [r.signed(bits) for _ in range(order)]
        if kind < 32:
            weights, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
        else:
            precision, shift = r.take(4) + 1, r.signed(5)
            weights = [r.signed(precision) for _ in range(order)]
        wide = 5 if r.take(2) else 4
        parts = r.take(4)
        for i in range(1 << parts):
            k = r.take(wide)
            raw = r.take(5) if k == (1 << wide) - 1 else None
            for _ in range((n >> parts) - (order if i == 0 else 0)):
                if raw is None:
                    u = r.unary() << k | r.take(k)
                    e = u >> 1 ^ -(u & 1)
                else:
                    e = r.signed(raw)
                out.append(e + (sum(w * s for w, s in zip(weights, reversed(out), strict=False)) >> shift))
    end = r.at + 7 >> 3
    crc = 0
    for b in stream[at:end]:
        crc = (crc << 8 & 0xFFFF) ^ int(CRC16[crc >> 8 ^ b])
    if crc != int.from_bytes(stream[end : end + 2], "big"):
        raise ValueError("wrong CRC-16")
    return number, [s << wasted for s in out], end + 2


def decode_frames(buf: np.ndarray, base: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rows of BLOCK samples of the frames at the given places. Frames of a kind are decoded in step: one residual of
    each at a time. Both checksums of every frame are verified. Frames that aren't in the encoder's form go through decode_frame()."""
    out = np.zeros((len(base), BLOCK), dtype=np.int16)
    first = buf[base + 4].astype(np.int64)
    head = 6 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0) + (first >= 0xF8) + (first >= 0xFC)
    plain = (buf[base] == 0xFF) & (buf[base + 1] == 0xF8) & (buf[base + 2] == 0x20) & (buf[base + 3] == 0x02)
    crc = _crc_rows(buf, base, length - 2, 16)
    if ((buf[base + length - 2].astype(np.int64) << 8 | buf[base + length - 1]) != crc).any():
        raise ValueError("wrong CRC-16")
    if (_crc_rows(buf, base, head - 1, 8)[plain] != buf[base + head - 1][plain]).any():
        raise ValueError("wrong CRC-8")
    bits = np.unpackbits(np.concatenate([buf, np.zeros(8, np.uint8)]))
    ends = np.arange(len(bits), dtype=np.int32)
    ends[bits == 0] = len(bits) - 1
    following = np.minimum.accumulate(ends[::-1])[::-1]
    wide = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.int64)
    wide = wide[:-4] << 24 | wide[1:-3] << 16 | wide[2:-2] << 8 | wide[3:-1]
    grab = lambda p, n: wide[p >> 3] >> (32 - (p & 7) - n) & ((1 << n) - 1)
    kind = buf[base + head].astype(np.int64) >> 1
    start = (base + head + 1) * 8
    flagged = ~plain | (buf[base + head] & 1 > 0) | ((kind > 12) & (kind < 32)) | ((kind > 1) & (kind < 8))
    for code in np.unique(kind[~flagged & (kind > 1)]):
        fixed, o = code < 32, int(code - 8 if code < 32 else code - 31)
        here = np.flatnonzero(~flagged & (kind == code))
        begin = start[here] + 8 * o
        if not fixed:  # the precision of the weights, the shift and the weights come first
            precision, shift = grab(begin, 4) + 1, grab(begin + 4, 5)
            weights = np.stack([grab(begin + 9 + precision * j, precision) for j in range(o)], axis=1)
            weights = weights - ((weights >> precision[:, None] - 1) << precision[:, None])
            flagged[here[shift > 15]] = True  # a negative shift
            begin = begin + 9 + precision * o
        orders = grab(begin, 6)
        flagged[here[orders > 15]] = True
        for parts in np.unique(orders[orders < 16]):
            mine = orders == parts
            rows = here[mine]
            pos = begin[mine] + 6
            u = np.zeros((BLOCK - o, len(rows)), dtype=np.int64)
            per, k = BLOCK >> int(parts), None
            bad = np.zeros(len(rows), dtype=bool)
            for i in range(BLOCK - o):
                if k is None or (i + o) % per == 0:
                    k = grab(pos, 4)
                    bad |= k == 15
                    pos, mask, less = pos + 4, (1 << k) - 1, 32 - k
                stop = following[np.minimum(pos, len(following) - 1)]
                p = stop + 1
                low = wide[np.minimum(p >> 3, len(wide) - 1)] >> (less - (p & 7)) & mask
                u[i] = (stop - pos) << k | low
                pos = p + k
            flagged[rows[bad]] = True
            s = ((u >> 1) ^ -(u & 1)).T
            warm = np.stack([_signed(grab(start[rows] + 8 * w, 8)) for w in range(o)], axis=1) if o else np.zeros((len(rows), 0), np.int64)
            if not fixed:
                made, w, by = np.concatenate([warm.T, s.T]), weights[mine].T[::-1].copy(), shift[mine]
                for i in range(o, BLOCK):
                    made[i] += (w * made[i - o : i]).sum(axis=0) >> by
                out[rows] = made.T
                continue
            for d in range(o - 1, -1, -1):  # sums of the differences of order d + 1, from the warm-up's
                s = np.cumsum(np.concatenate([np.diff(warm[:, : d + 1], n=d, axis=1)[:, :1], s], axis=1), axis=1) if d == 0 else np.cumsum(np.concatenate([np.diff(warm[:, : d + 1], n=d, axis=1), s], axis=1), axis=1)
            out[rows] = s
    rows = np.flatnonzero(~flagged & (kind == 1))
    if len(rows):
        out[rows] = buf[(base + head + 1)[rows][:, None] + np.arange(BLOCK)].view(np.int8)
    rows = np.flatnonzero(~flagged & (kind == 0))
    if len(rows):
        out[rows] = buf[(base + head + 1)[rows]].view(np.int8)[:, None]
    if flagged.any():
        data = buf.tobytes()
        for i in np.flatnonzero(flagged):
            _, samples, _ = decode_frame(data, int(base[i]))
            out[i] = samples
    return out


def _signed(v: np.ndarray) -> np.ndarray:
    return v - ((v & 128) << 1)


def decode_all(streams: list[bytes]) -> list[np.ndarray]:
    """Samples of each stream. Streams with a seek point for every frame of BLOCK samples are decoded side by side, others frame by frame."""
    out: list[np.ndarray | None] = [None] * len(streams)
    chunks, place, lengths, owner = [], [], [], []
    at = 0
    held = []
    for i, s in enumerate(streams):
        info, points, begin = metadata(s)
        held.append(info)
        if info["channels"] == 1 and info["bits"] == 8 and info["samples"] == len(points) * BLOCK and points and all(n == BLOCK for _, _, n in points):
            b = np.array([p[1] for p in points], dtype=np.int64)
            place.append(b + at)
            lengths.append(np.diff(np.append(b, len(s) - begin)))
            owner.append((i, len(points)))
            chunks.append(s[begin:])
            at += len(s) - begin
            continue
        samples, pos = [], begin
        while pos < len(s):
            _, got, pos = decode_frame(s, pos, info["bits"])
            samples += got
        out[i] = np.array(samples, dtype=np.int32)
    if owner:
        buf, base, length = np.frombuffer(b"".join(chunks), dtype=np.uint8), np.concatenate(place), np.concatenate(lengths)
        rows = []
        for i in range(0, len(base), SIDE):
            b, n = base[i : i + SIDE], length[i : i + SIDE]
            low, high = int(b[0]), int(b[-1] + n[-1])
            rows.append(decode_frames(buf[low:high], b - low, n))
        rows, at = np.concatenate(rows), 0
        for i, n in owner:
            out[i] = rows[at : at + n].reshape(-1)
            at += n
    for info, samples in zip(held, out, strict=True):
        if info["bits"] == 8 and any(info["md5"]) and hashlib.md5(samples.astype(np.int8).tobytes()).digest() != info["md5"]:
            raise ValueError("wrong MD5 of the samples")
    return out


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text in UTF-8 with bytes 255 up to a positive multiple of BLOCK, and its own length."""
    raw = (text or "").encode()
    return raw + b"\xff" * (BLOCK - len(raw) % BLOCK if len(raw) % BLOCK or not raw else 0), len(raw)


def feature(samples: np.ndarray) -> str:
    """Sum, sum of squares, peak and sign changes of the samples."""
    s = samples.astype(np.int64)
    return f"sum={s.sum()};squares={(s * s).sum()};peak={np.abs(s).max(initial=0)};crossings={int(np.count_nonzero(np.diff(np.signbit(s))))}"


def _groups(batches, column: int, most: int = SIDE * BLOCK):
    """Slices of batches, of about `most` bytes of text each."""
    for batch in batches:
        at, held = 0, 0
        sizes = [len(v.as_buffer()) if v.is_valid else 0 for v in batch.column(column)]
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n + BLOCK
        yield batch.slice(at)


def media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes and media, the FLAC stream of its padded bytes.

    A null text counts as empty and gives one block of 255; repeated rows each get a stream; equal texts give equal streams.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in _groups(batches, 1):
            made = [payload_of(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for _, n in made], pa.int64()), pa.array(encode_all([p for p, _ in made]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, media binary")


def stored(found: DataFrame) -> DataFrame:
    """media()'s rows, written to the shared folder and read back. The table is packed: headers, seek points and repeated
    streams are alike."""
    return written(found.sparkSession, found, "flac", **{"compression": "zstd", "parquet.compression.codec.zstd.level": "9"})[0]


def digests(found: DataFrame) -> DataFrame:
    """Of media()'s rows, what is read back: sizes, hashes and the feature of the decoded samples."""
    kind = found.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in _groups(batches, 2):
            streams = b.column(2).to_pylist()
            rows = []
            for stream, samples in zip(streams, decode_all(streams), strict=True):
                payload = (samples.astype(np.int8).view(np.uint8) ^ 128).tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), feature(samples)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)

    return found.select("doc_id", "n_bytes", "media").mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def pcm_blocks(found: DataFrame) -> DataFrame:
    """Of media()'s rows, the decoded blocks: doc_id, block, sample_offset, byte_offset (of its frame in the stream), pcm (signed 8-bit)."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in _groups(batches, 1):
            streams = b.column(1).to_pylist()
            for i, (stream, samples) in enumerate(zip(streams, decode_all(streams), strict=True)):
                _, points, begin = metadata(stream)
                n = len(points)
                pcm = [samples[s : s + c].astype(np.int8).tobytes() for s, _, c in points]
                ids = pa.array([b.column(0)[i].as_py()] * n, b.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(range(n), pa.int64()), pa.array([p[0] for p in points], pa.int64()), pa.array([begin + p[1] for p in points], pa.int64()), pa.array(pcm, pa.binary())], ["doc_id", "block", "sample_offset", "byte_offset", "pcm"])

    return found.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, block long, sample_offset long, byte_offset long, pcm binary")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(stored(media(table(spark, sf_dir, "documents"))))

import hashlib
import random
import zlib

import numpy as np
import pytest

from homolith.llm import flac

SCHEMA = "doc_id long, text string, media string, n_bytes string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def waves():
    """Payloads for which each way of coding a frame is the shortest."""
    draw, t = random.Random(1), np.arange(576 * 3)
    tone = lambda *f: (128 + sum(np.rint(30 * np.sin(t * x)) for x in f)).astype(np.uint8).tobytes()
    return {
        "constant": [b"\xff" * 576, bytes(1152)],
        "verbatim": [bytes(draw.choices(range(256), k=576))],
        "fitted": [tone(0.3, 1.1), tone(2.5)],
        "fixed": [(t // 8 % 256).astype(np.uint8).tobytes(), flac.payload_of("é" * 3000)[0]],
        "text": [flac.payload_of(x)[0] for x in (None, "a", "ab" * 288, "".join(chr(draw.randint(32, 126)) for _ in range(2000)))],
    }


def kinds(stream):
    """The code of the predictor of each frame."""
    _, points, at = flac.metadata(stream)
    out = []
    for _, b, _ in points:
        head = at + b + 4
        n = 8 - (stream[head] ^ 0xFF).bit_length()
        out.append(stream[head + max(n, 1) + 1] >> 1)
    return out


def test_round_trip():
    """Frames decoded side by side and bit by bit; both see the samples that went in."""
    used = {}
    for name, payloads in waves().items():
        streams = flac.encode_all(payloads)
        used[name] = {k for s in streams for k in kinds(s)}
        for p, s, x in zip(payloads, streams, flac.decode_all(streams), strict=True):
            assert (x.astype(np.int8).view(np.uint8) ^ 128).tobytes() == p
            _, points, at = flac.metadata(s)
            out, starts, begin = [], [], at
            while at < len(s):
                starts.append(at - begin)
                _, got, at = flac.decode_frame(s, at)
                out += got
            assert (np.array(out, np.int8).view(np.uint8) ^ 128).tobytes() == p
            assert starts == [b for _, b, _ in points]
    assert used["constant"] == {0} and used["verbatim"] == {1} and used["fitted"] == {32 | flac.LPC - 1} and used["fixed"] <= {8, 9, 10, 35}


def bits(*parts):
    """Bytes of (value, width) pairs, filled up with zeros."""
    s = "".join(f"{v & (1 << n) - 1:0{n}b}" for v, n in parts)
    s += "0" * (-len(s) % 8)
    return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8))


def crc(data, poly, width):
    c = 0
    for b in data:
        c ^= b << width - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c >> width - 1 else c << 1) & (1 << width) - 1
    return c


def frame_of(*body):
    """A frame of 16 samples around a subframe that is written by hand."""
    head = bits((0x7FFC, 15), (0, 1), (6, 4), (0, 4), (0, 4), (1, 3), (0, 1), (0, 8), (15, 8))
    data = head + bytes([crc(head, 7, 8)]) + bits(*body)
    return data + crc(data, 0x8005, 16).to_bytes(2, "big")


def rice(v, k):
    u = v << 1 if v >= 0 else (-v << 1) - 1
    return [(1, (u >> k) + 1), (u & (1 << k) - 1, k)] if k else [(1, u + 1)]


def test_frames_by_hand():
    """Wasted bits, two partitions of which one is escaped, a fitted predictor with a shift, a negative residual."""
    some = [3, -2, 0, 1, -1, 2, 0]
    lpc = frame_of((0, 1), (33, 6), (0, 1), (10, 8), (-4, 8), (4, 4), (2, 5), (6, 5), (-3, 5), (0, 2), (1, 4), (1, 4), *[p for v in some[:6] for p in rice(v, 1)], (15, 4), (3, 5), *[(v, 3) for v in (*some, 3)])
    want = [10, -4]
    for e in (*some[:6], *some, 3):
        want.append(e + (6 * want[-1] - 3 * want[-2] >> 2))
    assert flac.decode_frame(lpc, 0) == (0, want, len(lpc))
    wasted = frame_of((0, 1), (9, 6), (1, 1), (1, 3), (5, 5), (0, 2), (0, 4), (0, 4), *[p for v in [1] * 15 for p in rice(v, 0)])
    assert flac.decode_frame(wasted, 0)[1] == [8 * (5 + i) for i in range(16)]
    with pytest.raises(ValueError, match="CRC-16"):
        flac.decode_frame(lpc[:-3] + bytes([lpc[-3] ^ 4]) + lpc[-2:], 0)
    with pytest.raises(ValueError, match="CRC-8"):
        flac.decode_frame(bytes([*lpc[:4], lpc[4] ^ 1, *lpc[5:]]), 0)


def test_damage_is_found():
    (s,) = flac.encode_all([flac.payload_of("abc " * 900)[0]])
    for at in (-20, -200):
        broken = bytearray(s)
        broken[at] ^= 1
        with pytest.raises(ValueError, match="CRC"):
            flac.decode_all([bytes(broken)])


def test_query_columns(spark):
    long = "word é " * 200_000
    rows = [(1, None), (2, ""), (3, "a" * 576), (3, "a" * 576), (None, "a" * 576), (4, "a" * 577), (5, long)]
    got = [r for r in flac.digests(flac.stored(flac.media(frame(spark, rows)))).collect()]
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_bytes"]): r for r in got}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = by[i, len(raw)]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert by[3, 576]["media_sha256"] == by[None, 576]["media_sha256"] and by[1, 0]["feature"] == by[2, 0]["feature"]
    assert flac.digests(flac.stored(flac.media(frame(spark, rows).limit(0)))).count() == 0


def test_blocks_have_offsets(spark):
    """Any block can be read from the stream alone, from the byte that its row names."""
    media = flac.media(frame(spark, [(1, "one two " * 500), (2, None)]))
    streams = {r["doc_id"]: r["media"] for r in media.collect()}
    rows = flac.pcm_blocks(media).collect()
    assert [r["sample_offset"] for r in sorted(rows, key=lambda r: (r["doc_id"], r["block"])) if r["doc_id"] == 1] == [576 * i for i in range(7)]
    for r in rows:
        number, samples, _ = flac.decode_frame(bytes(streams[r["doc_id"]]), r["byte_offset"])
        assert number == r["block"] and np.array(samples, np.int8).tobytes() == bytes(r["pcm"])

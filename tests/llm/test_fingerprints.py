import hashlib
import random

import pytest
from pyspark.sql import functions as F

from homolith.llm import fingerprints as fp

ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (3, "b"), (4, " \t\n"), (5, "é😀 " * 300), (None, "one two three four five six"), (None, "x"), (6, "ONE two three four five six"), (7, "w " * 60_000)]
FULL = (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 30) * fp.MIX1 & FULL
    x = (x ^ x >> 27) * fp.MIX2 & FULL
    return x ^ x >> 31


VALUE = [mixed((b + 1) * fp.BASE & FULL) for b in range(256)]


def hashes(text):
    words = [mixed((sum(VALUE[c] * pow(fp.BASE, i, 1 << 64) for i, c in enumerate(w)) + len(w)) & FULL) for w in text.encode().lower().split()]
    if not words:
        return set()
    n = min(5, len(words))
    return {mixed(sum(w * pow(fp.STEP, t, 1 << 64) for t, w in enumerate(words[i : i + n])) & FULL) for i in range(len(words) - n + 1)}


def printed(text):
    """One permutation by definition, an empty bin borrowing from the first bin of its order that has a shingle."""
    least = {}
    for h in hashes(text):
        b, v = h >> 55, h & (1 << 55) - 1
        least[b] = min(v, least.get(b, v))
    if not least:
        return b""
    order = fp.probes()[0]
    bins = [least.get(b, least[next(o for o in order[b].tolist() if o in least)] if b not in least else None) & 15 for b in range(512)]
    return bytes(x << 4 | y for x, y in zip(bins[::2], bins[1::2], strict=True))


def near(a, b):
    if not a or not b:
        return float(a == b)
    same = sum((x >> 4 == y >> 4) + (x & 15 == y & 15) for x, y in zip(a, b, strict=True)) / 512
    return min(1.0, max(0.0, (same - 1 / 16) / (15 / 16)))


def texts(seed, n):
    draw = random.Random(seed)
    return [" ".join(draw.choice("abcdefgh") * draw.randint(1, 3) + str(draw.randint(0, 99)) for _ in range(draw.choice((0, 1, 4, 5, 6, 20, 40, 300)))) for _ in range(n)]


def test_fingerprints_by_hand(spark):
    rows = [r for r in ODD if r[0] != 7] + [(100 + i, t) for i, t in enumerate(texts(1, 60))]
    frame = spark.createDataFrame([(*r, "x", b"y") for r in rows], "doc_id long, text string, head string, fingerprint binary")
    got = sorted(((r["doc_id"], bytes(r["fingerprint"])) for r in fp.fingerprints(frame).collect()), key=repr)
    assert got == sorted(((i, printed(t or "")) for i, t in rows), key=repr)
    assert fp.fingerprints(frame.limit(0)).count() == 0


def test_likeness_is_near_jaccard(spark):
    draw, rows = random.Random(5), []
    for i in range(150):
        a = [str(draw.randint(0, 10**6)) for _ in range(draw.choice((12, 60, 400)))]
        cut = draw.randint(0, len(a))
        b = a[:cut] + [str(draw.randint(0, 10**6)) for _ in range(len(a) - cut)]
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        rows.append((i, " ".join(a), " ".join(b), len(x & y) / len(x | y)))
    prints = [fp.unpacked(fp.packed(fp._minima([r[k] for r in rows]))) for k in (1, 2)]
    off = [e - r[3] for e, r in zip(fp.alike(*prints), rows, strict=True)]
    assert abs(sum(off)) / len(off) < 0.015 and max(map(abs, off)) < 0.2
    pairs = spark.createDataFrame([(p, q) for p, q in zip(*[fp.packed(x) for x in prints], strict=True)] + [(b"", None), (b"", fp.packed(prints[0])[0])], "a binary, b binary")
    assert [r[0] for r in pairs.select(fp.likeness("a", "b")).collect()] == pytest.approx([*fp.alike(*prints), 1.0, 0.0])


def expected(spark, rows):
    key = {(i, t): h for i, t, h in spark.createDataFrame(rows, "i long, t string").select("i", "t", F.xxhash64(F.coalesce("t", F.lit("")))).collect()}
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), key[r], r[1] or ""))
    rows, out = [(i, t or "") for i, t in rows], []
    for (i, t), (_, after) in zip(rows, [*rows[1:], *rows[:1]], strict=True):
        k = len(t) // 3
        e = t[: len(t) - k] + after[:k]
        own, changed, nxt = printed(t), printed(e), printed(after)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), own.hex(), changed.hex(), round(near(own, changed), 9), round(near(own, nxt), 9)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [ODD + [(100 + i, t) for i, t in enumerate(texts(2, 80))], [(1, "a b c d e f g h")], [(4, "x y z"), (4, "x y z"), (2, None)], []])
def test_query_equals_brute_force(spark, tmp_path, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, head string, part long")
    frame.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = fp.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(((*tuple(r)[:5], round(r[5], 9), round(r[6], 9)) for r in got.collect()), key=repr) == (expected(spark, rows) if rows else [])

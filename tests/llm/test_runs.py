import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from homolith.llm import runs

ODD = [(1, None), (2, ""), (3, "a a a a a a a"), (3, "a a a a a a a"), (4, " \t\n"), (5, "é😀 " * 300), (None, "x x x x x x y"), (6, "b\x1cb b \x0b b b b b b"), (7, "one two " * 5000)]


def brute(w, least=6, power=4):
    """By definition: each stretch that repeats at a distance, of one stretch the smallest period."""
    out = {}
    for q in range(1, len(w) // power + 1):
        s = 0
        while s + q < len(w):
            e = s
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            if e > s and e - s + q >= max(least, power * q):
                out.setdefault((s, e + q), q)
            s = e + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def drawn(draw):
    k, n = draw.choice((1, 2, 3, 5)), draw.randint(0, draw.choice((5, 20, 60, 150)))
    w = [draw.choice("abcdefgh"[:k]) for _ in range(n)]
    for _ in range(draw.randint(0, 4)):
        if n > 4:
            a, p, length = draw.randrange(n), draw.randint(1, 6), draw.randint(1, 40)
            for i in range(a, min(n, a + length)):
                w[i] = w[a + (i - a) % p]
            at, part = draw.randrange(n), w[a : a + length]
            w = (w[:at] + part + w[at + len(part) :])[:n] if draw.random() < 0.5 else w
    return w


def test_runs_of_documents_taken_together():
    for seed in range(1500):
        draw = random.Random(seed)
        docs, names = [drawn(draw) for _ in range(draw.choice((1, 3, 6)))], {}
        numbers = np.array([names.setdefault(x, len(names)) for d in docs for x in d], np.int64)
        assert runs.runs_of(numbers, np.array([len(d) for d in docs], np.int64)) == [brute(d) for d in docs], seed


def test_longest_previous_factors():
    draw = random.Random(1)
    for _ in range(60):
        w = drawn(draw)
        codes = np.array([-1, *map(ord, w), -2])
        length, source, _ = runs.previous_factors(codes)
        for i in range(1, len(w) + 1):
            best = max((next(k for k in range(len(codes)) if codes[i + k] != codes[j + k]) for j in range(i)), default=0)
            assert length[i] == best
            assert not best or (source[i] < i and (codes[source[i] : source[i] + best] == codes[i : i + best]).all())


def test_words():
    words, sizes = runs.split(pa.array([" a b\x0b\x0c\x1cc\x85 d e \n", None, "", " ", "x"]).slice(0))
    assert words.to_pylist() == ["a", "b", "\x1cc\x85", "d e", "x"] and sizes.tolist() == [4, 0, 0, 0, 1]
    words, sizes = runs.split(pa.array(["q q", "a b", None, "x"]).slice(1))
    assert words.to_pylist() == ["a", "b", "x"] and sizes.tolist() == [2, 0, 1]


def test_fewer_periods_are_refused():
    with pytest.raises(ValueError, match="four periods"):
        runs.runs_of(np.zeros(3, np.int64), np.array([3]), power=3)


def expected(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(w), zlib.crc32(("" if i is None else str(i)).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = brute(w)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        lost = {x for s, length, q in found for x in range(s + q, s + length)}
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        kept = " ".join(x for k, x in enumerate(w) if k not in lost)
        out.append((i, len(found), *(best or (None,) * 3), best and best[1] * 1000 // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_query_equals_brute_force(spark, tmp_path):
    draw = random.Random(7)
    rows = ODD + [(100 + i, " ".join(drawn(draw))) for i in range(300)]
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs long, __h string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = runs.query(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns == names
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)


def test_operator(spark):
    frame = spark.createDataFrame([(*r, 1, "x") for r in ODD], "doc_id long, text string, runs long, doc_id_ string")
    got = {(r["doc_id"], r["n_words"]): r for r in runs.runs(frame).collect()}
    assert len(got) == len(ODD) - 1
    assert [tuple(x) for x in got[3, 7]["runs"]] == [(0, 7, 1)] and got[3, 7]["collapsed"] == "a"
    assert [tuple(x) for x in got[7, 10000]["runs"]] == [(0, 10000, 2)] and got[7, 10000]["collapsed"] == "one two"
    assert got[1, 0]["collapsed"] == "" and got[None, 7]["collapsed"] == "x y"
    assert runs.runs(frame.limit(0)).count() == 0
    assert "text" in runs.planted(frame).columns and len(runs.planted(frame).columns) == 4

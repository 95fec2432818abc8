from collections import Counter, defaultdict

import numpy as np
import pytest

from homolith.llm import ann

SCHEMA = "vec_id long, embedding array<double>, row string, list int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", 1, 2.0) for i, v in rows], SCHEMA)


def found(spark, rows, **more):
    out = defaultdict(list)
    for r in sorted(ann.search(frame(spark, rows), **more).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    return out


def recall(rows, got, n=20):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[: min(n, len(rows) - 1)]
        want, have = Counter(ids[best].tolist()), Counter(i for i, _, _ in got[ids[q]])
        hit, total = hit + sum((want & have).values()), total + len(best)
        for i, v, _ in got[ids[q]]:
            assert v in s[ids == i]
    return hit / total


def test_against_brute_force(spark):
    draw = np.random.default_rng(0)
    rows = list(enumerate(draw.normal(size=(900, 16)) * draw.uniform(0.5, 2, size=(900, 1))))
    got = found(spark, rows)
    assert recall(rows, got) >= 0.9 and all([r for _, _, r in g] == list(range(1, 21)) for g in got.values())


def test_tiles_and_sets(spark, monkeypatch):
    monkeypatch.setattr(ann, "TILE", 40)
    monkeypatch.setattr(ann, "QUERIES", 4)
    monkeypatch.setattr(ann, "STRETCH", 16)
    draw = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate(np.concatenate([draw.normal(size=(500, 24)), np.repeat(draw.normal(size=(1, 24)), 300, axis=0)]))]
    got = found(spark, rows)
    assert recall(rows, got) >= 0.9
    # 300 equal vectors: the smallest ids, the own one left out.
    assert [i for i, _, _ in got[520]] == list(range(500, 520)) and [i for i, _, _ in got[500]] == list(range(501, 521))


def test_repeated_rows(spark):
    """Two equal query rows are two queries, each a candidate of the other; copies of a candidate are candidates each."""
    draw = np.random.default_rng(2)
    x = draw.normal(size=(100, 8))
    rows = [*enumerate(x), (20, x[20]), (33, x[33]), (33, x[33])]
    got = found(spark, rows, target=1.0)
    ids, every = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for q in (0, 20, 40):
        s = (every * x[q]).sum(axis=1)
        s[q] = -np.inf  # of id 20 either row: the other has the same vector and score
        best = np.lexsort((ids, -s))[:20]
        want = Counter(zip(ids[best].tolist(), range(1, 21), strict=True))
        assert Counter((i, r) for i, _, r in got[q]) == Counter({k: n * (2 if q == 20 else 1) for k, n in want.items()})


def test_odd_rows(spark):
    one = [1.0] * 4
    rows = [(0, one), (1, one), (2, [0.5] * 4), (20, None), (40, [0.0] * 4), (60, [float("nan"), 1, 1, 1]), (80, [float("inf"), 1, 1, 1]), (100, [None, 1, 1, 1]), (None, one), (120, [1.0] * 3), (121, [2.0] * 3), (140, [3.0] * 9)]
    got = found(spark, rows)
    assert dict(got) == {0: [(1, 4.0, 1), (2, 2.0, 2)], 120: [(121, 6.0, 1)]}
    assert ann.search(frame(spark, [])).count() == 0 and ann.search(frame(spark, [(7, one), (20, None)])).count() == 0


def test_scan_gives_up_early():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.Index(x, 1.0, 16)
    bound = np.array([np.sort(x @ q)[-21] for q in x[:40]])
    q, i, s, read = ann.scan(index, np.arange(40), x[:40], bound, np.arange(2000), np.arange(2000), x, 20)
    assert read < 0.85 and len(q) >= 0.9 * 40 * 20
    loose = ann.scan(index, np.arange(40), x[:40], np.full(40, -np.inf), np.arange(2000), np.arange(2000), x, 20)
    assert read < loose[3] < 1.0 and len(loose[0]) == 40 * 20


@pytest.mark.parametrize("n", [1, 3])
def test_few_rows(spark, n):
    got = found(spark, [(20 * i, [1.0, i]) for i in range(n)])
    assert {q: len(g) for q, g in got.items()} == ({} if n == 1 else {20 * i: n - 1 for i in range(n)})

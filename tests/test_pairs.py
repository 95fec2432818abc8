import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from homolith.operators import communities, pairs, topology


def clouds(seed=5, n=90, width=5):
    """Three samples; many points are copies of others, so that distances are 0 and tie."""
    draw = np.random.default_rng(seed)
    x = draw.normal(0, 1, (n, width)) + 100
    x[n // 2 :: 3] = x[0]
    x[n // 2 + 1 :: 3] = x[draw.integers(0, n // 2, len(x[n // 2 + 1 :: 3]))]
    return [("abc"[i % 3], i * 7 % n, v.tolist()) for i, v in enumerate(x)]


def apart(rows):
    x = np.array([v for _, _, v in rows])
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))


def brute(rows, d, i, k, where):
    return [rows[j][1] for j in sorted((j for j in range(len(rows)) if where(j)), key=lambda j: (d[i, j], rows[j][1]))[:k]]


def test_nearest_over_many_blocks(spark):
    rows = clouds()
    d, held = apart(rows), pairs.tabled(pairs.packed(spark.createDataFrame(rows, "sample string, point_id long, vec array<double>"), "sample", size=8))
    assert held.count() > 9
    others = held.withColumn("group", F.col("s")).withColumn("at", F.struct("group", "block"))
    own = {(r["o"], r["id"]): r["near"] for r in pairs.nearest(held, others, F.col("own_s") == F.col("b.s"), 4, True).collect()}
    other = {(r["o"], r["id"]): r["near"] for r in pairs.nearest(held, others, F.col("own_s") != F.col("b.s"), 4, False).collect()}
    for i, (s, p, _) in enumerate(rows):
        for o in "abc":
            want = brute(rows, d, i, 4, lambda j: rows[j][0] == o and j != i)  # noqa: B023
            assert (own if o == s else other)[o, p] == want, (s, p, o)


def test_a_block_and_many_others_take_little_memory():
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(512, 64)), draw.normal(size=(20_000, 64))
    tracemalloc.start()
    near = pairs.Nearest(range(512), x, 50)
    for a in range(0, len(y), pairs.BLOCK):
        near.take(range(a, min(a + pairs.BLOCK, len(y))), y[a : a + pairs.BLOCK])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All differences at once are 5 GB.
    assert peak < 200 << 20
    for i in (0, 511):
        d = np.sqrt(((x[i] - y) ** 2).sum(axis=1))
        assert near.lists()[0][i] == np.argsort(d, kind="stable")[:50].tolist()


def test_silhouettes_of_copies(spark):
    rows = clouds()
    d, s = apart(rows), np.array([r[0] for r in rows])
    each = []
    for i in range(len(rows)):
        own = d[i, s == s[i]].sum() / (np.sum(s == s[i]) - 1)
        out = min(d[i, s == o].mean() for o in set(s) - {s[i]})
        each.append((out - own) / max(own, out))
    got = {r["sample"]: r["silhouette"] for r in topology.silhouette(spark.createDataFrame(rows, "sample string, point_id long, vec array<double>")).collect()}
    assert got == pytest.approx({o: np.mean(np.array(each)[s == o]) for o in set(s)}, abs=1e-9)


def test_corrections_by_more_anchors_than_weigh(spark):
    rows = clouds()
    points = spark.createDataFrame(rows, "sample string, point_id long, vec array<double>")
    found = topology.mutual_neighbours(points, 6, reference="a")
    every = topology.mutual_neighbours(points, 6).filter("batch_a = 'a' OR batch_b = 'a'")
    key = lambda t: sorted((r["batch_a"], r["batch_b"], r["pa"], r["pb"], r["d"]) for r in t.collect())
    assert key(found) == key(every)
    at, x = {p: np.array(v) for _, p, v in rows}, {}
    for s, p, v in rows:
        ends = sorted((r["pb"], r["pa"]) for r in found.collect() if r["batch_b"] == s) if p == rows[0][1] or (s, "ends") not in x else x[s, "ends"]
        x[s, "ends"] = ends
    got = {r["point_id"]: np.array(r["vec"]) for r in topology.corrected(points, found, "a", 7).collect()}
    assert len(got) == len(rows)
    for s, p, v in rows:
        want, ends = np.array(v), x[s, "ends"] if s != "a" else []
        if ends:
            d = np.array([np.sqrt(((want - at[a]) ** 2).sum()) for a, _ in ends])
            near = np.argsort(d, kind="stable")[:7]
            w = np.exp(-((2 * d[near] / max(d[near[-1]], 1e-12)) ** 2) / 2)
            want = want + sum(c * (at[ends[i][1]] - at[ends[i][0]]) for c, i in zip(w, near, strict=True)) / w.sum()
        assert np.abs(got[p] - want).max() < 1e-9


def test_neighbours_named_by_text(spark):
    rows = [("a", f"p{p}" if p % 2 else f"long{p}", v) for _, p, v in clouds()]
    d = apart(rows).round(12)
    near = {r["id"]: r["near"] for r in communities.nearest(spark.createDataFrame(rows, "sample string, point_id string, vec array<double>"), 5).collect()}
    assert near == {p: sorted([p, *brute(rows, d, i, 4, lambda j: j != i)]) for i, (_, p, _) in enumerate(rows)}  # noqa: B023

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from homolith.functions import kernels as k
from homolith.operators import topology


def full_reduction(d, threshold=np.inf):
    """Loops by reducing the whole boundary matrix of triangles, column by column."""
    n = len(d)
    edges = sorted((d[i, j], i, j) for i in range(n) for j in range(i + 1, n) if d[i, j] <= threshold)
    at = {(i, j): e for e, (_, i, j) in enumerate(edges)}
    faces = sorted(sorted((at[i, j], at[i, m], at[j, m]), reverse=True) for i in range(n) for j in range(i + 1, n) for m in range(j + 1, n) if {(i, j), (i, m), (j, m)} <= at.keys())
    held, out = {}, []
    for f in faces:
        column = set(f)
        while column and max(column) in held:
            column ^= held[max(column)]
        if column:
            held[max(column)] = column
            if edges[f[0]][0] > edges[max(column)][0]:
                out.append((edges[max(column)][0], edges[f[0]][0]))
    return np.array(sorted(out)).reshape(-1, 2)


def test_loops_equal_full_reduction():
    draw = np.random.default_rng(1)
    for t in range(40):
        x = draw.normal(size=(draw.integers(1, 16), draw.integers(1, 4)))
        d = k.distances(x.round(0) if t % 3 == 0 else x)
        limit = 1.5 if t % 4 == 0 else np.inf
        assert k.rips_h1(d, limit) == pytest.approx(full_reduction(d, limit)), t
    turn = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    ring = k.rips_h1(k.distances(np.column_stack([np.cos(turn), np.sin(turn)])))
    assert len(ring) == 1 and ring[0, 0] < 0.04 and 1.7 < ring[0, 1] < 1.8


def all_matchings(a, b):
    """The bottleneck distance over all matchings, by trying the distances in order against an augmenting search."""
    n, m = len(a), len(b)
    cost = np.zeros((n + m, n + m))
    if n and m:
        cost[:n, :m] = np.abs(a[:, None] - b[None]).max(axis=2)
    cost[:n, m:], cost[n:, :m] = ((a[:, 1] - a[:, 0]) / 2)[:, None], ((b[:, 1] - b[:, 0]) / 2)[None]

    def perfect(ok):
        mate = {}

        def place(u, seen):
            for v in np.flatnonzero(ok[u]).tolist():
                if v not in seen:
                    seen.add(v)
                    if v not in mate or place(mate[v], seen):
                        mate[v] = u
                        return True
            return False

        return all(place(u, set()) for u in range(n + m))

    return next((v for v in np.unique(cost) if perfect(cost <= v)), 0.0)


def test_bottleneck_equals_all_matchings():
    draw = np.random.default_rng(2)
    for t in range(120):
        a, b = (np.column_stack([s := draw.uniform(0, 1, n), s + draw.exponential(0.3, n)]) for n in draw.integers(0, 10, 2))
        if t % 3 == 0:
            a, b = a.round(1), b.round(1)
        if t % 7 == 0:
            b = a[draw.permutation(len(a))]
        assert k.bottleneck(a, b) == all_matchings(a, b), t


def test_trees():
    # 0 and 1 meet at 1, 2 and 3 at 2, both pairs at 5, 4 joins last.
    merges = [(0, 1, 1.0, 2), (2, 3, 2.0, 2), (5, 6, 5.0, 4), (4, 7, 9.0, 5)]
    assert k.leaves(merges, 5) == [4, 0, 1, 2, 3]
    c = k.cophenetic(merges, 5)
    assert c[0, 1] == 1 and c[3, 2] == 2 and c[0, 3] == 5 and set(c[4, :4]) == {9} and not c.diagonal().any()
    assert k.leaves([], 1) == [0] and k.leaves([(0, 1, 3.0, 2)], 2) == [0, 1]


def test_tables(spark):
    rows = [("a", "b", 1.0), ("a", "c", 5.0), ("b", "c", 6.0)]
    dist = spark.createDataFrame(rows, "i string, j string, d double")
    assert [r["sample"] for r in topology.leaf_order(dist, ["average"]).orderBy("place").collect()] == ["c", "a", "b"]
    assert {(r["i"], r["j"]): r["d"] for r in topology.cophenetic(dist, ["average"]).collect()} == {("a", "b"): 1.0, ("a", "c"): 5.5, ("b", "c"): 5.5}
    heat = topology.ordered_scores(dist, "average").orderBy("row", "col").collect()
    assert [(r["i"], r["j"], r["d"]) for r in heat[:3]] == [("c", "c", 0.0), ("c", "a", 5.0), ("c", "b", 6.0)]
    assert [r["z"] for r in heat[:3]] == pytest.approx([-11 / 3 / np.std([0, 5, 6], ddof=1), 4 / 3 / np.std([0, 5, 6], ddof=1), 7 / 3 / np.std([0, 5, 6], ddof=1)])


def test_persistence_in_sql(spark):
    draw = np.random.default_rng(3)
    rows = [(s, i, v.tolist()) for s in ("a", "b") for i, v in enumerate(draw.normal(size=(25, 2)))] + [("a", 99, None)]
    points = spark.createDataFrame(rows, "sample string, point_id long, vec array<double>")
    topology.register(spark)
    got = spark.sql("SELECT * FROM persistence(TABLE({p}) PARTITION BY sample)", p=points)
    key = lambda df: sorted((r["sample"], r["dim"], round(r["birth"], 9), round(r["death"], 9)) for r in df.collect())
    assert key(got) == key(topology.diagrams(points, 1)) and got.filter("dim = 1").count() > 0
    flat = spark.sql("SELECT * FROM persistence(TABLE({p}) PARTITION BY (sample), 0)", p=points)
    assert key(flat) == key(topology.diagrams(points, 0)) and flat.filter(F.col("dim") > 0).isEmpty()


def test_samples_are_dealt_over_tasks(spark, monkeypatch):
    draw = np.random.default_rng(4)
    points = spark.createDataFrame([(f"s{s}", i, draw.normal(size=3).tolist()) for s in range(12) for i in range(8)], "sample string, point_id long, vec array<double>")
    bars = topology.diagrams(points, 1)
    assert bars.select(F.spark_partition_id()).distinct().count() > 1
    assert topology.bottleneck(bars).select(F.spark_partition_id()).distinct().count() > 1
    # Columns that are made again each time they are needed.
    d = k.distances(draw.normal(size=(40, 6)))
    kept = k.rips_h1(d)
    monkeypatch.setattr(k, "COLUMNS", 0)
    assert len(kept) and np.array_equal(k.rips_h1(d), kept)


def test_components_of_points_without_a_matrix(spark):
    draw = np.random.default_rng(6)
    for n in (1, 2, 3, 40, 200):
        x = draw.normal(size=(n, 5))
        assert k.rips_h0_points(x) == pytest.approx(k.rips_h0(k.distances(x)))
    # Copies bear no bars, whatever a product of their vectors is rounded to.
    x = np.repeat(draw.normal(size=(30, 64)).astype(np.float32), 3, axis=0)
    points = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "sample string, point_id long, vec array<float>")
    assert topology.diagrams(points, 0).count() == 29


def test_loops_of_many_points(monkeypatch):
    draw = np.random.default_rng(7)
    for t in range(6):
        x = draw.normal(size=(30, 1 + t))
        d = k.distances(x.round(0) if t % 3 == 0 else x)
        want = full_reduction(d)
        for columns in (0, 3, 65_536):
            monkeypatch.setattr(k, "COLUMNS", columns)
            assert k.rips_h1(d) == pytest.approx(want), (t, columns)
    # In many dimensions the loops live together and hang on each other.
    x = draw.normal(size=(500, 64))
    d = k.distances(x / np.linalg.norm(x, axis=1, keepdims=True))
    began = time.process_time()
    assert len(k.rips_h1(d)) > 2000
    assert time.process_time() - began < 12


def test_bottleneck_of_many_short_bars():
    draw = np.random.default_rng(8)
    a, b = (np.column_stack([s := draw.normal(1.2, 0.02, 6000), s + draw.exponential(0.02, 6000)]) for _ in range(2))
    b[:, 0] -= 0.004
    began = time.process_time()
    r = k.bottleneck(a, b)
    assert time.process_time() - began < 1.2
    assert k.bottleneck(b, a) == r and 0 < r <= max(np.ptp(x, axis=1).max() for x in (a, b)) / 2


def test_ordered_scores_take_distances_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(frames):
        for p in frames:
            made.add(len(p))
            yield p

    dist = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 5.0), ("b", "c", 6.0)], "i string, j string, d double").mapInPandas(run, "i string, j string, d double")
    assert topology.ordered_scores(dist).count() == 9
    assert made.value == 3

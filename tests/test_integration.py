import hashlib

import numpy as np
import pytest

from homolith.functions import kernels
from homolith.operators import integration as g


def batches(seed=3, sizes=(50, 40, 30), width=70):
    """Three batches of the same four kinds of cells, each moved by a direction of its own."""
    draw = np.random.default_rng(seed)
    kinds, shifts = draw.normal(0, 4, (4, width)), draw.normal(0, 1.5, (len(sizes), width))
    rows, kind = [], []
    for b, n in enumerate(sizes):
        own = draw.integers(0, 4, n)
        rows += [(f"b{b}", f"b{b}_{i:03d}", v.tolist()) for i, v in enumerate(kinds[own] + shifts[b] + draw.normal(0, 0.4, (n, width)))]
        kind += own.tolist()
    return rows, np.array(kind)


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def components(x, dims):
    mean = x.mean(axis=0)
    _, s, v = np.linalg.svd(x - mean, full_matrices=False)
    return mean, v[:dims].T, s[:dims] / np.sqrt(len(x) - 1)


def near(q, base, k, names_q, names_b):
    d = -(q @ base.T).round(12)
    return [[names_b[j] for j in sorted(range(len(names_b)), key=lambda j: (d[i, j], names_b[j])) if names_b[j] != names_q[i]][:k] for i in range(len(names_q))]


def brute(rows, dims, k_anchor, k_filter, k_score, k_weight):
    x = {p: np.array(v) for _, p, v in rows}
    of = {}
    for s, p, _ in rows:
        of.setdefault(s, []).append(p)
    mats = {s: np.array([x[p] for p in ps]) for s, ps in of.items()}
    fit = {s: components(m, dims) for s, m in mats.items()}
    at = {(space, b): unit((m - fit[space][0]) @ fit[space][1] / fit[space][2]) for space in mats for b, m in mats.items()}
    table = {(s, b): dict(zip(of[s], near(at[s, s], at[s, b], max(k_score, k_anchor), of[s], of[b]), strict=True)) for s in of for b in of}
    anchors, names = {}, sorted(of)
    for a in names:
        for b in names:
            if a < b:
                found = [(p, q) for p in of[a] for q in table[a, b][p][:k_anchor] if p in table[b, a][q][:k_anchor]]
                found = [(p, q) for p, q in found if sum(unit(x[p]) @ unit(x[o]) > unit(x[p]) @ unit(x[q]) + 1e-9 for o in of[b]) < k_filter]
                shared = [len(set(table[a, a][p] + table[a, b][p]) & set(table[b, a][q] + table[b, b][q])) for p, q in found]
                if found:
                    low, high = np.quantile(shared, [0.01, 0.9])
                    anchors[a, b] = [(p, q, min(1, max(0, (s - low) / (high - low))) if high > low else 1.0) for (p, q), s in zip(found, shared, strict=True)]
    mean, load, _ = components(np.array([v for _, _, v in rows]), dims)
    place = {p: (v - mean) @ load for p, v in x.items()}
    for ref, query in g.merge_order({k: len(v) for k, v in anchors.items()}, {s: len(v) for s, v in of.items()}):
        pairs = sorted([(q, p, s) if a in ref else (p, q, s) for (a, b), v in anchors.items() for p, q, s in v if (a in ref and b in query) or (b in ref and a in query)], key=lambda r: (r[0], r[1]))
        new = {}
        for p in [p for s in query for p in of[s]]:
            d = [round(float(np.linalg.norm(place[p] - place[own])), 9) for own, _, _ in pairs]
            order = sorted(range(len(pairs)), key=lambda i: (d[i], i))[:k_weight]
            if not order:
                continue
            last = max(max(d[i] for i in order), 1e-12)
            w = np.array([1 - np.exp(-((1 - d[i] / last) * pairs[i][2]) / 4) for i in order])
            if w.sum() > 0:
                new[p] = x[p] + sum(c * (x[pairs[i][1]] - x[pairs[i][0]]) for c, i in zip(w / w.sum(), order, strict=True))
        x.update(new)
    return x, anchors


def test_shifts_of_batches_are_removed(spark):
    rows, kind = batches()
    points = spark.createDataFrame(rows, "sample string, point_id string, vec array<double>").repartition(3)
    found = g.found_anchors(points, 70, 3, 5, 20, 10)
    want, anchors = brute(rows, 3, 5, 20, 10, 20)
    got = {(r["a"], r["b"], r["pa"], r["pb"]): r["score"] for r in found.collect()}
    assert got == pytest.approx({(a, b, p, q): s for (a, b), v in anchors.items() for p, q, s in v}, abs=1e-9)
    out = {r["point_id"]: np.array(r["vec"]) for r in g.integrated(points, 3, 5, 20, 10, 20).collect()}
    assert out.keys() == want.keys() and max(np.abs(out[p] - want[p]).max() for p in out) < 1e-6
    # Cells of one kind but different batches were apart, and are as near as those of one batch now.
    before, after = np.array([v for _, _, v in rows]), np.array([out[p] for _, p, _ in rows])
    batch = np.array([s for s, _, _ in rows])

    def gap(x):
        return np.mean([np.linalg.norm(x[(kind == k) & (batch == a)].mean(0) - x[(kind == k) & (batch == b)].mean(0)) for k in range(4) for a in set(batch) for b in set(batch) if a < b])

    assert gap(before) > 10 and gap(after) < 0.25 * gap(before)


def test_merge_order():
    order = g.merge_order({("a", "b"): 5, ("a", "c"): 40, ("b", "c"): 4}, {"a": 10, "b": 100, "c": 12})
    assert order == [(["c"], ["a"]), (["b"], ["c", "a"])]
    assert g.merge_order({}, {"a": 1}) == []


def test_nothing_to_integrate(spark):
    one = spark.createDataFrame([("a", "p", [1.0, 2.0]), ("a", "q", [1.0, 3.0]), ("a", "n", None)], "sample string, point_id string, vec array<double>")
    assert g.harmony(one).count() == 2 and g.integrated(one.limit(0)).count() == 0


def entropy(x, batch, k=10):
    d = kernels.distances(x)
    np.fill_diagonal(d, np.inf)
    out = []
    for near_ in np.argsort(d, axis=1)[:, :k]:
        _, n = np.unique(batch[near_], return_counts=True)
        out.append(-(n / k * np.log(n / k)).sum())
    return np.mean(out)


def plain_harmony(rows, k, rounds, inner, sigma=0.1, theta=2.0, ridge=1.0, seed=1, tolerance=1e-4):
    raw, batch = np.array([v for _, _, v in rows]), np.array([s for s, _, _ in rows])
    names = sorted(set(batch))
    phi = np.array([[b == s for s in names] for b in batch], float)
    order = sorted(range(len(rows)), key=lambda i: hashlib.md5(f"{seed}|{rows[i][1]}".encode()).hexdigest())
    y, z = unit(raw[order[:k]]), raw
    for _ in range(rounds):
        o = None
        for _ in range(inner):
            pen = np.ones((len(names), k)) if o is None else ((phi.mean(0)[:, None] * o.sum(0) + 1) / (o + 1)) ** theta
            r = np.exp(-2 * (1 - unit(z) @ y.T) / sigma) * (phi @ pen)
            r /= r.sum(axis=1, keepdims=True)
            o, new = phi.T @ r, unit(r.T @ unit(z))
            moved, y = np.abs(new - y).max(), new
            if moved < tolerance:
                break
        pen = ((phi.mean(0)[:, None] * o.sum(0) + 1) / (o + 1)) ** theta
        r = np.exp(-2 * (1 - unit(z) @ y.T) / sigma) * (phi @ pen)
        r /= r.sum(axis=1, keepdims=True)
        design, fresh = np.hstack([np.ones((len(rows), 1)), phi]), raw.copy()
        for c in range(k):
            lam = np.diag([0.0, *[ridge] * len(names)])
            beta = np.linalg.solve(design.T @ (design * r[:, [c]]) + lam, design.T @ (raw * r[:, [c]]))
            beta[0] = 0
            fresh -= r[:, [c]] * (design @ beta)
        z = fresh
    return z


def test_harmony_mixes_batches(spark):
    rows, _ = batches(5, (60, 50, 40), 8)
    points = spark.createDataFrame([*rows, ("b0", "none", None)], "sample string, point_id string, vec array<double>").repartition(4)
    got = {r["point_id"]: np.array(r["vec"]) for r in g.harmony(points, 6, rounds=3, inner=3).collect()}
    assert len(got) == len(rows)
    out, want = np.array([got[p] for _, p, _ in rows]), plain_harmony(rows, 6, 3, 3)
    assert np.abs(out - want).max() < 1e-6
    batch = np.array([s for s, _, _ in rows])
    assert entropy(out, batch) > entropy(np.array([v for _, _, v in rows]), batch) + 0.3


def shuffled(spark):
    done = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(done.apply(i).totalShuffleWrite() for i in range(done.size()))


def test_neighbours_move_blocks_not_candidates(spark):
    rows, _ = batches(8, (400, 400, 400), 4)
    points = spark.createDataFrame(rows, "sample string, point_id string, vec array<double>")
    space = g.reciprocal(points, 4, 3).localCheckpoint()
    before = shuffled(spark)
    assert g.neighbours(space).count() == 3 * 1200
    assert shuffled(spark) - before < 500_000


def test_several_blocks_stay_and_pass(spark, monkeypatch):
    rows, _ = batches(9, (70, 40), 5)
    points = spark.createDataFrame(rows, "sample string, point_id string, vec array<double>")
    whole = {(r["space"], r["batch"], r["id"]): r["near"] for r in g.neighbours(g.reciprocal(points, 5, 3), 6).collect()}
    monkeypatch.setattr(g.spaces, "BLOCK", 7)
    parts = g.reciprocal(points, 5, 3)
    assert parts.count() > 20
    assert {(r["space"], r["batch"], r["id"]): r["near"] for r in g.neighbours(parts, 6).collect()} == whole

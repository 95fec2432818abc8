import random

import numpy as np
import pytest

from homolith.operators import communities as c


def graphs():
    """Planted groups, a ring of cliques, and cells around four centres."""
    draw, out = random.Random(4), {}
    group = [i % 4 for i in range(60)]
    out["planted"] = {(i, j): 1.0 for i in range(60) for j in range(i) if draw.random() < (0.4 if group[i] == group[j] else 0.04)}
    out["ring"] = {(5 * g + i, 5 * g + j): 1.0 for g in range(10) for i in range(5) for j in range(i)} | {(5 * g, (5 * g + 5) % 50): 1.0 for g in range(10)}
    out["weights"] = {(i, j): draw.random() for i in range(40) for j in range(i) if draw.random() < (0.5 if i // 10 == j // 10 else 0.1)}
    return out


def q(edges, label, resolution):
    m = 2 * sum(edges.values())
    k = {}
    for (a, b), w in edges.items():
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
    inside = 2 * sum(w for (a, b), w in edges.items() if label[a] == label[b])
    total = {}
    for n, d in k.items():
        total[label[n]] = total.get(label[n], 0) + d
    return inside / m - resolution * sum(t * t for t in total.values()) / m / m


def plain_louvain(edges, resolution):
    """One point after the other, then contraction."""
    nodes = sorted({n for e in edges for n in e})
    label, link = {n: n for n in nodes}, {}
    for (a, b), w in edges.items():
        link.setdefault(a, {})[b] = link.setdefault(b, {})[a] = w
    m, of = 2 * sum(edges.values()), {n: n for n in nodes}
    while True:
        k = {n: sum(link[n].values()) for n in link}
        own, total, moved = {n: n for n in link}, dict(k), True
        changed = False
        while moved:
            moved = False
            for n in sorted(link):
                total[own[n]] -= k[n]
                w = {own[n]: 0.0}
                for o, v in link[n].items():
                    if o != n:
                        w[own[o]] = w.get(own[o], 0) + v
                best = max(w, key=lambda x: (round(w[x] - resolution * k[n] * total.get(x, 0) / m, 12), x == own[n]))
                if best != own[n]:
                    moved = changed = True
                own[n] = best
                total[best] = total.get(best, 0) + k[n]
        of = {n: own[x] for n, x in of.items()}
        if not changed:
            return of
        new = {}
        for a in link:
            for b, w in link[a].items():
                new.setdefault(own[a], {})
                new[own[a]][own[b]] = new[own[a]].get(own[b], 0) + w
        link = new


def test_modularity_is_that_of_plain_louvain(spark):
    rows = [(g, *e, w) for g, edges in graphs().items() for (a, b), w in edges.items() for e in ((a, b), (b, a))]
    edges = spark.createDataFrame(rows, "graph string, p long, q long, w double")
    found = c.communities(edges, 1.0)
    label = {(r["graph"], r["id"]): r["label"] for r in found.collect()}
    value = {r["graph"]: r["modularity"] for r in c.modularity(edges, found, 1.0).collect()}
    for g, e in graphs().items():
        own = {n: label[g, n] for x in e for n in x}
        assert value[g] == pytest.approx(q(e, own, 1.0)) and value[g] >= q(e, plain_louvain(e, 1.0), 1.0) - 0.01, g
        assert all(min(n for n in own if own[n] == own[x]) == own[x] for x in own)


def test_shared_neighbours(spark):
    draw = np.random.default_rng(2)
    x = np.concatenate([draw.normal(0, 1, (25, 3)), draw.normal(9, 1, (25, 3))])
    points = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "sample string, point_id long, vec array<double>")
    near = {r["id"]: r["near"] for r in c.nearest(points, 6).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {i: sorted(np.argsort(np.where(np.arange(50) == i, -1, d[i]), kind="stable")[:6].tolist()) for i in range(50)}
    assert near == want
    edges = {(r["p"], r["q"]): r["w"] for r in c.shared(c.nearest(points, 6)).collect()}
    jaccard = {(i, j): len(set(want[i]) & set(want[j])) / len(set(want[i]) | set(want[j])) for i in want for j in want if i != j and (j in want[i] or i in want[j])}
    assert edges == pytest.approx({k: v for k, v in jaccard.items() if v >= 1 / 15})
    label = {r["id"]: r["label"] for r in c.clustered(points, 10, 0.3).collect()}
    assert {label[i] for i in range(25)}.isdisjoint({label[i] for i in range(25, 50)})

import itertools

import numpy as np
import pytest

from homolith.operators import comparisons as x


def rows(n=4, grid=30, seed=0):
    draw = np.random.default_rng(seed)
    tau = np.linspace(0, 2, grid)
    return tau, {(g, f"{g}_{i}"): np.abs(draw.normal(k, 1, grid)) for k, g in enumerate(("a b", "c")) for i in range(n)}


def frames(spark, tau, curves):
    ind = [("dimension_0", g, s, k, float(tau[k]), float(v[k])) for (g, s), v in curves.items() for k in range(len(tau))]
    ind += [("dimension_0", g, "x", k, float(t), 1.0) for g in (None, " ") for k, t in enumerate(tau)]
    mean = [("dimension_0", g, k, float(np.mean([v[k] for (h, _), v in curves.items() if h == g]))) for g in ("a b", "c") for k in range(len(tau))]
    return spark.createDataFrame(ind, "comparison string, grp string, sample string, gi int, tau double, v double"), spark.createDataFrame(mean, "comparison string, grp string, gi int, m double")


def ks_by_enumeration(a, b):
    """D, and the share of all splits of the pooled values whose D reaches it."""
    d = lambda p, q: max(abs(np.mean(p <= t) - np.mean(q <= t)) for t in np.concatenate([p, q]))
    both, seen = np.concatenate([a, b]), d(a, b)
    hits = [d(both[list(c)], np.delete(both, list(c))) >= seen - 1e-9 for c in itertools.combinations(range(len(both)), len(a))]
    return seen, float(np.mean(hits))


def test_statistics_by_hand(spark):
    tau, curves = rows()
    ind, mean = frames(spark, tau, curves)
    got = {(r["g1"], r["g2"]): r for r in x.pair_stats(ind, mean, reps=200).collect()}
    assert set(got) == {("a b", "a b"), ("a b", "c"), ("c", "c")}
    for g in ("a b", "c"):
        assert [got[g, g][s] for s in x.STATS] == [0, 1, 0, 0, 1]
    v1, v2 = (np.stack([v for (h, _), v in sorted(curves.items()) if h == g]) for g in ("a b", "c"))
    m1, m2 = v1.mean(axis=0), v2.mean(axis=0)
    r, step = got["a b", "c"], np.diff(tau)
    area = lambda y, dx: float((dx * (y[1:] + y[:-1]) / 2).sum())
    assert np.isclose(r["wasserstein"], area(np.abs(np.cumsum(m1 / m1.sum()) - np.cumsum(m2 / m2.sum())), step / tau.max()), atol=1e-6)
    l2 = area((m1 - m2) ** 2, step) ** 0.5
    assert np.isclose(r["effect_size"], l2 / np.std(np.concatenate([m1, m2]), ddof=1), atol=1e-5)
    each = [ks_by_enumeration(v1[:, k], v2[:, k]) for k in range(len(tau))]
    p = np.sort([q for _, q in each])
    assert np.isclose(r["ks_stat"], max(d for d, _ in each)) and np.isclose(r["ks_adj_p"], min(1, (p * len(p) / np.arange(1, len(p) + 1)).min()), atol=1e-6)
    names = [f"1|{s}" for h, s in sorted(curves) if h == "a b"] + [f"2|{s}" for h, s in sorted(curves) if h == "c"]
    both, hits = np.concatenate([v1, v2]), 0
    for rep in range(200):
        order = sorted(range(len(names)), key=lambda i: (x.draw(42, rep, names[i]), i))
        d = both[order[:4]].mean(axis=0) - both[order[4:]].mean(axis=0)
        hits += area(d**2, step) ** 0.5 >= l2 - 1e-9
    assert np.isclose(r["perm_p"], hits / 200)
    flat = {(r["Pair"], r["Group"]) for r in x.flat(x.pair_stats(ind, mean, reps=5), "t").collect()}
    assert flat == {("a_b_vs_a_b", "t"), ("a_b_vs_c", "t"), ("c_vs_c", "t")}


def test_ks_p():
    assert x.ks_p(0.0, 5, 5, False) == 1.0
    assert np.isclose(x.ks_p(0.5, 200, 200, False), 2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * 25) for k in range(1, 9)))
    assert np.allclose(x.adjusted(np.array([0.01, np.nan, 0.04, 0.03])), [0.03, np.nan, 0.04, 0.04], equal_nan=True)


def test_curves_without_shares():
    tau = np.linspace(0, 1, 5)
    assert np.isnan(x.wasserstein(np.array([1, -1, 0, 0, 0.0]), np.ones(5), tau)) and x.effect(np.ones(5), np.ones(5), tau) == 0


@pytest.mark.parametrize("n", [1, 2, 7])
def test_null_models(spark, n):
    draw = np.random.default_rng(n)
    rows = [(f"g_{i}", d, k, k / 9, float(v)) for i in range(n) for d in (0, 1) for k, v in enumerate(draw.uniform(1, 2, 10))]
    betti = spark.createDataFrame(rows, "sample string, dim int, gi int, tau double, raw double")
    land = betti.filter("dim = 0").withColumnRenamed("raw", "v")
    got = {r["stat"]: r for r in x.null_aggregated(land, reps=12).collect()}
    euler = {r["stat"]: r for r in x.null_euler(betti, reps=5, draws=4).collect()}
    if n == 1:
        assert not got and not euler
        return
    v = np.stack([[r[4] for r in rows if r[0] == f"g_{i}" and r[1] == 0] for i in range(n)])
    want = []
    for rep in range(12):
        order = sorted(range(n), key=lambda i: (x.draw(100, rep, i), i))
        a, b = v[order[: n // 2]].mean(axis=0), v[order[n // 2 :]].mean(axis=0)
        want.append(np.abs(np.cumsum(a / a.sum()) - np.cumsum(b / b.sum())).max())
    assert np.isclose(got["cdf_gap"]["q50"], np.median(want), atol=1e-6) and got["effect"]["reps"] == 12
    assert euler["ks"]["reps"] == 5 and 0 < euler["ks"]["mean"] <= 1 and euler["effect"]["q025"] <= euler["effect"]["q975"]

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from homolith.functions import negbin
from homolith.operators import points as pt
from homolith.operators import sct
from homolith.sources.cuts import cut


def drawn(seed=1, cells=150, genes=200):
    draw = np.random.default_rng(seed)
    depth, mean, theta = draw.gamma(5, 1, cells), np.exp(draw.normal(-0.5, 1, genes)), draw.gamma(2, 2, genes)
    return np.stack([draw.negative_binomial(theta[g], theta[g] / (theta[g] + mean[g] * depth / 5)) for g in range(genes)], axis=1).astype(float)


def likelihood(theta, y, mu):
    return sum(math.lgamma(theta + a) - math.lgamma(theta) + theta * math.log(theta) - (theta + a) * math.log(theta + m) for a, m in zip(y, mu, strict=True))


def plain(y):
    """Every gene by itself over all cells, absent counts as zeros: Newton's method, the likelihood's maximum on a golden section."""
    x = np.log10(y.sum(axis=1))
    design, fits = np.column_stack([np.ones(len(x)), x]), {}
    for g in range(y.shape[1]):
        v = y[:, g]
        if (v > 0).sum() < 5:
            continue
        b = np.array([np.log(v.mean()) - np.log(10) * x.mean(), np.log(10)])
        for _ in range(100):
            mu = np.exp(design @ b)
            b = b + np.linalg.solve(design.T @ (design * mu[:, None]), design.T @ (v - mu))
        mu, gold = np.exp(design @ b), (math.sqrt(5) - 1) / 2
        low, high = math.log(1e-3), math.log(1e5)
        for _ in range(90):
            p, q = high - gold * (high - low), low + gold * (high - low)
            low, high = (low, q) if likelihood(math.exp(p), v, mu) > likelihood(math.exp(q), v, mu) else (p, high)
        theta = math.exp((low + high) / 2)
        fits[g] = (*b, np.inf if theta > 5e4 else theta, 10 ** np.log10(1 + v).mean() - 1)
    a = np.array(list(fits.values()))
    z, over = np.log10(a[:, 3]), np.log10(1 + a[:, 3] / a[:, 2])
    q = np.quantile(z, [0.25, 0.75])
    h = 0.9 * min(z.std(ddof=1), (q[1] - q[0]) / 1.34) * len(z) ** -0.2
    width = (z.max() - z.min()) * h / 2
    use = ~(negbin.outlying(z, a[:, 0], width) | negbin.outlying(z, a[:, 1], width) | negbin.outlying(z, over, width))
    sd = 0.25 * 3 * h / 0.6744897501960817
    out = {}
    for g, at, gm in zip(fits, z, a[:, 3], strict=True):
        at = min(max(at, z[use].min()), z[use].max())
        w = np.exp(-(((at - z[use]) / sd) ** 2) / 2)
        b0, b1, od = ((w @ v[use]) / w.sum() for v in (a[:, 0], a[:, 1], over))
        out[g] = (b0, b1, gm / (10**od - 1))
    return fits, out


def values(y, b0, b1, theta, what):
    total = y.sum(axis=1)
    top = math.sqrt(len(total))
    out = {}
    for g in b0:
        mu = np.exp(b0[g] + b1[g] * np.log10(total))
        r = np.clip((y[:, g] - mu) / np.sqrt(mu + mu * mu / theta[g]), -top, top)
        m = math.exp(b0[g] + b1[g] * math.log10(np.median(total)))
        out[g] = r if what == "residuals" else np.log1p(np.maximum(0, np.rint(m + r * math.sqrt(m + m * m / theta[g]))))
    return out


@pytest.fixture(scope="module")
def made(spark):
    y = drawn()
    rows = [("s", f"c{i:03d}", f"g{g:03d}", float(y[i, g])) for i in range(y.shape[0]) for g in range(y.shape[1]) if y[i, g]]
    counts = cut(spark.createDataFrame(rows, "sample string, cell string, gene string, value double").repartition(4))
    totals = cut(sct.depths(counts))
    return y, counts, totals, cut(sct.scaled(sct.model(counts, totals), totals)), plain(y)


def test_fits_equal_plain_regression(made):
    y, counts, totals, _, (fits, _) = made
    got = {int(r["gene"][1:]): r for r in sct.fitted(counts, totals).collect()}
    assert got.keys() == fits.keys() and len(got) > 190
    for g, (b0, b1, theta, gmean) in fits.items():
        r = got[g]
        assert (r["b0"], r["b1"], r["gmean"]) == pytest.approx((b0, b1, gmean), abs=1e-6)
        assert r["theta"] == pytest.approx(theta, rel=1e-3) if math.isfinite(theta) else (r["theta"] is None or math.isnan(r["theta"]) or r["theta"] > 4e4)


@pytest.mark.parametrize("what", ["residuals", "data"])
def test_values_with_absent_counts(made, what):
    y, counts, totals, fits, (_, smooth) = made
    want = values(y, {g: v[0] for g, v in smooth.items()}, {g: v[1] for g, v in smooth.items()}, {g: v[2] for g, v in smooth.items()}, what)
    matrix = cut(sct.values(counts, totals, fits, what))
    vecs = {int(r["point_id"][1:]): np.array(r["vec"]) for r in pt.genes_as_points(matrix, totals, fits, lambda t: sct.value(what, F.lit(0.0), t)).collect()}
    assert vecs.keys() == want.keys()
    close = [np.abs(vecs[g] - want[g]).max() < 1e-4 for g in want]
    # Counts at the median depth are rounded: what lies next to a half may fall to either side.
    assert all(close) if what == "residuals" else np.mean(close) > 0.99
    genes = pt.features(pt.variances(pt.genes_as_points(matrix, totals, fits, lambda t: sct.value(what, F.lit(0.0), t))), 30)
    var = sorted(want, key=lambda g: (-vecs[g].var(ddof=1), g))[:30]
    assert [r["gene"] for r in genes.orderBy("place").collect()] == [f"g{g:03d}" for g in sorted(var)]
    cells = {r["point_id"]: np.array(r["vec"]) for r in pt.cells_as_points(matrix, totals, genes, fits, lambda t, of: sct.value(what, F.lit(0.0), t, of)).collect()}
    assert len(cells) == len(y)
    for i in (0, 7, 149):
        assert np.abs(cells[f"s\tc{i:03d}"] - np.array([vecs[g][i] for g in sorted(var)])).max() < 1e-9
    again = pt.as_matrix(spark_frame(cells, genes), genes).groupBy("cell").agg(F.sum("value").alias("v"), F.count("*").alias("n")).collect()
    assert all(r["n"] == 30 and r["v"] == pytest.approx(cells[f"s\t{r['cell']}"].sum()) for r in again)


def spark_frame(cells, genes):
    return genes.sparkSession.createDataFrame([("s", k, v.tolist()) for k, v in cells.items()], "sample string, point_id string, vec array<double>")


def test_filled(spark):
    rows = [(1, [(2, 5.0), (3, 6.0)], [0.5] * 4), (2, [], [1.0, 2.0]), (3, [(1, 9.0), (4, 8.0)], [0.0] * 4)]
    df = spark.createDataFrame(rows, "i int, e array<struct<place:int,value:double>>, f array<double>")
    assert {r["i"]: r["v"] for r in df.select("i", pt.filled(F.col("e"), F.col("f")).alias("v")).collect()} == {1: [0.5, 5.0, 6.0, 0.5], 2: [1.0, 2.0], 3: [9.0, 0.0, 0.0, 8.0]}


def test_kernels():
    assert negbin.digamma(np.array([1.0, 10.0])) == pytest.approx([-0.5772156649015329, 2.251752589066721], abs=1e-11)
    # All cells of one depth: the slope is that of proportion, the mean is the counts' mean.
    b0, b1 = negbin.poisson(np.array([2.0]), np.array([4.0]), np.array([8.0]), np.array([16.0]))
    assert b1[0] == pytest.approx(math.log(10)) and b0[0] + 2 * b1[0] == pytest.approx(math.log(2))
    x = np.array([1.0, 2, 3, 4, 5, 6, 7, 8, 9, 10])
    y = x.copy()
    y[4] = 500
    assert negbin.outlying(x, y, 4.0).tolist() == [False] * 4 + [True] + [False] * 5
    assert negbin.smoothed(x, 2 * x, np.array([5.5]), 2.0)[0] == pytest.approx(11) and negbin.smoothed(x[:1], x[:1], np.array([3.0]), 0.0)[0] == 1

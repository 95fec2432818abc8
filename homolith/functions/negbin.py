"""Numeric kernels of regularised negative-binomial regression: fits from sums and histograms, smoothing over gene means."""

from __future__ import annotations

import numpy as np

#: Dispersions are looked for between these; a gene whose likelihood still rises at the last has none (it is Poisson). Beyond, the
#: score is smaller than its rounding.
THETA = (1e-4, 1e5)


def digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.asarray(x, float), 0.0
    for _ in range(6):
        out, x = out - 1 / x, x + 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def poisson(x: np.ndarray, cells: np.ndarray, s0: np.ndarray, s1: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(b0, b1) of log(mu) = b0 + b1 x for each gene, from the sums of its counts (s0) and of counts times x (s1), where `cells` many
    cells have each x: all that the likelihood needs. With one x alone the slope is that of proportion (x is a decimal logarithm)."""
    centre = (x * cells).sum() / cells.sum()
    z = x - centre
    t1 = s1 - centre * s0
    b1 = np.full(len(s0), np.log(10.0))
    b0 = np.log(s0 / (np.exp(np.outer(b1, z)) @ cells))
    if (z * z) @ cells > 1e-12 * cells.sum():
        for _ in range(rounds):
            mu = np.exp(np.clip(b0[:, None] + np.outer(b1, z), -700, 50)) * cells
            a, b, c = mu.sum(axis=1), mu @ z, mu @ (z * z)
            g0, g1, det = s0 - a, t1 - b, np.maximum(a * c - b * b, 1e-300)
            d0, d1 = (c * g0 - b * g1) / det, (a * g1 - b * g0) / det
            limit = np.minimum(1.0, 3.0 / np.maximum(np.maximum(np.abs(d0), np.abs(d1)), 1e-300))
            b0, b1 = b0 + limit * d0, b1 + limit * d1
            if max(np.abs(d0).max(initial=0), np.abs(d1).max(initial=0)) < 1e-10:
                break
    return b0 - b1 * centre, b1


def dispersion(x: np.ndarray, cells: np.ndarray, b0: np.ndarray, b1: np.ndarray, gene: np.ndarray, at: np.ndarray, count: np.ndarray, n: np.ndarray, steps: int = 60) -> np.ndarray:
    """The likeliest theta of each gene given its means, infinite if there is none: where the score changes its sign, by halving
    on a logarithmic scale. (gene, at, count, n) are the cells with counts: n cells with x = at have the count."""
    mu, own = np.exp(b0[:, None] + np.outer(b1, x)), np.exp(b0[gene] + b1[gene] * at)

    def score(theta: np.ndarray) -> np.ndarray:
        t = theta[:, None]
        every = (np.log(t) + 1 - np.log(t + mu) - t / (mu + t)) @ cells
        t = theta[gene]
        return every + np.bincount(gene, n * (digamma(t + count) - digamma(t) - count / (own + t)), minlength=len(b0))

    low, high = np.full(len(b0), np.log(THETA[0])), np.full(len(b0), np.log(THETA[1]))
    endless = score(np.exp(high)) > 0
    for _ in range(steps):
        mid = (low + high) / 2
        up = score(np.exp(mid)) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return np.where(endless, np.inf, np.exp((low + high) / 2))


def bandwidth(x: np.ndarray) -> float:
    """The rule of thumb 0.9 min(sd, IQR / 1.34) n^-0.2."""
    if len(x) < 2:
        return 0.0
    q = np.quantile(x, [0.25, 0.75])
    spread = min(s for s in (x.std(ddof=1), (q[1] - q[0]) / 1.34, np.inf) if s > 0) if x.std(ddof=1) > 0 else 0.0
    return 0.9 * spread * len(x) ** -0.2


def outlying(x: np.ndarray, y: np.ndarray, width: float, limit: float = 10.0) -> np.ndarray:
    """Whether y is far from the median of its bin of x, in units of the bin's median deviation, in two sets of bins that are half a bin apart."""
    if width <= 0:
        return np.zeros(len(x), bool)
    least = np.full(len(x), np.inf)
    for shift in (0.0, 0.5):
        bin_ = np.floor((x - x.min()) / width + shift).astype(int)
        for b in np.unique(bin_):
            own = bin_ == b
            off = np.abs(y[own] - np.median(y[own]))
            least[own] = np.minimum(least[own], off / (1.4826 * np.median(off) + 1e-12))
    return least > limit


def smoothed(x: np.ndarray, y: np.ndarray, at: np.ndarray, width: float) -> np.ndarray:
    """Means of y around each point, weighted by a normal density whose quartiles are a quarter of the width away. Points
    outside of x count as its ends."""
    if width <= 0 or len(x) < 2:
        return np.interp(at, x[(o := np.argsort(x, kind="stable"))], y[o])
    sd, at = 0.25 * width / 0.6744897501960817, np.clip(at, x.min(), x.max())
    out = np.empty(len(at))
    for i in range(0, len(at), 512):
        d = ((at[i : i + 512, None] - x[None, :]) / sd) ** 2
        w = np.exp(-(d - d.min(axis=1, keepdims=True)) / 2)
        out[i : i + 512] = (w @ y) / w.sum(axis=1)
    return out


def regularised(b0: np.ndarray, b1: np.ndarray, theta: np.ndarray, gmean: np.ndarray, factor: float = 3.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters as smooth functions of the logarithm of genes' geometric means: intercept, slope, and the overdispersion
    log10(1 + gmean / theta), from which theta is found again. Genes of which one lies far outside don't shape the others."""
    x = np.log10(gmean)
    over = np.log10(1 + gmean / theta)
    narrow = bandwidth(x)
    width = (x.max() - x.min()) * narrow / 2
    use = ~(outlying(x, b0, width) | outlying(x, b1, width) | outlying(x, over, width))
    if not use.any():
        use[:] = True
    a, b, d = (smoothed(x[use], v[use], x, factor * narrow) for v in (b0, b1, over))
    with np.errstate(divide="ignore"):
        return a, b, gmean / np.maximum(10**d - 1, 1e-300) if len(x) else d

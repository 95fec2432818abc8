"""Comparing groups of curves: all statistics of all pairs of groups, and null models, as grouped maps over arrays.

`individuals` is (comparison, grp, sample, gi, tau, v), a curve of each sample; `means` is (comparison, grp, gi, m), a curve
of each group. Comparisons are dimension_0, dimension_1, euler, landscape."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homolith.functions import kernels
from homolith.functions.sqlop import Op

#: Label shuffles; seed; product of group sizes from which Kolmogorov-Smirnov p-values are asymptotic.
PERMUTATIONS, SEED, EXACT_BELOW = 1000, 42, 10_000

GROUP = "split_part(sample, '_', 1)"


def individuals(betti: Op, euler: Op, landscape: Op, grid: int, name="individual_curves") -> Op:
    """Normalised Betti and Euler curves, and landscape curves on a grid of [0, 1]."""
    return Op(name, f"""
SELECT 'dimension_' || CAST(dim AS VARCHAR(9)) AS comparison, {GROUP} AS grp, sample, gi, tau, norm AS v FROM {{betti}}
UNION ALL SELECT 'euler', {GROUP}, sample, gi, tau, norm FROM {{euler}}
UNION ALL SELECT 'landscape', {GROUP}, sample, gi, gi / {grid - 1:e}, v FROM {{landscape}}""", betti=betti, euler=euler, landscape=landscape)


def group_curves(betti_bands: Op, euler_bands: Op, landscape_bands: Op, name="group_bands") -> Op:
    """Mean, lower and upper curve of each group and comparison."""
    out = Op(name, """
SELECT 'dimension_' || CAST(dim AS VARCHAR(9)) AS comparison, grp, gi, mean AS m, lower, upper FROM {betti}
UNION ALL SELECT 'euler', grp, gi, mean, lower, upper FROM {euler} UNION ALL SELECT 'landscape', grp, gi, mean, lower, upper FROM {landscape}""", betti=betti_bands, euler=euler_bands, landscape=landscape_bands)
    out.apart = True
    return out


def valid_groups(df: DataFrame, column: str = "grp") -> DataFrame:
    """Rows whose group is neither null nor blank."""
    return df.filter(F.length(F.trim(F.col(column))) > 0)


def draw(*key) -> int:
    """A number from the MD5 of the key's parts; the same in any engine that has MD5."""
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:8], 16)


def trapezoid(tau: np.ndarray) -> np.ndarray:
    """Weights of the points of a grid in the trapezoid rule."""
    step = np.diff(tau)
    return (np.append(step, 0) + np.insert(step, 0, 0)) / 2


def integrated_diff(d: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """Root of the integral of the square of each row; 0 for fewer than two points."""
    return np.sqrt(np.maximum((d * d) @ trapezoid(tau), 0.0)) if len(tau) > 1 else np.zeros(d.shape[:-1])


def wasserstein(m1: np.ndarray, m2: np.ndarray, tau: np.ndarray) -> float:
    """Area between the cumulated shares of two curves over tau / max tau; NaN if the values of one sum to 0."""
    if any(abs(m.sum()) <= 1e-12 for m in (m1, m2)):
        return float("nan")
    gap = np.abs(np.cumsum(m1 / m1.sum()) - np.cumsum(m2 / m2.sum()))
    return float(gap @ trapezoid(tau / tau.max()))


def effect(m1: np.ndarray, m2: np.ndarray, tau: np.ndarray) -> float:
    sd = np.concatenate([m1, m2]).std(ddof=1)
    return float(integrated_diff(m1 - m2, tau) / sd) if sd else 0.0


def shuffled(labels: list[str], n1: int, reps: int, seed: int) -> np.ndarray:
    """For each shuffle the weight of each sample in the difference of the sides' means: the first n1 by hash are side 1."""
    n = len(labels)
    hashes = np.array([[draw(seed, rep, s) for s in labels] for rep in range(reps)]).reshape(reps, n)
    place = np.argsort(np.argsort(hashes, axis=1, kind="stable"), axis=1, kind="stable")
    return np.where(place < n1, 1 / n1, -1 / (n - n1))


def permutation_p(v1: np.ndarray, v2: np.ndarray, m1: np.ndarray, m2: np.ndarray, tau: np.ndarray, labels: list[str], reps: int, seed: int) -> float:
    """Share of label shuffles whose integrated difference of mean curves reaches that of the groups' curves. Differences are
    linear in the samples, so their squares' integrals come from one matrix of products."""
    v = np.concatenate([v1, v2])
    gram = (v * trapezoid(tau)) @ v.T
    w = shuffled(labels, len(v1), reps, seed)
    stat = np.sqrt(np.maximum(np.einsum("ri,ij,rj->r", w, gram, w, optimize=True), 0.0))
    return float((stat >= integrated_diff(m1 - m2, tau) - 1e-9).mean())


@lru_cache(maxsize=4096)
def ks_p(d: float, n: int, m: int, ties: bool) -> float:
    """Two-sided p: exact for small groups without ties, else asymptotic."""
    if d <= 0:
        return 1.0
    if not ties and n * m < EXACT_BELOW:
        return kernels.ks_exact_p(d, n, m)
    x = 2 * d * d * n * m / (n + m)
    k = np.arange(1, 101)
    return float(min(max(2 * ((-1.0) ** (k - 1) * np.exp(-x * k * k)).sum(), 0.0), 1.0))


def ks(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Largest two-sample D of two samples of values, and its p."""
    a, b = np.sort(a), np.sort(b)
    both = np.concatenate([a, b])
    d = float(np.abs(np.searchsorted(a, both, side="right") / len(a) - np.searchsorted(b, both, side="right") / len(b)).max())
    return d, ks_p(round(d, 12), len(a), len(b), len(np.unique(both)) < len(both))


def adjusted(p: np.ndarray) -> np.ndarray:
    """Benjamini-Hochberg; nulls stay null and don't count."""
    out = np.full(len(p), np.nan)
    some = np.flatnonzero(~np.isnan(p))
    order = some[np.argsort(-p[some], kind="stable")]
    n = len(some)
    out[order] = np.minimum(np.minimum.accumulate(p[order] * n / np.arange(n, 0, -1)), 1.0)
    return out


STATS = ["wasserstein", "perm_p", "effect_size", "ks_stat", "ks_adj_p"]


def statistics(v1, v2, m1, m2, tau, labels, reps: int = PERMUTATIONS, seed: int = SEED) -> list[float]:
    """The five statistics of a pair of groups: curves of samples (rows), of groups, the grid, and the samples' names by side."""
    each = [ks(v1[:, k], v2[:, k]) for k in range(v1.shape[1])]
    return [wasserstein(m1, m2, tau), permutation_p(v1, v2, m1, m2, tau, labels, reps, seed), effect(m1, m2, tau), max(d for d, _ in each), float(adjusted(np.array([p for _, p in each])).min())]


def arrays(curves: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Curves as arrays in the order of the grid: a row for each key."""
    rows = F.array_sort(F.collect_list(F.struct("gi", *columns)))
    return curves.groupBy(*keys).agg(rows.alias("points")).select(*keys, *[F.col("points")[c].alias(c) for c in columns])


def pair_stats(individuals_: DataFrame, means: DataFrame, reps: int = PERMUTATIONS, seed: int = SEED, digits: int = 6) -> DataFrame:
    """comparison, g1, g2, wasserstein, perm_p, effect_size, ks_stat, ks_adj_p for all pairs g1 <= g2 of groups, each with
    itself too. Null and blank groups are left out; a Wasserstein distance of a curve without shares is null.

    A pair and comparison is one task, which holds a curve of each of the two groups' samples (4 KB at 500 points) and the
    products of all of them; curves are copied once for each group that theirs meets."""
    ind = arrays(valid_groups(individuals_), ["comparison", "grp", "sample"], ["tau", "v"])
    mean = arrays(valid_groups(means), ["comparison", "grp"], ["m"])
    groups = mean.select("comparison", "grp")
    pairs = groups.withColumnRenamed("grp", "g1").join(groups.withColumnRenamed("grp", "g2"), "comparison").filter("g1 <= g2")
    none = F.lit(None)
    rows = [x.join(pairs.withColumn("grp", F.col(g)), ["comparison", "grp"]).select("comparison", "g1", "g2", F.lit(side).alias("side"), *c) for side, g in ((1, "g1"), (2, "g2")) for x, c in ((ind, ["sample", "tau", "v"]), (mean, [none.cast("string").alias("sample"), none.cast("array<double>").alias("tau"), F.col("m").alias("v")]))]
    dealt = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["side", "sample"])
        curve = p["sample"].notna()
        side = [p[curve & (p["side"] == s)] for s in (1, 2)]
        m = [np.asarray(p.loc[~curve & (p["side"] == s), "v"].iloc[0], float) for s in (1, 2)]
        v = [np.stack(s["v"].to_list()).astype(float) for s in side]
        labels = [f"{s}|{x}" for s, rows in zip((1, 2), side, strict=True) for x in rows["sample"]]
        row = statistics(v[0], v[1], m[0], m[1], np.asarray(side[0]["tau"].iloc[0], float), labels, reps, seed)
        return pd.DataFrame([[p["comparison"].iloc[0], p["g1"].iloc[0], p["g2"].iloc[0], *row]], columns=["comparison", "g1", "g2", *STATS])

    found = dealt.groupBy("comparison", "g1", "g2").applyInPandas(run, "comparison string, g1 string, g2 string, " + ", ".join(f"{s} double" for s in STATS))
    return found.select("comparison", "g1", "g2", *[F.round(F.nanvl(s, F.lit(None)), 5 if s == "effect_size" else digits).alias(s) for s in STATS])


def flat(stats: DataFrame, group: str = "all") -> DataFrame:
    """The flat table: Group, Pair (blanks as underscores), Comparison and the five statistics."""
    name = lambda c: F.regexp_replace(c, " ", "_")
    return stats.select(F.lit(group).alias("Group"), F.concat_ws("_vs_", name("g1"), name("g2")).alias("Pair"), F.col("comparison").alias("Comparison"), *STATS)


def heat_table(stats: DataFrame) -> DataFrame:
    """Statistics as rows (i, j, comparison, stat, v, minus_log10), each pair also the other way round; only p-values have logs."""
    long = stats.unpivot(["comparison", "g1", "g2"], STATS, "stat", "v")
    both = long.selectExpr("g1 AS i", "g2 AS j", "comparison", "stat", "v").unionByName(long.filter("g1 <> g2").selectExpr("g2 AS i", "g1 AS j", "comparison", "stat", "v"))
    log = F.when(F.col("stat").isin("perm_p", "ks_adj_p"), F.round(-F.log10(F.when(F.col("v") == 0, 1e-16).otherwise(F.col("v"))), 5))
    return both.withColumn("minus_log10", log + 0.0)


def _summary(rows: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    out = []
    for n in names:
        v = rows[n].dropna().to_numpy(float)
        q = np.quantile(v, [0.025, 0.5, 0.975]) if len(v) else [None] * 3
        out.append((n, len(v), v.mean() if len(v) else None, v.std(ddof=1) if len(v) > 1 else None, *q))
    return pd.DataFrame(out, columns=["stat", "reps", "mean", "sd", "q025", "q50", "q975"])


NULL_SCHEMA = "stat string, reps int, mean double, sd double, q025 double, q50 double, q975 double"


def null_aggregated(curves: DataFrame, reps: int = 50, seed: int = 100) -> DataFrame:
    """stat (effect, cdf_gap), reps, mean, sd, q025, q50, q975 over random half splits of all samples' curves (sample, gi, tau,
    v): the halves' mean curves' integrated difference by the standard deviation of both, and the gap of their cumulated
    shares. Fewer than two samples give no row. One task holds a curve of each sample."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("sample")
        v, tau, n, rows = np.stack(p["v"].to_list()).astype(float), np.asarray(p["tau"].iloc[0], float), len(p), []
        if n < 2:
            return pd.DataFrame(columns=["stat", "reps", "mean", "sd", "q025", "q50", "q975"])
        for rep in range(reps):
            order = sorted(range(n), key=lambda i: (draw(seed, rep, i), i))
            a, b = v[order[: n // 2]].mean(axis=0), v[order[n // 2 :]].mean(axis=0)
            gap = np.abs(np.cumsum(a / a.sum()) - np.cumsum(b / b.sum())).max() if a.sum() and b.sum() else np.nan
            rows.append((effect(a, b, tau), gap))
        return _summary(pd.DataFrame(rows, columns=["effect", "cdf_gap"]), ["effect", "cdf_gap"])

    one = arrays(curves, ["sample"], ["tau", "v"]).withColumn("all", F.lit(1))
    return one.groupBy("all").applyInPandas(run, NULL_SCHEMA).select("stat", "reps", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "q025", "q50", "q975")])


def normalised(v: np.ndarray) -> np.ndarray:
    total = v.sum(axis=-1, keepdims=True)
    return np.where(np.abs(total) > 1e-12, v / np.where(total == 0, 1, total), 0.0)


def bootstrap_mean(raw: np.ndarray, draws: int, key: tuple) -> np.ndarray:
    """Mean over resamples with replacement of the rows' normalised sums."""
    n = len(raw)
    pick = np.array([[draw(*key, rep, slot) % n for slot in range(n)] for rep in range(draws)])
    return normalised(raw[pick].sum(axis=1)).mean(axis=0)


def null_euler(betti: DataFrame, reps: int = 20, draws: int = 50, seed: int = 42) -> DataFrame:
    """The same summary of effect and KS statistic for random pairs of halves of the samples: both halves' Euler curves as the
    alternating sum of bootstrapped mean curves, and the largest D over the grid of their samples' Euler curves. Betti curves
    are (sample, dim, gi, tau, raw). A random grouping is one task over a curve of each sample and dimension."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        rep, rows = int(p["rep"].iloc[0]), []
        names = sorted(p["sample"].unique(), key=lambda s: (draw(seed, rep, s), s))
        tau = np.asarray(p["tau"].iloc[0], float)
        raw = {(s, d): np.asarray(v, float) for s, d, v in zip(p["sample"], p["dim"], p["raw"], strict=True)}
        dims = sorted({d for _, d in raw})
        zero, halves = np.zeros(len(tau)), (names[: len(names) // 2], names[len(names) // 2 :])
        if halves[0]:
            of = lambda half, d: np.stack([raw.get((s, d), zero) for s in sorted(half)])
            mean = [sum((-1) ** d * bootstrap_mean(of(h, d), draws, (seed, rep, k, d)) for d in dims) for k, h in enumerate(halves)]
            own = [normalised(sum((-1) ** d * of(h, d) for d in dims)) for h in halves]
            rows.append((rep, effect(mean[0], mean[1], tau), max(ks(own[0][:, g], own[1][:, g])[0] for g in range(len(tau)))))
        return pd.DataFrame(rows, columns=["rep", "effect", "ks"])

    each = arrays(betti, ["sample", "dim"], ["tau", "raw"]).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    found = each.groupBy("rep").applyInPandas(run, "rep int, effect double, ks double").unpivot("rep", ["effect", "ks"], "stat", "v")
    return found.groupBy("stat").agg(F.count("v").cast("int").alias("reps"), *[F.round(x, 6).alias(n) for n, x in (("mean", F.avg("v")), ("sd", F.stddev_samp("v")), ("q025", F.percentile("v", F.lit(0.025))), ("q50", F.percentile("v", F.lit(0.5))), ("q975", F.percentile("v", F.lit(0.975))))])


#: pair_stats() in SQL, from the formulas: shuffles over a matrix of products, and p-values by the closed form for two groups of
#: the same size (else the column is null). Relations ind, means.
PAIR_STATS_SQL = """
g AS (SELECT DISTINCT comparison, grp FROM means WHERE length(trim(grp)) > 0),
q AS (SELECT a.comparison, a.grp AS g1, b.grp AS g2 FROM g a JOIN g b ON a.comparison = b.comparison AND a.grp <= b.grp),
axis AS (SELECT DISTINCT comparison, gi, tau, tau / max(tau) OVER (PARTITION BY comparison) AS x FROM ind),
wt AS (SELECT comparison, gi, tau, x, (coalesce(lead(tau) OVER o, tau) - coalesce(lag(tau) OVER o, tau)) / 2e0 AS w, (coalesce(lead(x) OVER o, x) - coalesce(lag(x) OVER o, x)) / 2e0 AS wx FROM axis WINDOW o AS (PARTITION BY comparison ORDER BY gi)),
share AS (SELECT comparison, grp, gi, m, sum(m) OVER (PARTITION BY comparison, grp ORDER BY gi) / CASE WHEN abs(sum(m) OVER (PARTITION BY comparison, grp)) > 1e-12 THEN sum(m) OVER (PARTITION BY comparison, grp) END AS f FROM means),
mm AS (SELECT q.comparison, q.g1, q.g2, round(sum(abs(a.f - b.f) * wt.wx), 6) AS wasserstein, sqrt(sum((a.m - b.m) * (a.m - b.m) * wt.w)) AS l2
  FROM q JOIN share a ON a.comparison = q.comparison AND a.grp = q.g1 JOIN share b ON b.comparison = q.comparison AND b.grp = q.g2 AND b.gi = a.gi JOIN wt ON wt.comparison = q.comparison AND wt.gi = a.gi GROUP BY ALL),
sd AS (SELECT q.comparison, q.g1, q.g2, stddev_samp(v.m) AS sd FROM q JOIN (SELECT 1 AS side, * FROM means UNION ALL SELECT 2, * FROM means) v ON v.comparison = q.comparison AND v.grp = CASE v.side WHEN 1 THEN q.g1 ELSE q.g2 END GROUP BY ALL),
prod AS (SELECT a.comparison, a.sample AS s, b.sample AS t, sum(a.v * b.v * wt.w) AS p FROM ind a JOIN ind b ON a.comparison = b.comparison AND a.gi = b.gi JOIN wt ON wt.comparison = a.comparison AND wt.gi = a.gi GROUP BY ALL),
who AS (SELECT DISTINCT comparison, grp, sample FROM ind),
mem AS (SELECT q.comparison, q.g1, q.g2, 1 AS side, sample FROM q JOIN who ON who.comparison = q.comparison AND who.grp = q.g1 UNION ALL SELECT q.comparison, q.g1, q.g2, 2, sample FROM q JOIN who ON who.comparison = q.comparison AND who.grp = q.g2),
size AS (SELECT comparison, g1, g2, count(*) FILTER (side = 1) AS n1, count(*) FILTER (side = 2) AS n2 FROM mem GROUP BY ALL),
ord AS (SELECT mem.*, rep, row_number() OVER (PARTITION BY mem.comparison, g1, g2, rep ORDER BY CAST('0x' || substr(md5('42|' || rep || '|' || side || '|' || sample), 1, 8) AS BIGINT), side, sample) AS place FROM mem, range(1000) r(rep)),
coef AS (SELECT ord.*, CASE WHEN place <= n1 THEN 1e0 / n1 ELSE -1e0 / n2 END AS c FROM ord JOIN size USING (comparison, g1, g2)),
perm AS (SELECT a.comparison, a.g1, a.g2, a.rep, sqrt(greatest(0e0, sum(a.c * b.c * prod.p))) AS stat FROM coef a JOIN coef b ON a.comparison = b.comparison AND a.g1 = b.g1 AND a.g2 = b.g2 AND a.rep = b.rep JOIN prod ON prod.comparison = a.comparison AND prod.s = a.sample AND prod.t = b.sample GROUP BY ALL),
pp AS (SELECT perm.comparison, perm.g1, perm.g2, round(avg(CASE WHEN stat >= l2 - 1e-9 THEN 1e0 ELSE 0e0 END), 6) AS perm_p FROM perm JOIN mm USING (comparison, g1, g2) GROUP BY ALL),
val AS (SELECT mem.comparison, g1, g2, side, gi, v FROM mem JOIN ind ON ind.comparison = mem.comparison AND ind.sample = mem.sample),
hist AS (SELECT comparison, g1, g2, gi, v, count(*) FILTER (side = 1) AS c1, count(*) FILTER (side = 2) AS c2 FROM val GROUP BY ALL),
ecdf AS (SELECT *, sum(c1) OVER o AS f1, sum(c2) OVER o AS f2 FROM hist WINDOW o AS (PARTITION BY comparison, g1, g2, gi ORDER BY v)),
d AS (SELECT e.comparison, e.g1, e.g2, e.gi, max(abs(f1 * 1e0 / n1 - f2 * 1e0 / n2)) AS d, max(n1) AS n, max(n2) AS m, max(c1 + c2) > 1 AS ties FROM ecdf e JOIN size USING (comparison, g1, g2) GROUP BY ALL),
kinds AS (SELECT DISTINCT round(d, 9) AS d, n, m, ties FROM d),
term AS (SELECT d, n, m, ties, j, CAST(round(d * n) AS INT) AS k FROM kinds, range(1, 101) r(j)),
kp AS (SELECT d, n, m, ties, CASE WHEN d = 0 THEN 1e0
  WHEN NOT ties AND n = m THEN 2e0 * sum(CASE WHEN j * k <= n THEN (CASE WHEN j % 2 = 1 THEN 1e0 ELSE -1e0 END) * exp(2 * lgamma(n + 1.0) - lgamma(greatest(n - j * k, 0) + 1.0) - lgamma(n + j * k + 1.0)) ELSE 0e0 END)
  WHEN ties THEN greatest(0e0, least(1e0, 2e0 * sum((CASE WHEN j % 2 = 1 THEN 1e0 ELSE -1e0 END) * exp(-2e0 * j * j * d * d * n * m / (n + m))))) END AS p FROM term GROUP BY d, n, m, ties),
dp AS (SELECT d.comparison, g1, g2, gi, d.d, kp.p, row_number() OVER (PARTITION BY d.comparison, g1, g2 ORDER BY kp.p) AS rk, count(*) OVER (PARTITION BY d.comparison, g1, g2) AS total FROM d JOIN kp ON kp.d = round(d.d, 9) AND kp.n = d.n AND kp.m = d.m AND kp.ties = d.ties),
kk AS (SELECT comparison, g1, g2, round(max(d), 6) AS ks_stat, round(least(1e0, min(p * total / rk)), 6) AS ks_adj_p FROM dp GROUP BY ALL),
pair AS (SELECT mm.comparison, mm.g1, mm.g2, wasserstein, perm_p, round(coalesce(l2 / nullif(sd, 0), 0e0), 5) AS effect_size, ks_stat, ks_adj_p FROM mm JOIN sd USING (comparison, g1, g2) JOIN pp USING (comparison, g1, g2) JOIN kk USING (comparison, g1, g2))"""


def oracle(individuals_: Op, means: Op, last: str) -> str:
    """A statement over the tables: the inputs' own SQL, pair_stats() in SQL, and what is selected from `pair`."""
    held = means.parts(individuals_.parts({}))
    parts = [f"{k} AS ({v})" for k, v in held.items()]
    return "WITH " + ",\n".join([*parts, f"ind AS (SELECT * FROM r_{individuals_.name})", f"means AS (SELECT comparison, grp, gi, m FROM r_{means.name})"]) + "," + PAIR_STATS_SQL + "\n" + last

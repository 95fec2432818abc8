"""Comparing groups of curves in SQL: Wasserstein, L2 and effect size, null models of areas, p adjustment."""

from __future__ import annotations

from homolith.functions.sqlop import Op, numbers

from .curves import GROUP

PAIRS = "a.grp <= b.grp AND a.dim = b.dim AND a.gi = b.gi"


def wasserstein(means: Op, name="pair_wasserstein") -> Op:
    """Area between the cumulated shares of two mean curves over tau / max tau, for all pairs of groups and each with itself."""
    return Op(name, f"""
WITH c AS (SELECT grp, dim, gi, tau / nullif(max(tau) OVER (), 0) AS x, sum(m) OVER (PARTITION BY grp, dim ORDER BY gi ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / nullif(sum(m) OVER (PARTITION BY grp, dim), 0) AS f FROM {{means}}),
p AS (SELECT a.grp AS g1, b.grp AS g2, a.dim, a.gi, a.x, abs(a.f - b.f) AS gap FROM c a JOIN c b ON {PAIRS}),
l AS (SELECT *, lag(x) OVER w AS px, lag(gap) OVER w AS pg FROM p WINDOW w AS (PARTITION BY g1, g2, dim ORDER BY gi))
SELECT g1, g2, dim, round(sum((x - px) * (gap + pg) / 2e0), 7) AS wasserstein FROM l WHERE px IS NOT NULL GROUP BY g1, g2, dim""", means=means)


def l2_effect(means: Op, name="pair_l2_effect") -> Op:
    """Root of the integrated squared difference, the standard deviation of both curves' values, and their ratio (0 without spread)."""
    return Op(name, f"""
WITH p AS (SELECT a.grp AS g1, b.grp AS g2, a.dim, a.gi, a.tau, a.m AS m1, b.m AS m2, (a.m - b.m) * (a.m - b.m) AS q FROM {{means}} a JOIN {{means}} b ON {PAIRS}),
l AS (SELECT *, lag(tau) OVER w AS pt, lag(q) OVER w AS pq FROM p WINDOW w AS (PARTITION BY g1, g2, dim ORDER BY gi)),
d AS (SELECT g1, g2, dim, sqrt(sum((tau - pt) * (q + pq) / 2e0)) AS l2 FROM l WHERE pt IS NOT NULL GROUP BY g1, g2, dim),
s AS (SELECT g1, g2, dim, stddev_samp(v) AS sd FROM (SELECT g1, g2, dim, m1 AS v FROM p UNION ALL SELECT g1, g2, dim, m2 FROM p) u GROUP BY g1, g2, dim)
SELECT d.g1, d.g2, d.dim, round(l2, 7) AS l2, round(sd, 7) AS sd, round(coalesce(l2 / nullif(sd, 0), 0e0), 5) AS effect_size FROM d JOIN s ON d.g1 = s.g1 AND d.g2 = s.g2 AND d.dim = s.dim""", means=means)


def null_areas(areas: Op, reps: int = 50, seed: int = 100, name="null_landscape") -> Op:
    """Per resample of all areas, the first half of whose draws (rounded down) is set against the others: the effect
    |difference of means| / sd, the two-sample KS statistic, and the largest gap of the cumulated shares in draw order (null
    if either sums to 0; a shorter first half starts anew). Of each the mean, sd and percent points. Fewer than two
    samples give no row."""
    return Op(name, f"""
WITH o AS (SELECT area, row_number() OVER (ORDER BY sample) - 1 AS slot, count(*) OVER () AS n FROM {{areas}}),
d AS (SELECT r.rep, o.slot, o.n, #hash[['{seed}|' || CAST(r.rep AS VARCHAR(9)) || '|' || CAST(o.slot AS VARCHAR(9))]] % o.n AS pick FROM o CROSS JOIN {numbers(reps, "rep")} r),
h AS (SELECT d.rep, d.slot, d.n, CASE WHEN d.slot < floor(d.n / 2e0) THEN 1 ELSE 2 END AS side, o.area FROM d JOIN o ON o.slot = d.pick WHERE d.n >= 2),
e AS (SELECT rep, coalesce(abs(avg(CASE WHEN side = 1 THEN area END) - avg(CASE WHEN side = 2 THEN area END)) / nullif(stddev_samp(area), 0), 0e0) AS effect FROM h GROUP BY rep),
k AS (SELECT rep, max(abs(c1 * 1e0 / n1 - c2 * 1e0 / n2)) AS ks FROM (SELECT rep, sum(2 - side) OVER w AS c1, sum(side - 1) OVER w AS c2, sum(2 - side) OVER t AS n1, sum(side - 1) OVER t AS n2 FROM h WINDOW w AS (PARTITION BY rep ORDER BY area RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), t AS (PARTITION BY rep)) u GROUP BY rep),
f AS (SELECT rep, side, n, CAST(slot - CASE WHEN side = 2 THEN floor(n / 2e0) ELSE 0 END AS INT) AS place, sum(area) OVER (PARTITION BY rep, side ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / nullif(sum(area) OVER (PARTITION BY rep, side), 0) AS share FROM h),
g AS (SELECT b.rep, max(abs(a.share - b.share)) AS gap FROM f b JOIN f a ON a.rep = b.rep AND a.side = 1 AND a.place = b.place % CAST(floor(b.n / 2e0) AS INT) WHERE b.side = 2 GROUP BY b.rep),
m AS (SELECT 'effect' AS stat, effect AS v FROM e UNION ALL SELECT 'ks', ks FROM k UNION ALL SELECT 'cdf_gap', gap FROM g)
SELECT stat, count(*) AS reps, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(#quantile[[v @@ 0.025e0]], 6) AS q025, round(#quantile[[v @@ 0.5e0]], 6) AS q50, round(#quantile[[v @@ 0.975e0]], 6) AS q975 FROM m GROUP BY stat""", areas=areas)


def adjusted(ps: Op, name="bh_adjust") -> Op:
    """Benjamini-Hochberg ("fdr" is the same) and Bonferroni, over the p that aren't null; each comparison is a family."""
    return Op(name, """
WITH n AS (SELECT *, count(perm_p) OVER (PARTITION BY comparison) AS n, row_number() OVER (PARTITION BY comparison ORDER BY perm_p, g1, g2) AS rk FROM {ps} WHERE perm_p IS NOT NULL)
SELECT g1, g2, comparison, perm_p, round(least(1e0, min(perm_p * n / rk) OVER (PARTITION BY comparison ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS p_bh, round(least(1e0, perm_p * n), 6) AS p_bonferroni FROM n""", ps=ps)

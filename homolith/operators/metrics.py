"""Clusterings against labels: pair counting and information metrics from one contingency roll-up, baselines, codes."""

from __future__ import annotations

from homolith.functions.sqlop import Op, numbers



def normal(observed: str, random: str, bigger: bool = True) -> str:
    """How far an observed value is from the random one to the best: 1, or 0 where smaller is better."""
    if bigger:
        return f"({observed} - {random}) / CASE WHEN abs(1e0 - {random}) < 1e-8 THEN 1e-8 ELSE 1e0 - {random} END"
    return f"(CASE WHEN abs({random}) < 1e-8 THEN 1e-8 ELSE {random} END - {observed}) / CASE WHEN abs({random}) < 1e-8 THEN 1e-8 ELSE {random} END"


def code(p: str) -> str:
    return f"CASE WHEN {p} < 1e-3 THEN '***' WHEN {p} < 1e-2 THEN '**' WHEN {p} < 5e-2 THEN '*' WHEN {p} < 1e-1 THEN '.' ELSE '' END"


LABELS = Op("labels_long", "SELECT o_orderkey AS cell, o_orderpriority AS x, o_orderstatus AS y FROM {orders}")


def contingency(labels: Op, name="contingency") -> Op:
    """Counts of (x, y), x, y and all rows, in one pass; g tells which."""
    return Op(name, "SELECT x, y, count(*) AS n, grouping(x) AS gx, grouping(y) AS gy FROM {labels} WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY GROUPING SETS ((x, y), (x), (y), ())", labels=labels)


def metrics(table: Op, name="cluster_metrics") -> Op:
    """ARI, NMI (by the larger entropy), Jaccard over pairs, variation of information (nats), purity."""
    return Op(name, """
WITH s AS (SELECT
  sum(CASE WHEN gx = 0 AND gy = 0 THEN n * (n - 1) / 2e0 END) AS c, sum(CASE WHEN gx = 0 AND gy = 1 THEN n * (n - 1) / 2e0 END) AS a,
  sum(CASE WHEN gx = 1 AND gy = 0 THEN n * (n - 1) / 2e0 END) AS b, sum(CASE WHEN gx = 1 AND gy = 1 THEN n * (n - 1) / 2e0 END) AS t,
  sum(CASE WHEN gx = 0 AND gy = 0 THEN n * ln(n) END) AS lxy, sum(CASE WHEN gx = 0 AND gy = 1 THEN n * ln(n) END) AS lx,
  sum(CASE WHEN gx = 1 AND gy = 0 THEN n * ln(n) END) AS ly, max(CASE WHEN gx = 1 AND gy = 1 THEN n * 1e0 END) AS n FROM {table}),
h AS (SELECT *, ln(n) - lxy / n AS hxy, ln(n) - lx / n AS hx, ln(n) - ly / n AS hy FROM s),
p AS (SELECT sum(m) AS m FROM (SELECT x, max(n) AS m FROM {table} WHERE gx = 0 AND gy = 0 GROUP BY x) q)
SELECT round(coalesce((c - a * b / t) / nullif((a + b) / 2e0 - a * b / t, 0), 1e0), 8) AS ari, round(coalesce((hx + hy - hxy) / nullif(greatest(hx, hy), 0), 1e0), 8) AS nmi,
  round(coalesce(c / nullif(a + b - c, 0), 0e0), 8) AS jaccard, round(2e0 * hxy - hx - hy, 8) AS vi, round(m / n, 8) AS purity FROM h CROSS JOIN p""", table=table)


def random_groups(labels: Op, reps: int = 5, k: int = 5, seed: int = 42, name="random_groups") -> Op:
    """Balanced random groups of cells: ntile over a hash order, one for each rep."""
    return Op(name, f"SELECT rep, cell, ntile({k}) OVER (PARTITION BY rep ORDER BY #hash[['{seed}|' || CAST(rep AS VARCHAR(9)) || '|' || CAST(cell AS VARCHAR(20))]], cell) AS g FROM {{labels}} CROSS JOIN {numbers(reps, 'rep')} r", labels=labels)


def baseline(labels: Op, groups: Op, real: Op, name="random_baseline") -> Op:
    """Pair-counting Jaccard of the clustering with each random grouping: mean, and the share that reaches the real one."""
    return Op(name, """
WITH c AS (SELECT g.rep, l.x, g.g, count(*) AS n, grouping(l.x) AS gx, grouping(g.g) AS gy FROM {labels} l JOIN {groups} g ON l.cell = g.cell GROUP BY GROUPING SETS ((g.rep, l.x, g.g), (g.rep, l.x), (g.rep, g.g))),
j AS (SELECT rep, sum(CASE WHEN gx = 0 AND gy = 0 THEN n * (n - 1) / 2e0 END) AS c, sum(CASE WHEN gx + gy = 1 THEN n * (n - 1) / 2e0 END) AS ab FROM c GROUP BY rep)
SELECT round(max(r.jaccard), 6) AS observed, round(avg(c / (ab - c)), 6) AS rand_mean, round(avg(CASE WHEN round(c / (ab - c), 8) >= r.jaccard THEN 1e0 ELSE 0e0 END), 6) AS pval FROM j CROSS JOIN {real} r""", labels=labels, groups=groups, real=real)


def normalised(base: Op, name="normalized_metrics") -> Op:
    """(observed - random) / (1 - random), a divisor next to 0 being 1e-8; and the code of the p-value."""
    return Op(name, f"SELECT observed, rand_mean, round({normal('observed', 'rand_mean')}, 6) AS norm, {code('pval')} AS flag FROM {{base}}", base=base)

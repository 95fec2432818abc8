"""Persistence diagrams to curves: smoothed Betti, Euler and landscape curves, their bands, areas and distances.

A diagram is (sample, dim, feature_id, birth, death); curves are long (sample, dim, gi, tau, raw, norm)."""

from __future__ import annotations

from homolith.functions.sqlop import Op, numbers

#: Grid of curves and landscapes, base width of the kernel, resamples.
GRID, LANDSCAPE_GRID, SIGMA, RESAMPLES, SEED = 500, 100, 1.0, 100, 42

DIAGRAM = Op("pd", """
SELECT sample, dim, feature_id, least(value, next) AS birth, greatest(value, next) AS death FROM (
  SELECT event_type || '_' || CAST(user_id % 8 AS VARCHAR(9)) AS sample, event_type AS grp, CAST(event_id % 2 AS INT) AS dim, event_id AS feature_id, value / 1e2 AS value,
    lead(value / 1e2) OVER (PARTITION BY event_type, user_id % 8, event_id % 2 ORDER BY event_id) AS next FROM {events}) e
WHERE next IS NOT NULL AND value <> next""")


def betti(pd: Op, grid: int = GRID, sigma: float = SIGMA, name="betti_curve") -> Op:
    """Sum over a dimension's intervals of persistence times a normal density at the middle, as wide as half the interval or
    sigma; and that divided by its sum over the grid (0 where that is 0). The grid runs to the largest death, or to 1 if that isn't
    finite or there is none; bars that never end have no middle and are left out."""
    return Op(name, f"""
WITH top AS (SELECT CASE WHEN max(death) < 1e308 THEN max(death) ELSE 1e0 END AS tmax FROM {{pd}}),
g AS (SELECT gi, gi * tmax / {grid - 1:e} AS tau FROM {numbers(grid)} n CROSS JOIN top),
s AS (SELECT DISTINCT sample, dim FROM {{pd}}),
i AS (SELECT sample, dim, death - birth AS life, (birth + death) / 2e0 AS mu, greatest({sigma:e}, (death - birth) / 2e0) AS sd FROM {{pd}} WHERE birth < death AND death < 1e308),
r AS (SELECT i.sample, i.dim, g.gi, sum(life * exp(-(tau - mu) * (tau - mu) / (2e0 * sd * sd)) / (sd * sqrt(2e0 * pi()))) AS raw FROM i CROSS JOIN g GROUP BY i.sample, i.dim, g.gi),
a AS (SELECT s.sample, s.dim, g.gi, g.tau, coalesce(r.raw, 0e0) AS raw FROM s CROSS JOIN g LEFT JOIN r ON r.sample = s.sample AND r.dim = s.dim AND r.gi = g.gi)
SELECT sample, dim, gi, round(tau, 8) AS tau, round(raw, 8) AS raw, round(coalesce(raw / nullif(sum(raw) OVER (PARTITION BY sample, dim), 0), 0e0), 8) AS norm FROM a""", pd=pd)


def euler(curves: Op, name="euler_curve") -> Op:
    """Alternating sum of the raw curves over dimensions (of normalised ones the sum would be rounding noise); normalised
    unless its sum is 0."""
    return Op(name, """
WITH e AS (SELECT sample, gi, tau, sum(CASE WHEN dim % 2 = 0 THEN raw ELSE -raw END) AS raw FROM {curves} GROUP BY sample, gi, tau),
t AS (SELECT *, sum(raw) OVER (PARTITION BY sample) AS total FROM e)
SELECT sample, gi, tau, round(raw, 8) + 0e0 AS raw, round(CASE WHEN abs(total) > 1e-12 THEN raw / total ELSE 0e0 END, 6) + 0e0 AS norm FROM t""", curves=curves)


def consistent(curves: Op, euler_curve: Op, name="euler_consistency") -> Op:
    return Op(name, """
SELECT e.sample, e.gi, abs(e.raw - b.raw) < 1e-6 AS consistent FROM {euler} e JOIN
  (SELECT sample, gi, sum(CASE WHEN dim % 2 = 0 THEN raw ELSE -raw END) AS raw FROM {curves} GROUP BY sample, gi) b ON e.sample = b.sample AND e.gi = b.gi""", curves=curves, euler=euler_curve)


def landscape(pd: Op, grid: int = LANDSCAPE_GRID, t_max: float = 1.0, level: int = 1, name="landscape") -> Op:
    """The level-th largest tent value over a dimension's intervals, at points of [0, t_max]; 0 without intervals. The first
    level is a maximum, which is combined before anything moves."""
    if level == 1:
        return Op(name, f"""
WITH g AS (SELECT gi, gi * {t_max:e} / {grid - 1:e} AS t FROM {numbers(grid)} n)
SELECT p.sample, p.dim, g.gi, round(max(g.t), 8) AS t, round(max(greatest(0e0, least(t - birth, death - t))), 8) AS v FROM {{pd}} p CROSS JOIN g GROUP BY p.sample, p.dim, g.gi""", pd=pd)
    return Op(name, f"""
WITH g AS (SELECT gi, gi * {t_max:e} / {grid - 1:e} AS t FROM {numbers(grid)} n), s AS (SELECT DISTINCT sample, dim FROM {{pd}}),
v AS (SELECT p.sample, p.dim, g.gi, greatest(0e0, least(t - birth, death - t)) AS v, row_number() OVER (PARTITION BY p.sample, p.dim, g.gi ORDER BY greatest(0e0, least(t - birth, death - t)) DESC) AS k FROM {{pd}} p CROSS JOIN g)
SELECT s.sample, s.dim, g.gi, round(g.t, 8) AS t, round(coalesce(v.v, 0e0), 8) AS v FROM s CROSS JOIN g LEFT JOIN v ON v.sample = s.sample AND v.dim = s.dim AND v.gi = g.gi AND v.k = {level}""", pd=pd)


def landscape_curve(land: Op, name="landscape_curve") -> Op:
    """Both dimensions together: the root of the sum of squares."""
    return Op(name, "SELECT sample, gi, t, round(sqrt(sum(v * v)), 8) AS v FROM {land} GROUP BY sample, gi, t", land=land)


def resampled(curve: Op, points: int, to: int, name="landscape_resampled") -> Op:
    """Linear interpolation of a curve of `points` points to `to` points over the same stretch."""
    return Op(name, f"""
WITH n AS (SELECT k, k * {points - 1:e} / {to - 1:e} AS x FROM {numbers(to, "k")} m),
b AS (SELECT k, x, CAST(floor(x) AS INT) AS lo, CAST(least(floor(x) + 1, {points - 1}) AS INT) AS hi FROM n)
SELECT l.sample, b.k AS gi, round(l.v + (h.v - l.v) * (b.x - b.lo), 8) AS v FROM b JOIN {{curve}} l ON l.gi = b.lo JOIN {{curve}} h ON h.gi = b.hi AND h.sample = l.sample""", curve=curve)


def area(curve: Op, name="landscape_auc") -> Op:
    """Trapezoid area under a landscape curve."""
    return Op(name, "SELECT sample, round(sum((t - pt) * (v + pv) / 2e0), 7) AS area FROM (SELECT sample, t, v, lag(t) OVER w AS pt, lag(v) OVER w AS pv FROM {curve} WINDOW w AS (PARTITION BY sample ORDER BY gi)) a WHERE pt IS NOT NULL GROUP BY sample", curve=curve)


def landscape_distance(land: Op, name="landscape_distance") -> Op:
    """Euclidean distance over grid points and dimensions, for samples i < j; a vector norm without a step width."""
    return Op(name, "SELECT a.sample AS i, b.sample AS j, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 6) AS d FROM {land} a JOIN {land} b ON a.dim = b.dim AND a.gi = b.gi AND a.sample < b.sample GROUP BY a.sample, b.sample", land=land)


GROUP = "split_part(sample, '_', 1)"


def draws(samples_of: Op, resamples: int = RESAMPLES, seed: int = SEED, name="draws") -> Op:
    """Resamples with replacement in each group: slot by slot a sample, by a hash of seed, rep and slot."""
    return Op(name, f"""
WITH s AS (SELECT DISTINCT sample FROM {{of}}), o AS (SELECT sample, {GROUP} AS grp, row_number() OVER (PARTITION BY {GROUP} ORDER BY sample) - 1 AS slot, count(*) OVER (PARTITION BY {GROUP}) AS n FROM s),
d AS (SELECT o.grp, r.rep, o.slot, #hash[['{seed}|' || CAST(r.rep AS VARCHAR(9)) || '|' || CAST(o.slot AS VARCHAR(9))]] % o.n AS pick FROM o CROSS JOIN {numbers(resamples, "rep")} r)
SELECT d.grp, d.rep, d.slot, o.sample FROM d JOIN o ON o.grp = d.grp AND o.slot = d.pick""", of=samples_of)


def bands(curves: Op, drawn: Op, value: str = "norm", keys: str = "dim, gi", mean: bool = False, name="curve_bands") -> Op:
    """Mean and 2.5 and 97.5 percent points over resamples of a group's summed (or averaged) curves, each normalised."""
    first = keys.split(",")[0].strip()
    over = f"(PARTITION BY grp, rep{', dim' if first == 'dim' else ''})"
    one = "v" if mean else f"coalesce(v / nullif(sum(v) OVER {over}, 0), 0e0)"
    return Op(name, f"""
WITH b AS (SELECT d.grp, d.rep, {", ".join("c." + k.strip() for k in keys.split(","))}, {"avg" if mean else "sum"}(c.{value}) AS v FROM {{drawn}} d JOIN {{curves}} c ON c.sample = d.sample GROUP BY d.grp, d.rep, {", ".join("c." + k.strip() for k in keys.split(","))}),
n AS (SELECT grp, rep, {keys}, {one} AS v FROM b)
SELECT grp, {keys}, round(avg(v), 6) AS mean, round(#quantile[[v @@ 0.025e0]], 6) AS lower, round(#quantile[[v @@ 0.975e0]], 6) AS upper FROM n GROUP BY grp, {keys}""", curves=curves, drawn=drawn)


def group_mean(curves: Op, name="group_curves") -> Op:
    """Mean normalised curve of each group and dimension."""
    return Op(name, f"SELECT {GROUP} AS grp, dim, gi, tau, avg(norm) AS m FROM {{curves}} GROUP BY {GROUP}, dim, gi, tau", curves=curves)

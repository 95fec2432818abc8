"""Queries by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from homolith.operators import curves as c
from homolith.operators import metrics as m
from homolith.functions.sqlop import Op
from homolith.operators import clusterings as k
from homolith.operators import comparisons as x
from homolith.operators import communities, integration, qc, relations, sct, spaces, stats, topology
from homolith.sources.cuts import cut

PCT = qc.feature_pct(qc.COUNTS)
# The tables here have cells of few genes: the limits of the filter are parameters.
KEPT = qc.cells(PCT, low=2, mito=60, ribo=5)
BETTI = c.betti(c.DIAGRAM)
EULER = c.euler(BETTI)
LAND = c.landscape(c.DIAGRAM)
LAND_CURVE = c.landscape_curve(LAND)
AREA = c.area(LAND_CURVE)
DRAWS = c.draws(c.DIAGRAM)
MEANS = c.group_mean(BETTI)
BANDS = c.bands(BETTI, DRAWS)
EULER_BANDS = c.bands(EULER, DRAWS, "raw", "gi", name="euler_bands")
LAND_WIDE = c.resampled(LAND_CURVE, c.LANDSCAPE_GRID, c.GRID)
INDIVIDUALS = x.individuals(BETTI, EULER, LAND_WIDE, c.GRID)
GROUP_BANDS = x.group_curves(BANDS, EULER_BANDS, c.bands(LAND_WIDE, DRAWS, "v", "gi", True, "landscape_wide_bands"))
WASSERSTEIN, EFFECT = stats.wasserstein(MEANS), stats.l2_effect(MEANS)
TABLE = m.contingency(m.LABELS)
METRICS = m.metrics(TABLE)
GROUPS = m.random_groups(m.LABELS)
BASE = m.baseline(m.LABELS, GROUPS, METRICS)

CLUSTERINGS, REFERENCES = Op("clusterings", k.LABELS_SQL), Op("references", k.REFERENCES_SQL)

SQL = [
    PCT, KEPT, qc.genes(qc.COUNTS, KEPT, 3), qc.samples(KEPT, 20), qc.lognorm(qc.COUNTS), qc.residuals(qc.COUNTS), qc.variable(qc.COUNTS), qc.scaled(qc.COUNTS), qc.centred(qc.COUNTS), qc.constant_metadata(qc.COUNTS), qc.zero_filled(qc.COUNTS),
    BETTI, EULER, c.consistent(BETTI, EULER), LAND, c.landscape(c.DIAGRAM, level=2, name="landscape_level2"), LAND_CURVE, LAND_WIDE, AREA, c.landscape_distance(LAND), BANDS, EULER_BANDS, GROUP_BANDS, c.bands(LAND_CURVE, DRAWS, "v", "gi", True, "landscape_bands"),
    WASSERSTEIN, EFFECT, stats.null_areas(AREA),
    TABLE, METRICS, GROUPS, BASE, m.normalised(BASE),
    relations.broadcast_labels(qc.COUNTS), relations.pending(c.DIAGRAM), relations.wide(WASSERSTEIN, EFFECT), relations.long(WASSERSTEIN), relations.completed(qc.COUNTS), relations.labels(), relations.fill_down(),
]


def curve_frames(spark, sf_dir):
    """Curves of samples and of groups, computed once: Betti curves first, which all others come from."""
    held = {BETTI.name: cut(BETTI.query(spark, sf_dir)), LAND_WIDE.name: cut(LAND_WIDE.query(spark, sf_dir)), DRAWS.name: cut(DRAWS.query(spark, sf_dir))}
    held[BANDS.name] = cut(BANDS.query(spark, sf_dir, dict(held)))
    means = GROUP_BANDS.over(spark, **{k: op.query(spark, sf_dir, dict(held)) if op.name not in held else held[op.name] for k, op in GROUP_BANDS.inputs.items()})
    return cut(INDIVIDUALS.query(spark, sf_dir, dict(held))), cut(means.select("comparison", "grp", "gi", "m"))


def comparison(spark, sf_dir):
    return k.comparison(CLUSTERINGS.query(spark, sf_dir), REFERENCES.query(spark, sf_dir), GROUPS.query(spark, sf_dir))


def comparison_oracle() -> str:
    held = GROUPS.parts(REFERENCES.parts(CLUSTERINGS.parts({})))
    return "WITH " + ",\n".join([f"{n} AS ({v})" for n, v in held.items()] + [f"lab AS (SELECT * FROM r_{CLUSTERINGS.name}), refs AS (SELECT * FROM r_{REFERENCES.name}), grp AS (SELECT * FROM r_{GROUPS.name})"]) + "," + k.ORACLE


def points(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("label").cast("string").alias("sample"), F.col("vec_id").alias("point_id"), F.col("embedding").alias("vec"))


def _h1(spark, sf_dir):
    return topology.diagrams(points(spark, sf_dir), 1)


def _bottleneck(spark, sf_dir):
    return topology.bottleneck(_h1(spark, sf_dir), samples=points(spark, sf_dir))


def _mnn(spark, sf_dir):
    found = topology.mutual_neighbours(points(spark, sf_dir))
    return found.withColumn("d", F.round("d", 6))


def _corrected(spark, sf_dir):
    p = points(spark, sf_dir)
    return topology.corrected(p, topology.mutual_neighbours(p, reference="0"), "0")


def _regressed(what):
    def query(spark, sf_dir):
        counts = cut(qc.COUNTS.query(spark, sf_dir).select("sample", F.col("cell").cast("string").alias("cell"), "gene", "value"))
        totals = cut(sct.depths(counts))
        return sct.values(counts, totals, cut(sct.scaled(sct.model(counts, totals), totals)), what).withColumn("value", F.round("value", 6))

    return query


def _from_sql(spark, sf_dir):
    topology.register(spark)
    narrow = points(spark, sf_dir).filter("vec IS NOT NULL").select("sample", "point_id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    return spark.sql("SELECT p.* FROM persistence(TABLE({rows}) PARTITION BY (sample), 0) p", rows=narrow)


def _components(spark, sf_dir):
    p = points(spark, sf_dir).filter("vec IS NOT NULL")
    width = p.select(F.max(F.size("vec"))).first()[0]
    return spaces.pca(spaces.dense_rows(p), width, 5)[1].select(F.col("batch").alias("sample"), F.col("id").alias("point_id"), "pc")


KERNELS = {
    "sct_residuals": _regressed("residuals"),
    "sct_data": _regressed("data"),
    "batch_components": _components,
    "anchor_integration": lambda s, d: integration.integrated(points(s, d), dims=10),
    "harmony_integration": lambda s, d: integration.harmony(points(s, d), 20, rounds=3),
    "modularity_clusters": lambda s, d: communities.clustered(points(s, d)),
    "persistence_sql": _from_sql,
    "leaf_order": lambda s, d: topology.leaf_order(_bottleneck(s, d)),
    "cophenetic": lambda s, d: topology.cophenetic(_bottleneck(s, d)),
    "ordered_scores": lambda s, d: topology.ordered_scores(_bottleneck(s, d)),
    "cluster_comparison": comparison,
    "cluster_comparison_wide": lambda s, d: k.wide(comparison(s, d)),
    "pair_stats": lambda s, d: x.pair_stats(*curve_frames(s, d)),
    "cross_iteration_stats": lambda s, d: x.flat(x.pair_stats(*curve_frames(s, d))),
    "pair_stats_heat": lambda s, d: x.heat_table(x.pair_stats(*curve_frames(s, d))),
    "bh_adjust": lambda s, d: stats.adjusted(INDIVIDUALS).over(s, ps=x.pair_stats(*curve_frames(s, d))),
    "null_aggregated": lambda s, d: x.null_aggregated(INDIVIDUALS.query(s, d).filter("comparison = 'landscape'")),
    "null_euler": lambda s, d: x.null_euler(BETTI.query(s, d)),
    "h0_mst_deaths": lambda s, d: topology.diagrams(points(s, d), 0),
    "h1_diagram": _h1,
    "bottleneck": _bottleneck,
    "spectral_distance": lambda s, d: topology.spectral_distance(_bottleneck(s, d)),
    "linkage_merges": lambda s, d: topology.merges(_bottleneck(s, d)),
    "distance_clusters": lambda s, d: topology.clusters(_bottleneck(s, d), 3),
    "knn_threshold": lambda s, d: topology.knn_threshold(points(s, d)),
    "silhouette": lambda s, d: topology.silhouette(points(s, d)).withColumn("silhouette", F.round("silhouette", 6)),
    "kmeans": lambda s, d: topology.kmeans(points(s, d), 10),
    "pca": lambda s, d: topology.pca(points(s, d)),
    "mnn_integration": _mnn,
    "mnn_correction": _corrected,
    "graph_clusters": lambda s, d: topology.graph_clusters(points(s, d)),
}

QUERIES = {op.name: op.query for op in SQL} | KERNELS
ORACLES = {op.name: op.oracle() for op in SQL} | {
    "pair_stats": x.oracle(INDIVIDUALS, GROUP_BANDS, "SELECT * FROM pair"),
    "cluster_comparison": comparison_oracle(),
    "silhouette": """WITH p AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS s, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.id, a.s, b.s AS o, sum(list_distance(a.v, b.v)) / nullif(count(*) - CASE WHEN a.s = b.s THEN 1 ELSE 0 END, 0) AS d FROM p a CROSS JOIN p b GROUP BY a.id, a.s, b.s),
e AS (SELECT id, s, max(CASE WHEN s = o THEN d END) AS a, min(CASE WHEN s <> o THEN d END) AS b FROM d GROUP BY ALL),
t AS (SELECT s AS sample, count(*) AS points, avg((b - a) / greatest(a, b)) AS m FROM e GROUP BY ALL)
SELECT sample, points, CASE WHEN (SELECT min(points) FROM t) > 1 AND (SELECT count(*) FROM t) > 1 THEN round(m, 6) END AS silhouette FROM t""",
    "mnn_integration": """WITH p AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS s, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.s AS batch_a, b.s AS batch_b, a.id AS pa, b.id AS pb, list_distance(a.v, b.v) AS d FROM p a JOIN p b ON a.s < b.s),
r AS (SELECT *, row_number() OVER (PARTITION BY batch_a, batch_b, pa ORDER BY d, pb) AS ra, row_number() OVER (PARTITION BY batch_a, batch_b, pb ORDER BY d, pa) AS rb FROM d)
SELECT batch_a, batch_b, pa, pb, round(d, 6) AS d FROM r WHERE ra <= 5 AND rb <= 5""",
    "bh_adjust": x.oracle(INDIVIDUALS, GROUP_BANDS, """SELECT a.g1, a.g2, a.comparison, a.perm_p, round(min(least(1e0, b.perm_p * b.n / b.above)), 6) AS p_bh, round(least(1e0, max(a.perm_p * b.n)), 6) AS p_bonferroni
FROM pair a JOIN (SELECT p.comparison, p.perm_p, count(*) AS above, max(t.n) AS n FROM pair p JOIN (SELECT comparison, count(*) AS n FROM pair GROUP BY ALL) t USING (comparison) JOIN pair o ON o.comparison = p.comparison AND o.perm_p <= p.perm_p GROUP BY p.comparison, p.perm_p, p.g1, p.g2) b ON b.comparison = a.comparison AND b.perm_p >= a.perm_p GROUP BY ALL"""),
    "cross_iteration_stats": x.oracle(INDIVIDUALS, GROUP_BANDS, "SELECT 'all' AS \"Group\", g1 || '_vs_' || g2 AS \"Pair\", comparison AS \"Comparison\", wasserstein, perm_p, effect_size, ks_stat, ks_adj_p FROM pair"),
    "pair_stats_heat": x.oracle(INDIVIDUALS, GROUP_BANDS, """, l AS (FROM pair UNPIVOT INCLUDE NULLS (v FOR stat IN (wasserstein, perm_p, effect_size, ks_stat, ks_adj_p)))
SELECT i, j, comparison, stat, v, CASE WHEN stat IN ('perm_p', 'ks_adj_p') THEN round(-log10(CASE WHEN v = 0 THEN 1e-16 ELSE v END), 5) + 0e0 END AS minus_log10
FROM (SELECT g1 AS i, g2 AS j, comparison, stat, v FROM l UNION ALL SELECT g2, g1, comparison, stat, v FROM l WHERE g1 <> g2) b"""),
}

"""The table that sets clusterings against reference labels and against random groups: five metrics, p-values, normalised values.

Clusterings are long: (iteration, method, cell, cluster); references (cell, ref, label) with ref SRA, Tissue or Approach;
random groups (rep, cell, g)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import code, normal

METRICS = ("ARI", "NMI", "Jaccard", "VI", "Purity")
#: Smaller values are better.
SMALLER = ("VI",)
#: What marks a comparison with a side of one cluster only.
DEGENERATE = "X"
#: Suffixes of methods' names and the reference that each stands for; the default.
SUFFIXES, DEFAULT = {"_sra": "SRA", "_tissue": "Tissue", "_approach": "Approach"}, "Tissue"


def slug(name):
    return F.regexp_replace(F.lower(name), "\\s+", "_")


def expanded(labels: DataFrame) -> DataFrame:
    """Clusterings whose method names no target, those of graphs, stand once for each target."""
    graph = F.col("method").rlike("(?i)^seurat_cluster_") & ~F.col("method").rlike("(_sra|_tissue|_approach)$")
    each = F.explode(F.when(graph, F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: F.concat(F.col("method"), s))).otherwise(F.array("method"))).alias("method")
    return labels.select("iteration", each, "cell", "cluster")


def reference_of(method, before_linkage: bool = True):
    """The reference that a method is judged by: by suffix, which stands at the end or, unless told otherwise, before the linkage's
    name. (With the end alone, every hierarchical clustering is judged by the default.)"""
    out = F.lit(DEFAULT)
    for suffix, ref in SUFFIXES.items():
        out = F.when(method.rlike(f"{suffix}{'(_[A-Za-z.0-9]+)?' if before_linkage else ''}$"), ref).otherwise(out)
    return out


def scores(table: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kx, ky (clusters on each side) and the five metrics of contingency tables (keys, x, y, n).

    Marginals come from the table of counts, which is small, not from the cells."""
    choose, n_log = lambda c: c * (c - 1) / 2.0, lambda c: c * F.log(c)
    n = F.col("n").cast("double")
    cells = table.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(choose(n)).alias("c"), F.sum(n_log(n)).alias("lxy"))

    def side(of, name):
        one = table.groupBy(*keys, of).agg(F.sum(n).alias("m"), F.max(n).alias("top"))
        return one.groupBy(*keys).agg(F.count("*").alias(f"k{of}"), F.sum(choose(F.col("m"))).alias(name), F.sum(n_log(F.col("m"))).alias(f"l{of}"), F.sum("top").alias(f"p{of}"))

    t = cells.join(side("x", "a"), keys).join(side("y", "b"), keys)
    total = F.col("n")
    expected = F.col("a") * F.col("b") / F.nullif(choose(total), F.lit(0.0))
    hx, hy, hxy = (F.log(total) - F.col(c) / total for c in ("lx", "ly", "lxy"))
    ari = F.coalesce((F.col("c") - expected) / F.nullif((F.col("a") + F.col("b")) / 2.0 - expected, F.lit(0.0)), F.lit(1.0))
    nmi = F.when(F.greatest(hx, hy) > 1e-12, (hx + hy - hxy) / F.greatest(hx, hy)).otherwise(0.0)
    both = F.col("a") + F.col("b") - F.col("c")
    jaccard = F.when(both == 0, 0.0).otherwise(F.col("c") / both)
    return t.select(*keys, "kx", "ky", *[F.round(v, 8).alias(m) for m, v in zip(METRICS, (ari, nmi, jaccard, 2 * hxy - hx - hy, F.col("px") / total), strict=True)])


def long(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.unpivot(keys, list(METRICS), "metric", name)


def adjust(df: DataFrame, family: list[str], p: str = "pval") -> DataFrame:
    """p_bh, p_fdr (the same) and p_bonferroni over each family's p-values that aren't null; nulls stay null."""
    own = Window.partitionBy(*family, F.col(p).isNull())
    down = own.orderBy(F.desc("rk")).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("nn", F.count(p).over(own)).withColumn("rk", F.row_number().over(own.orderBy(p, "method")))
    bh = F.round(F.least(F.lit(1.0), F.min(F.col(p) * F.col("nn") / F.col("rk")).over(down)), 8)
    bh = F.when(F.col(p).isNotNull(), bh)
    return df.withColumns({"p_bh": bh, "p_fdr": bh, "p_bonferroni": F.when(F.col(p).isNotNull(), F.round(F.least(F.lit(1.0), F.col(p) * F.col("nn")), 8))}).drop("nn", "rk")


def comparison(labels: DataFrame, references: DataFrame, groups: DataFrame) -> DataFrame:
    """iteration, method, reference, metric, observed, rand_mean, pval, flag, p_bh, p_fdr, p_bonferroni, norm, code: a row for
    each clustering and metric.

    The baseline compares the clustering with each random grouping; p is the share of them that does as well or better (for
    VI: as small). A side of one cluster gives 0, the flag X and no p. Cells without a cluster or a label are left out, and
    so are methods whose reference has no labels."""
    rows = expanded(labels).filter("cluster IS NOT NULL").withColumn("ref", reference_of(F.col("method")))
    keys = ["iteration", "method"]
    real = rows.join(references.filter("label IS NOT NULL"), ["cell", "ref"]).groupBy(*keys, "ref", F.col("cluster").alias("x"), F.col("label").alias("y")).agg(F.count("*").alias("n"))
    real = scores(real, [*keys, "ref"])
    deg = (F.col("kx") == 1) | (F.col("ky") == 1)
    real = real.select(*keys, "ref", deg.alias("deg"), *[F.when(deg, 0.0).otherwise(F.col(m)).alias(m) for m in METRICS])
    # The groupings stand beside the clusterings of a cell; counts are combined before they move.
    rand = rows.join(groups, "cell").groupBy(*keys, "rep", F.col("cluster").alias("x"), F.col("g").alias("y")).agg(F.count("*").alias("n"))
    rand = long(scores(rand, [*keys, "rep"]).drop("kx", "ky"), [*keys, "rep"], "v")
    obs = long(real, [*keys, "ref", "deg"], "observed")
    reaches = F.when(F.col("metric").isin(*SMALLER), F.col("v") <= F.col("observed")).otherwise(F.col("v") >= F.col("observed"))
    both = obs.join(rand, [*keys, "metric"], "left").groupBy(*keys, "ref", "metric", "deg", "observed").agg(F.round(F.avg("v"), 8).alias("rand_mean"), F.round(F.avg(F.when(reaches, 1.0).otherwise(F.when(F.col("v").isNotNull(), 0.0))), 8).alias("pval"))
    both = adjust(both.withColumn("pval", F.when(~F.col("deg"), F.col("pval"))), ["iteration", "metric"])
    norm = F.when(F.col("metric").isin(*SMALLER), F.expr(normal("observed", "rand_mean", False))).otherwise(F.expr(normal("observed", "rand_mean")))
    return both.select(*keys, F.col("ref").alias("reference"), "metric", "observed", "rand_mean", "pval", F.when(F.col("deg"), DEGENERATE).otherwise("").alias("flag"), "p_bh", "p_fdr", "p_bonferroni", F.round(norm, 6).alias("norm"), F.expr(code("p_fdr")).alias("code"))


def wide(table: DataFrame) -> DataFrame:
    """A row for each clustering, columns <metric>_<value>: the layout of the exported table."""
    values = {"Real": "observed", "RandMean": "rand_mean", "pval": "pval", "flag": "flag", "pval_adj_fdr": "p_fdr", "pval_adj_bh": "p_bh", "pval_adj_bonferroni": "p_bonferroni", "Norm": "norm"}
    at = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return table.groupBy("iteration", F.col("method").alias("Method"), F.col("reference").alias("ReferenceCol")).agg(*[at(m, c).alias(f"{m}_{n}") for m in METRICS for n, c in values.items()])


#: Clusterings of orders, their references and random groups, for a table of counts.
LABELS_SQL = """SELECT 'raw' AS iteration, m AS method, o_orderkey AS cell, CASE m WHEN 'kmeans_cluster_raw_tissue' THEN o_orderpriority WHEN 'hierarchical_cluster_bdm_ph_raw_sra_average' THEN CAST(o_custkey % 7 AS VARCHAR(9))
  WHEN 'seurat_cluster_raw' THEN CAST((o_custkey % 25) % 5 AS VARCHAR(9)) WHEN 'kmeans_cluster_raw_approach' THEN 'one' ELSE o_orderstatus END AS cluster
FROM {orders} CROSS JOIN (SELECT * FROM (VALUES ('kmeans_cluster_raw_tissue'), ('hierarchical_cluster_bdm_ph_raw_sra_average'), ('seurat_cluster_raw'), ('kmeans_cluster_raw_approach'), ('spectral_cluster_bdm_raw_approach')) AS v(m)) w"""
REFERENCES_SQL = """SELECT o_orderkey AS cell, r AS ref, CASE r WHEN 'SRA' THEN n_name WHEN 'Tissue' THEN CAST(n_regionkey AS VARCHAR(9)) ELSE CAST(n_nationkey % 2 AS VARCHAR(9)) END AS label
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey CROSS JOIN (SELECT * FROM (VALUES ('SRA'), ('Tissue'), ('Approach')) AS v(r)) w"""

ORACLE = """
e AS (SELECT iteration, unnest(CASE WHEN method LIKE 'seurat_cluster_%' THEN [method || '_sra', method || '_tissue', method || '_approach'] ELSE [method] END) AS method, cell, cluster FROM lab),
w AS (SELECT *, CASE WHEN regexp_matches(method, '_approach(_|$)') THEN 'Approach' WHEN regexp_matches(method, '_tissue(_|$)') THEN 'Tissue' WHEN regexp_matches(method, '_sra(_|$)') THEN 'SRA' ELSE 'Tissue' END AS ref FROM e),
pair AS (SELECT w.iteration, w.method, w.ref, -1 AS rep, w.cluster AS x, r.label AS y FROM w JOIN refs r ON r.cell = w.cell AND r.ref = w.ref
  UNION ALL SELECT w.iteration, w.method, w.ref, g.rep, w.cluster, CAST(g.g AS VARCHAR) FROM w JOIN grp g ON g.cell = w.cell),
cnt AS (SELECT iteration, method, ref, rep, x, y, CAST(count(*) AS DOUBLE) AS n FROM pair GROUP BY ALL),
tot AS (SELECT iteration, method, ref, rep, sum(n) AS n, sum(n * (n - 1) / 2) AS c FROM cnt GROUP BY ALL),
mx AS (SELECT iteration, method, ref, rep, x, sum(n) AS n, max(n) AS top FROM cnt GROUP BY ALL), my AS (SELECT iteration, method, ref, rep, y, sum(n) AS n FROM cnt GROUP BY ALL),
px AS (SELECT mx.iteration, mx.method, mx.ref, mx.rep, count(*) AS kx, sum(mx.n * (mx.n - 1) / 2) AS a, -sum(mx.n / tot.n * ln(mx.n / tot.n)) AS h, sum(top) AS p FROM mx JOIN tot USING (iteration, method, ref, rep) GROUP BY ALL),
py AS (SELECT my.iteration, my.method, my.ref, my.rep, count(*) AS ky, sum(my.n * (my.n - 1) / 2) AS b, -sum(my.n / tot.n * ln(my.n / tot.n)) AS h FROM my JOIN tot USING (iteration, method, ref, rep) GROUP BY ALL),
pj AS (SELECT cnt.iteration, cnt.method, cnt.ref, cnt.rep, -sum(cnt.n / tot.n * ln(cnt.n / tot.n)) AS h FROM cnt JOIN tot USING (iteration, method, ref, rep) GROUP BY ALL),
s AS (SELECT iteration, method, ref, rep, kx = 1 OR ky = 1 AS deg, round(coalesce((c - a * b / (tot.n * (tot.n - 1) / 2)) / nullif((a + b) / 2 - a * b / (tot.n * (tot.n - 1) / 2), 0), 1e0), 8) AS "ARI",
  round(CASE WHEN greatest(px.h, py.h) > 1e-12 THEN (px.h + py.h - pj.h) / greatest(px.h, py.h) ELSE 0e0 END, 8) AS "NMI", round(CASE WHEN a + b - c = 0 THEN 0e0 ELSE c / (a + b - c) END, 8) AS "Jaccard", round(2 * pj.h - px.h - py.h, 8) AS "VI", round(px.p / tot.n, 8) AS "Purity"
  FROM tot JOIN px USING (iteration, method, ref, rep) JOIN py USING (iteration, method, ref, rep) JOIN pj USING (iteration, method, ref, rep)),
l AS (FROM s UNPIVOT (v FOR metric IN ("ARI", "NMI", "Jaccard", "VI", "Purity"))),
o AS (SELECT a.iteration, a.method, a.ref, a.metric, a.deg, CASE WHEN a.deg THEN 0e0 ELSE a.v END AS observed FROM l a WHERE rep = -1),
b AS (SELECT o.*, round(avg(r.v), 8) AS rand_mean, CASE WHEN NOT deg THEN round(avg(CASE WHEN CASE WHEN o.metric = 'VI' THEN r.v <= observed ELSE r.v >= observed END THEN 1e0 ELSE 0e0 END), 8) END AS pval FROM o JOIN (SELECT iteration, method, metric, v FROM l WHERE rep >= 0) r USING (iteration, method, metric) GROUP BY o.iteration, o.method, o.ref, o.metric, o.deg, o.observed),
k AS (SELECT *, count(pval) OVER (PARTITION BY iteration, metric) AS n, row_number() OVER (PARTITION BY iteration, metric, pval IS NULL ORDER BY pval, method) AS rk FROM b),
z AS (SELECT *, CASE WHEN pval IS NOT NULL THEN round(least(1e0, min(pval * n / rk) OVER (PARTITION BY iteration, metric, pval IS NULL ORDER BY rk DESC)), 8) END AS p_bh FROM k)
SELECT iteration, method, ref AS reference, metric, observed, rand_mean, pval, CASE WHEN deg THEN 'X' ELSE '' END AS flag, p_bh, p_bh AS p_fdr, CASE WHEN pval IS NOT NULL THEN round(least(1e0, pval * n), 8) END AS p_bonferroni,
  round(CASE WHEN metric = 'VI' THEN (CASE WHEN abs(rand_mean) < 1e-8 THEN 1e-8 ELSE rand_mean END - observed) / CASE WHEN abs(rand_mean) < 1e-8 THEN 1e-8 ELSE rand_mean END ELSE (observed - rand_mean) / CASE WHEN abs(1 - rand_mean) < 1e-8 THEN 1e-8 ELSE 1 - rand_mean END END, 6) AS norm,
  CASE WHEN p_bh < 0.001 THEN '***' WHEN p_bh < 0.01 THEN '**' WHEN p_bh < 0.05 THEN '*' WHEN p_bh < 0.1 THEN '.' ELSE '' END AS code FROM z"""

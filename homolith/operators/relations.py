"""Joins, reshaping and bookkeeping between the numeric operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from homolith.functions.sqlop import Op
from homolith.sources import tables


def broadcast_labels(counts: Op, name="cluster_label_broadcast") -> Op:
    """A sample's label on each of its cells; cells of unlabelled samples get null."""
    return Op(name, "SELECT c.sample, c.cell, l.label FROM (SELECT DISTINCT sample, cell FROM {counts}) c LEFT JOIN (SELECT n_name AS sample, n_regionkey AS label FROM {nation}) l ON c.sample = l.sample", counts=counts)


def pending(pd: Op, name="pending_jobs_anti") -> Op:
    """Samples without more than 125 bars of dimension 0, which stand for jobs that aren't done."""
    return Op(name, """
WITH done AS (SELECT sample, count(*) AS n FROM {pd} WHERE dim = 0 GROUP BY sample HAVING count(*) > 125), jobs AS (SELECT DISTINCT sample FROM {pd})
SELECT j.sample FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.sample = j.sample)""", pd=pd)


def wide(w: Op, e: Op, name="wide_stats_full_outer") -> Op:
    """One row for each pair, a column for each statistic; pairs that one side lacks have nulls."""
    out = Op(name, "SELECT coalesce(w.g1, e.g1) AS group1, coalesce(w.g2, e.g2) AS group2, coalesce(w.dim, e.dim) AS dim, w.wasserstein, e.l2, e.effect_size FROM {w} w FULL OUTER JOIN {e} e ON w.g1 = e.g1 AND w.g2 = e.g2 AND w.dim = e.dim", w=w, e=e)
    # Both sides come from one relation of curves, whose copies Spark can't tell apart once all is one plan of subqueries.
    out.apart = True
    return out


def long(w: Op, name="long_stats") -> Op:
    """Statistics as rows, and each pair also the other way round."""
    return Op(name, "SELECT g1 AS i, g2 AS j, dim, 'wasserstein' AS stat, wasserstein AS v FROM {w} UNION ALL SELECT g2, g1, dim, 'wasserstein', wasserstein FROM {w} WHERE g1 <> g2", w=w)


def completed(counts: Op, name="complete_fill") -> Op:
    """Every (sample, gene set) with its count, 0 where there is none."""
    return Op(name, "SELECT s.sample, m.metric, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT sample FROM {counts}) s CROSS JOIN (SELECT * FROM (VALUES ('MT-'), ('RPS'), ('HBA'), ('XYZ')) AS v(metric)) m LEFT JOIN (SELECT sample, substr(gene, 1, 3) AS metric, count(*) AS n FROM {counts} GROUP BY 1, 2) c ON c.sample = s.sample AND c.metric = m.metric", counts=counts)


def labels(name="iteration_labels") -> Op:
    """Names of processing variants brought to their labels, unknown ones as they are, with the names of their tables. The
    preferred one comes first."""
    config = ", ".join(f"('{label}', '{prefix}', {i}, '{'unintegrated_' if prefix in tables.UNINTEGRATED else ''}')" for i, (label, prefix, _) in enumerate(tables.ITERATIONS, 1))
    return Op(name, f"WITH cfg AS (SELECT * FROM (VALUES {config}) AS v(label, prefix, ord, pre)), ids AS (SELECT DISTINCT CASE event_type WHEN 'click' THEN 'raw' WHEN 'error' THEN 'Seurat Integration' WHEN 'purchase' THEN 'harmony_integration' ELSE event_type END AS id FROM {{events}}) SELECT i.id, coalesce(c.label, i.id) AS label, 'BDM_' || coalesce(c.pre || c.prefix, i.id) || '.rds' AS bdm_matrix, 'SDM_' || coalesce(c.pre || c.prefix, i.id) || '.rds' AS sdm_matrix, 'PD_list_' || coalesce(c.pre || c.prefix, i.id) || '.rds' AS pd_list, row_number() OVER (ORDER BY CASE WHEN c.label = '{tables.PREFERRED}' THEN 0 ELSE 1 END, coalesce(c.ord, 99), i.id) AS ord FROM ids i LEFT JOIN cfg c ON i.id = c.prefix OR i.id = c.label")


def first_match(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order (ties are broken by the other columns, so that reruns agree)."""
    by = Window.partitionBy(*keys).orderBy(*order, *[c for c in rows.columns if c not in keys])
    at = "__first"
    return rows.withColumn(at, F.row_number().over(by)).filter(F.col(at) == 1).drop(at)


def annotated(cells: DataFrame, manifest: DataFrame, key: str = "sample") -> DataFrame:
    """Cells with their sample's metadata, by name and not by position; a sample that the manifest repeats has its first row."""
    more = [c for c in manifest.columns if c != key and c not in cells.columns]
    one = first_match(manifest.select(key, *more), [key], [F.col(c) for c in more])
    return cells.join(F.broadcast(one), key, "left")


def preferring(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left rows; of columns on both sides the right value, where there is one."""
    shared = [c for c in right.columns if c in left.columns and c not in keys]
    renamed = right.select(*keys, *[F.col(c).alias(f"{c}.right") for c in shared], *[c for c in right.columns if c not in left.columns])
    out = left.join(renamed, keys, "left")
    return out.select(*[F.coalesce(F.col(f"`{c}.right`"), F.col(c)).alias(c) if c in shared else F.col(c) for c in left.columns], *[c for c in right.columns if c not in left.columns])


def aligned(frames: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Diagrams of several iterations as one table: (diagrams, metadata) by iteration. A diagram has the first metadata row of
    its sample, diagrams without one are dropped, columns that all have are kept, and samples are named iteration_sample."""
    out = []
    for name, (pd, meta) in frames.items():
        joined = pd.join(annotated(pd.select("sample").distinct().join(meta.select("sample").distinct(), "sample"), meta), "sample")
        out.append(joined.withColumn("iteration", F.lit(name)).withColumn("sample", F.concat_ws("_", F.lit(name), "sample")))
    common = [c for c in out[0].columns if all(c in f.columns for f in out)]
    return reduce(lambda a, b: a.unionByName(b), [f.select(*common) for f in out])


def in_order(rows: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Rows sorted by an outer list of names, others last."""
    order = rows.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"`{key}` string, __ord int")
    return rows.join(F.broadcast(order), key, "left").orderBy(F.col("__ord").asc_nulls_last(), key).drop("__ord")


def one_per_sample(cells: DataFrame, columns: list[str], cell: str = "cell") -> DataFrame:
    """Each column's value in a sample's smallest cell."""
    return cells.groupBy("sample").agg(*[F.min_by(c, cell).alias(c) for c in columns])


def spans(rows: DataFrame, group: str, at: str) -> DataFrame:
    """Least, largest and middle place of each group."""
    return rows.groupBy(group).agg(F.min(at).alias("least"), F.max(at).alias("most"), ((F.min(at) + F.max(at)) / 2).alias("middle"))


def prefixed(cells: DataFrame) -> DataFrame:
    """Cells named sample_cell, so that merged samples have no name twice."""
    return cells.withColumn("cell", F.concat_ws("_", "sample", F.col("cell").cast("string")))


def merged(samples: list[DataFrame]) -> DataFrame:
    """Samples' long matrices as one, cells named by sample; a gene that a sample lacks is 0 there, as an absent row is."""
    return reduce(lambda a, b: a.unionByName(b), [prefixed(s) for s in samples])


def fill_down(name="fill_down") -> Op:
    """The last value that isn't null so far, and whether a row begins a run."""
    return Op(name, "SELECT event_id, event_type, #last[[v]] OVER w AS filled, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS starts FROM (SELECT event_id, event_type, user_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM {events}) e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")

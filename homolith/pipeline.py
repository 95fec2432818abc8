"""From a manifest to tables of comparisons: quality control, variants, diagrams, distances, clusterings, statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homolith.functions.sqlop import Op
from homolith.operators import clusterings, communities, comparisons, curves, integration, metrics, points, qc, relations, sct, spaces, topology
from homolith.sources import tables
from homolith.sources.cuts import cut, tabled

#: The integration methods that there are.
INTEGRATIONS = {"seurat": "seurat_integration", "harmony": "harmony_integration"}


@dataclass
class Config:
    """What a run does. Limits of the quality filter and sizes of the statistics have the operators' defaults."""

    manifest: str
    results: str
    integration_methods: tuple[str, ...] = ("seurat",)
    min_cells: int = qc.MIN_CELLS
    min_features: int = qc.MIN_FEATURES
    max_features: int = qc.MAX_FEATURES
    max_mito: float = qc.MAX_MITO
    min_ribo: float = qc.MIN_RIBO
    min_gene_cells: int = qc.MIN_GENE_CELLS
    #: Values of the regressed variants: logarithms of corrected counts ("data") or "residuals".
    sct_values: str = "data"
    sct_min_cells: int = sct.MIN_CELLS
    features: int = 3000
    dims: int = 50
    min_integration_cells: int = 200
    k_anchor: int = integration.K_ANCHOR
    k_filter: int = integration.K_FILTER
    k_score: int = integration.K_SCORE
    k_weight: int = integration.K_WEIGHT
    harmony_clusters: int | None = None
    harmony_rounds: int = 10
    dim: int = 1
    threshold: float = -1.0
    #: Samples whose diagrams are committed at a time: a run that was killed goes on behind its last commit.
    batch: int = 16
    run_hierarchical: bool = True
    run_spectral: bool = True
    run_kmeans: bool = True
    run_standard: bool = True
    kmeans_starts: int = 25
    resolution: float = 0.5
    run_cluster: bool = False
    run_betti: bool = False
    run_cross_iteration: bool = False
    group_by: str = "tissue"
    linkages: tuple[str, ...] = topology.METHODS
    #: Random groupings of the cells that a clustering is compared with: p-values move in steps of one over it.
    random_groups: int = 100
    permutations: int = comparisons.PERMUTATIONS
    resamples: int = curves.RESAMPLES
    grid: int = curves.GRID
    overrides: dict | str | None = None
    more: dict = field(default_factory=dict)


def checked(cfg: Config) -> list[str]:
    """Prefixes of the integrations that are asked for; none or an unknown one is an error."""
    wanted = [m.lower() for m in cfg.integration_methods]
    if not wanted or any(m not in INTEGRATIONS for m in wanted):
        raise ValueError(f"integration methods are {', '.join(INTEGRATIONS)}")
    return [INTEGRATIONS[m] for m in wanted]


_FRAME = Op("frame", "")


def filtered(spark: SparkSession, counts: DataFrame, cfg: Config) -> DataFrame:
    """Counts of the cells, genes and samples that pass the quality filter."""
    pct = qc.feature_pct(_FRAME).over(spark, counts=counts)
    kept = cut(qc.cells(_FRAME, cfg.min_features, cfg.max_features, cfg.max_mito, cfg.min_ribo).over(spark, pct=pct))
    samples = qc.samples(_FRAME, cfg.min_cells).over(spark, kept=kept)
    genes = qc.genes(_FRAME, _FRAME, cfg.min_gene_cells).over(spark, counts=counts, kept=kept)
    out = counts.join(kept.select("sample", "cell"), ["sample", "cell"], "left_semi").join(genes.select("sample", "gene"), ["sample", "gene"], "left_semi")
    return out.join(F.broadcast(samples.select("sample")), "sample", "left_semi")


@dataclass
class Variant:
    """A long matrix of what is stored, its cells (sample, cell, total), and what absent values follow from: 0, or fill(total, of) of a
    cell's depth and of(name), the columns that `absent` has of a gene."""

    matrix: DataFrame
    cells: DataFrame
    absent: DataFrame | None = None
    fill: Callable | None = None

    def points(self) -> DataFrame:
        """Each gene of a sample as a point."""
        return points.genes_as_points(self.matrix, self.cells, self.absent, self.fill and (lambda t: self.fill(t, F.col)))

    def vectors(self, genes: DataFrame) -> DataFrame:
        """Each cell as a point over these genes."""
        return points.cells_as_points(self.matrix, self.cells, genes, self.absent, self.fill)


def regressed(counts: DataFrame, totals: DataFrame, fits: DataFrame, what: str) -> Variant:
    return Variant(cut(sct.values(counts, totals, fits, what)), totals, fits, lambda t, of: sct.value(what, F.lit(0.0), t, of))


def split_names(df: DataFrame) -> DataFrame:
    """Rows of cells named sample, tab, cell, with both parts again."""
    parts = F.split("cell", "\t")
    return df.withColumn("sample", parts[0]).withColumn("cell", parts[1])


def variants(counts: DataFrame, integrations: list[str], cfg: Config) -> dict[str, Variant]:
    """By prefix: counts; values regressed on depth, sample by sample and over all cells; integrated values over shared features.

    Anchors are found among residuals of each sample, of samples with enough cells; soft clusters in the values of all cells."""
    counts = counts.select("sample", "cell", "gene", "value")
    totals = cut(sct.depths(counts))
    fits = cut(sct.scaled(sct.model(counts, totals, cfg.sct_min_cells), totals))
    whole = counts.select(F.lit("all").alias("sample"), F.concat_ws("\t", "sample", "cell").alias("cell"), "gene", "value")
    depth = cut(sct.depths(whole))
    joint = cut(sct.scaled(sct.model(whole, depth, cfg.sct_min_cells), depth))
    one = regressed(whole, depth, joint, cfg.sct_values)
    over_all = Variant(split_names(one.matrix), totals, joint.drop("sample"), one.fill)
    out = {"raw": Variant(counts, totals), "sct_individual": regressed(counts, totals, fits, cfg.sct_values), "sct_whole": over_all}
    for prefix in integrations:
        if prefix == "seurat_integration":
            enough = totals.groupBy("sample").count().filter(F.col("count") >= cfg.min_integration_cells)
            base = regressed(counts, totals, fits, "residuals")
            base.cells = cut(totals.join(F.broadcast(enough.select("sample")), "sample", "left_semi"))
        else:
            base = over_all
        genes = cut(points.features(points.variances(base.points()), cfg.features))
        cells = base.vectors(genes)
        if prefix == "seurat_integration":
            mixed = integration.integrated(cells, cfg.dims, cfg.k_anchor, cfg.k_filter, cfg.k_score, cfg.k_weight)
        else:
            mixed = integration.harmony(cells, cfg.harmony_clusters, cfg.harmony_rounds)
        out[prefix] = Variant(cut(points.as_matrix(mixed, genes)), base.cells)
    return out


#: What of a configuration diagrams depend on.
SHAPES = ("integration_methods", "min_cells", "min_features", "max_features", "max_mito", "min_ribo", "min_gene_cells", "sct_values", "sct_min_cells", "features", "dims", "min_integration_cells", "k_anchor", "k_filter", "k_score", "k_weight", "harmony_clusters", "harmony_rounds", "dim", "threshold")


def stage_key(cfg: Config, *inputs) -> str:
    """A name for what follows from this configuration and these inputs: nothing made of others is read in its place."""
    held = asdict(cfg)
    return hashlib.sha256(repr([*[(k, held[k]) for k in SHAPES], *inputs]).encode()).hexdigest()[:16]


def resumed_diagrams(spark: SparkSession, vectors: DataFrame, path: str, cfg: Config) -> DataFrame:
    """Diagrams of all samples at `path`, a table by sample and a log of finished ones. Samples are taken in batches, each logged
    once its diagrams are written; those that are logged aren't made again, and rows of a batch that broke off are replaced."""
    log = f"{path}-log"
    names = sorted(r[0] for r in vectors.select("sample").distinct().collect())
    done = {r[0] for r in spark.read.parquet(log).filter("status = 'completed'").select("job_id").collect()} if tables.exists(spark, log) else set()
    left = [n for n in names if n not in done]
    for i in range(0, len(left), cfg.batch):
        part = left[i : i + cfg.batch]
        found = topology.diagrams(vectors.filter(F.col("sample").isin(part)), cfg.dim, threshold=cfg.threshold)
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample").parquet(path)
        tables.log_progress(spark.createDataFrame([(n, "completed", cfg.threshold) for n in part], "job_id string, status string, threshold double"), log)
    schema = "dim int, feature_id int, birth double, death double, sample string"
    return spark.read.schema(schema).parquet(path).select("sample", "dim", "feature_id", "birth", "death") if names else spark.createDataFrame([], schema)


def process(spark: SparkSession, cfg: Config) -> list[dict]:
    """Variants with their diagrams, which are written under results/pd; metadata goes to results/metadata, before and after the filter."""
    integrations = checked(cfg)
    manifest = tables.manifest(spark, cfg.manifest)
    paths = sorted(r["file_path"] for r in manifest.filter("file_path IS NOT NULL").select("file_path").collect())
    counts = tables.matrices(spark, paths)
    meta = cut(relations.first_match(manifest.filter("sample IS NOT NULL").drop("file_path"), ["sample"], []))
    before = relations.annotated(counts, meta)
    counts = cut(filtered(spark, before, cfg))
    for name, df in (("metadata_before", before), ("metadata", counts)):
        tables.save(qc.constant_metadata(_FRAME).over(spark, counts=df), f"{cfg.results}/{name}")
    key, found = stage_key(cfg, paths), {}
    for prefix, variant in variants(counts, integrations, cfg).items():
        pd = resumed_diagrams(spark, variant.points(), f"{cfg.results}/pd/{prefix}-{key}", cfg)
        found[prefix] = {"variant": variant, "matrix": variant.matrix, "pd": pd, "meta": meta, "cells": counts.select("sample", "cell").distinct(), "key": key}
    mine = tables.assembled(found)
    return resolved(spark, mine, tables.overrides(mine, tables.imported_overrides(cfg.overrides), spark))


def resolved(spark: SparkSession, mine: list[dict], given: list[dict]) -> list[dict]:
    """Variants whose given tables have taken the place of their own: diagrams, cells with their metadata (sample, cell, sra, tissue,
    approach), landscapes. Distances stay paths, which distances() reads. Whatever is given changes the names of what is made of it."""
    out = []
    for own, it in zip(mine, given, strict=True):
        flags, data = it.get("flags", {}), dict(own["data"])
        if flags.get("data"):
            cells = spark.read.parquet(it["data"])
            data["cells"] = cells.select("sample", "cell").distinct()
            data["meta"] = cut(relations.first_match(cells.drop("cell"), ["sample"], []))
        if flags.get("pd_list"):
            data["pd"] = spark.read.parquet(it["pd_list"])
        if flags.get("landscape_list"):
            data["landscapes"] = spark.read.parquet(it["landscape_list"])
            if not tables.valid_landscapes(data["landscapes"], curves.LANDSCAPE_GRID):
                raise ValueError(f"the landscapes of {it['name']} don't have both dimensions of every sample")
        if any(flags.values()):
            data["key"] = hashlib.sha256(repr([data["key"], *[(k, str(it[k])) for k in ("data", "pd_list", "landscape_list") if flags.get(k)]]).encode()).hexdigest()[:16]
        out.append({**it, "data": data})
    return out


def landscapes(spark: SparkSession, data: dict) -> DataFrame:
    return data["landscapes"] if "landscapes" in data else curves.landscape(_FRAME).over(spark, pd=data["pd"])


def distances(spark: SparkSession, it: dict, cfg: Config) -> dict[str, DataFrame]:
    """bdm, sdm and landscape tables (i, j, d). Given tables are taken as they are; those made of the same diagrams before are read
    again if they are whole."""
    pd = it["data"]["pd"]
    samples = it["data"]["meta"].select("sample").join(pd.select("sample").distinct(), "sample", "left_semi")
    n, out, flags = samples.count(), {}, it.get("flags", {})

    def kept(kind, flag, make, *of):
        if flags.get(flag):
            return spark.read.parquet(it[flag])
        path = f"{cfg.results}/{kind}/{it['prefix']}-{hashlib.sha256(repr([it['data']['key'], *of]).encode()).hexdigest()[:16]}"
        if not tables.exists(spark, f"{path}/_SUCCESS") or not tables.valid_distances(spark.read.parquet(path), n):
            make().select("i", "j", "d").write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    out["bdm"] = kept("bdm", "bdm_matrix", lambda: topology.bottleneck(pd, samples=samples))
    out["sdm"] = kept("sdm", "sdm_matrix", lambda: topology.spectral_distance(out["bdm"]), str(it["bdm_matrix"]) if flags.get("bdm_matrix") else "")
    out["landscape"] = kept("landscape", "landscape_matrix", lambda: curves.landscape_distance(_FRAME).over(spark, land=landscapes(spark, it["data"])))
    return out


def cell_clusters(iterations: list[dict], cfg: Config) -> DataFrame | None:
    """(iteration, method, cell, cluster): k-means (as many as a target has values) and communities of neighbour graphs of the cells, in
    principal components of the scaled features of each variant; one run of each step for all variants."""
    if not (cfg.run_kmeans or cfg.run_standard):
        return None
    ranked, rows = None, None
    for it in iterations:
        v = points.variances(it["data"]["variant"].points()).withColumn("sample", F.concat(F.lit(it["name"] + "|"), "sample"))
        ranked = v if ranked is None else ranked.unionByName(v)
    genes = cut(points.features(ranked, cfg.features).select("gene", (F.col("place") - 1).alias("place")))
    for it in iterations:
        named = it["data"]["matrix"].select(F.lit(it["name"]).alias("batch"), F.concat_ws("_", "sample", "cell").alias("cell"), "gene", "value")
        own = spaces.sparse_rows(named, genes, "batch")
        rows = own if rows is None else rows.unionByName(own)
    place = tabled(spaces.pca(rows, genes.count(), cfg.dims, True)[1].select(F.col("batch").alias("sample"), F.col("id").alias("point_id"), F.col("pc").alias("vec")))
    out = None
    if cfg.run_standard:
        out = communities.clustered(place, resolution=cfg.resolution).select(F.col("graph").alias("iteration"), F.concat(F.lit("seurat_cluster_"), F.lower(F.regexp_replace("graph", " ", "_"))).alias("method"), F.col("id").alias("cell"), F.col("label").alias("cluster"))
    for it in iterations if cfg.run_kmeans else []:
        k, slug = targets(it), it["name"].lower().replace(" ", "_")
        for target, of in k.items():
            if of >= 2:
                found = topology.kmeans(place.filter(F.col("sample") == it["name"]), of, cfg.kmeans_starts)
                found = found.select(F.lit(it["name"]).alias("iteration"), F.lit(f"kmeans_cluster_{slug}_{target}").alias("method"), F.col("point_id").alias("cell"), F.col("label").cast("string").alias("cluster"))
                out = found if out is None else out.unionByName(found)
    return tabled(out) if out is not None else None


def targets(it: dict) -> dict[str, int]:
    """How many values each label has."""
    return it["data"]["meta"].agg(*[F.count_distinct(c).alias(c) for c in ("sra", "tissue", "approach")]).first().asDict()


def clustered(it: dict, dist: dict[str, DataFrame], cfg: Config) -> DataFrame | None:
    """(iteration, method, sample, cluster) of all distances, targets and linkages: as many clusters as a target has values."""
    meta = it["data"]["meta"]
    k = targets(it)
    if not (cfg.run_hierarchical or cfg.run_spectral):
        return None
    n, slug, out = meta.count(), it["name"].lower().replace(" ", "_"), None
    for kind, d in dist.items():
        for target, of in k.items():
            if not 1 <= of <= n:
                continue
            found = topology.clusters(d, of, cfg.linkages, cfg.run_spectral).filter(F.lit(cfg.run_hierarchical) | (F.col("method") == "spectral"))
            linkage = F.regexp_replace("method", "^hierarchical_", "")
            name = F.when(F.col("method") == "spectral", f"spectral_cluster_{kind}_{slug}_{target}").otherwise(F.concat(F.lit(f"hierarchical_cluster_{kind}_ph_{slug}_{target}_"), linkage))
            found = found.select(F.lit(it["name"]).alias("iteration"), name.alias("method"), "sample", F.col("label").cast("string").alias("cluster"))
            out = found if out is None else out.unionByName(found)
    return out


def compared(spark: SparkSession, it: dict, labels: DataFrame | None, own: DataFrame | None, cfg: Config) -> DataFrame | None:
    """The cluster comparison table of an iteration: samples' labels on their cells, and cells' own, against metadata and random groups."""
    cells = relations.prefixed(it["data"]["cells"])
    on_cells = labels.join(cells, "sample").select("iteration", "method", "cell", "cluster") if labels is not None else None
    if own is not None:
        own = own.filter(F.col("iteration") == it["name"])
        on_cells = own if on_cells is None else on_cells.unionByName(own)
    if on_cells is None:
        return None
    meta = it["data"]["meta"].select("sample", F.col("sra").alias("SRA"), F.col("tissue").alias("Tissue"), F.col("approach").alias("Approach"))
    references = cells.join(meta, "sample").unpivot(["cell"], ["SRA", "Tissue", "Approach"], "ref", "label")
    groups = metrics.random_groups(_FRAME, cfg.random_groups).over(spark, labels=cells.select("cell"))
    return clusterings.comparison(on_cells, references, groups)


def curve_tables(spark: SparkSession, pd: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """Curves of samples (comparison, grp, sample, gi, tau, v) and of groups (comparison, grp, gi, m, lower, upper) of diagrams whose samples
    are named group_sample."""
    betti = cut(curves.betti(_FRAME, cfg.grid).over(spark, pd=pd))
    euler = cut(curves.euler(_FRAME).over(spark, curves=betti))
    land = cut(curves.resampled(_FRAME, curves.LANDSCAPE_GRID, cfg.grid).over(spark, curve=curves.landscape_curve(_FRAME).over(spark, land=curves.landscape(_FRAME).over(spark, pd=pd))))
    drawn = cut(curves.draws(_FRAME, cfg.resamples).over(spark, of=pd))
    bands = cut(curves.bands(_FRAME, _FRAME).over(spark, curves=betti, drawn=drawn))
    wide = curves.bands(_FRAME, _FRAME, "v", "gi", True).over(spark, curves=land, drawn=drawn)
    ind = comparisons.individuals(_FRAME, _FRAME, _FRAME, cfg.grid).over(spark, betti=betti, euler=euler, landscape=land)
    around = curves.bands(_FRAME, _FRAME, "raw", "gi").over(spark, curves=euler, drawn=drawn)
    means = comparisons.group_curves(_FRAME, _FRAME, _FRAME).over(spark, betti=bands, euler=cut(around), landscape=cut(wide))
    return cut(ind), cut(means)


def curve_statistics(curve: tuple[DataFrame, DataFrame], cfg: Config) -> DataFrame:
    """pair_stats() of curve_tables()."""
    return cut(comparisons.pair_stats(curve[0], curve[1].select("comparison", "grp", "gi", "m"), cfg.permutations))


def _token(group):
    """A group's name without the character that ends it in names like group_sample; _shown() has it back."""
    return F.regexp_replace(group, "_", "\x1f")


def _shown(c: str) -> F.Column:
    return F.regexp_replace(F.regexp_replace(c, "(^|_vs_)\\d{3}\x1e", "$1"), "\x1f", "_").alias(c)


def _grouped(pd: DataFrame, group) -> DataFrame:
    """Samples named group_sample."""
    return pd.filter(F.length(F.trim(group)) > 0).withColumn("sample", F.concat_ws("_", _token(group), "sample"))


def cross_iteration(spark: SparkSession, iterations: list[dict], cfg: Config) -> DataFrame:
    """The flat table of statistics between iterations, for each value of a metadata column; pairs stand in the order of iterations."""
    named = {f"{i:03d}\x1e" + it["name"].replace("_", "\x1f").replace(" ", "\x1f"): it for i, it in enumerate(iterations)}
    one = relations.aligned({name: (it["data"]["pd"], it["data"]["meta"]) for name, it in named.items()})
    one = cut(one)
    values = [r[0] for r in comparisons.valid_groups(one, cfg.group_by).select(cfg.group_by).distinct().orderBy(cfg.group_by).collect()]
    out = None
    for v in values:
        found = comparisons.flat(curve_statistics(curve_tables(spark, one.filter(F.col(cfg.group_by) == v), cfg), cfg), v)
        found = found.withColumn("Pair", _shown("Pair"))
        out = found if out is None else out.unionByName(found)
    return out


def postprocess(spark: SparkSession, iterations: list[dict], cfg: Config) -> dict[str, DataFrame]:
    """Tables by name, each written under results: labels and comparisons of clusterings, statistics of groups and iterations."""
    out: dict[str, DataFrame] = {}

    def add(name: str, df: DataFrame | None) -> None:
        if df is not None:
            out[name] = df if name not in out else out[name].unionByName(df)

    own = cell_clusters(iterations, cfg) if cfg.run_cluster else None
    add("cell_labels", own)
    for it in iterations:
        dist = distances(spark, it, cfg)
        for kind, d in dist.items():
            add("distances", d.select(F.lit(it["name"]).alias("iteration"), F.lit(kind).alias("kind"), "i", "j", "d"))
        if cfg.run_cluster:
            labels = clustered(it, dist, cfg)
            labels = cut(labels) if labels is not None else None
            add("labels", labels)
            table = compared(spark, it, labels, own, cfg)
            add("cluster_comparison", cut(table) if table is not None else None)
        if cfg.run_betti:
            for column in ("tissue", "sra", "approach"):
                pd = _grouped(it["data"]["pd"].join(F.broadcast(it["data"]["meta"]), "sample"), F.col(column)).select("sample", "dim", "feature_id", "birth", "death")
                curve = curve_tables(spark, pd, cfg)
                tagged = lambda df: df.select(F.lit(it["name"]).alias("iteration"), F.lit(column).alias("target"), "*")  # noqa: B023, E731
                add("group_statistics", comparisons.flat(curve_statistics(curve, cfg), column).withColumn("Pair", _shown("Pair")).withColumn("iteration", F.lit(it["name"])))
                add("curves", tagged(curve[0]).withColumn("grp", _shown("grp")).withColumn("sample", _shown("sample")))
                add("bands", tagged(curve[1]).withColumn("grp", _shown("grp")))
    if cfg.run_cross_iteration:
        add("cross_iteration_statistics", cross_iteration(spark, iterations, cfg))
    for name, df in out.items():
        tables.save(df, f"{cfg.results}/{name}")
        out[name] = spark.read.parquet(f"{cfg.results}/{name}")
    return out


def run(spark: SparkSession, cfg: Config) -> tuple[list[dict], dict[str, DataFrame]]:
    """The whole run: variants with diagrams, and the tables of whatever is switched on."""
    iterations = process(spark, cfg)
    names = tables.prioritized([it["name"] for it in iterations])
    iterations = sorted(iterations, key=lambda it: names.index(it["name"]))
    wanted = cfg.run_cluster or cfg.run_betti or cfg.run_cross_iteration
    return iterations, postprocess(spark, iterations, cfg) if wanted else {}

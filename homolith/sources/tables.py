"""Manifests, matrices, configuration and progress logs."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings of the manifest's columns (fixed values); the first that is there counts.
SPELLINGS = {"file_path": ("File Path", "File.Path"), "sample": ("Sample Name", "Sample.Name"), "sra": ("SRA", "SRA_Number", "SRA Number"), "tissue": ("Tissue", "tissue"), "approach": ("Approach", "approach")}


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each sample; paths are coalesced over their spellings. No metadata column, or no path at all, is an error."""
    raw = spark.read.csv(path, header=True)
    have = {k: [F.col(f"`{c}`") for c in names if c in raw.columns] for k, names in SPELLINGS.items()}
    if not any(have[k] for k in ("sra", "tissue", "approach")):
        raise ValueError("the manifest has none of SRA, Tissue and Approach")
    out = raw.select(*[(F.coalesce(*c) if k == "file_path" else c[0]).alias(k) if c else F.lit(None).cast("string").alias(k) for k, c in have.items()])
    if out.filter("file_path IS NOT NULL").isEmpty():
        raise ValueError("the manifest has no file paths")
    return out


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def matrices(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """Long matrices (cell, gene, value) with the sample from the file's name; None for no paths."""
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"files do not exist: {', '.join(missing)}")
    if not paths:
        return None
    # The first part of the path that ends as a table does; files below it have names of their own.
    return spark.read.parquet(*paths).withColumn("sample", F.regexp_extract(F.input_file_name(), "([^/]+?)(\\.sparse)?\\.parquet(/|$)", 1))


# Label, prefix and assay of the processing variants, in order; which of them are not integrated.
ITERATIONS = (("Raw", "raw", "RNA"), ("SCT_Individual", "sct_individual", "SCT_Ind"), ("SCT_Whole", "sct_whole", "SCT"), ("Seurat Integration", "seurat_integration", "integrated"), ("Harmony Integration", "harmony_integration", "harmony"))
UNINTEGRATED = ("raw", "sct_individual", "sct_whole")
PREFERRED = "Seurat Integration"


def matrix_market(spark: SparkSession, path: str, sample: str, genes: list[str], cells: list[str]) -> DataFrame:
    """Long matrix (cell, gene, value, sample) of a coordinate file whose rows are genes; indices are matched to the names given."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("%")).select(F.split(F.trim("value"), "\\s+").alias("x"))
    shape = (len(genes), len(cells))
    # The first line that is no comment has the shape and as many fields as others, but stands for no entry.
    names = lambda values, c: spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], f"{c}_i long, {c} string")
    size = lines.first()
    if size is None or tuple(map(int, size["x"][:2])) != shape:
        raise ValueError(f"the matrix isn't {shape[0]} by {shape[1]}")
    rows = spark.read.text(path).filter(~F.col("value").startswith("%")).withColumn("n", F.monotonically_increasing_id()).filter("n > 0")
    rows = rows.select(F.split(F.trim("value"), "\\s+").alias("x")).select(F.col("x")[0].cast("long").alias("gene_i"), F.col("x")[1].cast("long").alias("cell_i"), F.col("x")[2].cast("double").alias("value"))
    out = rows.join(F.broadcast(names(genes, "gene")), "gene_i").join(F.broadcast(names(cells, "cell")), "cell_i")
    return out.filter("value <> 0").select("cell", "gene", "value", F.lit(sample).alias("sample"))


def default_config() -> list[tuple[str, str, str]]:
    return list(ITERATIONS)


def iteration_config(spark: SparkSession, path: str) -> DataFrame:
    """label, prefix, assay of the processing variants, in order."""
    raw = spark.read.csv(path, header=True)
    lacking = {"label", "prefix", "assay"} - set(raw.columns)
    if lacking:
        raise ValueError(f"the configuration lacks {sorted(lacking)}")
    return raw.select(*[F.col(c).cast("string") for c in ("label", "prefix", "assay")])


def normal_label(name: str, config=ITERATIONS) -> str:
    """The label of a label or prefix; unknown names stay."""
    return next((label for label, prefix, _ in config if name and name in (label, prefix)), name)


def labels(config=ITERATIONS) -> list[str]:
    return list(dict.fromkeys(label for label, _, _ in config))


def iteration_paths(prefix: str, unintegrated: bool = False) -> dict[str, str]:
    """Names of a variant's tables."""
    name = f"unintegrated_{prefix}" if unintegrated else prefix
    return {"bdm_matrix": f"BDM_{name}.rds", "sdm_matrix": f"SDM_{name}.rds", "pd_list": f"PD_list_{name}.rds"}


def prioritized(names: list[str], preferred: str = PREFERRED, config=ITERATIONS) -> list[str]:
    """The preferred variant first, or the first default one; the others keep their order."""
    wanted = normal_label(preferred, config)
    first = [n for n in names if n == wanted and wanted in labels(config)] or [n for n in names if n == PREFERRED][:1]
    return first + [n for n in names if n not in first]


def assembled(available: dict, config=ITERATIONS) -> list[dict]:
    """Variants (by prefix) that have data, in the order of the configuration, with the names of their tables."""
    out = []
    for label, prefix, assay in config:
        if available.get(prefix) is not None:
            out.append({"name": label, "label": label, "prefix": prefix, "assay": assay, "data": available[prefix], **iteration_paths(prefix, prefix in UNINTEGRATED)})
    return out


# What an override may name, and the spellings of each, the first that is there counting.
OVERRIDES = {
    "data": ("seurat_object_path", "seurat_object", "seurat_path"),
    "pd_list": ("ph_list_path", "ph_list", "pd_list_path"),
    "bdm_matrix": ("bdm_matrix_path", "bdm_path"),
    "sdm_matrix": ("sdm_matrix_path", "sdm_path"),
    "landscape_list": ("landscape_list_path", "landscape_path"),
    "landscape_matrix": ("landscape_l2_distance_matrix_path", "landscape_matrix_path", "landscape_distance_matrix_path"),
}


def imported_overrides(given) -> dict | None:
    """None, a dictionary, or the path of a JSON file with one; nothing is executed. A dictionary that names no path is none."""
    if given is None:
        return None
    if isinstance(given, str):
        with open(given, encoding="utf-8") as f:
            given = json.load(f)
    if not isinstance(given, dict):
        raise TypeError("overrides are a dictionary by label or prefix, or the path of a JSON file")
    return given if any(v for one in given.values() if isinstance(one, dict) for v in one.values()) else None


def overrides(iterations: list[dict], given: dict | None, spark: SparkSession, config=ITERATIONS) -> list[dict]:
    """Variants with given paths in place of their own tables, and `flags` that tell which. Labels and prefixes both name a
    variant; a path that doesn't exist is an error, and so is an entry that is no dictionary."""
    if not given:
        return iterations
    if any(not k for k in given):
        raise ValueError("overrides are named by label or prefix")
    by, out = {}, []
    for name, one in given.items():
        by.setdefault(normal_label(name, config), one)
    for it in iterations:
        one = by.get(normal_label(it["name"], config))
        if one is None:
            out.append(it)
            continue
        if not isinstance(one, dict):
            raise TypeError(f"the override of {it['name']} is no dictionary")
        found = {kind: next((one[s] for s in spellings if one.get(s) is not None), None) for kind, spellings in OVERRIDES.items()}
        for kind, path in found.items():
            if path is not None and not exists(spark, path):
                raise FileNotFoundError(f"{kind} of {it['name']} does not exist: {path}")
        out.append({**it, **{k: p for k, p in found.items() if p is not None}, "flags": {k: p is not None for k, p in found.items()}})
    return out


def valid_distances(dist: DataFrame, n: int | None = None) -> bool:
    """Whether a distance table (i, j, d; i < j) has every pair of its samples once, all finite and not below 0."""
    bad = F.count_if(F.col("d").isNull() | F.isnan("d") | (F.abs("d") == float("inf")) | (F.col("d") < 0) | (F.col("i") >= F.col("j")))
    row = dist.agg(F.count("*").alias("rows"), F.count_distinct("i", "j").alias("pairs"), bad.alias("bad")).first()
    names = dist.select("i").union(dist.select("j")).distinct().count()
    return row["bad"] == 0 and row["rows"] == row["pairs"] == names * (names - 1) // 2 and (n is None or names == n)


def valid_landscapes(land: DataFrame, grid: int = 100, samples: int | None = None) -> bool:
    """Whether every sample has both dimensions with `grid` points each."""
    per = land.groupBy("sample", "dim").agg(F.count_distinct("gi").alias("n")).groupBy("sample").agg(F.count_if(F.col("dim").isin(0, 1) & (F.col("n") == grid)).alias("ok"), F.count("*").alias("dims"))
    row = per.agg(F.count("*").alias("samples"), F.count_if((F.col("ok") != 2) | (F.col("dims") != 2)).alias("bad")).first()
    return row["bad"] == 0 and row["samples"] > 0 and (samples is None or row["samples"] == samples)


def cache_name(folder: str, *parts) -> str:
    """Where a curve is kept: by a hash of what it is made of."""
    return f"{folder}/curve_cache_{hashlib.sha256('|'.join(map(str, parts)).encode()).hexdigest()}"


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at a path; made and written first if it isn't there. A write that broke off leaves no table."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def toy_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """20 samples: 2 studies, 5 tissues, 2 approaches."""
    rows = [(f"{folder}/s{i}.sparse.parquet", f"s{i}", f"SRA{i % 2 + 1}", f"Tissue{i // 2 % 5 + 1}", ("scRNA", "snRNA")[i // 10]) for i in range(20)]
    return spark.createDataFrame(rows, "`File Path` string, `Sample Name` string, SRA string, Tissue string, Approach string")


def toy_counts(spark: SparkSession, samples: int = 20, genes: int = 100, cells: int = 300, density: float = 0.05, seed: int = 123) -> DataFrame:
    """Sparse counts drawn by hash."""
    rows = spark.range(samples * genes * cells)
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "id")), 1, 8), 16, 10).cast("long")
    return rows.withColumn("u", draw).filter(F.col("u") % 10000 < int(density * 10000)).select(F.concat(F.lit("s"), F.floor(F.col("id") / (genes * cells))).alias("sample"), F.concat(F.lit("c"), F.floor(F.col("id") / genes) % cells).alias("cell"), F.concat(F.lit("g"), F.col("id") % genes).alias("gene"), (F.col("u") % 7 + 1).cast("double").alias("value"))


def save(df: DataFrame, path: str, by: str | None = None) -> None:
    """Written as Parquet, over what was there, by iteration if told."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def log_progress(df: DataFrame, path: str) -> None:
    """Appends job_id, status, threshold with the time."""
    df.select("job_id", "status", "threshold", F.current_timestamp().alias("ts")).write.mode("append").parquet(path)


def unfinished(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """Jobs that the log doesn't have as completed."""
    return jobs.join(log.filter("status = 'completed'"), "job_id", "left_anti")


def save_diagrams(diagrams: DataFrame, thresholds: DataFrame | None, folder: str) -> None:
    """Diagrams by iteration, and the thresholds that they were made with."""
    save(diagrams, f"{folder}/pd", "iteration")
    if thresholds is not None:
        save(thresholds, f"{folder}/thresholds")

import json

import pytest
from pyspark.sql import functions as F

from homolith import pipeline
from homolith.operators import relations
from homolith.sources import tables


def toy(spark, folder, samples=6):
    counts = tables.toy_counts(spark, samples, 24, 16, 0.5)
    counts = counts.withColumn("gene", F.concat(F.when(F.col("gene").isin("g1", "g2", "g3"), "RPS").otherwise(""), F.col("gene"))).cache()
    rows = []
    for i in range(samples):
        path = f"{folder}/s{i}.sparse.parquet"
        counts.filter(F.col("sample") == f"s{i}").drop("sample").write.parquet(path)
        rows.append((path, f"s{i}", f"SRA{i % 2}", ("liver", "bone marrow")[i // 3 % 2], ("sc", "sn")[i % 2]))
    spark.createDataFrame(rows, "`File Path` string, `Sample Name` string, SRA string, Tissue string, Approach string").coalesce(1).write.csv(f"{folder}/manifest", header=True)
    return pipeline.Config(f"{folder}/manifest", f"{folder}/results", min_cells=5, min_features=2, max_mito=100, min_ribo=-1, min_gene_cells=1, permutations=9, resamples=4, grid=40, linkages=("average", "median"), random_groups=3, features=20, dims=4, min_integration_cells=5, sct_min_cells=2, k_filter=10, k_score=5, k_weight=5, harmony_clusters=3, harmony_rounds=1, kmeans_starts=1)


def test_whole_run(spark, tmp_path):
    cfg = toy(spark, str(tmp_path))
    cfg.run_cluster = cfg.run_betti = cfg.run_cross_iteration = True
    cfg.run_standard = False
    iterations, out = pipeline.run(spark, cfg)
    assert [it["name"] for it in iterations] == ["Seurat Integration", "Raw", "SCT_Individual", "SCT_Whole"]
    assert iterations[1]["bdm_matrix"] == "BDM_unintegrated_raw.rds"
    n = 6 * 5 // 2
    assert {(r["iteration"], r["kind"]): r["count"] for r in out["distances"].groupBy("iteration", "kind").count().collect()} == {(it["name"], k): n for it in iterations for k in ("bdm", "sdm", "landscape")}
    assert {r[0] for r in out["cluster_comparison"].select("metric").distinct().collect()} == {"ARI", "NMI", "Jaccard", "VI", "Purity"}
    assert out["labels"].filter("method = 'hierarchical_cluster_bdm_ph_raw_tissue_median'").count() == 6
    assert {r[0] for r in out["cell_labels"].select("method").distinct().collect()} >= {"kmeans_cluster_raw_tissue", "kmeans_cluster_seurat_integration_sra"}
    assert out["cell_labels"].filter("iteration = 'Raw'").groupBy("method").agg(F.count_distinct("cell").alias("n")).select("n").distinct().collect()[0][0] == 6 * 16
    assert {r[0] for r in out["cluster_comparison"].select("method").distinct().collect()} >= {"kmeans_cluster_raw_tissue"}
    assert {(r["iteration"], r["target"], r["comparison"]) for r in out["bands"].select("iteration", "target", "comparison").distinct().collect()} >= {("Raw", "tissue", "euler"), ("SCT_Whole", "sra", "landscape")}
    assert out["curves"].filter("iteration = 'Raw' AND target = 'tissue' AND comparison = 'euler'").count() == 6 * 40
    flat = out["cross_iteration_statistics"]
    assert flat.columns == ["Group", "Pair", "Comparison", "wasserstein", "perm_p", "effect_size", "ks_stat", "ks_adj_p"]
    assert {r[0] for r in flat.select("Pair").distinct().collect()} >= {"Raw_vs_SCT_Individual", "SCT_Individual_vs_SCT_Whole", "Seurat_Integration_vs_Raw", "Raw_vs_Raw"}
    assert {r[0] for r in out["group_statistics"].filter("`Group` = 'tissue'").select("Pair").distinct().collect()} == {"bone_marrow_vs_bone_marrow", "bone_marrow_vs_liver", "liver_vs_liver"}
    assert flat.count() == 2 * 10 * 4 and {r[0] for r in flat.select("Group").distinct().collect()} == {"liver", "bone marrow"}
    own = flat.filter("split(Pair, '_vs_')[0] = split(Pair, '_vs_')[1]").collect()
    assert len(own) == 2 * 4 * 4 and all((r["wasserstein"], r["perm_p"], r["effect_size"], r["ks_stat"], r["ks_adj_p"]) == (0, 1, 0, 0, 1) for r in own)
    # A second run reads the valid distances again; a given table takes the place of its own.
    given = f"{tmp_path}/given"
    spark.createDataFrame([(f"s{i}", f"s{j}", 7.0) for i in range(6) for j in range(i + 1, 6)], "i string, j string, d double").write.parquet(given)
    its = tables.overrides(iterations, {"raw": {"bdm_path": given}}, spark)
    dist = pipeline.distances(spark, next(it for it in its if it["prefix"] == "raw"), cfg)
    assert dist["bdm"].agg(F.min("d"), F.max("d")).first() == (7.0, 7.0) and dist["landscape"].count() == n


def test_nothing_but_diagrams(spark, tmp_path):
    cfg = toy(spark, str(tmp_path), 3)
    cfg.integration_methods = ("Harmony",)
    iterations, out = pipeline.run(spark, cfg)
    assert not out and [it["prefix"] for it in iterations] == ["raw", "sct_individual", "sct_whole", "harmony_integration"]
    # A second run takes the finished samples' diagrams; one that broke off makes what isn't logged, and replaces what was half written.
    raw = next(it for it in iterations if it["prefix"] == "raw")
    path = f"{cfg.results}/pd/raw-{raw['data']['key']}"
    want = sorted(map(tuple, raw["data"]["pd"].collect()))
    log = spark.read.parquet(f"{path}-log")
    assert log.count() == 3 and want
    log = log.filter("job_id <> 's1'").collect()
    spark.createDataFrame(log, "job_id string, status string, threshold double, ts timestamp").write.mode("overwrite").parquet(f"{path}-log")
    spark.createDataFrame([(0, 0, 0.0, 99.0, "s1")], "dim int, feature_id int, birth double, death double, sample string").write.mode("append").partitionBy("sample").parquet(path)
    seen = []
    real, pipeline.topology.diagrams = pipeline.topology.diagrams, lambda p, *a, **k: (seen.extend(r[0] for r in p.select("sample").distinct().collect()), real(p, *a, **k))[1]
    try:
        again = pipeline.resumed_diagrams(spark, raw["data"]["variant"].points(), path, cfg)
    finally:
        pipeline.topology.diagrams = real
    assert seen == ["s1"] and sorted(map(tuple, again.collect())) == want
    cfg.run_kmeans = False
    cells = pipeline.cell_clusters([raw], cfg)
    assert cells.count() == 3 * 16 and cells.select("method").distinct().collect()[0][0] == "seurat_cluster_raw"
    other = pipeline.stage_key(pipeline.Config("", "", threshold=2.0), [])
    assert other != pipeline.stage_key(pipeline.Config("", ""), []) == pipeline.stage_key(pipeline.Config("", "", permutations=3), [])
    for methods in ((), ("other",)):
        with pytest.raises(ValueError, match="integration methods"):
            pipeline.checked(pipeline.Config("", "", integration_methods=methods))


def test_labels_and_paths():
    assert [tables.normal_label(n) for n in ("seurat_integration", "Seurat Integration", "raw", "other", "")] == ["Seurat Integration", "Seurat Integration", "Raw", "other", ""]
    assert tables.iteration_paths("raw", True) == {"bdm_matrix": "BDM_unintegrated_raw.rds", "sdm_matrix": "SDM_unintegrated_raw.rds", "pd_list": "PD_list_unintegrated_raw.rds"}
    got = tables.assembled({"raw": 1, "sct_individual": 1, "sct_whole": 1, "seurat_integration": 1, "harmony_integration": None})
    assert [g["prefix"] for g in got] == ["raw", "sct_individual", "sct_whole", "seurat_integration"] and all(g["prefix"] in g["bdm_matrix"] for g in got)
    assert tables.prioritized(["Raw", "SCT_Whole", "Harmony Integration"], "harmony_integration") == ["Harmony Integration", "Raw", "SCT_Whole"]
    assert tables.prioritized(["Raw", "Seurat Integration"], "none") == ["Seurat Integration", "Raw"] and tables.prioritized([]) == []


def test_overrides(spark, tmp_path):
    assert tables.imported_overrides(None) is None and tables.imported_overrides({"raw": {"bdm_path": None}}) is None
    path = f"{tmp_path}/o.json"
    with open(path, "w") as f:
        json.dump({"Raw": {"sdm_path": "x"}}, f)
    assert tables.imported_overrides(path) == {"Raw": {"sdm_path": "x"}}
    with pytest.raises(TypeError):
        tables.imported_overrides(3)
    its = tables.assembled({"raw": 1})
    with pytest.raises(FileNotFoundError, match="does not exist"):
        tables.overrides(its, {"raw": {"sdm_path": f"{tmp_path}/none"}}, spark)
    with pytest.raises(TypeError):
        tables.overrides(its, {"raw": "x"}, spark)
    assert tables.overrides(its, {"other": {"sdm_path": "x"}}, spark) == its


def test_relations(spark, tmp_path):
    cells = spark.createDataFrame([("a", "c1"), ("a", "c2"), ("b", "c1"), ("z", "c9")], "sample string, cell string")
    meta = spark.createDataFrame([("a", "t1"), ("b", "t2"), ("b", "t1")], "sample string, tissue string")
    assert sorted(map(tuple, relations.annotated(cells, meta).collect()), key=str) == [("a", "c1", "t1"), ("a", "c2", "t1"), ("b", "c1", "t1"), ("z", "c9", None)]
    right = spark.createDataFrame([("a", None, 1), ("b", "new", 2)], "sample string, tissue string, n int")
    got = relations.preferring(spark.createDataFrame([("a", "old"), ("b", "old")], "sample string, tissue string"), right, ["sample"])
    assert sorted(map(tuple, got.collect())) == [("a", "old", 1), ("b", "new", 2)]
    pd = spark.createDataFrame([("a", 0, 1.0), ("q", 0, 1.0)], "sample string, dim int, death double")
    both = relations.aligned({"x": (pd, meta), "y": (pd, meta.withColumn("more", F.lit(1)))})
    assert sorted(r["sample"] for r in both.collect()) == ["x_a", "y_a"] and "more" not in both.columns
    assert [r["sample"] for r in relations.in_order(meta, "sample", ["b", "a"]).collect()] == ["b", "b", "a"]
    assert [tuple(r) for r in relations.spans(cells.withColumn("x", F.length("cell")), "sample", "x").filter("sample = 'a'").collect()] == [("a", 2, 2, 2.0)]
    assert {r["cell"] for r in relations.merged([cells.filter("sample = 'a'"), cells.filter("sample = 'b'")]).collect()} == {"a_c1", "a_c2", "b_c1"}
    assert {tuple(r) for r in relations.one_per_sample(cells.withColumn("v", F.concat("sample", "cell")), ["v"]).collect()} >= {("a", "ac1"), ("b", "bc1")}
    mtx = f"{tmp_path}/m.mtx"
    with open(mtx, "w") as f:
        f.write("%%MatrixMarket matrix coordinate real general\n%\n2 3 2\n1 1 5\n2 3 1.5\n")
    assert sorted(map(tuple, tables.matrix_market(spark, mtx, "s", ["g1", "g2"], ["c1", "c2", "c3"]).collect())) == [("c1", "g1", 5.0, "s"), ("c3", "g2", 1.5, "s")]
    with pytest.raises(ValueError):
        tables.matrix_market(spark, mtx, "s", ["g1"], ["c1"])


def test_validation_and_cache(spark, tmp_path):
    d = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 0.0)], "i string, j string, d double")
    assert tables.valid_distances(d) and tables.valid_distances(d, 3) and not tables.valid_distances(d, 4) and not tables.valid_distances(d.filter("d < 2"))
    assert not tables.valid_distances(d.withColumn("d", F.when(F.col("d") == 1, float("nan")).otherwise(F.col("d"))))
    land = spark.range(20).select(F.lit("s").alias("sample"), (F.col("id") % 2).alias("dim"), F.floor(F.col("id") / 2).alias("gi"))
    assert tables.valid_landscapes(land, 10, 1) and not tables.valid_landscapes(land, 11) and not tables.valid_landscapes(land.filter("dim = 0"), 10)
    path, made = tables.cache_name(str(tmp_path), "pd", 0, 1.0), []
    make = lambda: (made.append(1), d)[1]
    assert tables.cached(spark, path, make).count() == tables.cached(spark, path, make).count() == 3 and len(made) == 1
    assert tables.cache_name("f", 1, 2) != tables.cache_name("f", 1, 3) and tables.toy_manifest(spark, "f").count() == 20
    tables.save_diagrams(d.withColumn("iteration", F.lit("x")), d, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/pd").count() == 3

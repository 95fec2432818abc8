import duckdb
import numpy as np
import pytest

from homolith.functions import kernels
from homolith.functions.sqlop import TABLES
from homolith.operators import curves, topology
from homolith.plans import registry
from homolith.sources import tables

SF = "/root/testdata/sf0.001"


def test_kernels():
    square = kernels.distances(np.array([[0, 0], [0, 1], [1, 0], [1, 1.0]]))
    assert np.allclose(kernels.rips_h0(square), 1)
    assert np.allclose(kernels.rips_h1(square), [[1, 2**0.5]])
    assert kernels.bottleneck([(0, 1)], [(0, 0.5)]) == 0.5
    assert kernels.bottleneck([(0, 1)], []) == 0.5
    assert np.isclose(kernels.bottleneck([(0, 1), (0.2, 0.4)], [(0, 0.9)]), 0.1)
    assert np.allclose(kernels.spectral(np.array([[0, 1.0], [1, 0]]))[0, 1], 2**0.5)
    assert np.isclose(kernels.ks_exact_p(1, 3, 3), 0.1)
    for n, p in ((6, 2.164502e-3), (12, 7.396023e-7), (25, 1.582146e-14)):
        assert np.isclose(kernels.ks_exact_p(1, n, n), p, rtol=1e-6)


def full_reduction(d):
    """Every simplex up to triangles, reduced one column after the other."""
    n = len(d)
    simplices = [(0.0, (i,)) for i in range(n)] + [(d[i, j], (i, j)) for i in range(n) for j in range(i + 1, n)] + [(max(d[i, j], d[i, k], d[j, k]), (i, j, k)) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)]
    simplices.sort(key=lambda s: (s[0], len(s[1]), s[1]))
    at = {s: i for i, (_, s) in enumerate(simplices)}
    low, out = {}, {0: [], 1: []}
    for c, (v, s) in enumerate(simplices):
        col = {at[s[:k] + s[k + 1 :]] for k in range(len(s))} if len(s) > 1 else set()
        while col and max(col) in low:
            col ^= low[max(col)]
        if col:
            low[max(col)] = col
            b = simplices[max(col)][0]
            if v > b:
                out[len(s) - 2].append((b, v))
    return {k: np.array(sorted(v)).reshape(-1, 2) for k, v in out.items()}


@pytest.mark.parametrize("seed", range(4))
def test_rips_against_full_reduction(seed):
    x = np.random.default_rng(seed).normal(size=(12, 2))
    d = kernels.distances(x)
    want = full_reduction(d)
    assert np.allclose(kernels.rips_h0(d), want[0][:, 1])
    assert np.allclose(kernels.rips_h1(d), want[1])
    shuffled = np.random.default_rng(9).permutation(12)
    assert np.allclose(kernels.rips_h1(d[np.ix_(shuffled, shuffled)]), want[1])
    moved = kernels.distances(x + np.random.default_rng(5).uniform(-0.01, 0.01, x.shape))
    assert kernels.bottleneck(kernels.rips_h1(d), kernels.rips_h1(moved)) <= 2 * 0.01 * 2**0.5 + 1e-9


def test_linkage_and_cut():
    d = kernels.distances(np.array([[0.0], [0.1], [5.0], [5.2]]))
    for m in topology.LINKAGES:
        assert kernels.cut(kernels.linkage(d, m), 4, 2).tolist() == [1, 1, 2, 2]
    with pytest.raises(ValueError):
        kernels.cut(kernels.linkage(d), 4, 9)
    assert kernels.spectral_clusters(d, 2).tolist() == [1, 1, 2, 2]


def test_betti_values(spark):
    pd = spark.createDataFrame([("s", 0, 0, 0.0, 1.0), ("s", 0, 1, 0.2, 0.5)], "sample string, dim int, feature_id int, birth double, death double")
    got = [r["raw"] for r in curves.betti(curves.DIAGRAM, 10, 0.1).over(spark, pd=pd).orderBy("gi").collect()]
    assert np.allclose(got, [0.536385, 0.814110, 1.238879, 1.547741, 1.447393, 1.104976, 0.840700, 0.697458, 0.590887, 0.484008], atol=1e-6)
    land = curves.landscape(curves.DIAGRAM, 5).over(spark, pd=pd)
    assert [r["v"] for r in land.orderBy("gi").collect()] == [0, 0.25, 0.5, 0.25, 0]


@pytest.mark.parametrize("name", ["qc_cells", "qc_genes", "lognorm", "betti_curve", "landscape_distance", "pair_wasserstein", "bh_adjust", "pair_stats", "null_landscape", "scale_data", "batch_centring", "cluster_metrics", "complete_fill", "fill_down"])
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = registry.QUERIES[name](spark, SF)
    r = c.execute(registry.ORACLES[name])
    names = [x[0] for x in r.description]
    key = lambda rows: sorted(repr(x) for x in rows)
    assert key(tuple(x[n] for n in names) for x in df.collect()) == key(r.fetchall())


def test_sizes_of_the_survey():
    import inspect

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    one = lambda what, name: c.execute(f"SELECT {what} FROM ({registry.ORACLES[name]}) q").fetchone()[0]
    assert one("count(DISTINCT gi)", "betti_curve") == 500
    assert one("count(DISTINCT gi)", "landscape") == 100 and one("max(gi)", "landscape_resampled") == 499
    assert c.execute(f"SELECT count(DISTINCT rep) FROM ({registry.DRAWS.oracle()}) q").fetchone()[0] == 100
    assert inspect.signature(topology.kmeans).parameters["starts"].default == 25


def test_sources(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("File Path,Sample Name,Tissue\na.parquet,s1,t1\n")
    assert tables.manifest(spark, str(p)).collect()[0].asDict() == {"file_path": "a.parquet", "sample": "s1", "sra": None, "tissue": "t1", "approach": None}
    assert tables.matrices(spark, []) is None
    with pytest.raises(FileNotFoundError, match="do not exist"):
        tables.matrices(spark, [str(tmp_path / "none.parquet")])
    one = str(tmp_path / "s1.sparse.parquet")
    spark.createDataFrame([("c", "g", 1.0)], "cell string, gene string, value double").write.parquet(one)
    assert [tuple(r) for r in tables.matrices(spark, [one]).collect()] == [("c", "g", 1.0, "s1")]
    assert tables.toy_counts(spark, 2, 10, 10).count() > 0
    cfg = tmp_path / "c.csv"
    cfg.write_text("label,prefix,assay\nRaw,raw,RNA\n")
    assert tables.iteration_config(spark, str(cfg)).collect()[0]["prefix"] == "raw"
    cfg.write_text("label,assay\nRaw,RNA\n")
    with pytest.raises(ValueError, match="prefix"):
        tables.iteration_config(spark, str(cfg))
    log = str(tmp_path / "log")
    tables.log_progress(spark.createDataFrame([("a", "completed", 0.5), ("b", "failed", None)], "job_id string, status string, threshold double"), log)
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "job_id string")
    assert sorted(r["job_id"] for r in tables.unfinished(jobs, spark.read.parquet(log)).collect()) == ["b", "c"]


def test_points_and_clusters(spark):
    draw = np.random.default_rng(4)
    x = np.concatenate([draw.normal(0, 0.2, (30, 4)), draw.normal(3, 0.2, (30, 4))])
    rows = [("ab"[i // 30], i, [float(v) for v in r]) for i, r in enumerate(x)]
    points = spark.createDataFrame(rows, "sample string, point_id long, vec array<double>")
    d = kernels.distances(x)
    own = np.arange(60) // 30
    a = np.array([d[i, own == own[i]].sum() / 29 for i in range(60)])
    b = np.array([d[i, own != own[i]].mean() for i in range(60)])
    got = {r["sample"]: r["silhouette"] for r in topology.silhouette(points).collect()}
    assert np.isclose(got["a"], ((b - a) / np.maximum(a, b))[:30].mean()) and np.isclose(got["b"], ((b - a) / np.maximum(a, b))[30:].mean())
    one = points.unionByName(spark.createDataFrame([("c", 99, [0.0] * 4)], points.schema))
    assert {r["silhouette"] for r in topology.silhouette(one).collect()} == {None}
    labels = {r["point_id"]: r["label"] for r in topology.graph_clusters(points, 5).collect()}
    assert not {labels[i] for i in range(30)} & {labels[i] for i in range(30, 60)}
    assert len({r["label"] for r in topology.kmeans(points, 2, starts=2).collect()}) == 2
    anchors = topology.mutual_neighbours(points, 3)
    assert all(r["batch_a"] == "a" and r["pa"] < 30 <= r["pb"] for r in anchors.collect())
    moved = {r["point_id"]: np.array(r["vec"]) for r in topology.corrected(points, anchors, "a").collect()}
    assert np.allclose(moved[0], x[0]) and np.abs(np.mean([moved[i] for i in range(30, 60)], axis=0)).max() < 1
    sd = x[:30].std(axis=0, ddof=1)
    _, _, v = np.linalg.svd((x[:30] - x[:30].mean(axis=0)) / sd)
    line = ((x[:30] - x[:30].mean(axis=0)) / sd) @ v[0]
    near = np.sort(np.abs(line[:, None] - line[None]), axis=1)[:, 7]
    threshold = {r["sample"]: r["threshold"] for r in topology.knn_threshold(points, 7).collect()}
    assert np.isclose(threshold["a"], np.quantile(near, 0.9))
    same = spark.createDataFrame([("s", i, [1.0, 2.0]) for i in range(5)], points.schema)
    with pytest.raises(Exception, match="zero"):
        topology.knn_threshold(same).collect()
    dist = topology.bottleneck(topology.diagrams(points, 1), samples=one)
    assert {(r["i"], r["j"]) for r in dist.collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    cut_off = topology.diagrams(points, 1, threshold=0.3)
    assert cut_off.agg({"death": "max"}).first()[0] <= 0.3


def test_linkage_names():
    with pytest.raises(ValueError, match="unknown"):
        topology.linkages(["average", "other"])
    with pytest.raises(ValueError):
        topology.linkages([])
    with pytest.warns(UserWarning):
        assert topology.linkages(["average", "average"]) == ["average"]
    with pytest.raises(ValueError, match="square"):
        kernels.linkage(np.zeros((2, 3)))


def test_stream_adds_diagrams_once(spark, tmp_path):
    from homolith.streaming import incremental

    src, table = str(tmp_path / "in"), str(tmp_path / "pd")
    schema = "sample string, point_id long, vec array<double>"
    rows = lambda s: spark.createDataFrame([(s, i, [float(i), float(i * i % 5)]) for i in range(6)], schema)
    rows("a").write.parquet(src)
    for turn in range(3):
        incremental.add_diagrams(spark.readStream.schema(schema).parquet(src), table, str(tmp_path / "ck")).awaitTermination()
        if turn == 0:
            rows("b").write.mode("append").parquet(src)
    got = spark.read.parquet(table).groupBy("sample").count().collect()
    assert {r["sample"]: r["count"] for r in got} == {s: topology.diagrams(rows(s)).count() for s in "ab"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_statistics_of_pairs_can_be_written(spark, tmp_path):
    registry.QUERIES["wide_stats_full_outer"](spark, SF).write.parquet(f"{tmp_path}/wide")
    assert spark.read.parquet(f"{tmp_path}/wide").count() == registry.QUERIES["pair_l2_effect"](spark, SF).count()


def test_neighbours_in_bounded_memory():
    import tracemalloc

    x = np.random.default_rng(7).normal(size=(6000, 1))
    tracemalloc.start()
    found = kernels.knn_distance(x, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6
    assert np.isclose(found[17], np.sort(np.abs(x[:, 0] - x[17, 0]))[5])

"""Diagrams of point clouds, distances between diagrams, trees and clusterings of distances: grouped maps over kernels."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homolith.functions import kernels
from homolith.operators import pairs
from homolith.sources.cuts import cut, tabled


def dealt(rows: DataFrame, *by) -> DataFrame:
    """Rows dealt by columns over as many partitions as shuffles have. A number that is named stays: from the bytes of rows alone, many that
    take long would be put in one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def diagrams(points: DataFrame, max_dim: int = 1, sample: str = "sample", point: str = "point_id", vector: str = "vec", threshold: float = -1.0) -> DataFrame:
    """sample, dim, feature_id, birth, death of the Vietoris-Rips complex of each sample's points up to a threshold (below 0:
    none). The endless component, bars that outlast the threshold and bars of no length are left out. One task for each
    sample; only the three columns are moved."""
    top = threshold if threshold >= 0 else np.inf

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("point_id")
        x = np.stack(p["vec"].to_list()).astype(float)
        dead = kernels.rips_h0_points(x)
        dead = dead[dead <= top]
        out = [pd.DataFrame({"dim": 0, "birth": 0.0, "death": dead[dead > 0]})]
        if max_dim > 0:
            loops = kernels.rips_h1(kernels.distances(x), top)
            out.append(pd.DataFrame({"dim": 1, "birth": loops[:, 0], "death": loops[:, 1]}))
        out = pd.concat(out, ignore_index=True)
        out.insert(0, "sample", p["sample"].iloc[0])
        out["feature_id"] = range(len(out))
        return out[["sample", "dim", "feature_id", "birth", "death"]]

    narrow = points.select(F.col(sample).alias("sample"), F.col(point).alias("point_id"), F.col(vector).alias("vec")).filter("vec IS NOT NULL")
    return dealt(narrow, "sample").groupBy("sample").applyInPandas(run, "sample string, dim int, feature_id int, birth double, death double")


class Persistence:
    """The table function persistence(TABLE(points) PARTITION BY (sample), dim): diagrams() of (sample, point_id, vec) in SQL, up to dimension 1
    or the one given after the table. Rows without a vector take no part."""

    def __init__(self):
        self.points, self.sample, self.dim = [], None, 1

    def eval(self, row, dim: int = 1):
        self.sample, self.dim = row["sample"], dim
        if row["vec"] is not None:
            self.points.append((row["point_id"], np.array(row["vec"], float)))

    def terminate(self):
        if not self.points:
            return
        points = np.array([v for _, v in sorted(self.points, key=lambda p: p[0])])
        bars = [(0, 0.0, float(x)) for x in kernels.rips_h0_points(points) if x > 0] + [(1, float(b), float(x)) for b, x in (kernels.rips_h1(kernels.distances(points)) if self.dim > 0 else [])]
        for i, (dim, birth, death) in enumerate(bars):
            yield self.sample, dim, i, birth, death


def register(spark) -> None:
    """Makes persistence() known to a session's SQL."""
    spark.udtf.register("persistence", F.udtf(Persistence, returnType="sample string, dim int, feature_id int, birth double, death double"))


def bottleneck(diagrams_: DataFrame, dim: int = 1, samples: DataFrame | None = None) -> DataFrame:
    """i, j, d for all samples i < j (of `samples`, if given); a sample without bars of the dimension has the empty diagram.

    Diagrams move once for each pair, as arrays; pairs are dealt evenly."""
    own = F.col("dim") == dim
    bars = F.array_sort(F.filter(F.collect_list(F.when(own, F.struct("birth", "death"))), lambda x: x.isNotNull()))
    each = diagrams_.groupBy("sample").agg(bars.alias("bars")).select("sample", F.col("bars.birth").alias("birth"), F.col("bars.death").alias("death"))
    if samples is not None:
        none = F.array().cast("array<double>")
        each = samples.select("sample").distinct().join(each, "sample", "left").select("sample", *[F.coalesce(c, none).alias(c) for c in ("birth", "death")])
    each = each.withColumn("key", F.lit("all"))
    side = lambda n: each.select("key", F.col("sample").alias(n), F.col("birth").alias(f"b{n}"), F.col("death").alias(f"d{n}"))
    each_two = side("i").join(side("j"), "key").filter("i < j").drop("key")

    def run(frames):
        for p in frames:
            yield pd.DataFrame({"i": p["i"], "j": p["j"], "d": [kernels.bottleneck(np.column_stack([a, b]), np.column_stack([c, d])) for a, b, c, d in zip(p["bi"], p["di"], p["bj"], p["dj"], strict=True)]})

    return dealt(each_two, F.xxhash64("i", "j")).mapInPandas(run, "i string, j string, d double")


def _square(p: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    names = sorted(set(p["i"]) | set(p["j"]))
    at = {n: k for k, n in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    for i, j, v in zip(p["i"], p["j"], p["d"], strict=True):
        d[at[i], at[j]] = d[at[j], at[i]] = v
    return names, d


def _one(dist: DataFrame) -> DataFrame:
    return dist.select("i", "j", "d", *([] if "iteration" not in dist.columns else ["iteration"])).withColumn("iteration", F.col("iteration") if "iteration" in dist.columns else F.lit("all"))


def spectral_distance(dist: DataFrame, eigen: int = 50) -> DataFrame:
    """iteration, i, j, d: distances in the spectral embedding of a distance matrix (i < j, diagonal 0), for each iteration."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        names, d = _square(p)
        s = kernels.spectral(d, eigen)
        a, b = np.triu_indices(len(names), 1)
        return pd.DataFrame({"iteration": p["iteration"].iloc[0], "i": [names[k] for k in a], "j": [names[k] for k in b], "d": s[a, b]})

    return _one(dist).groupBy("iteration").applyInPandas(run, "iteration string, i string, j string, d double")


# The linkages that are known, and those that are taken if none are named.
LINKAGES = ("ward.D", "ward.D2", "single", "complete", "average", "mcquitty", "median", "centroid")
METHODS = ("ward.D2", "average", "complete", "mcquitty")


def linkages(methods) -> list[str]:
    """Each method once, with a warning if one repeats; unknown ones, or none, are errors."""
    if not methods:
        raise ValueError("no linkage is named")
    unknown = [m for m in methods if m not in LINKAGES]
    if unknown:
        raise ValueError(f"unknown linkages: {', '.join(unknown)}")
    out = list(dict.fromkeys(methods))
    if len(out) < len(methods):
        warnings.warn("linkages that repeat are taken once", stacklevel=2)
    return out


def merges(dist: DataFrame, methods=METHODS) -> DataFrame:
    """iteration, linkage, step, a, b, height, size: the tree of each linkage."""
    methods = linkages(methods)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        _, d = _square(p)
        rows = [(p["iteration"].iloc[0], m, step, *row) for m in methods for step, row in enumerate(kernels.linkage(d, m))]
        return pd.DataFrame(rows, columns=["iteration", "linkage", "step", "a", "b", "height", "size"])

    return _one(dist).groupBy("iteration").applyInPandas(run, "iteration string, linkage string, step int, a int, b int, height double, size int")


def leaf_order(dist: DataFrame, methods=METHODS) -> DataFrame:
    """iteration, linkage, place (from 0 on), sample: the order in which each linkage's tree shows the samples."""
    methods = linkages(methods)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        names, d = _square(p)
        rows = [(p["iteration"].iloc[0], m, place, names[i]) for m in methods for place, i in enumerate(kernels.leaves(kernels.linkage(d, m), len(names)))]
        return pd.DataFrame(rows, columns=["iteration", "linkage", "place", "sample"])

    return _one(dist).groupBy("iteration").applyInPandas(run, "iteration string, linkage string, place int, sample string")


def cophenetic(dist: DataFrame, methods=METHODS) -> DataFrame:
    """iteration, linkage, i, j, d: the height at which two samples i < j meet in each linkage's tree."""
    methods = linkages(methods)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        names, d = _square(p)
        a, b = np.triu_indices(len(names), 1)
        found = {m: kernels.cophenetic(kernels.linkage(d, m), len(names))[a, b] for m in methods}
        return pd.concat([pd.DataFrame({"iteration": p["iteration"].iloc[0], "linkage": m, "i": [names[k] for k in a], "j": [names[k] for k in b], "d": v}) for m, v in found.items()])

    return _one(dist).groupBy("iteration").applyInPandas(run, "iteration string, linkage string, i string, j string, d double")


def ordered_scores(dist: DataFrame, linkage: str = "ward.D2") -> DataFrame:
    """iteration, row, col, i, j, d, z: the distance matrix with rows and columns in the order of a tree, and each value against the mean and
    deviation of its row (0 in a row without)."""
    dist = cut(dist)  # it is needed many times below
    both = _one(dist).select("iteration", "i", "j", "d").unionByName(_one(dist).select("iteration", F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    names = both.select("iteration", F.col("i").alias("s")).distinct()
    whole = both.unionByName(names.select("iteration", F.col("s").alias("i"), F.col("s").alias("j"), F.lit(0.0).alias("d")))
    order = leaf_order(dist, [linkage]).select("iteration", F.col("sample").alias("s"), "place")
    per = whole.groupBy("iteration", "i").agg(F.avg("d").alias("m"), F.stddev_samp("d").alias("sd"))
    z = F.coalesce((F.col("d") - F.col("m")) / F.nullif("sd", F.lit(0.0)), F.lit(0.0))
    rows = whole.join(per, ["iteration", "i"]).join(order.select("iteration", F.col("s").alias("i"), F.col("place").alias("row")), ["iteration", "i"])
    return rows.join(order.select("iteration", F.col("s").alias("j"), F.col("place").alias("col")), ["iteration", "j"]).select("iteration", "row", "col", "i", "j", "d", z.alias("z"))


def clusters(dist: DataFrame, k: int, methods=METHODS, spectral: bool = True) -> DataFrame:
    """iteration, sample, method, label: trees cut into k, and spectral clusters. k must be from 1 to the number of samples."""
    methods = linkages(methods)
    if k < 1:
        raise ValueError("k must be from 1 to the number of items")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        names, d = _square(p)
        out = {f"hierarchical_{m}": kernels.cut(kernels.linkage(d, m), len(names), min(k, len(names))) for m in methods}
        if spectral:
            out["spectral"] = kernels.spectral_clusters(d, min(k, len(names)))
        return pd.DataFrame([(p["iteration"].iloc[0], n, m, int(v)) for m, labels in out.items() for n, v in zip(names, labels, strict=True)], columns=["iteration", "sample", "method", "label"])

    return _one(dist).groupBy("iteration").applyInPandas(run, "iteration string, sample string, method string, label int")


def knn_threshold(points: DataFrame, k: int = 100, q: float = 0.9, dim: int = 1) -> DataFrame:
    """sample, threshold: a quantile of the distances to the k-th neighbour within a sample, among the first `dim` principal
    components of centred and scaled columns; zeros are left out, and nothing but zeros is an error. One task a sample."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        name = p["sample"].iloc[0]
        v = kernels.knn_distance(kernels.components(np.stack(p["vec"].to_list()).astype(float), dim), k)
        v = v[v > 0]
        if not len(v):
            raise ValueError(f"all distances to neighbours are zero in sample {name}")
        return pd.DataFrame({"sample": [name], "threshold": [float(np.quantile(v, q))]})

    return points.select("sample", "vec").groupBy("sample").applyInPandas(run, "sample string, threshold double")


def silhouette(points: DataFrame) -> DataFrame:
    """sample, points and mean silhouette (Euclidean) over all; null with fewer than two samples or if a sample has one point.

    Blocks of points meet in numpy and give sums of distances, one row for each point and sample."""
    n = points.groupBy(F.col("sample").alias("o")).agg(F.count("*").alias("n"))
    d = pairs.sums(points, "sample").groupBy("p", "s", "o").agg(F.sum("d").alias("d")).join(F.broadcast(n), "o")
    d = d.withColumn("d", F.col("d") / F.nullif(F.col("n") - (F.col("s") == F.col("o")).cast("int"), F.lit(0)))
    each = d.groupBy("p", "s").agg(F.max(F.when(F.col("s") == F.col("o"), F.col("d"))).alias("a"), F.min(F.when(F.col("s") != F.col("o"), F.col("d"))).alias("b"))
    out = each.groupBy("s").agg(F.count("*").alias("points"), F.avg(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 0.0))).alias("silhouette"))
    lone = out.agg(F.min("points").alias("least"), F.count("*").alias("samples"))
    whole = (F.col("least") > 1) & (F.col("samples") > 1)
    return out.join(F.broadcast(lone)).select(F.col("s").alias("sample"), "points", F.when(whole, F.col("silhouette")).alias("silhouette"))


def kmeans(points: DataFrame, k: int, starts: int = 25, seed: int = 1) -> DataFrame:
    """point_id, label: the best of some k-means runs by cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = points.select("point_id", array_to_vector(F.transform("vec", lambda v: v.cast("double"))).alias("features"))
    fits = [KMeans(k=k, seed=seed + i, maxIter=100).fit(x) for i in range(starts)]
    return min(fits, key=lambda m: m.summary.trainingCost).transform(x).select("point_id", F.col("prediction").alias("label"))


def pca(points: DataFrame, k: int = 2) -> DataFrame:
    """point_id, pc array<double>: coordinates in the first principal components."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = points.select("point_id", array_to_vector(F.transform("vec", lambda v: v.cast("double"))).alias("raw"))
    x = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(x).transform(x)
    return PCA(k=k, inputCol="features", outputCol="pc").fit(x).transform(x).select("point_id", vector_to_array("pc").alias("pc"))


def mutual_neighbours(points: DataFrame, k: int = 5, reference: str | None = None) -> DataFrame:
    """batch_a, batch_b, pa, pb, d: pairs of points of two batches a < b that are among each other's k nearest: anchors of an
    integration. Ties go to the smaller id. With a reference, pairs of batches of which one is this."""
    held = tabled(pairs.packed(points, "sample").drop("labels"))
    others = held.withColumn("group", F.col("s")).withColumn("at", F.struct("group", "block"))
    apart = F.col("own_s") != F.col("b.s")
    if reference is not None:
        apart = (F.col("own_s") == reference) != (F.col("b.s") == reference)
    near = pairs.nearest(held, others, apart, k, False)
    near = tabled(near.select("s", "o", "id", F.explode(F.arrays_zip("near", "d")).alias("n")).select("s", "o", "id", F.col("n.near").alias("other"), F.col("n.d").alias("d")))
    one = near.filter("s < o").select(F.col("s").alias("batch_a"), F.col("o").alias("batch_b"), F.col("id").alias("pa"), F.col("other").alias("pb"), "d")
    two = near.filter("s > o").select(F.col("o").alias("batch_a"), F.col("s").alias("batch_b"), F.col("other").alias("pa"), F.col("id").alias("pb"))
    return one.join(two, ["batch_a", "batch_b", "pa", "pb"], "left_semi")


def corrected(points: DataFrame, anchors: DataFrame, reference: str, weigh: int = 50) -> DataFrame:
    """sample, point_id, vec: the points of every other batch moved to the reference batch by the differences of their anchor
    pairs, weighted by a Gaussian kernel of the distance to the `weigh` nearest anchors; a batch without anchors stays as it
    is. A plain analogue of anchor integration. Blocks of points meet blocks of their batch's anchors twice: to find the nearest,
    and to add up the differences."""
    ends = anchors.filter((F.col("batch_a") == reference) | (F.col("batch_b") == reference))
    own_first = F.col("batch_a") == reference
    ends = ends.select(F.when(own_first, F.col("batch_b")).otherwise(F.col("batch_a")).alias("s"), F.when(own_first, F.col("pa")).otherwise(F.col("pb")).alias("to"), F.when(own_first, F.col("pb")).otherwise(F.col("pa")).alias("at"))
    vec = points.select(F.col("point_id").alias("k"), F.transform("vec", lambda x: x.cast("double")).alias("x"))
    moves = ends.join(vec.withColumnRenamed("k", "to").withColumnRenamed("x", "xt"), "to").join(vec.withColumnRenamed("k", "at").withColumnRenamed("x", "xa"), "at")
    chunks = ends.groupBy("s").agg(F.ceil(F.count_distinct("at") / pairs.BLOCK).alias("chunks"))
    moves = moves.join(F.broadcast(chunks), "s").withColumn("block", F.pmod(F.xxhash64("at"), "chunks").cast("int")).drop("chunks")
    of = pairs.kind(points)

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["at", "to"])
        ids, first, many = np.unique(pairs.named(p["at"]), return_index=True, return_counts=True)
        x, to = np.stack(p["xa"].to_list()), np.stack(p["xt"].to_list())
        # Of a point's anchors the first so many may be taken: their differences are added up beforehand.
        added = np.concatenate([(to - x)[f : f + n].cumsum(axis=0) for f, n in zip(first, many, strict=True)])
        return pd.DataFrame({"s": [p["s"].iloc[0]], "block": p["block"].iloc[0], "ids": [ids.tolist()], "x": [x[first].tobytes()], "many": [many.tolist()], "added": [added.tobytes()]})

    held = tabled(moves.groupBy("s", "block").applyInPandas(pack, f"s string, block int, ids array<{of}>, x binary, many array<int>, added binary"))
    meet = (F.col("own_s") == F.col("b.s")) & (F.col("own_s") != reference)
    found = tabled(pairs.meeting(pairs.packed(points, "sample").drop("labels"), held.select("s", F.col("block").alias("at"), "ids", "x", "many"), meet, lambda row: _Weighed(row, weigh), f"s string, block int, ids array<{of}>, x binary, near array<{of}>, many binary, w binary"))
    return pairs.meeting(found, held.select("s", F.col("block").alias("at"), "ids", "many", "added"), meet, _Moved, f"sample string, point_id {of}, vec array<double>")


class _Weighed:
    """The nearest `weigh` anchors of a block's points: their own ends, how many anchors of each, and its weight."""

    def __init__(self, row, weigh: int):
        self.row, self.weigh = row, weigh
        self.x = pairs.unpacked(row["ids"], row["x"], row["single"])
        self.near = pairs.Nearest(row["ids"], self.x, weigh)

    def take(self, other):
        self.near.take(other["ids"], pairs.unpacked(other["ids"], other["x"], False), np.array(list(other["many"]), np.int32))
        yield from ()

    def done(self):
        near, many, w = [], np.zeros(0, np.int32), np.zeros(0)
        if self.near.near is not None:
            d = self.near.d
            many = np.where(np.isfinite(d), self.near.more, 0)
            many = np.clip(self.weigh - (many.cumsum(axis=1) - many), 0, many).astype(np.int32)
            d = np.where(many > 0, d, 0.0)
            w = np.exp(-((2 * d / np.maximum(d.max(axis=1, keepdims=True), 1e-12)) ** 2) / 2) * (many > 0)
            w /= (w * many).sum(axis=1, keepdims=True)
            near = self.near.near.ravel().tolist()
        yield pd.DataFrame({"s": self.row["s"], "block": self.row["block"], "ids": [list(self.row["ids"])], "x": [self.x.tobytes()], "near": [near], "many": [many.tobytes()], "w": [w.tobytes()]})


class _Moved:
    """A block's points moved by the weighted differences of their anchors."""

    def __init__(self, row):
        self.row, n = row, len(row["ids"])
        self.x = pairs.unpacked(row["ids"], row["x"], False)
        self.near, self.many, self.w = pairs.named(row["near"]).reshape(n, -1), np.frombuffer(row["many"], np.int32).reshape(n, -1), np.frombuffer(row["w"]).reshape(n, -1)
        self.by = np.zeros(self.x.shape)

    def take(self, other):
        ids, many = pairs.named(other["ids"]), np.array(list(other["many"]))
        first, added = many.cumsum() - many, np.frombuffer(other["added"]).reshape(many.sum(), -1)
        for a in range(0, len(self.x), pairs.TILE):
            at = slice(a, a + pairs.TILE)
            place = np.minimum(np.searchsorted(ids, self.near[at]), len(ids) - 1)
            i, j = np.nonzero((ids[place] == self.near[at]) & (self.many[at] > 0))
            if len(i):
                part = self.w[at][i, j][:, None] * added[first[place[i, j]] + self.many[at][i, j] - 1]
                starts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                self.by[at][i[starts]] += np.add.reduceat(part, starts, axis=0)
        yield from ()

    def done(self):
        yield pd.DataFrame({"sample": self.row["s"], "point_id": self.row["ids"], "vec": list(self.x + self.by)})


def graph_clusters(points: DataFrame, k: int = 20, rounds: int = 20) -> DataFrame:
    """point_id, label: labels spread over the graph of shared nearest neighbours until they stay (at most `rounds` times): a
    point takes the label that weighs most among its neighbours, of equal weights the smaller. An analogue of community
    search on a neighbour graph."""
    near = pairs.within(points.withColumn("sample", F.lit("all")), "sample", k).select(F.col("id").alias("p"), F.explode("near").alias("q"))
    near = tabled(near)
    edges = cut(near.unionByName(near.select(F.col("q").alias("p"), F.col("p").alias("q"))).groupBy("p", "q").agg(F.count("*").alias("w")))
    labels, still = points.select("point_id", F.col("point_id").alias("label")), 0
    for turn in range(rounds):
        heard = edges.join(labels, F.col("q") == F.col("point_id")).groupBy("p", "label").agg(F.sum("w").alias("w"))
        # Half of the points change at a time, so that two don't swap their labels for ever.
        best = heard.groupBy("p").agg(F.max_by("label", F.struct("w", -F.col("label"))).alias("new"))
        moved = labels.join(best, F.col("p") == F.col("point_id"), "left").select("point_id", "label", F.when(F.pmod(F.xxhash64("point_id"), F.lit(2)) == turn % 2, F.coalesce("new", "label")).otherwise(F.col("label")).alias("new"))
        moved = cut(moved)
        labels = moved.select("point_id", F.col("new").alias("label"))
        still = still + 1 if moved.filter("label <> new").isEmpty() else 0
        if still == 2:
            break
    return labels

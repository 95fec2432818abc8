"""Approximate nearest neighbours by largest inner product: inverted lists and an adaptive dimension scan."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, small_batches, table, written

#: Vectors that the index is fitted on at most, those of the smallest hashes; rounds of k-means; seed of the rotation.
SAMPLE, ROUNDS, SEED = 32_768, 8, 4
#: Lists are the root of the number of vectors, but one for SHARE sample vectors at most.
SHARE = 16
#: As many lists are probed as find this share of the neighbours of PILOT sample vectors in the sample.
TARGET, PILOT = 0.97, 512
#: Columns of a block; slack of the hypothesis test (larger: fewer wrong rejections).
COLUMNS, SLACK = 16, 1.2
#: Vectors of a list that one task scans, and queries that it takes; vectors that are scanned before the bounds are tightened.
TILE, QUERIES, STRETCH = 4096, 512, 512
#: Share of pairs above which a block of columns is taken for all pairs at once.
DENSE = 0.6
#: A query is each row whose id this divides.
EVERY, NEAREST = 20, 20


class Index:
    """Centroids over a bounded sample, the rotation, and the number of lists to probe.

    Vectors get a further component that brings them all to the length of the longest, so that the largest inner product
    is the smallest distance; scores are always taken from the original vectors.
    """

    def __init__(self, sample: np.ndarray, longest: float, lists: int, nearest: int = NEAREST, target: float = TARGET, seed: int = SEED):
        self.dim = sample.shape[1]
        self.longest = longest
        draw = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(draw.standard_normal((self.dim + 1, self.dim + 1)))[0]
        x = self.lifted(sample)
        centres = x[draw.choice(len(x), max(1, min(lists, len(x))), replace=False)]
        for _ in range(ROUNDS):
            near = np.concatenate([self._near(x[i : i + 4096], centres).argmax(axis=1) for i in range(0, len(x), 4096)])
            sums, sizes = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
            np.add.at(sums, near, x)
            centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        self.centres = centres
        self.probes = self._probes(sample, x, draw, nearest, target)

    @staticmethod
    def _near(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return x @ centres.T - 0.5 * (centres**2).sum(axis=1)

    def _probes(self, sample: np.ndarray, x: np.ndarray, draw, nearest: int, target: float) -> int:
        """The least number of lists that holds the target share of sample vectors' neighbours in the sample, by brute force."""
        pilot = draw.choice(len(x), min(PILOT, len(x)), replace=False)
        n = min(nearest, len(x) - 1)
        if n < 1:
            return len(self.centres)
        own = np.concatenate([self._near(x[i : i + 4096], self.centres).argmax(axis=1) for i in range(0, len(x), 4096)])
        places = []
        for p in pilot:
            s = sample @ sample[p]
            s[p] = -np.inf
            best = np.argpartition(-s, n - 1)[:n]
            order = self.lists_of(self.lifted(sample[p][None], query=True), len(self.centres))[0]
            at = np.empty(len(order), int)
            at[order] = np.arange(len(order))
            places.append(at[own[best]])
        return int(np.quantile(np.concatenate(places), target, method="higher")) + 1

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x**2).sum(axis=1), 0.0))
        return np.concatenate([x, more[:, None]], axis=1) @ self.rotation

    def lists_of(self, lifted: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self._near(lifted, self.centres), axis=1, kind="stable")[:, :n]


class Best:
    """The n best rows of each query so far: largest score, then smallest id."""

    def __init__(self, queries: int, n: int, bound: np.ndarray):
        self.n, self.given = n, bound
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.bound = bound.copy()

    def add(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        fits = score >= self.bound[query]
        q, s, i = (np.concatenate(x) for x in ((self.query, query[fits]), (self.score, score[fits]), (self.id, id_[fits])))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        last, keep = place == self.n - 1, place < self.n
        # The score of a query's n-th best: nothing below it counts any more.
        self.bound[q[last]] = np.maximum(self.given[q[last]], s[last])
        self.query, self.score, self.id = q[keep], s[keep], i[keep]


def scan(index: Index, q_row: np.ndarray, q: np.ndarray, bound: np.ndarray, v_row: np.ndarray, v_id: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(query, id, score) of the n best vectors of one tile for each query, none below the query's bound (a score), and the
    share of columns that were read. The query's own row is no candidate.

    Vectors are taken in stretches. Of a stretch, squared distances grow by blocks of rotated columns; after d of D columns
    a pair is given up if its partial distance, scaled up by D / d, is beyond the query's bound by more than the slack of
    the test over the root of d. What is left after the last block is scored exactly, and bounds are tightened.
    """
    big = index.dim + 1
    ql, vl = index.lifted(q, query=True), index.lifted(v)
    length = (q**2).sum(axis=1) + index.longest**2
    best, read = Best(len(q), n, bound), 0
    cuts = [(a, min(a + COLUMNS, big)) for a in range(0, big, COLUMNS)]
    q2, v2 = [(ql[:, a:b] ** 2).sum(axis=1) for a, b in cuts], [(vl[:, a:b] ** 2).sum(axis=1) for a, b in cuts]
    for at in range(0, len(v), STRETCH):
        rows = slice(at, at + STRETCH)
        open_ = np.isfinite(best.bound)
        # The squared distance at which the bound lies.
        limit = np.where(open_, length - 2 * np.where(open_, best.bound, 0.0), np.inf)
        part, pairs = np.zeros((len(q), len(v_id[rows]))), None
        for k, (a, b) in enumerate(cuts):
            if pairs is None:
                part += q2[k][:, None] + v2[k][None, rows] - 2 * ql[:, a:b] @ vl[rows, a:b].T
                read += part.size * (b - a)
            else:
                i, j = pairs
                part = part + ((ql[i, a:b] - vl[at + j, a:b]) ** 2).sum(axis=1)
                read += len(i) * (b - a)
            slack = (1 + SLACK / math.sqrt(b)) ** 2 if b < big else 1 + 1e-9
            top = limit * slack * (b / big) + 1e-9
            if pairs is None:
                keep = part <= top[:, None]
                if b == big or np.count_nonzero(keep) < DENSE * keep.size:
                    pairs = np.nonzero(keep)
                    part = part[pairs]
            else:
                keep = part <= top[pairs[0]]
                pairs, part = (pairs[0][keep], pairs[1][keep]), part[keep]
        i, j = pairs
        other = q_row[i] != v_row[at + j]
        i, j = i[other], at + j[other]
        for p in range(0, len(i), 1 << 16):  # the same sum for equal vectors, wherever they stand
            x, y = i[p : p + (1 << 16)], j[p : p + (1 << 16)]
            best.add(x, (v[y] * q[x]).sum(axis=1), v_id[y])
    return best.query, best.id, best.score, read / max(len(q) * len(v) * big, 1)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: an id, and a vector without null or non-finite components that isn't zero."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, nearest: int = NEAREST, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found for each query, every row but its own being a candidate.

    Rows that usable() leaves out take no part. Vectors meet those of their own length; each length has its index. Rows that
    repeat are candidates each, and queries each: an id that stands twice has two sets of ranks. Equal scores go by the
    smaller id. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors, key, vector)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    # One row for each length of vectors.
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("longest")).orderBy("d").collect()
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for x in lengths:
        out = out.unionByName(search_length(rows.filter(F.size("v") == x["d"]), x["n"], x["longest"], every, nearest, sample, target))
    return out


def search_length(rows: DataFrame, n: int, longest: float, every: int, nearest: int, sample: int, target: float) -> DataFrame:
    """search() of n vectors of one length.

    The index is fitted on a bounded sample; every row is in a list. Lists are cut into tiles of about TILE vectors, and a
    list's queries into sets, so that neither side of a task grows with the table. A query scans its nearest list first;
    the score of its n-th best there is its bound in all others.
    """
    spark = rows.sparkSession
    fit = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    index = Index(np.stack(fit["v"].to_list()), longest, int(min(math.sqrt(n), max(len(fit) // SHARE, 1))), nearest, target)
    shared = spark.sparkContext.broadcast(index)

    def place(many):
        def run(frames):
            for p in frames:
                if len(p):
                    near = shared.value.lists_of(shared.value.lifted(np.stack(p["v"].to_list()), query=many > 1), many)
                    yield p.assign(list=[list(map(int, r)) for r in near])

        return run

    kind = "row long, vec_id long, v array<double>, list array<int>"
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    stored, _ = written(spark, numbered.mapInPandas(place(1), kind).select("row", "vec_id", "v", F.col("list")[0].alias("list")), "ann")
    asked, _ = written(spark, stored.select("row", "vec_id", "v").filter(F.col("vec_id") % every == 0).mapInPandas(place(max(index.probes, 2)), kind), "ann-queries")

    def round_(probed: DataFrame, label: str) -> DataFrame:
        """(row, query_id, vec_id, score) found in lists, for queries (row, vec_id, v, bound, list)."""
        dealt = stored.groupBy("list").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
        dealt = dealt.join(probed.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("sets")), "list")
        # One row for each list, of which there are sample / SHARE at most.
        dealt, path = written(spark, dealt, "ann-lists")
        put = stored.join(F.broadcast(dealt), "list").withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int")).withColumn("set", F.explode(F.sequence(F.lit(0), F.col("sets") - 1)))
        groups = probed.join(F.broadcast(spark.read.schema(dealt.schema).parquet(path)), "list").withColumn("set", F.pmod(F.xxhash64("row", F.lit(1)), F.col("sets")).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))

        def tile(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(v):
                return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []})
            at, ids, score, _ = scan(shared.value, q["row"].to_numpy(), np.stack(q["v"].to_list()), q["bound"].to_numpy(float), v["row"].to_numpy(), v["vec_id"].to_numpy(), np.stack(v["v"].to_list()), nearest)
            return pd.DataFrame({"row": q["row"].to_numpy()[at], "query_id": q["vec_id"].to_numpy()[at], "vec_id": ids, "score": score})

        found = groups.groupBy("list", "tile", "set").cogroup(put.groupBy("list", "tile", "set")).applyInPandas(tile, "row long, query_id long, vec_id long, score double")
        found, _ = written(spark, found, label)
        drop(spark, path)
        return found

    least = F.lit(float("-inf"))
    first = round_(asked.select("row", "vec_id", "v", least.alias("bound"), F.col("list")[0].alias("list")), "ann-first")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    bounds = first.withColumn("k", F.row_number().over(best)).filter(F.col("k") == nearest).select("row", F.col("score").alias("bound"))
    others = asked.join(bounds, "row", "left").select("row", "vec_id", "v", F.coalesce("bound", least).alias("bound"), F.explode(F.slice("list", 2, 1 << 30)).alias("list"))
    found = first.unionByName(round_(others, "ann-others"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))

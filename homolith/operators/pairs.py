"""All points against all points: a block of points stays in a task while the blocks that it meets pass by, one at a time. What is kept
of them (the nearest, sums) doesn't grow with their number, and vectors move as packed numbers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homolith.sources.cuts import tabled

#: Points of a block; points of a staying block that are compared at a time; columns whose least value stands for them in a first bound;
#: pairs whose differences are held at a time.
BLOCK, TILE, FEW, DIFFERENCES = 4096, 256, 32, 65_536
#: Rounding of a scalar product, a place; the distance that stands for that of a point to itself.
EPS, ITSELF = 2.3e-16, -1e300


def kind(points: DataFrame, column: str = "point_id") -> str:
    return points.schema[column].dataType.simpleString()


def packed(points: DataFrame, key: str, labels: str | None = None, size: int = BLOCK, more: str | None = None) -> DataFrame:
    """(s, block, ids, x, single, labels, and more, if told, a column's value for each point): the points of each value of `key` in blocks of about `size`; x are the vectors as binary doubles (floats,
    if they are such), row by row, in order of the labels (a column, or empty strings) and ids."""
    single = points.schema["vec"].dataType.elementType.simpleString() == "float"
    sizes = points.groupBy(F.col(key).alias("s")).agg(F.ceil(F.count("*") / size).alias("blocks"))
    rows = points.select(F.col(key).alias("s"), F.col(labels).cast("string").alias("label") if labels else F.lit("").alias("label"), "point_id", "vec", *([F.col(more).alias("more")] if more else []))
    rows = rows.join(F.broadcast(sizes), "s").withColumn("block", F.pmod(F.xxhash64("point_id"), "blocks").cast("int")).drop("blocks")

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["label", "point_id"])
        x = np.stack(p["vec"].to_list()).astype(np.float32 if single else np.float64)
        return pd.DataFrame({"s": [p["s"].iloc[0]], "block": p["block"].iloc[0], "ids": [p["point_id"].tolist()], "x": [x.tobytes()], "single": single, "labels": [p["label"].tolist() if labels else []]} | ({"more": [p["more"].tolist()]} if more else {}))

    also = f", more array<{kind(points, more)}>" if more else ""
    return rows.groupBy("s", "block").applyInPandas(pack, f"s string, block int, ids array<{kind(points)}>, x binary, single boolean, labels array<string>{also}")


def unpacked(ids, x: bytes, single: bool) -> np.ndarray:
    return np.frombuffer(x, np.float32 if single else np.float64).reshape(len(ids), -1).astype(float)


def named(ids) -> np.ndarray:
    """Ids as an array that sorts as Spark sorts them."""
    ids = list(ids)
    return np.array(ids, str) if ids and isinstance(ids[0], str) else np.array(ids)


def meeting(own: DataFrame, others: DataFrame, condition, start: Callable, schema: str) -> DataFrame:
    """What staying blocks make of those they meet. `own` has s and block, which name a block; `others` has `at`, by which passing blocks
    are ordered. condition(a, b) tells from columns of both sides which meet (a: s and block of an own one, b: all of another).

    start(row) gets an own row and gives an object whose take(row) and done() yield frames. Passing blocks move once for each block
    that they meet; a task holds one of each kind."""
    stays = own.select(F.col("s").alias("own_s"), F.col("block").alias("own_block"))
    passing = [c for c in others.columns if c != "at"]
    met = others.alias("b").join(F.broadcast(stays.alias("a")), condition)
    met = met.select(F.col("own_s").alias("s"), F.col("own_block").alias("block"), F.lit(1).alias("turn"), F.col("b.at").alias("at"), F.lit(None).alias("own"), F.struct(*[F.col(f"b.{c}") for c in passing]).alias("other"))
    held = own.select("s", "block", F.lit(0).alias("turn"), F.lit(None).alias("at"), F.struct(*own.columns).alias("own"), F.lit(None).alias("other"))
    spark = own.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), own.select("s").count())
    rows = held.unionByName(met).repartition(tasks, "s", "block").sortWithinPartitions("s", "block", "turn", "at").select("turn", "own", "other")

    def run(frames):
        now = None
        for f in frames:
            for turn, mine, other in zip(f["turn"], f["own"], f["other"], strict=True):
                if turn:
                    yield from now.take(other)
                    continue
                if now is not None:
                    yield from now.done()
                now = start(mine)
        if now is not None:
            yield from now.done()

    return rows.mapInPandas(run, schema)


def apart(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of x[i] and y[j], from differences: a copy's is 0."""
    out = np.empty(len(i))
    for a in range(0, len(i), DIFFERENCES):
        at = slice(a, a + DIFFERENCES)
        out[at] = np.sqrt(((x[i[at]] - y[j[at]]) ** 2).sum(axis=1))
    return out


class Nearest:
    """The k nearest of all that pass for each point of a block: by distance (to `digits` decimals, if told), ties to the smaller id.

    A product of matrices gives all squared distances nearly; only pairs that it can't rule out are measured by differences. With `own`
    a point that meets itself is its own nearest, at ITSELF. Measures: "distance", or "product" (the largest scalar product, negated)."""

    def __init__(self, ids, x: np.ndarray, k: int, own: bool = False, digits: int | None = None, measure: str = "distance"):
        self.ids, self.x, self.k, self.own, self.digits, self.measure = named(ids), x, k, own, digits, measure
        self.square = (x * x).sum(axis=1)
        self.d, self.near, self.more = np.full((len(x), k), np.inf), None, None

    def take(self, ids, y: np.ndarray, more: np.ndarray | None = None) -> None:
        ids, other = named(ids), (y * y).sum(axis=1)
        for a in range(0, len(self.x), TILE):
            at = slice(a, min(a + TILE, len(self.x)))
            x, last = self.x[at], self.d[at, -1]
            wide = (self.square[at] + other.max()) * EPS * (x.shape[1] + 8)
            d = x @ y.T
            if self.measure == "distance":
                d *= -2
                d += other
                d += self.square[at, None]
                bound = last * last + 4e-12 * np.where(np.isinf(last), 0, last) + 1e-20
            else:
                np.negative(d, out=d)
                bound = last + 4e-12
            full = len(ids) // FEW
            if full >= self.k and np.isinf(last).any():
                least = d[:, : full * FEW].reshape(len(x), FEW, full).min(axis=1)
                seen = np.partition(least, self.k - 1, axis=1)[:, self.k - 1]
                bound = np.minimum(bound, seen + 4e-12 * np.sqrt(np.maximum(seen, 0)) + 4e-12)
            i, j = np.nonzero(d <= (bound + 2 * wide)[:, None])
            if len(i):
                self._merge(at, i, j, apart(x, y, i, j) if self.measure == "distance" else d[i, j], ids, more)

    def _merge(self, at: slice, i, j, d, ids, more) -> None:
        if self.digits is not None:
            d = d.round(self.digits)
        if self.own:
            d = np.where(self.ids[at][i] == ids[j], ITSELF, d)
        if self.near is None:
            self.near = np.zeros(self.d.shape, ids.dtype)
            self.more = None if more is None else np.zeros(self.d.shape, more.dtype)
        elif self.near.dtype != ids.dtype:
            self.near = self.near.astype(np.promote_types(self.near.dtype, ids.dtype))
        r, c = np.nonzero(np.isfinite(self.d[at]))
        row, d, name = np.concatenate([r, i]), np.concatenate([self.d[at][r, c], d]), np.concatenate([self.near[at][r, c], ids[j]])
        order = np.lexsort((name, d, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        row, rank, order = row[keep], rank[keep], order[keep]
        self.d[at][row, rank] = d[order]
        self.near[at][row, rank] = name[order]
        if self.more is not None:
            self.more[at][row, rank] = np.concatenate([self.more[at][r, c], more[j]])[order]

    def lists(self):
        """Ids and distances of each point, nearest first, without the point itself."""
        if self.near is None:
            return [[] for _ in self.x], [[] for _ in self.x]
        keep, k = np.isfinite(self.d) & (self.d != ITSELF), self.k - self.own
        return [n[m][:k].tolist() for n, m in zip(self.near, keep, strict=True)], [v[m][:k] for v, m in zip(self.d, keep, strict=True)]


class _Groups:
    """Nearest of each group of passing blocks (`group`), which pass one group after the other."""

    def __init__(self, row, k: int, own: bool, digits: int | None, measure: str):
        self.row, self.now, self.group = row, None, None
        self.x = unpacked(row["ids"], row["x"], row["single"])
        self.new = lambda: Nearest(row["ids"], self.x, k + own, own, digits, measure)

    def take(self, other):
        if self.now is None or other["group"] != self.group:
            yield from self.done()
            self.now, self.group = self.new(), other["group"]
        self.now.take(other["ids"], unpacked(other["ids"], other["x"], other["single"]))

    def done(self):
        if self.now is not None:
            near, d = self.now.lists()
            yield pd.DataFrame({"s": self.row["s"], "o": self.group, "id": self.row["ids"], "near": near, "d": d})
        self.now = None


def nearest(own: DataFrame, others: DataFrame, condition, k: int, itself: bool, digits: int | None = None, measure: str = "distance") -> DataFrame:
    """(s, o, id, near, d): for each point of `own` (packed()) its k nearest of each `group` of `others` (packed(), group, at), nearest first,
    ties to the smaller id; with `itself` a point may meet itself, and doesn't count."""
    of = own.schema["ids"].dataType.elementType.simpleString()
    return meeting(own, others, condition, lambda row: _Groups(row, k, itself, digits, measure), f"s string, o string, id {of}, near array<{of}>, d array<double>")


def within(points: DataFrame, key: str, k: int, digits: int | None = None) -> DataFrame:
    """(s, id, near, d): each point's k nearest others of the same value of a column."""
    held = tabled(packed(points, key))
    others = held.withColumn("group", F.col("s")).withColumn("at", F.struct("group", "block"))
    return nearest(held.drop("labels"), others.drop("labels"), F.col("own_s") == F.col("b.s"), k, True, digits).drop("o")


class _Sums:
    """Sums of distances to the points of each label, given up before they are too many to hold."""

    def __init__(self, row):
        self.row, self.sums = row, {}
        self.x = unpacked(row["ids"], row["x"], row["single"])
        self.square = (self.x * self.x).sum(axis=1)

    def take(self, other):
        y, label = unpacked(other["ids"], other["x"], other["single"]), np.array(list(other["labels"]), object)
        starts = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
        square = (y * y).sum(axis=1)
        for n in label[starts]:
            if n not in self.sums:
                self.sums[n] = np.zeros(len(self.x))
        for a in range(0, len(self.x), TILE):
            at = slice(a, min(a + TILE, len(self.x)))
            d = self.x[at] @ y.T
            d *= -2
            d += square
            d += self.square[at, None]
            # Where squares nearly cancel, differences are measured.
            i, j = np.nonzero(d < (1e-6 * (self.square[at] + square.max()))[:, None])
            d[i, j] = apart(self.x[at], y, i, j) ** 2
            for n, v in zip(label[starts], np.add.reduceat(np.sqrt(d, out=d), starts, axis=1).T, strict=True):
                self.sums[n][at] += v
        if len(self.sums) * len(self.x) > 8_000_000:
            yield from self.done()

    def done(self):
        for n, v in self.sums.items():
            yield pd.DataFrame({"p": self.row["ids"], "s": self.row["labels"], "o": n, "d": v})
        self.sums = {}


def sums(points: DataFrame, labels: str) -> DataFrame:
    """(p, s, o, d): for each point, its label and each label o, parts of the sum of distances to all points of that label."""
    held = tabled(packed(points.withColumn("__all", F.lit("all")), "__all", labels))
    return meeting(held, held.withColumn("at", F.struct("block")), F.lit(True), _Sums, f"p {kind(points)}, s string, o string, d double")

"""Integration of batches of cells: anchors in reciprocal principal components, corrections merged along a tree, and soft
clusters with a diversity penalty. Points are (sample, point_id, vec): a batch, a cell's id over all batches, its values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homolith.functions import kernels
from homolith.operators import pairs, spaces
from homolith.sources.cuts import tabled as cut

#: Neighbours that make an anchor, that a filter looks at, that a score compares, that a cell's correction is weighed from.
K_ANCHOR, K_FILTER, K_SCORE, K_WEIGHT = 5, 50, 30, 50
#: Blocks of cells that stay in a task together; values of a cell that are corrected in one task; products that are added at a time.
STAYING, PART, ADDED = 4, 64, 65_536


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def reciprocal(points: DataFrame, width: int, dims: int = 50) -> DataFrame:
    """(space, batch, block, ids, x): all cells in the components of each batch, each component over its deviation there, of length 1. x are
    a block's cells as binary doubles, cell by cell."""
    held = cut(spaces.blocks(spaces.dense_rows(points)))
    kind = points.schema["point_id"].dataType.simpleString()

    def run(frames):
        for f in frames:
            x = [_unit(np.frombuffer(y).reshape(len(i), -1) / np.maximum(np.frombuffer(s), 1e-12)).tobytes() for i, y, s in zip(f["ids"], f["pc"], f["spread"], strict=True)]
            yield f[["space", "batch", "block", "ids"]].assign(x=x)

    found = spaces.block_scores(held, spaces.loadings(held, width, dims), "all")
    return found.select("space", "batch", "block", "ids", "pc", "spread").mapInPandas(run, f"space string, batch string, block int, ids array<{kind}>, x binary")


def neighbours(rows: DataFrame, k: int = K_SCORE) -> DataFrame:
    """(space, batch, id, near): for each cell of the batch that a space belongs to, its k nearest cells of each batch there, nearest
    first, ties to the smaller id; a cell is not its own neighbour. Some blocks of a batch stay in a task while all of its space pass by."""
    held = cut(rows.withColumn("single", F.lit(False)))
    kind = rows.schema["ids"].dataType.simpleString()

    def joined(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("block")
        return pd.DataFrame([[p["space"].iloc[0], p["block"].iloc[0] // STAYING, np.concatenate(p["ids"].to_list()).tolist(), b"".join(p["x"]), False]], columns=["s", "block", "ids", "x", "single"])

    own = held.filter("space = batch").withColumn("own", F.floor(F.col("block") / STAYING))
    own = cut(own.groupBy("space", "own").applyInPandas(joined, f"s string, block int, ids {kind}, x binary, single boolean"))
    others = held.select(F.col("space").alias("s"), F.col("batch").alias("group"), F.struct("batch", "block").alias("at"), "ids", "x", "single")
    found = pairs.nearest(own, others, F.col("own_s") == F.col("b.s"), k, True, 12, "product")
    return found.filter(F.size("near") > 0).select(F.col("s").alias("space"), F.col("o").alias("batch"), "id", "near")


def anchors(near: DataFrame, k: int = K_ANCHOR) -> DataFrame:
    """(a, b, pa, pb, shared): pairs of cells of batches a < b among the k nearest of each other, each in the space of its own batch, with
    the number of neighbours (in both batches) that both cells have."""
    home = near.filter("space = batch").select("id", F.col("near").alias("home"))
    cross = cut(near.filter("space <> batch").join(home, "id").select("space", "batch", "id", F.slice("near", 1, k).alias("first"), F.concat("home", "near").alias("both")))
    one = cross.filter("space < batch").select(F.col("space").alias("a"), F.col("batch").alias("b"), F.col("id").alias("pa"), F.explode("first").alias("pb"))
    two = cross.filter("space > batch").select(F.col("batch").alias("a"), F.col("space").alias("b"), F.col("id").alias("pb"), F.explode("first").alias("pa"))
    of_a = cross.filter("space < batch").select(F.col("batch").alias("b"), F.col("id").alias("pa"), F.col("both").alias("na"))
    of_b = cross.filter("space > batch").select(F.col("batch").alias("a"), F.col("id").alias("pb"), F.col("both").alias("nb"))
    held = one.join(two, ["a", "b", "pa", "pb"]).join(of_a, ["b", "pa"]).join(of_b, ["a", "pb"])
    return held.select("a", "b", "pa", "pb", F.size(F.array_intersect("na", "nb")).alias("shared"))


class _Near:
    """Keeps the anchors of a block of first cells whose second cell is among the k nearest (or as near as the k-th) of all that pass."""

    def __init__(self, row, k: int):
        self.row, self.x, self.k = row, _unit(pairs.unpacked(row["ids"], row["x"], row["single"])), k
        self.nearest = pairs.Nearest(row["ids"], self.x, k, measure="product")
        self.at = np.repeat(np.arange(len(self.x)), [len(m) for m in row["more"]])
        self.to = pairs.named([p for m in row["more"] for p in m])
        self.product = np.full(len(self.to), np.nan)

    def take(self, other):
        y, ids = _unit(pairs.unpacked(other["ids"], other["x"], other["single"])), pairs.named(other["ids"])
        j = np.minimum(np.searchsorted(ids, self.to), len(ids) - 1)
        here = np.flatnonzero(ids[j] == self.to)
        self.product[here] = (self.x[self.at[here]] * y[j[here]]).sum(axis=1)
        self.nearest.take(other["ids"], y)
        yield from ()

    def done(self):
        keep = np.flatnonzero(self.product + 1e-9 >= -self.nearest.d[self.at, self.k - 1])
        yield pd.DataFrame({"pa": pairs.named(self.row["ids"])[self.at[keep]], "pb": self.to[keep]})


def filtered(found: DataFrame, points: DataFrame, k: int = K_FILTER) -> DataFrame:
    """Anchors whose second cell is among the k cells of its batch that are nearest to the first, by the values themselves at length 1.
    First cells stay in blocks, with their anchors, while the batch passes by."""
    kind = points.schema["point_id"].dataType.simpleString()
    rows = points.select(F.col("sample").alias("group"), "point_id", "vec")
    first = found.groupBy("b", "pa").agg(F.array_sort(F.collect_list("pb")).alias("more")).join(rows.select(F.col("point_id").alias("pa"), "vec"), "pa")
    own = cut(pairs.packed(first.select("b", F.col("pa").alias("point_id"), "vec", "more"), "b", size=STAYING * spaces.BLOCK, more="more").drop("labels"))
    others = cut(pairs.packed(rows, "group").drop("labels")).withColumn("at", F.struct("block"))
    kept = pairs.meeting(own, others, F.col("own_s") == F.col("b.s"), lambda row: _Near(row, k), f"pa {kind}, pb {kind}")
    return found.join(kept, ["pa", "pb"], "left_semi").select(found.columns)


def scored(found: DataFrame) -> DataFrame:
    """Anchors with a score from 0 to 1: shared neighbours between the 1 and 90 percent points of the pair of batches."""
    q = found.groupBy("a", "b").agg(F.percentile("shared", F.array(F.lit(0.01), F.lit(0.9))).alias("q"))
    low, high = F.col("q")[0], F.col("q")[1]
    score = F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("shared") - low) / (high - low)))).otherwise(F.lit(1.0))
    return found.join(F.broadcast(q), ["a", "b"]).select("a", "b", "pa", "pb", score.alias("score"))


def merge_order(counts: dict[tuple[str, str], int], sizes: dict[str, int]) -> list[tuple[list[str], list[str]]]:
    """Pairs of groups of batches in the order in which they are merged, the reference (more cells) first: a tree of complete
    linkage over the inverse of anchors for each cell of the smaller batch. Numbers are of batches, not of cells."""
    names = sorted(sizes)
    d = np.zeros((len(names), len(names)))
    for i, a in enumerate(names):
        for j in range(i):
            n = counts.get((names[j], a), 0) / min(sizes[a], sizes[names[j]])
            d[i, j] = d[j, i] = 1 / n if n else 1e9
    groups, out = {i: [n] for i, n in enumerate(names)}, []
    for step, (i, j, _, _) in enumerate(kernels.linkage(d, "complete")):
        one, two = groups.pop(i), groups.pop(j)
        if sum(sizes[x] for x in two) > sum(sizes[x] for x in one):
            one, two = two, one
        out.append((one, two))
        groups[len(names) + step] = one + two
    return out


class _Weighed:
    """The ends of anchors that a block of cells is weighed from: of the nearest, as many as have k anchors, of the last maybe not all."""

    def __init__(self, row, k: int):
        self.row, self.k = row, k
        self.nearest = pairs.Nearest(row["ids"], pairs.unpacked(row["ids"], row["x"], row["single"]), k, digits=9)

    def take(self, other):
        self.nearest.take(other["ids"], pairs.unpacked(other["ids"], other["x"], other["single"]), np.asarray(other["more"]))
        yield from ()

    def done(self):
        d, n = self.nearest.d, self.nearest.more
        n = np.where(np.isfinite(d), n, 0)
        before = np.cumsum(n, axis=1) - n
        cell, rank = np.nonzero((n > 0) & (before < self.k))
        last = np.maximum.reduceat(d[cell, rank], np.flatnonzero(np.append(True, cell[1:] != cell[:-1])))
        taken = np.minimum(n, self.k - before)[cell, rank]
        yield pd.DataFrame({"block": self.row["block"], "cell": cell, "own": self.nearest.near[cell, rank], "d": d[cell, rank], "n": taken, "last": np.maximum(last, 1e-12)[np.cumsum(np.append(0, cell[1:] != cell[:-1]))]})


def weights(held: DataFrame, found: DataFrame, place: DataFrame, k: int = K_WEIGHT, sd: float = 1.0) -> DataFrame:
    """(block, cell, ref, own, w): for each cell (its number in a block of `held`, packed()) the k anchors (found: ref, own, score) whose own
    cells are nearest in `place` (point_id, vec), and their weights: one less the distance over that to the last of them, times the
    score, through a Gaussian of width 2 / sd. Ties go to the smaller own cell, then the smaller ref."""
    kind = place.schema["point_id"].dataType.simpleString()
    ends = cut(found.groupBy("own").agg(F.array_sort(F.collect_list(F.struct("ref", "score"))).alias("r")))
    counted = ends.select(F.col("own").alias("point_id"), F.size("r").alias("more")).join(place, "point_id").withColumn("g", F.lit("q"))
    others = cut(pairs.packed(counted, "g", more="more").drop("labels")).withColumn("at", F.struct("block"))
    near = pairs.meeting(held, others, F.lit(True), lambda row: _Weighed(row, k), f"block int, cell int, own {kind}, d double, n int, last double")
    rows = near.join(ends, "own").select("block", "cell", "own", "d", "last", F.explode(F.slice("r", F.lit(1), F.col("n"))).alias("a"))
    w = 1 - F.exp(-((1 - F.col("d") / F.col("last")) * F.col("a.score")) / (2 / sd) ** 2)
    return rows.select("block", "cell", F.col("a.ref").alias("ref"), "own", w.alias("w")).filter("w > 0")


def _parts(points: DataFrame, width: int) -> DataFrame:
    """(batch, id, j, part): values of cells in PART-long pieces."""
    j = F.explode(F.sequence(F.lit(0), F.lit((width - 1) // PART))).alias("j")
    rows = points.select(F.col("sample").alias("batch"), F.col("point_id").alias("id"), F.transform("vec", lambda v: v.cast("double")).alias("vec"), j)
    return rows.select("batch", "id", "j", F.slice("vec", F.col("j") * PART + 1, PART).alias("part"))


def _moved(parts: DataFrame, held: DataFrame, shares: DataFrame, query: list[str]) -> DataFrame:
    """Pieces of the query batches' cells moved by the differences of their anchors, over the sum of weights. A cell that anchors name goes
    once to each block (of `held`, packed()) with cells that it counts for; a task holds the sums of one block's pieces."""
    kind = parts.schema["id"].dataType.simpleString()
    both = F.explode(F.array(F.struct(F.col("ref").alias("id"), F.col("w").alias("w")), F.struct(F.col("own").alias("id"), (-F.col("w")).alias("w")))).alias("e")
    sources = shares.select("block", "cell", both).select("block", F.col("e.id").alias("id"), "cell", F.col("e.w").alias("w")).repartition("id")
    sources = sources.groupBy("id", "block").agg(F.array_sort(F.collect_list(F.struct("cell", "w"))).alias("r"))
    none = F.lit(None)
    sent = sources.join(parts.select("id", "j", "part"), "id").select("block", "j", F.lit(1).alias("turn"), "id", none.cast(f"array<{kind}>").alias("ids"), "part", F.col("r.cell").alias("cell"), F.col("r.w").alias("w"))
    stays = held.withColumn("j", F.explode(F.array(*[F.lit(j) for j in range(parts.agg(F.max("j")).first()[0] + 1)])))
    stays = stays.select("block", "j", F.lit(0).alias("turn"), none.cast(kind).alias("id"), "ids", none.cast("array<double>").alias("part"), none.cast("array<int>").alias("cell"), none.cast("array<double>").alias("w"))
    rows = stays.unionByName(sent).repartition("block", "j").sortWithinPartitions("block", "j", "turn", "id")

    def run(frames):
        ids, j, sums, total = None, None, None, None

        def moved():
            at = np.flatnonzero(total > 0)
            if ids is not None and sums is not None and len(at):
                yield pd.DataFrame({"id": ids[at], "j": j, "by": list(sums[at] / total[at, None])})

        for f in frames:
            starts = np.append(np.flatnonzero(f["turn"].to_numpy() == 0), len(f))
            for a, b in zip(np.append(0, starts[:-1]), starts, strict=True):
                p = f.iloc[a:b]
                if len(p) and p["turn"].iloc[0] == 0:
                    if ids is not None:
                        yield from moved()
                    ids, j, sums, p = pairs.named(p["ids"].iloc[0]), p["j"].iloc[0], None, p.iloc[1:]
                    total = np.zeros(len(ids))
                if not len(p):
                    continue
                x, cell, w = np.stack(p["part"].to_list()), np.concatenate(p["cell"].to_list()), np.concatenate(p["w"].to_list())
                row = np.repeat(np.arange(len(p)), [len(c) for c in p["cell"]])
                sums = np.zeros((len(ids), x.shape[1])) if sums is None else sums
                total += np.bincount(cell, np.maximum(w, 0), len(ids))
                order = np.argsort(cell, kind="stable")
                for i in range(0, len(order), ADDED):
                    o = order[i : i + ADDED]
                    to = cell[o]
                    first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                    sums[to[first]] += np.add.reduceat(x[row[o]] * w[o, None], first, axis=0)
        if ids is not None:
            yield from moved()

    by = rows.mapInPandas(run, f"id {kind}, j int, by array<double>")
    own = parts.filter(F.col("batch").isin(query)).join(by, ["id", "j"], "left")
    part = F.when(F.col("by").isNull(), F.col("part")).otherwise(F.zip_with("part", "by", lambda x, y: x + y))
    return parts.filter(~F.col("batch").isin(query)).unionByName(own.select("batch", "id", "j", part.alias("part")))


def found_anchors(points: DataFrame, width: int, dims: int = 50, k_anchor: int = K_ANCHOR, k_filter: int = K_FILTER, k_score: int = K_SCORE) -> DataFrame:
    """(a, b, pa, pb, score): anchors of all pairs of batches."""
    near = cut(neighbours(reciprocal(points, width, dims), max(k_score, k_anchor)))
    return scored(filtered(cut(anchors(near, k_anchor)), points, k_filter))


def integrated(points: DataFrame, dims: int = 50, k_anchor: int = K_ANCHOR, k_filter: int = K_FILTER, k_score: int = K_SCORE, k_weight: int = K_WEIGHT, found: DataFrame | None = None) -> DataFrame:
    """(sample, point_id, vec): batches merged two by two along a tree, the smaller moved by its anchors with the larger. Cells are
    weighed in the principal components of all cells; a batch without anchors stays as it is. Null vectors take no part.

    `found` are anchors of an earlier call, which are taken as they are. Driver and closures hold numbers of batches, not of cells."""
    points = cut(points.filter("vec IS NOT NULL").select(F.col("sample").cast("string").alias("sample"), "point_id", "vec"))
    first = points.select(F.size("vec").alias("n")).first()
    as_it_is = points.withColumn("vec", F.transform("vec", lambda v: v.cast("double")))
    if first is None:
        return as_it_is
    width = first["n"]
    found = cut(found_anchors(points, width, dims, k_anchor, k_filter, k_score) if found is None else found)
    sizes = {r["sample"]: r["count"] for r in points.groupBy("sample").count().collect()}
    counts = {(r["a"], r["b"]): r["count"] for r in found.groupBy("a", "b").count().collect()}
    if not counts:
        return as_it_is
    place = cut(spaces.pca(spaces.dense_rows(points.withColumn("sample", F.lit("all"))), width, dims)[1].select(F.col("id").alias("point_id"), F.col("pc").alias("vec")))
    batch_of = points.select("point_id", F.col("sample").alias("batch"))
    parts = cut(_parts(points, width))
    for ref, query in merge_order(counts, sizes):
        ahead = F.col("a").isin(ref) & F.col("b").isin(query)
        behind = F.col("b").isin(ref) & F.col("a").isin(query)
        used = found.filter(ahead | behind).select(F.when(ahead, F.col("pa")).otherwise(F.col("pb")).alias("ref"), F.when(ahead, F.col("pb")).otherwise(F.col("pa")).alias("own"), "score")
        if not any(counts.get(p) for a in ref for b in query for p in ((a, b), (b, a))):
            continue
        cells = batch_of.filter(F.col("batch").isin(query)).join(place, "point_id").withColumn("g", F.lit("q"))
        held = cut(pairs.packed(cells, "g", size=STAYING * spaces.BLOCK).drop("labels"))
        parts = cut(_moved(parts, held, cut(weights(held, used, place, k_weight)), query))
    whole = parts.groupBy("batch", "id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("j", "part"))), lambda r: r["part"])).alias("vec"))
    return whole.select(F.col("batch").alias("sample"), F.col("id").alias("point_id"), "vec")


# Soft clusters with a diversity penalty. Width of the clusters' kernel, weight of the penalty, ridge.
SIGMA, THETA, RIDGE = 0.1, 2.0, 1.0


def _assigned(z: np.ndarray, centres: np.ndarray, penalty: np.ndarray, sigma: float) -> np.ndarray:
    """Shares (points x clusters); penalty has a row for each point."""
    s = -2 * (1 - _unit(z) @ centres.T) / sigma
    r = np.exp(s - s.max(axis=1, keepdims=True)) * penalty
    return r / np.maximum(r.sum(axis=1, keepdims=True), 1e-300)


def harmony(points: DataFrame, clusters: int | None = None, rounds: int = 10, inner: int = 5, sigma: float = SIGMA, theta: float = THETA, ridge: float = RIDGE, seed: int = 1, tolerance: float = 1e-4) -> DataFrame:
    """(sample, point_id, vec): soft k-means of all batches' cells by angle, in which a cluster with more of a batch than its share
    draws fewer of that batch; then each cluster's offsets of the batches (ridge regression) are taken off its cells, by share.

    Each inner round is one pass that adds up shares and directions by cluster and batch; corrections move one row for each
    cluster and batch. Driver and closures hold (clusters x values) and (clusters x batches) numbers. The first centres are the
    cells of smallest hash. Null vectors take no part; with one batch nothing changes."""
    points = cut(points.filter("vec IS NOT NULL").select(F.col("sample").cast("string").alias("sample"), "point_id", F.transform("vec", lambda v: v.cast("double")).alias("vec")))
    share = {r["sample"]: r["count"] for r in points.groupBy("sample").count().collect()}
    n, names = sum(share.values()), sorted(share)
    if len(names) < 2:
        return points
    k = clusters or max(2, min(100, round(n / 30)))
    at = {b: i for i, b in enumerate(names)}
    part = np.array([share[b] / n for b in names])
    kind = points.schema["point_id"].dataType.simpleString()
    first = points.select("vec", F.md5(F.concat(F.lit(f"{seed}|"), F.col("point_id").cast("string"))).alias("h"), "point_id").orderBy("h", "point_id").limit(k).collect()
    centres = _unit(np.array([r["vec"] for r in first]))
    k, width = centres.shape
    now = points.withColumn("block", F.pmod(F.xxhash64("point_id"), F.lit(max(1, n // 4096))).cast("int"))
    now = cut(now.groupBy("sample", "block").agg(F.array_sort(F.collect_list(F.struct("point_id", "vec"))).alias("r")).select("sample", F.col("r.point_id").alias("ids"), F.col("r.vec").alias("z"), F.col("r.vec").alias("raw")))

    def passed(held: DataFrame, centres: np.ndarray, observed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Shares by cluster and batch, and directions by cluster."""
        penalty = _penalty(observed, part, theta)

        def run(frames):
            for f in frames:
                for s, z in zip(f["sample"], f["z"], strict=True):
                    z = np.stack(list(z))
                    r = _assigned(z, centres, penalty[at[s]][None, :], sigma)
                    yield pd.DataFrame({"b": at[s], "c": np.arange(k), "n": r.sum(axis=0), "y": list(r.T @ _unit(z))})

        def add(p: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"c": [p["c"].iloc[0]], "n": [np.bincount(p["b"], p["n"], minlength=len(names))], "y": [np.sum(list(p["y"]), axis=0)]})

        o, y = np.zeros((len(names), k)), np.zeros((k, width))
        for r in held.select("sample", "z").mapInPandas(run, "b int, c int, n double, y array<double>").groupBy("c").applyInPandas(add, "c int, n array<double>, y array<double>").collect():
            o[:, r["c"]], y[r["c"]] = r["n"], r["y"]
        return o, _unit(y)

    for _ in range(rounds):
        observed = None
        for _ in range(inner):
            observed, new = passed(now, centres, observed)
            moved, centres = np.abs(new - centres).max(), new
            if moved < tolerance:
                break
        penalty = _penalty(observed, part, theta)

        def sums(frames, centres=centres, penalty=penalty):
            for f in frames:
                for s, z, raw in zip(f["sample"], f["z"], f["raw"], strict=True):
                    r = _assigned(np.stack(list(z)), centres, penalty[at[s]][None, :], sigma)
                    yield pd.DataFrame({"c": np.arange(k), "b": at[s], "n": r.sum(axis=0), "s": [x.tobytes() for x in r.T @ np.stack(list(raw))]})

        def solve(p: pd.DataFrame) -> pd.DataFrame:
            m, s = np.zeros(len(names)), np.zeros((len(names), width))
            for b, c, v in zip(p["b"], p["n"], p["s"], strict=True):
                m[b] += c
                s[b] += np.frombuffer(v)
            left = np.diag(np.append(0.0, m + ridge))
            left[0, 0], left[0, 1:], left[1:, 0] = max(m.sum(), 1e-12), m, m
            beta = np.linalg.solve(left, np.vstack([s.sum(axis=0), s]))[1:]
            return pd.DataFrame({"sample": names, "c": p["c"].iloc[0], "beta": [x.tobytes() for x in beta]})

        def add(p: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([[p["c"].iloc[0], p["b"].iloc[0], p["n"].sum(), np.sum([np.frombuffer(v) for v in p["s"]], axis=0).tobytes()]], columns=["c", "b", "n", "s"])

        added = now.mapInPandas(sums, "c int, b int, n double, s binary").groupBy("c", "b").applyInPandas(add, "c int, b int, n double, s binary")
        beta = added.groupBy("c").applyInPandas(solve, "sample string, c int, beta binary").groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("c", "beta"))).alias("r")).select("sample", F.col("r.beta").alias("beta"))

        def shift(frames, centres=centres, penalty=penalty):
            for f in frames:
                out = []
                for s, z, raw, beta in zip(f["sample"], f["z"], f["raw"], f["beta"], strict=True):
                    r = _assigned(np.stack(list(z)), centres, penalty[at[s]][None, :], sigma)
                    out.append(list(np.stack(list(raw)) - r @ np.stack([np.frombuffer(b) for b in beta])))
                yield f[["sample", "ids"]].assign(z=out, raw=f["raw"])

        now = cut(now.join(beta, "sample").mapInPandas(shift, f"sample string, ids array<{kind}>, z array<array<double>>, raw array<array<double>>"))
    return now.select("sample", F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("z").alias("v"))).alias("x")).select("sample", F.col("x.id").alias("point_id"), F.col("x.v").alias("vec"))


def _penalty(observed: np.ndarray | None, part: np.ndarray, theta: float) -> np.ndarray:
    """(batches x clusters): expected over observed shares, to the power of theta; 1 where nothing has been observed yet."""
    if observed is None:
        return np.ones((len(part), 1))
    expected = part[:, None] * observed.sum(axis=0)[None, :]
    return ((expected + 1) / (observed + 1)) ** theta

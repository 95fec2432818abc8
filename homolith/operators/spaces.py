"""Principal components of many cells by block power iteration: partial products of blocks of cells, summed by batch.

Rows are (batch, id, idx, val): the places and values of a cell that aren't 0, or all its values if idx is null. What is moved is a
matrix of (genes x components) for each block of cells; nothing but the result of a batch is in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homolith.sources.cuts import tabled as cut

#: Cells of a block; cells that are dense at a time while a block is multiplied; partial sums that are added in one task.
BLOCK, DENSE, FAN = 2048, 128, 16
#: Columns beyond those that are asked for, and rounds of the iteration.
EXTRA, ROUNDS = 10, 8
FITS = "batch string, n long, width int, loadings binary, mean binary, sd binary, spread binary"


def sparse_rows(matrix: DataFrame, genes: DataFrame, batch: str = "sample", cell: str = "cell") -> DataFrame:
    """Rows of a long matrix; `genes` is (gene, place) from 0 on. Cells without any of the genes have no row."""
    held = matrix.join(genes, "gene").groupBy(F.col(batch).alias("batch"), F.col(cell).alias("id"))
    rows = held.agg(F.array_sort(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), F.col("value").cast("double").alias("value")))).alias("r"))
    return rows.select("batch", "id", F.col("r.place").alias("idx"), F.col("r.value").alias("val"))


def dense_rows(points: DataFrame, batch: str = "sample", point: str = "point_id") -> DataFrame:
    return points.select(F.col(batch).cast("string").alias("batch"), F.col(point).alias("id"), F.lit(None).cast("array<int>").alias("idx"), F.transform("vec", lambda x: x.cast("double")).alias("val"))


def blocks(rows: DataFrame) -> DataFrame:
    """(batch, block, ids, idx, val), arrays of about BLOCK cells each."""
    sizes = rows.groupBy("batch").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(F.broadcast(sizes), "batch").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return placed.groupBy("batch", "block").agg(F.array_sort(F.collect_list(F.struct("id", "idx", "val"))).alias("r")).select("batch", "block", F.col("r.id").alias("ids"), F.col("r.idx").alias("idx"), F.col("r.val").alias("val"))


def _dense(idx, val, width: int):
    """The block's cells, DENSE at a time, as matrices."""
    for i in range(0, len(val), DENSE):
        part, at = val[i : i + DENSE], idx[i : i + DENSE]
        if at[0] is None:
            yield np.stack([np.asarray(v, float) for v in part])
            continue
        x = np.zeros((len(part), width))
        x[np.repeat(np.arange(len(part)), [len(a) for a in at]), np.concatenate([np.asarray(a, int) for a in at])] = np.concatenate([np.asarray(v, float) for v in part])
        yield x


def _summed(parts: DataFrame, finish, schema: str) -> DataFrame:
    """Sums of the rows (batch, part, n, arrays as binaries) of each batch, in two steps, given to finish(batch, n, arrays)."""
    names = [c for c in parts.columns if c not in ("batch", "part", "n")]

    def add(p: pd.DataFrame) -> tuple[int, list[np.ndarray]]:
        return int(p["n"].sum()), [np.sum([np.frombuffer(b) for b in p[c]], axis=0) for c in names]

    def some(p: pd.DataFrame) -> pd.DataFrame:
        n, sums = add(p)
        return pd.DataFrame([[p["batch"].iloc[0], 0, n, *[s.tobytes() for s in sums]]], columns=["batch", "part", "n", *names])

    def all_(p: pd.DataFrame) -> pd.DataFrame:
        return finish(p["batch"].iloc[0], *add(p))

    held = parts.select("batch", F.floor(F.col("part") / FAN).cast("int").alias("part"), "n", *names)
    kept = "batch string, part int, n long, " + ", ".join(f"{c} binary" for c in names)
    return held.groupBy("batch", "part").applyInPandas(some, kept).groupBy("batch").applyInPandas(all_, schema)


def moments(held: DataFrame, width: int, scale: bool) -> DataFrame:
    """FITS of each batch with its genes' means and, with `scale`, deviations (1 for a gene without); no loadings yet."""

    def part(frames):
        for f in frames:
            for batch, block, idx, val in zip(f["batch"], f["block"], f["idx"], f["val"], strict=True):
                s, ss = np.zeros(width), np.zeros(width)
                for x in _dense(idx, val, width):
                    s += x.sum(axis=0)
                    ss += (x * x).sum(axis=0)
                yield pd.DataFrame([[batch, block, len(val), s.tobytes(), ss.tobytes()]], columns=["batch", "part", "n", "s", "ss"])

    def finish(batch, n, sums):
        s, ss = sums
        sd = np.sqrt(np.maximum(ss - s * s / n, 0) / max(n - 1, 1)) if scale else np.ones(width)
        sd[sd <= 1e-12] = 1.0
        return pd.DataFrame([[batch, n, width, b"", (s / n).tobytes(), sd.tobytes(), b""]], columns=[c.split()[0] for c in FITS.split(", ")])

    return _summed(held.select("batch", "block", "idx", "val").mapInPandas(part, "batch string, part int, n long, s binary, ss binary"), finish, FITS)


def _start(width: int, columns: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((width, columns)))[0]


def loadings(held: DataFrame, width: int, k: int = 50, scale: bool = False, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """FITS of each batch: the loadings (width x components, at most k and what the batch's rank is) of its centred (and scaled) cells,
    and the deviation of each component (spread). Each loading's largest weight is positive.

    Centring is a product with the means beside that with the cells, so absent values stay absent."""
    columns = min(k + EXTRA, width)
    fits = cut(moments(held, width, scale))

    def part(frames):
        for f in frames:
            for batch, block, idx, val, w, mean, sd in zip(f["batch"], f["block"], f["idx"], f["val"], f["loadings"], f["mean"], f["sd"], strict=True):
                mean, sd = np.frombuffer(mean), np.frombuffer(sd)
                w = (np.frombuffer(w).reshape(width, -1) if len(w) else _start(width, columns, seed)) / sd[:, None]
                shift, z = mean @ w, np.zeros((width, w.shape[1]))
                for x in _dense(idx, val, width):
                    y = x @ w - shift
                    z += x.T @ y - np.outer(mean, y.sum(axis=0))
                yield pd.DataFrame([[batch, block, len(val), (z / sd[:, None]).tobytes()]], columns=["batch", "part", "n", "z"])

    def turned(last: bool):
        def finish(batch, n, sums):
            z = sums[0].reshape(width, -1)
            if last:
                return pd.DataFrame([[batch, n, z.tobytes()]], columns=["batch", "n", "z"])
            return pd.DataFrame([[batch, n, np.linalg.qr(z)[0].tobytes()]], columns=["batch", "n", "z"])

        return finish

    def ritz(frames):
        for f in frames:
            for batch, n, w, z, mean, sd in zip(f["batch"], f["n"], f["loadings"], f["z"], f["mean"], f["sd"], strict=True):
                w, z = np.frombuffer(w).reshape(width, -1), np.frombuffer(z).reshape(width, -1)
                c = w.T @ z
                power, v = np.linalg.eigh((c + c.T) / 2)
                top = np.argsort(-power)[: min(k, max(n - 1, 1))]
                # What is only rounding is no component.
                top = top[power[top] > 1e-10 * max(power.max(), 1e-300)]
                power, v = np.maximum(power[top], 0), w @ v[:, top]
                v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
                yield pd.DataFrame([[batch, n, width, v.tobytes(), mean, sd, np.sqrt(power / max(n - 1, 1)).tobytes()]], columns=[c.split()[0] for c in FITS.split(", ")])

    for turn in range(rounds + 1):
        z = _summed(held.join(fits.select("batch", "loadings", "mean", "sd"), "batch").mapInPandas(part, "batch string, part int, n long, z binary"), turned(turn == rounds), "batch string, n long, z binary")
        if turn < rounds:
            fits = cut(fits.drop("loadings").join(z.select("batch", F.col("z").alias("loadings")), "batch").select(*[c.split()[0] for c in FITS.split(", ")]))
    return cut(fits.drop("n").join(z, "batch").mapInPandas(ritz, FITS))


def _met(held: DataFrame, fits: DataFrame, on: str | None) -> DataFrame:
    spaces = fits.select(F.col("batch").alias("space"), "width", "loadings", "mean", "sd", "spread")
    return held.join(spaces, held["batch"] == spaces["space"]) if on is None else held.join(F.broadcast(spaces if on == "all" else spaces.filter(F.col("space") == on)))


def block_scores(held: DataFrame, fits: DataFrame, on: str | None = None) -> DataFrame:
    """(batch, space, block, ids, pc, spread): scores() of whole blocks, as binary doubles, and the deviations of the components."""
    kind = held.schema["ids"].dataType.simpleString()

    def run(frames):
        for f in frames:
            for batch, space, block, ids, idx, val, width, w, mean, sd, spread in zip(*[f[c] for c in ("batch", "space", "block", "ids", "idx", "val", "width", "loadings", "mean", "sd", "spread")], strict=True):
                mean = np.frombuffer(mean)
                w = np.frombuffer(w).reshape(width, -1) / np.frombuffer(sd)[:, None]
                y = np.concatenate([x @ w - mean @ w for x in _dense(idx, val, width)])
                yield pd.DataFrame([[batch, space, block, ids, y.tobytes(), spread]], columns=["batch", "space", "block", "ids", "pc", "spread"])

    met = _met(held, fits, on).select("batch", "space", "block", "ids", "idx", "val", "width", "loadings", "mean", "sd", "spread")
    return met.mapInPandas(run, f"batch string, space string, block int, ids {kind}, pc binary, spread binary")


def scores(held: DataFrame, fits: DataFrame, on: str | None = None) -> DataFrame:
    """(batch, space, id, pc): the cells of each batch in the components of `space`: their own batch's, of all batches with `on` "all",
    or of the batch that `on` names."""
    kind = held.schema["ids"].dataType.elementType.simpleString()

    def run(frames):
        for f in frames:
            for batch, space, ids, y in zip(*[f[c] for c in ("batch", "space", "ids", "pc")], strict=True):
                yield pd.DataFrame({"batch": batch, "space": space, "id": ids, "pc": list(np.frombuffer(y).reshape(len(ids), -1))})

    return block_scores(held, fits, on).select("batch", "space", "ids", "pc").mapInPandas(run, f"batch string, space string, id {kind}, pc array<double>")


def pca(rows: DataFrame, width: int, k: int = 50, scale: bool = False) -> tuple[DataFrame, DataFrame]:
    """FITS of each batch, and (batch, space, id, pc) of its cells."""
    held = cut(blocks(rows))
    fits = loadings(held, width, k, scale)
    return fits, scores(held, fits)

"""Regularised negative-binomial regression of counts on cells' depths: models of genes, residuals, corrected counts.

A gene's likelihood needs its counts only through sums and histograms, which are combined before anything moves, and the
sample's depths through the number of cells of each depth: absent counts take part without being rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homolith.functions import negbin

#: Genes with counts in fewer cells of a sample have no model; genes that one task fits at a time.
MIN_CELLS, BLOCK = 5, 32
MODEL = "sample string, gene string, b0 double, b1 double, theta double, gmean double"


def depths(counts: DataFrame) -> DataFrame:
    """sample, cell, total: the sum of each cell's counts; cells without any are left out."""
    return counts.groupBy("sample", "cell").agg(F.sum("value").alias("total")).filter("total > 0")


def fitted(counts: DataFrame, totals: DataFrame, min_cells: int = MIN_CELLS) -> DataFrame:
    """MODEL of each sample's genes, not yet smoothed; theta is null for a gene without overdispersion.

    Blocks of genes are fitted together. What moves is, for each gene, the number of cells of each (depth, count), and for each
    block the sample's histogram of depths; both are bounded by the values that there are, not by cells."""
    rows = counts.filter("value > 0").join(totals, ["sample", "cell"])
    known = rows.groupBy("sample", "gene").agg(F.count("*").alias("n")).filter(F.col("n") >= min_cells)
    blocks = max(1, -(-counts.select("gene").distinct().count() // BLOCK))
    block = F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int").alias("block")
    held = rows.groupBy("sample", "gene", "total", "value").agg(F.count("*").alias("n")).join(known.select("sample", "gene"), ["sample", "gene"], "left_semi").select("sample", block, "gene", "total", "value", "n")
    each = totals.groupBy("sample", "total").agg(F.count("*").alias("n")).groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("total", "n"))).alias("d"))
    each = each.select(F.col("sample").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), F.col("d.total").alias("depth"), F.col("d.n").alias("cells"))

    def fit(one: pd.DataFrame, depth: pd.DataFrame) -> pd.DataFrame:
        names = ["sample", "gene", "b0", "b1", "theta", "gmean"]
        if one.empty or depth.empty:
            return pd.DataFrame({n: pd.Series(dtype=str if i < 2 else float) for i, n in enumerate(names)})
        x, cells = np.log10(np.asarray(depth["depth"].iloc[0], float)), np.asarray(depth["cells"].iloc[0], float)
        genes, gene = np.unique(one["gene"].to_numpy(str), return_inverse=True)
        at, y, n = np.log10(one["total"].to_numpy(float)), one["value"].to_numpy(float), one["n"].to_numpy(float)
        total = lambda v: np.bincount(gene, v, minlength=len(genes))
        b0, b1 = negbin.poisson(x, cells, total(n * y), total(n * y * at))
        theta = negbin.dispersion(x, cells, b0, b1, gene, at, y, n)
        gmean = 10 ** (total(n * np.log10(1 + y)) / cells.sum()) - 1
        return pd.DataFrame({"sample": one["sample"].iloc[0], "gene": genes, "b0": b0, "b1": b1, "theta": np.where(np.isinf(theta), np.nan, theta), "gmean": gmean})[names]

    return held.groupBy("sample", "block").cogroup(each.groupBy("of", "part")).applyInPandas(fit, MODEL)


def model(counts: DataFrame, totals: DataFrame, min_cells: int = MIN_CELLS, factor: float = 3.0) -> DataFrame:
    """fitted(), smoothed over genes' means within each sample: one task holds a sample's genes, five numbers each."""

    def smooth(g: pd.DataFrame) -> pd.DataFrame:
        theta = g["theta"].fillna(np.inf).to_numpy()
        b0, b1, t = negbin.regularised(g["b0"].to_numpy(), g["b1"].to_numpy(), theta, g["gmean"].to_numpy(), factor)
        return g.assign(b0=b0, b1=b1, theta=np.where(t < 1e290, t, np.nan))

    return fitted(counts, totals, min_cells).groupBy("sample").applyInPandas(smooth, MODEL)


def scale(totals: DataFrame) -> DataFrame:
    """sample, top (the limit of residuals: the root of the number of cells) and middle (the median depth)."""
    return totals.groupBy("sample").agg(F.sqrt(F.count("*")).alias("top"), F.percentile("total", F.lit(0.5)).alias("middle"))


def value(what: str, y, total, of=F.col) -> F.Column:
    """A residual, or with `what` "data" the logarithm of one more than the count at the median depth that has this residual, of a
    count and a depth; of(name) are MODEL's and scale()'s columns."""
    spread = lambda mu: F.sqrt(mu + F.coalesce(mu * mu / of("theta"), F.lit(0.0)))
    mu = F.exp(of("b0") + of("b1") * F.log10(total))
    r = F.greatest(-of("top"), F.least(of("top"), (y - mu) / spread(mu)))
    if what == "residuals":
        return r
    if what != "data":
        raise ValueError("values are residuals or data")
    middle = F.exp(of("b0") + of("b1") * F.log10(of("middle")))
    return F.log1p(F.greatest(F.lit(0.0), F.rint(middle + r * spread(middle))))


def values(counts: DataFrame, totals: DataFrame, fits: DataFrame, what: str = "residuals") -> DataFrame:
    """(sample, cell, gene, value) of the counts that there are, of genes with a model; `fits` are scaled(). Absent ones have the value()
    of a count of 0, which differs by cell (and isn't 0, for residuals)."""
    rows = counts.filter("value > 0").join(totals, ["sample", "cell"]).join(fits, ["sample", "gene"])
    return rows.select("sample", "cell", "gene", value(what, F.col("value"), F.col("total")).alias("value"))


def scaled(fits: DataFrame, totals: DataFrame) -> DataFrame:
    """MODEL with scale(): what the values of a gene follow from."""
    return fits.join(F.broadcast(scale(totals)), "sample")

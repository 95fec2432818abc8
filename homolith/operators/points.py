"""From long matrices to vectors: genes as points over cells, cells as points over genes. What a long matrix lacks is filled in."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filled(entries: F.Column, fill: F.Column) -> F.Column:
    """The array `fill` with the values of `entries`, structs (place from 1 on, value) in order of place, in their places. Work is that
    of one copy: pieces of `fill` stand between the entries."""
    place = lambda i: F.coalesce(F.get(entries, i)["place"], F.lit(0))
    piece = lambda e, i: F.concat(F.slice(fill, place(i - 1) + 1, e["place"] - place(i - 1) - 1), F.array(e["value"]))
    last = place(F.size(entries) - 1)
    return F.concat(F.flatten(F.transform(entries, piece)), F.slice(fill, last + 1, F.size(fill) - last))


def _placed(rows: DataFrame, over: list[str], by: str) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*over).orderBy(by)))


def genes_as_points(matrix: DataFrame, cells: DataFrame, absent: DataFrame | None = None, fill: Callable | None = None) -> DataFrame:
    """(sample, point_id, vec): each gene of a sample as a point, whose coordinates are the sample's cells in order of their names.

    `cells` is (sample, cell, total). Absent values are 0, or fill(total) of each cell, an expression over the columns that `absent`
    (gene, and sample unless it holds for all) has of the gene; genes that `absent` lacks are filled with 0."""
    places = _placed(cells.select("sample", "cell", "total"), ["sample"], "cell")
    axis = places.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("place", "total"))).alias("axis")).select("sample", F.col("axis.total").alias("axis"))
    entry = F.struct("place", F.col("value").cast("double").alias("value"))
    rows = matrix.join(places.drop("total"), ["sample", "cell"]).groupBy("sample", "gene").agg(F.array_sort(F.collect_list(entry)).alias("entries")).join(axis, "sample")
    zeros = F.transform("axis", lambda t: F.lit(0.0))
    if absent is not None:
        rows = rows.join(absent.withColumn("__known", F.lit(True)), ["sample", "gene"] if "sample" in absent.columns else "gene", "left")
        zeros = F.when(F.col("__known"), F.transform("axis", fill)).otherwise(zeros)
    rows = rows.withColumn("base", zeros)
    return rows.select("sample", F.col("gene").alias("point_id"), filled(F.col("entries"), F.col("base")).alias("vec"))


def cells_as_points(matrix: DataFrame, cells: DataFrame, genes: DataFrame, absent: DataFrame | None = None, fill: Callable | None = None) -> DataFrame:
    """(sample, point_id, vec): each cell as a point (named sample, tab, cell) over the genes of `genes` (gene, place from 1 on).

    Absent values are 0, or fill(total, gene's columns) with `absent` as in genes_as_points(); every cell has a row."""
    kept = matrix.join(F.broadcast(genes), "gene")
    entry = F.struct(F.col("place").cast("int").alias("place"), F.col("value").cast("double").alias("value"))
    rows = kept.groupBy("sample", "cell").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    rows = cells.select("sample", "cell", "total").join(rows, ["sample", "cell"], "left").withColumn("entries", F.coalesce("entries", F.array().cast("array<struct<place:int,value:double>>")))
    known = genes.select("gene", "place")
    if absent is None:
        base = known.agg(F.array_sort(F.collect_list("place")).alias("axis"))
        rows = rows.join(F.broadcast(base)).withColumn("base", F.transform("axis", lambda p: F.lit(0.0)))
    else:
        own = [c for c in absent.columns if c not in ("sample", "gene")]
        keys = ["sample"] if "sample" in absent.columns else []
        # Of a sample that has no model of a gene the columns are null, and so is fill(): 0.
        every = known if not keys else absent.select("sample").distinct().join(F.broadcast(known))
        axis = every.join(absent, [*keys, "gene"], "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", *own))).alias("axis"))
        rows = rows.join(axis, "sample", "left") if keys else rows.join(F.broadcast(axis))
        rows = rows.withColumn("base", F.transform("axis", lambda g: F.coalesce(fill(F.col("total"), lambda c: g[c]), F.lit(0.0))))
    return rows.select("sample", F.concat_ws("\t", "sample", "cell").alias("point_id"), filled(F.col("entries"), F.col("base")).alias("vec"))


def variances(points: DataFrame) -> DataFrame:
    """(sample, gene, v): the variance of each point's coordinates; none with one coordinate. In numpy: as expressions over arrays the
    vectors, themselves expressions, would be made again for each coordinate."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"sample": f["sample"], "gene": f["point_id"], "v": [float(np.var(v, ddof=1)) if len(v) > 1 else None for v in f["vec"]]})

    return points.select("sample", "point_id", "vec").mapInPandas(run, "sample string, gene string, v double")


def features(variance: DataFrame, top: int) -> DataFrame:
    """(gene, place from 1 on): genes that are among the `top` of largest variance in most samples, of equal ones those with the better
    median rank; at most `top`, in order of their names."""
    rank = F.row_number().over(Window.partitionBy("sample").orderBy(F.col("v").desc(), "gene"))
    ranked = variance.filter("v IS NOT NULL").select("gene", rank.alias("r")).filter(F.col("r") <= top)
    best = ranked.groupBy("gene").agg(F.count("*").alias("n"), F.percentile("r", F.lit(0.5)).alias("m")).orderBy(F.col("n").desc(), "m", "gene").limit(top)
    return best.select("gene").withColumn("place", F.row_number().over(Window.orderBy("gene")))


def as_matrix(cells: DataFrame, genes: DataFrame) -> DataFrame:
    """(sample, cell, gene, value): the vectors of cells_as_points() as a long matrix."""
    rows = cells.select("sample", F.split("point_id", "\t")[1].alias("cell"), F.posexplode("vec").alias("p", "value"))
    return rows.join(F.broadcast(genes), F.col("p") + 1 == F.col("place")).select("sample", "cell", "gene", "value")

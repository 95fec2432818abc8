"""Community search on neighbour graphs: shared-neighbour weights, modularity moves, contraction. Several graphs at once, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homolith.operators import pairs
from homolith.sources.cuts import tabled as cut

#: Neighbours of a point, itself included; edges of less weight are left out; passes over a graph and contractions at most.
K, PRUNE, PASSES, LEVELS = 20, 1 / 15, 24, 12


def nearest(points: DataFrame, k: int = K) -> DataFrame:
    """(graph, id, near): each point's k - 1 nearest others of its graph (the column sample) and itself, by Euclidean distance, ties to the
    smaller id."""
    found = pairs.within(points, "sample", k - 1, 12)
    return found.select(F.col("s").alias("graph"), "id", F.array_sort(F.array_append("near", F.col("id"))).alias("near"))


def shared(near: DataFrame, prune: float = PRUNE) -> DataFrame:
    """(graph, p, q, w), both ways: points of which one is a neighbour of the other, weighed by the Jaccard similarity of their neighbours.
    (Points joined by third ones alone have no edge: a hub's neighbours aren't paired.)"""
    one = near.select("graph", F.col("id").alias("p"), F.col("near").alias("a"), F.explode("near").alias("q")).filter("p <> q")
    both = one.join(near.select("graph", F.col("id").alias("q"), F.col("near").alias("b")), ["graph", "q"])
    n = F.size(F.array_intersect("a", "b"))
    edges = both.select("graph", "p", "q", (n / (F.size("a") + F.size("b") - n)).alias("w")).filter(F.col("w") >= prune)
    return edges.unionByName(edges.select("graph", F.col("q").alias("p"), F.col("p").alias("q"), "w")).groupBy("graph", "p", "q").agg(F.max("w").alias("w"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(graph, modularity) of labels (graph, id, label). Edges stand both ways; a loop stands once with twice its weight."""
    end = lambda c, n: labels.select("graph", F.col("id").alias(c), F.col("label").alias(n))
    rows = edges.join(end("p", "lp"), ["graph", "p"]).join(end("q", "lq"), ["graph", "q"])
    per = rows.groupBy("graph", F.col("lp").alias("label")).agg(F.sum("w").alias("k"), F.sum(F.when(F.col("lp") == F.col("lq"), F.col("w")).otherwise(0.0)).alias("inside"))
    return per.groupBy("graph").agg(F.sum("k").alias("m"), F.sum("inside").alias("i"), F.sum(F.col("k") * F.col("k")).alias("kk")).select("graph", (F.col("i") / F.col("m") - resolution * F.col("kk") / (F.col("m") * F.col("m"))).alias("modularity"))


def _moves(edges: DataFrame, resolution: float, passes: int) -> DataFrame:
    """(graph, id, label): single points moved to the community of a neighbour that raises modularity most.

    Points of a pass decide at once, a part of them by hash, so that two don't change places for ever; a pass is a join of the
    edges with the labels and two sums. A graph is done after all parts in turn have moved nothing."""
    degree = cut(edges.groupBy("graph", F.col("p").alias("id")).agg(F.sum("w").alias("k")))
    m = F.broadcast(degree.groupBy("graph").agg(F.sum("k").alias("m")))
    labels, still = degree.select("graph", "id", F.col("id").alias("label"), "k"), 0
    links, parts = edges.filter("p <> q"), 2
    for turn in range(passes):
        total = labels.groupBy("graph", "label").agg(F.sum("k").alias("t"))
        heard = links.join(labels.select("graph", F.col("id").alias("q"), "label"), ["graph", "q"]).groupBy("graph", F.col("p").alias("id"), "label").agg(F.sum("w").alias("w"))
        own = labels.select("graph", "id", "label", F.lit(0.0).alias("w"))
        choice = heard.unionByName(own).groupBy("graph", "id", "label").agg(F.sum("w").alias("w"))
        choice = choice.join(total, ["graph", "label"]).join(labels.select("graph", "id", "k", F.col("label").alias("now")), ["graph", "id"]).join(m, "graph")
        stays = F.col("label") == F.col("now")
        gain = F.round(F.col("w") - resolution * F.col("k") * (F.col("t") - F.when(stays, F.col("k")).otherwise(0.0)) / F.col("m"), 12)
        # Of equal gains the own community, then the smaller.
        best = choice.groupBy("graph", "id", "k", "now").agg(F.min_by("label", F.struct(-gain, ~stays, F.col("label"))).alias("new"))
        free = F.pmod(F.xxhash64("id", F.lit(turn // parts)), F.lit(parts)) == turn % parts
        moved = cut(best.select("graph", "id", "k", "now", F.when(free, F.col("new")).otherwise(F.col("now")).alias("label")))
        still = still + 1 if moved.filter("label <> now").isEmpty() else 0
        labels = moved.select("graph", "id", "label", "k")
        if still == parts:
            break
    return labels.select("graph", "id", "label")


def communities(edges: DataFrame, resolution: float = 0.5, passes: int = PASSES, levels: int = LEVELS) -> DataFrame:
    """(graph, id, label) of edges (graph, p, q, w), which stand both ways: moves, then each community is one point and its inner edges a
    loop, until no community joins another. Labels are a point of the community (its smallest one). Points without edges aren't in it."""
    edges = cut(edges.groupBy("graph", "p", "q").agg(F.sum("w").alias("w")))
    found = edges.select("graph", F.col("p").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(levels):
        step = cut(_moves(edges, resolution, passes))
        if step.filter("id <> label").isEmpty():
            break
        found = cut(found.join(step.select("graph", F.col("id").alias("label"), F.col("label").alias("to")), ["graph", "label"]).select("graph", "id", F.col("to").alias("label")))
        end = lambda c, n: step.select("graph", F.col("id").alias(c), F.col("label").alias(n))  # noqa: B023, E731
        edges = cut(edges.join(end("p", "lp"), ["graph", "p"]).join(end("q", "lq"), ["graph", "q"]).groupBy("graph", F.col("lp").alias("p"), F.col("lq").alias("q")).agg(F.sum("w").alias("w")))
    least = found.groupBy("graph", "label").agg(F.min("id").alias("least"))
    return found.join(least, ["graph", "label"]).select("graph", "id", F.col("least").alias("label"))


def clustered(points: DataFrame, k: int = K, resolution: float = 0.5) -> DataFrame:
    """(graph, id, label): communities of the graph of shared nearest neighbours of each sample's points."""
    return communities(shared(cut(nearest(points, k))), resolution)

"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, unit_draw, written

#: Weights that the sources get in turn, by code point, null last.
WEIGHTS = (5, 2, 1)
#: A source is repeated so many times at most.
MOST = 3
SEED = 8


def with_size(docs: DataFrame, text: str = "text", size: str = "size") -> DataFrame:
    """The number of words of each text; a null text has none."""
    return docs.withColumn(size, F.coalesce(F.size(F.split(F.trim(F.regexp_replace(F.col(text), "[\\x20\\x09-\\x0D]+", " ")), " ")), F.lit(0)).cast("long")).withColumn(
        size, F.when(F.coalesce(F.col(text), F.lit("")).rlike("[^\\x20\\x09-\\x0D]"), F.col(size)).otherwise(F.lit(0).cast("long"))
    )


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, none above `most` times its source.

    The excess of a source at its limit goes to the others by weight until none is above its limit. That is
    target = min(limit, weight * level) with one level for all sources, found by putting the sources in the order in
    which a rising level reaches their limits. The table has a row for each source, so its windows are over aggregated
    rows. Sources without words get target 0; an empty table gives an empty table.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("__n", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__n") % len(weights) + 1).cast("int"))
    per = per.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * float(most))
    by_reach = Window.orderBy((F.col("__cap") / F.col("__w")).asc(), F.col("__n").asc())
    to_here, everything = by_reach.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = (
        per.withColumn("__total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("__capped", F.coalesce(F.sum("__cap").over(to_here), F.lit(0.0)))
        .withColumn("__left", F.sum("__w").over(by_reach.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__level", (F.col("__total") - F.col("__capped")) / F.col("__left"))
        .withColumn("__free", F.col("__w") * F.col("__level") <= F.col("__cap"))
    )
    level = F.min(F.when(F.col("__free"), F.struct("__capped", "__level"))).over(everything)["__level"]
    per = per.withColumn("__level", level)
    return per.select("source", "source_size", F.when(F.col("__level").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__w") * F.col("__level"))).alias("target"))


def planned(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Every document with size, source_size, target, copies and taken.

    rate = target / source_size; a document is taken floor(rate) times, and once more if its draw, hashed from seed
    and key, is below the fraction of the rate. Repeated rows with one key get one draw, a null key draws as an empty
    text, a null source is a source of its own. Documents without words count 0 words and follow the rate of their
    source (a source without any words is taken once). Other columns are not read.
    """
    spark = docs.sparkSession
    # Counted once: the sums and the plan read this narrow table.
    sizes = with_size(docs.select(key, source, text), text).select(F.col(key).alias("doc_id"), F.col(source).alias("source"), "size")
    sizes, _ = written(spark, sizes, "mix")
    targets, _ = written(spark, source_targets(sizes, weights=weights, most=most).withColumnRenamed("source", "__mix_source"), "mix-targets")
    # The size of a written table is known before the join: small targets are broadcast and no document is moved; else AQE
    # splits a hot source.
    out = sizes.join(targets, F.col("source").eqNullSafe(F.col("__mix_source")), "left").drop("__mix_source")
    return with_copies(out, F.col("doc_id"), seed)


def with_copies(df: DataFrame, key, seed: int) -> DataFrame:
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    df = df.withColumn("rate", rate)
    extra = (unit_draw(seed, key) < F.col("rate") - F.floor("rate")).cast("long")
    return df.withColumn("copies", F.floor("rate").cast("long") + extra).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each row of docs, with docs' columns, as many times as planned() has it."""
    spark = docs.sparkSession
    sizes, _ = written(spark, with_size(docs.select(source, text), text, "size").select(F.col(source).alias("source"), "size"), "mix")
    own_source, own_size, own_target, copy = fresh(docs, "__mix_source", "__mix_size", "__mix_target", "__mix_copy")
    rates = source_targets(sizes, weights=weights, most=most).select(F.col("source").alias(own_source), F.col("source_size").alias(own_size), F.col("target").alias(own_target))
    rates, _ = written(spark, rates, "mix-targets")
    joined = docs.join(rates, F.col(source).eqNullSafe(F.col(own_source)), "left")
    rate = F.when(F.col(own_size) > 0, F.col(own_target) / F.col(own_size)).otherwise(F.lit(1.0))
    copies = F.floor(rate).cast("int") + (unit_draw(seed, F.col(key)) < rate - F.floor(rate)).cast("int")
    return joined.withColumn(copy, F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")))).select(*docs.columns)

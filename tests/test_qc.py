import numpy as np
import pytest
from pyspark.sql import functions as F

from homolith.functions.sqlop import Op
from homolith.operators import qc


def test_centred_equals_dense(spark):
    draw = np.random.default_rng(9)
    y = draw.poisson(0.7, size=(9, 5)).astype(float)
    y[:4, 0] = 0  # a gene that the first sample lacks
    y[8] = [2, 0, 0, 0, 0]
    who = ["a"] * 4 + ["b"] * 5
    rows = [(who[i], i, f"g{j}", float(y[i, j])) for i in range(9) for j in range(5) if y[i, j]] + [("a", i, "g4", 0.0) for i in range(4) if not y[i, 4]]
    rows += [("b", 8, None, 7.0)]  # a count of no gene has no mean
    counts = spark.createDataFrame(rows, "sample string, cell long, gene string, value double")
    got = qc.centred(Op("counts", "")).over(spark, counts=counts).collect()
    cells = sorted({i for _, i, _, _ in rows})
    z, of = y[cells], np.array([who[i] for i in cells])
    want = z - np.stack([z[of == s].mean(axis=0) for s in of]) + z.mean(axis=0)
    genes = [j for j in range(5) if any(r[2] == f"g{j}" for r in rows)]
    assert len(got) == len(cells) * len(genes)
    assert {(r["sample"], r["cell"], r["gene"]): r["value"] for r in got} == pytest.approx({(of[k], i, f"g{j}"): want[k, j] for k, i in enumerate(cells) for j in genes}, abs=1e-6)


def test_centred_cells_of_a_sample_are_in_several_tasks(spark):
    s = spark.newSession()
    s.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    s.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    counts = s.range(400).select(F.lit("a").alias("sample"), F.col("id").alias("cell"), F.lit("g").alias("gene"), F.lit(1.0).alias("value"))
    assert qc.centred(Op("counts", "")).over(s, counts=counts).select(F.spark_partition_id()).distinct().count() > 1

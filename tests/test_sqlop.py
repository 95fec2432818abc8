from pyspark.sql import functions as F

from homolith.functions import sqlop
from homolith.functions.sqlop import Op


def test_tasks_stay_small(spark, monkeypatch):
    monkeypatch.setattr(sqlop, "TASK_BYTES", "64k")
    parts = lambda s: Op("sums", "SELECT k, sum(v) AS v FROM {rows} GROUP BY k").over(s, rows=s.range(200_000).select(F.xxhash64("id").alias("k"), F.col("id").alias("v")))
    tasks = {}
    for own in (None, "16m"):
        s = spark.newSession()
        s.conf.set("spark.sql.shuffle.partitions", "32")
        s.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
        if own:
            s.conf.set(sqlop.TASK, own)
        out = parts(s)
        assert s.conf.get(sqlop.TASK) == (own or "64k")
        tasks[own] = out.select(F.spark_partition_id()).distinct().count()
        assert out.agg(F.sum("v")).first()[0] == 200_000 * 199_999 // 2
    # A session's own setting is kept.
    assert tasks[None] > 16 > tasks["16m"]

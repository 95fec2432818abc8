"""New samples as they arrive: a stream of points adds diagrams of samples that the table doesn't have."""

from __future__ import annotations

from pyspark.sql import DataFrame

from homolith.operators import topology
from homolith.sources.tables import exists


def add_diagrams(points: DataFrame, table: str, checkpoint: str):
    """Starts a query over a stream of (sample, point_id, vec). A batch that runs again adds nothing twice."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if exists(spark, table):
            batch = batch.join(spark.read.parquet(table).select("sample").distinct(), "sample", "left_anti")
        topology.diagrams(batch).write.mode("append").parquet(table)

    return points.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

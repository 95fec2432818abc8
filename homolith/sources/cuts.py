"""Lineage cut in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    """The checkpoint folder that spark.checkpoint.dir names; a temporary one where all is one process."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="homolith-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df computed once, in the checkpoint folder."""
    _folder(df)
    return df.checkpoint()


def tabled(df: DataFrame) -> DataFrame:
    """df computed once, as a table in the checkpoint folder. Unlike a checkpoint it brings no constraints of its former plan along, which
    in a loop of joins grow from round to round until planning takes longer than the work."""
    path = f"{_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

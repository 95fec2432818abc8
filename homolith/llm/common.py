"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that removes shuffle files at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all is one
    process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="homolith-"))
    return _own_dir[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, label: str, **options: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back, which cuts its lineage; and its path, for drop(). Options are the writer's.

    What it shuffled is removed at once: no later plan reads it (a task that is lost before then still finds it, or has
    its stage run again)."""
    path = new_path(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Long texts: few rows for each Arrow batch, so that a Python worker holds a few MB at a time. A session that has its own
    setting keeps it; the setting stays, as plans read it when they run."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, "512")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, or if df has a column of that name, one made of it that df hasn't."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def release() -> None:
    """Gives memory that the allocators keep for later back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """run, a function of a task's batches, that releases memory now and then and at its end: Python workers outlive a
    task, and what one stage's workers keep would stand beside what the next stage needs."""

    def tidied(batches):
        for n, out in enumerate(run(batches)):
            yield out
            del out
            if n % 32 == 31:
                release()
        release()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_draw(seed: int, *keys) -> F.Column:
    """A number in [0, 1) from an MD5 of the seed and the keys; the same in any engine that has MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)

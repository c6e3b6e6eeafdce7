"""Python workers must find this package, wherever the session was started from."""

from __future__ import annotations

import atexit
import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Arrow batches by rows and bytes where the session has Spark's defaults: texts are long, and a batch is held by the
#: executor and, copied, by its Python worker, once for each task that runs.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


#: Python workers give large arrays back to the system as they go; they live as long as their executor, whose memory they share.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "MALLOC_ARENA_MAX": "2"}


def ready(spark: SparkSession) -> SparkSession:
    """Puts the package's folder on the workers' path, keeps Arrow batches small and workers lean. On a cluster whose nodes do not
    have that folder, ship the package with ``--py-files``."""
    for key, (default, value) in BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)
    for key, value in WORKERS.items():
        spark.sparkContext.environment.setdefault(key, value)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, ROOT]))
    return spark


#: Used only where the session names no shared folder and runs on one machine, as in tests.
DEFAULT_SHARED = "/tmp/checkpoints/claimlake"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where a local session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(DEFAULT_SHARED)
        found = DEFAULT_SHARED
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _at_end(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session may be gone before the interpreter ends
        pass


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, removed when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/claimlake-{uuid.uuid4().hex}"
    atexit.register(_at_end, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its plan runs once, its lineage ends, and Spark knows its size."""
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's setting to remove an execution's shuffle files when it ends, not when the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go with the job that wrote them; for steps none of whose frames runs twice."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before) if before is not None else spark.conf.unset(TIDY)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly to two tasks a core, or to as many as it has: for work that costs far more than reading the rows. Small
    files make few scan tasks, and row groups go whole to one."""
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(tasks, df.rdd.getNumPartitions()))

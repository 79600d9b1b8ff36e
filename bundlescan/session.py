"""Session helpers: sane defaults for the scan jobs and a shared checkpoint folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch of rows that may hold whole files; one row alone may be larger.
BATCH_BYTES = 8 * 1024 * 1024

DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # scanning is CPU-bound (~150 regex passes per file): smaller input splits give shorter,
    # better balanced tasks and cheaper recomputation when an executor is lost
    "spark.sql.files.maxPartitionBytes": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows can hold whole files (an archive up to 500 MiB): bound Arrow batches by bytes both
    # ways for the Python stages (archive unpacking, optional encoder), not only by rows
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    "spark.sql.execution.arrow.maxBytesPerOutputBatch": str(64 * 1024 * 1024),
}


def get_spark(master: str | None = None, app: str = "bundlescan", **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``. Unset, a scratch
    folder of this machine serves, in local mode only: on a cluster executors could not see it."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return configured or current
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: computed once for all that use it, and whatever
    executors are lost."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES (Spark's default is 64 MiB): every worker of an executor holds
    one, next to what it makes of it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    with contextlib.suppress(ValueError):  # a size with a unit, like Spark's default
        if 0 < int(spark.conf.get(key)) <= BATCH_BYTES:
            return
    spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Give back to the system what this worker has freed: workers outlive their tasks, and the next
    stage's need would come on top of the largest of all before it."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: functions of its modules
    are pickled by reference, and executors need not have the package installed."""
    sc = spark.sparkContext
    if getattr(sc, "_bundlescan_shipped", False):
        return
    package = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{package.name}-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(path)
    sc._bundlescan_shipped = True

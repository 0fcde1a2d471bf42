"""Session set-up, scratch space and timed steps (K4, K5).

Sizes (memory, cores, shuffle width) belong to whoever submits the job; the
builder here only pins what results depend on (UTC, ANSI) and what keeps the
plans adaptive (AQE, skew-join splitting, partition coalescing).
"""

from __future__ import annotations

import atexit
import os
import tempfile
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(
    master: str | None = None,
    app: str = "strata",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Return (or create) a session with the engine defaults applied.

    ``shuffle_partitions`` is only set when given: on a cluster the submitter
    sizes it (AQE coalesces small partitions at run time anyway).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def scale_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Session settings sized for an input (K4): scan splits and shuffle
    partitions of about ``partition_bytes`` each, at least two waves of tasks,
    and AQE's advisory size and skew thresholds on the same scale. Pass the
    result to ``get_session(conf=...)`` or to spark-submit.

    Example: 100 TB on 1000 executors x 8 cores gives ~400k shuffle
    partitions of 256 MB (AQE coalesces what turns out smaller).
    """
    shuffle = max(2 * total_cores, -(-int(input_bytes) // partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session; only when it is unset in a local-mode session
    (tests, single-machine runs) a private folder is created and registered.
    A cluster session without the setting is an error: a folder on the
    driver's disk is not visible to executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="strata-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the checkpoint root for intermediate tables."""
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/strata-scratch/{name}-{uuid.uuid4().hex[:12]}"
    _scratch[path] = spark
    return path


_scratch: dict[str, SparkSession] = {}


@atexit.register
def sweep() -> None:
    """Delete the scratch folders that this driver made and nobody released."""
    for path, spark in list(_scratch.items()):
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return
        _scratch.pop(path, None)


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme so Python tooling can see a local path."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return path


def delete_path(spark: SparkSession, path: str) -> bool:
    """Recursive delete through the Hadoop file system of the path."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(hpath, True))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once as parquet under the checkpoint root and read it back.

    Cuts lineage like ``checkpoint()`` (the data lives in the shared
    checkpoint folder, so a lost executor does not recompute upstream
    stages) in a single job: ``Dataset.checkpoint`` evaluates its input
    twice unless it is also cached.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._strata_scratch = path
    return out


def release(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``; nothing may read it any more."""
    path = getattr(df, "_strata_scratch", None)
    if path:
        delete_path(df.sparkSession, path)
        _scratch.pop(path, None)


class temp_output:
    """Context manager: a scratch path removed on exit, also on failure."""

    def __init__(self, spark: SparkSession, name: str = "tmp"):
        self.spark = spark
        self.path = scratch_path(spark, name)

    def __enter__(self) -> str:
        return self.path

    def __exit__(self, *exc: Any) -> None:
        try:
            delete_path(self.spark, self.path)
        except Exception:  # cleanup must not mask the original error
            pass


TIMING_SCHEMA = T.StructType(
    [
        T.StructField("step", T.StringType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("rows", T.LongType()),
    ]
)


def timed(step: str, action: Callable[[], Any]) -> tuple[Any, tuple[str, float, int | None]]:
    """Run an action, return its result and a (step, seconds, rows) record (K5)."""
    t0 = time.perf_counter()
    result = action()
    secs = time.perf_counter() - t0
    rows = result if isinstance(result, int) else None
    return result, (step, round(secs, 3), rows)


def timings_frame(spark: SparkSession, records: list[tuple[str, float, int | None]]) -> DataFrame:
    """Timing records as a table, ready to be written next to the outputs."""
    return spark.createDataFrame(records, TIMING_SCHEMA)


def literal_ts(value: str):
    """A TIMESTAMP_NTZ literal column; tests and plans pass clocks explicitly."""
    return F.expr(f"TIMESTAMP_NTZ '{value}'")


def env_int(name: str, default: int) -> int:
    try:
        return int(os.environ.get(name, default))
    except ValueError:
        return default

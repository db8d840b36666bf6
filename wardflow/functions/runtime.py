"""Session helpers: the shared checkpoint folder and tables written to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_DIR: str | None = None
_WRITTEN: list[tuple[SparkSession, str]] = []
_TABLES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one on a local master; on a cluster that raises.

    Executors of a cluster would each write to a disk of their own, and rows would be lost.
    """
    global _LOCAL_DIR
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = "file://" + tempfile.mkdtemp(prefix="wardflow-")
    return _LOCAL_DIR


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that lost executors cost no recomputation.

    The table is parquet, so later reads prune columns and carry size statistics for join planning. Shuffle files of the job are
    deleted with its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wardflow-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _WRITTEN.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    _TABLES[table] = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables returned by :func:`materialize` now; nothing that is still to run may read them."""
    for table in tables:
        path = _TABLES.pop(table)
        _WRITTEN.remove((table.sparkSession, path))
        _delete(table.sparkSession, path)


def scratch(spark: SparkSession, name: str = "files") -> str:
    """A new folder in the shared one, deleted like the tables of :func:`materialize`."""
    path = f"{shared_dir(spark)}/wardflow-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def release() -> None:
    """Delete every table written by :func:`materialize` in this process."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone at exit
            pass


atexit.register(release)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer partitions than there are; else as it is.

    For inputs of a few files that cost much CPU a row. A table of many files is never shuffled by it.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_catalogued: dict[str, str] = {}  # names of written tables that have buckets, by path


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the session names none, a temporary folder in local mode (as in tests), else an error:
    on a cluster every executor would write to a disk of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: its lineage ends here, and lost executors cost no recomputation beyond it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def deal(parts: list[DataFrame], name: str, tasks: int, key: str) -> DataFrame:
    """parts as one written table in buckets of key: a join on key in as many tasks reads it as it lies, without a shuffle. The parts are
    written one after another, and the shuffle files of one go before the next."""
    spark, name = parts[0].sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    for d in parts:
        d.repartition(tasks, key).write.mode("append").format("parquet").option("compression", "zstd").option("path", path).bucketBy(tasks, key).saveAsTable(name)
        if path not in _written:
            _written.append(path)
            _catalogued[path] = name
        if tasks > 1:
            forget(spark)
    out = spark.table(name)
    out._written = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut has written, once nothing reads them any more; others are left alone."""
    for t in tables:
        path = getattr(t, "_written", None)
        if path in _written:
            _written.remove(path)
            _delete(t.sparkSession, path)


@contextmanager
def shuffled_joins(spark: SparkSession):
    """Within it, joins are shuffled and none is broadcast. The planner goes by the bytes of files, and ids pack so well that a file of less
    than ten megabytes held 1.9 million of them: 256 MB in the driver for one join, and as much in every executor."""
    first, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    with _settings(spark, {n: "-1" for n in (first, adaptive) if n == first or spark.conf.get(n, None) is not None}):  # adaptive follows the first if unset
        yield


def dealt_groups(spark: SparkSession, tasks: int):
    """Within it, groups are dealt to so many tasks, after each task has put together what it holds of a group."""
    return _settings(spark, {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false"})


@contextmanager
def _settings(spark: SparkSession, new: dict[str, str]):
    old = {n: spark.conf.get(n) for n in new}
    for n, v in new.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in old.items():
            spark.conf.set(n, v)


def forget(spark: SparkSession) -> None:
    """Shuffle files go when no plan refers to them any more, but Spark looks for that only every half hour; between steps
    whose results are written, this makes it look at once, so a long job does not keep the files of all its steps. The
    first round lets go of what Python refers to, the next ones of what hung on that."""
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def release(spark: SparkSession) -> int:
    """Deletes the tables that this process has written, once no result that reads them is needed; how many there were."""
    n = len(_written)
    while _written:
        _delete(spark, _written.pop())
    return n


def _delete(spark: SparkSession, path: str) -> None:
    if path in _catalogued:
        spark.sql(f"DROP TABLE IF EXISTS {_catalogued.pop(path)}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

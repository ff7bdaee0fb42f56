"""Session helpers shared by every operator: shared-folder tables and bounded collects."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it in ``spark.checkpoint.dir``.

    Only where the setting is absent and all tasks run in this process (local tests), a folder of our own is created,
    recorded in the session, and removed at the end. On a cluster an absent setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="gleaner-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone; its folder is removed with it
        pass


def table_in_shared_dir(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet into the shared folder and returns a scan of it.

    It cuts lineage like a checkpoint, survives the loss of executors, and keeps columnar pruning for its readers. The
    session's ``drop_tables`` removes what its queries have written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gleaner-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.setdefault(spark, []).append(path)
    return spark.read.parquet(path)


_written: weakref.WeakKeyDictionary[SparkSession, list[str]] = weakref.WeakKeyDictionary()


def drop_tables(spark: SparkSession) -> int:
    """Removes the tables that queries of this session have written so far; results that weren't read yet can't be after it."""
    paths = _written.pop(spark, [])
    for p in paths:
        _drop(spark, p)
    return len(paths)


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """Collects ``df`` after proving that it has at most ``limit`` rows; raises otherwise."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows, which is its documented bound")
    return rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """As ``table``, for work that takes long for each row: a file that can't be cut into enough tasks for half of the cores is
    spread over all of them. Rows and results are the same; a large table is never shuffled by it."""
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() <= cores else rows

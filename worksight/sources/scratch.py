"""Where results live: outputs in the warehouse, intermediates in the checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
WAREHOUSE_DIR = "spark.sql.warehouse.dir"
# whether Spark removes the shuffle files of a query when it ends, not when it notices later
# that nothing refers to them
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# bytes of rows that a Python worker is sent at once
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

# what stored() keeps per application, until release()
_kept: dict[str, list] = {}


def shared_dir(spark: SparkSession) -> str | None:
    """The folder the cluster names for intermediates, or None."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/") if folder else None


def _table_path(spark: SparkSession, folder: str, name: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{folder.rstrip('/')}/worksight/{app}/{name}-{uuid.uuid4().hex}"


def output_path(spark: SparkSession, name: str) -> str:
    """A new path for a real output, such as the risk table, in Spark's warehouse."""
    return _table_path(spark, spark.conf.get(WAREHOUSE_DIR), name)


def new_table_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate that every executor can reach."""
    folder = shared_dir(spark) or spark.conf.get(WAREHOUSE_DIR)
    return _table_path(spark, folder, name)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def without_leftovers(spark: SparkSession):
    """Queries that run in here leave no shuffle files behind; for writes of whole frames."""
    return _setting(spark, SHUFFLE_CLEANUP, "true")


def small_batches(spark: SparkSession, size: int):
    """Queries planned in here send Python workers batches of about so many bytes, or of one row.

    Spark's own bound lets rows of megabytes add up, in the JVM and again in the worker.
    """
    return _setting(spark, BATCH_BYTES, f"{size}b")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame computed once: a Parquet table in the shared folder, read back.

    The table cuts the lineage and outlives executors, is pruned by column, and its
    size is known to the planner. Without a shared folder the frame is persisted by
    Spark instead, which recomputes what a lost executor held.
    """
    spark = df.sparkSession
    if not shared_dir(spark):
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        _kept.setdefault(spark.sparkContext.applicationId, []).append(kept)
        return kept
    path = new_table_path(spark, name)
    with without_leftovers(spark):
        df.write.option("compression", "zstd").parquet(path)
    _kept.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_path(spark: SparkSession, path: str) -> None:
    """Count files under ``path`` among what ``release`` gives back."""
    _kept.setdefault(spark.sparkContext.applicationId, []).append(path)


def kept(spark: SparkSession) -> list:
    """What this application keeps now; a later list holds what came after, too."""
    return list(_kept.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, items: list | None = None) -> int:
    """Give back everything ``stored()`` keeps for this application, or some items of it.

    Frames built on it can't be read any more. Returns how many were released.
    """
    mine = _kept.get(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    chosen = [x for x in mine if items is None or any(x is item for item in items)]
    for item in chosen:
        if isinstance(item, str):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(item)
            path.getFileSystem(hadoop).delete(path, True)
        else:
            item.unpersist()
    mine[:] = [x for x in mine if not any(x is item for item in chosen)]
    return len(chosen)

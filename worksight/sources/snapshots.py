"""Tables that are replaced while others read them: versions in folders of their own.

A version is claimed by an exclusive marker file, written to its own folder and committed by a
second marker. Readers take the highest committed version and stay bound to its folder, so they
see a whole old or a whole new table, never none. Old versions stay until they are expired.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MARKERS = "_versions"
_DIGITS = 12


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = hadoop_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, hadoop_path


def _folder(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/version={version:0{_DIGITS}d}"


def _marker(path: str, version: int, state: str) -> str:
    return f"{path.rstrip('/')}/{_MARKERS}/{version:0{_DIGITS}d}.{state}"


def _marked(spark: SparkSession, path: str, state: str) -> list[int]:
    system, hadoop_path = _file_system(spark, path)
    folder = hadoop_path(f"{path.rstrip('/')}/{_MARKERS}")
    if not system.exists(folder):
        return []
    names = (entry.getPath().getName() for entry in system.listStatus(folder))
    return sorted(int(name.split(".")[0]) for name in names if name.endswith(f".{state}"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, oldest first."""
    return _marked(spark, path, "committed")


def _write_parquet(df: DataFrame, folder: str) -> None:
    df.write.parquet(folder)


def publish(
    df: DataFrame, path: str, write: Callable[[DataFrame, str], None] = _write_parquet
) -> int:
    """Write the frame as the next version of the table at ``path``; returns its number.

    Versions of several writers at once get different numbers. If writing fails, nothing is
    committed and readers keep the version they have.
    """
    spark = df.sparkSession
    system, hadoop_path = _file_system(spark, path)
    version = max(_marked(spark, path, "claimed"), default=0) + 1
    while not system.createNewFile(hadoop_path(_marker(path, version, "claimed"))):
        version += 1
    write(df, _folder(path, version))
    system.createNewFile(hadoop_path(_marker(path, version, "committed")))
    return version


def location(spark: SparkSession, path: str, version: int | None = None) -> str:
    """The folder of a committed version, of the newest one by default."""
    committed = versions(spark, path)
    if not committed:
        raise LookupError(f"no committed version at {path}")
    if version is None:
        version = committed[-1]
    elif version not in committed:
        raise LookupError(f"version {version} at {path} is not committed; there are {committed}")
    return _folder(path, version)


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A committed version as a frame, which stays bound to it when others are published."""
    return spark.read.parquet(location(spark, path, version))


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete all but the newest ``keep`` committed versions; returns what went.

    The commit goes first, so that no reader chooses a version that is being deleted; frames
    bound to it can't be read any more.
    """
    if keep < 1:
        raise ValueError("keep at least one version")
    system, hadoop_path = _file_system(spark, path)
    old = versions(spark, path)[:-keep]
    for version in old:
        system.delete(hadoop_path(_marker(path, version, "committed")), False)
        system.delete(hadoop_path(_folder(path, version)), True)
    return old

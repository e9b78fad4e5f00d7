"""Existence, renaming and deletion through the Hadoop file system of a path, so that any storage will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):  # noqa: ANN202
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(sc._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _system(spark, path)
    return bool(system.exists(place))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    system, place = _system(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def delete(spark: SparkSession, path: str) -> None:
    system, place = _system(spark, path)
    system.delete(place, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Move a file or folder; raises OSError if the storage refuses."""
    system, place = _system(spark, path)
    target = _system(spark, to)[1]
    system.mkdirs(target.getParent())
    if not system.rename(place, target):
        raise OSError(f"cannot rename {path} to {to}")


def swap_in(spark: SparkSession, fresh: str, path: str) -> None:
    """Put ``fresh`` in the place of ``path``. At every moment one of them is whole; ``settle`` ends a swap that was cut short."""
    if exists(spark, path):
        delete(spark, path + ".old")
        rename(spark, path, path + ".old")
    rename(spark, fresh, path)
    delete(spark, path + ".old")


def settle(spark: SparkSession, fresh: str, path: str) -> None:
    """End a swap that stopped half-way: the fresh state goes in if the old one was moved away already, else it is dropped."""
    if not exists(spark, path):
        if exists(spark, fresh):
            rename(spark, fresh, path)
        elif exists(spark, path + ".old"):
            rename(spark, path + ".old", path)
    delete(spark, fresh)
    delete(spark, path + ".old")

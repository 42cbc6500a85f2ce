"""Small files in whatever file system a path names, through Hadoop's own interface."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the file, then put it in its place: readers see the old file or the new one."""
    if not _put(spark, path, text, replace=True):
        raise OSError(f"{path} could not be written")


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Make the file whole or not at all; False if there is one already."""
    return _put(spark, path, text, replace=False)


def _put(spark: SparkSession, path: str, text: str, replace: bool) -> bool:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, target = _at(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(beside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    kinds = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE if replace else kinds.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(beside, target, how)
        return True
    except Exception as e:
        fs.delete(beside, False)
        if not replace and "FileAlreadyExists" in str(e):
            return False
        raise


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    fs, where = _at(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)

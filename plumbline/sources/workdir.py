"""A folder that driver and executors share, for tables on their way to a sink."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def workdir(spark: SparkSession) -> str:
    """A new folder's name below ``spark.checkpoint.dir``; a temporary one on a local master alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is unset: {master} needs a folder there that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='plumbline')}"
    return f"{base.rstrip('/')}/plumbline-{uuid.uuid4().hex}"


def named_file(rows: DataFrame, path: str, kind: str = "json") -> str:
    """Write a small table as the one file ``path``."""
    spark = rows.sparkSession
    rows.coalesce(1).write.format(kind).save(path + ".parts")
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parts, target = jvm.org.apache.hadoop.fs.Path(path + ".parts"), jvm.org.apache.hadoop.fs.Path(path)
    fs = parts.getFileSystem(conf)
    for f in fs.listStatus(parts):
        if f.getPath().getName().startswith("part-"):
            fs.rename(f.getPath(), target)
    fs.delete(parts, True)
    return path


def bytes_file(spark: SparkSession, content: bytes, path: str) -> str:
    """Write bytes of the driver as the file ``path``."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target)
    out.write(bytearray(content))
    out.close()
    return path

"""Tables between two jobs, kept where every executor and the driver can read them.

The folder is below ``spark.checkpoint.dir``; where that is unset, below the folder of ``setCheckpointDir``; where
that is unset too, a temporary one, but on a local master alone: on a cluster executors would write files
that others do not see, so there it is an error.  Tables go when the application ends, or with ``release``.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT: dict[str, str] = {}
_SHIPPED: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors and bound the bytes of an Arrow batch, whose texts may be long.

    The bound is set for the session, as plans that are run later need it, and only where the session has none of
    its own.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        target = os.path.join(tempfile.mkdtemp(prefix="plumbline"), "plumbline_code.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        spark.sparkContext.addPyFile(target)
        _SHIPPED.add(app)
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def folder(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    app = spark.sparkContext.applicationId
    if app not in _ROOT:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
            base = set_dir.get() if set_dir.isDefined() else None
        if not base:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError(f"spark.checkpoint.dir is unset: {master} needs a folder there that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='plumbline')}"
        _ROOT[app] = f"{base.rstrip('/')}/plumbline-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _ROOT[app])
    return _ROOT[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone
        pass


def release(spark: SparkSession) -> None:
    """Remove all tables so far; results that were not read or written yet are lost."""
    root = _ROOT.pop(spark.sparkContext.applicationId, None)
    if root:
        _remove(spark, root)


def drop(*tables: DataFrame | None) -> None:
    """Remove tables that no later plan reads."""
    for t in tables:
        if t is not None:
            _remove(t.sparkSession, t.scratch_path)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the shuffles behind a table that is written are of no more use
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["scratch_path"] = path
    return out

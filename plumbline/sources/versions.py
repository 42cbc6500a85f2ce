"""Tables in versions: merges by id, replacements and old states, for readers that never see a part of a change.

A table is a folder.  ``data`` has a folder for each commit and in it one for each bucket; ids are dealt to buckets by their
hash.  ``versions`` has a small JSON file for each version, which names the folder of every bucket, the id columns and the
schema.  A commit writes new folders first and then makes the file of the next version, which is one atomic rename that
fails if another writer was faster; so a crash leaves unused folders and no damage, and readers, who take the last
version's file, see the state before or after.  (A file system without atomic renames needs a commit service of its own.)

A merge reads and writes only buckets that its rows touch: one shuffle, of these buckets' rows by bucket.  What is planned on the driver is
a row a bucket.  ``buckets`` is set when the table is made: some 100 MB to 1 GB each are good.

Ids are not null; further columns may be.  If rows repeat an id, the one with the greatest ``order`` wins; without ``order`` that is an error.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files

_MARK = "__plumbline"


class Conflict(RuntimeError):
    """Another writer has made the next version."""


def _path(path: str, version: int) -> str:
    return f"{path}/versions/{version:012d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that there are, the last one being the table's state."""
    return [int(n[:-5]) for n in files.names(spark, f"{path}/versions") if n.endswith(".json") and not n.startswith(".")]


def state(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What a version's file says; None if there is no table."""
    if version is None:
        known = versions(spark, path)
        if not known:
            return None
        version = known[-1]
    return json.loads(files.read_text(spark, _path(path, version)))


def _commit(spark: SparkSession, path: str, before: dict | None, after: dict) -> int:
    after["version"] = before["version"] + 1 if before else 1
    after["written"] = int(time.time())
    if not files.create_text(spark, _path(path, after["version"]), json.dumps(after, sort_keys=True)):
        raise Conflict(f"{path}: version {after['version']} was made by another writer")
    return after["version"]


def _bucket(key: list[str], buckets: int):
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.lit(buckets)).cast("int")


def _laid(rows: DataFrame, path: str) -> str:
    """Write rows, which have their bucket in ``_MARK``, dealt by bucket; the folder's name below ``path``."""
    folder = f"data/{uuid.uuid4().hex}"
    rows.write.partitionBy(_MARK).option("compression", "zstd").parquet(f"{path}/{folder}")
    return folder


def _written(spark: SparkSession, path: str, folder: str) -> dict[str, str]:
    """The buckets in a folder of a commit."""
    return {n.split("=")[1]: f"{folder}/{n}" for n in files.names(spark, f"{path}/{folder}") if n.startswith(f"{_MARK}=")}


def _of(spark: SparkSession, path: str, said: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(said["schema"]))
    folders = [f"{path}/{f}" for b, f in said["folders"].items() if buckets is None or int(b) in set(buckets)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table's last state, or that of a version."""
    said = state(spark, path, version)
    if said is None:
        raise FileNotFoundError(f"{path} has no version")
    return _of(spark, path, said)


def lookup(ids: DataFrame, path: str) -> DataFrame:
    """The rows of these ids (columns of the key), from their buckets alone."""
    spark, said = ids.sparkSession, state(ids.sparkSession, path)
    wanted = ids.select(*said["key"]).distinct()
    touched = [r[0] for r in wanted.select(_bucket(said["key"], said["buckets"])).distinct().collect()]  # a row a bucket at most
    return _of(spark, path, said, touched).join(wanted, said["key"], "left_semi")


def replace(rows: DataFrame, path: str, key: list[str] | None = None, buckets: int = 16) -> int:
    """A new version of these rows alone (K14: all old rows go, and stay readable as the version before)."""
    spark, before = rows.sparkSession, state(rows.sparkSession, path)
    if key:
        dealt = _one_a_key(rows.withColumn(_MARK, _bucket(key, buckets)), key, None)
    else:
        dealt = rows.withColumn(_MARK, F.lit(0))
    folder = _laid(dealt, path)
    return _commit(spark, path, before, {"key": key or [], "buckets": buckets, "schema": rows.schema.json(), "folders": _written(spark, path, folder)})


def _one_a_key(dealt: DataFrame, key: list[str], order: str | None) -> DataFrame:
    """One row an id, dealt by bucket; ids must not be null, and without ``order`` not repeated."""
    name = F.concat_ws(", ", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("null")) for k in key])
    null = F.greatest(*[F.col(f"`{k}`").isNull() for k in key], F.lit(False))
    by = Window.partitionBy(_MARK, *[F.col(f"`{k}`") for k in key]).orderBy(F.col(f"`{order}`").desc() if order else F.lit(1))
    numbered = dealt.repartition(_MARK).withColumn("__n", F.row_number().over(by))
    if order is None:
        numbered = numbered.withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated id "), name))).otherwise(F.col("__n")))
    return numbered.where(F.when(null, F.raise_error(F.lit("null id"))).otherwise(F.col("__n") == 1)).drop("__n")


def _changed(rows: DataFrame, path: str, key: list[str], merge, buckets: int) -> int:
    """Commit ``merge(old rows of the touched buckets)``."""
    spark = rows.sparkSession
    before = state(spark, path)
    if before and before["key"] != list(key):
        raise ValueError(f"{path} has the key {before['key']}")
    buckets = before["buckets"] if before else buckets
    touched = sorted(r[0] for r in rows.select(_bucket(key, buckets)).distinct().collect())  # a row a bucket at most
    old = _of(spark, path, before, touched) if before else None
    folder = _laid(merge(old, buckets), path)
    kept = {b: f for b, f in (before["folders"] if before else {}).items() if int(b) not in set(touched)}
    schema = before["schema"] if before else rows.schema.json()
    return _commit(spark, path, before, {"key": list(key), "buckets": buckets, "schema": schema, "folders": kept | _written(spark, path, folder)})


def upsert(rows: DataFrame, path: str, key: list[str], order: str | None = None, buckets: int = 16) -> int:
    """Put ``rows`` in the place of those with their ids, add the others, keep all else; the new version."""

    def merge(old: DataFrame | None, count: int) -> DataFrame:
        new = _one_a_key(rows.withColumn(_MARK, _bucket(key, count)), key, order)
        if old is None:
            return new
        if sorted(old.columns) != sorted(rows.columns):
            raise ValueError(f"{path} has the columns {old.columns}")
        both = old.withColumn(_MARK, _bucket(key, count)).withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
        # dealt by bucket once: a window by bucket and id needs no other shuffle
        last = Window.partitionBy(_MARK, *[F.col(f"`{k}`") for k in key]).orderBy(F.col("__new").desc())
        return both.repartition(_MARK).withColumn("__n", F.row_number().over(last)).where("__n = 1").select(*[F.col(f"`{c}`") for c in old.columns], _MARK)

    return _changed(rows, path, list(key), merge, buckets)


def delete(ids: DataFrame, path: str) -> int:
    """A new version without the rows of these ids; the other buckets stay as they are."""
    said = state(ids.sparkSession, path)
    gone = ids.select(*said["key"])
    return _changed(gone, path, said["key"], lambda old, count: old.join(gone, said["key"], "left_anti").withColumn(_MARK, _bucket(said["key"], count)).repartition(_MARK), said["buckets"])


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove all versions but the last ``keep``, and folders that none of these names; what was removed.

    Not while a merge is under way, whose folder no version names yet."""
    known = versions(spark, path)
    for v in known[: max(0, len(known) - keep)]:
        files.remove(spark, _path(path, v))
    used = {f for v in versions(spark, path) for f in state(spark, path, v)["folders"].values()}
    gone = []
    for folder in files.names(spark, f"{path}/data"):
        held = [f"data/{folder}/{n}" for n in files.names(spark, f"{path}/data/{folder}") if n.startswith(f"{_MARK}=")]
        for unused in ([f"data/{folder}"] if not used & set(held) else [h for h in held if h not in used]):
            files.remove(spark, f"{path}/{unused}")
            gone.append(unused)
    return gone

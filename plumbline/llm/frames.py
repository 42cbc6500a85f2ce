"""Columns whose names may clash, and joins on keys that may be hot."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot that holds more than one in so many rows; so there are fewer hot keys than this.
HOT = 1000
#: Rows of a few numbers that may be sent to every executor.
FEW = 500_000


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def own(df: DataFrame) -> list[Column]:
    """All columns of ``df``."""
    return [column(c) for c in df.columns]


def mapped(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for columns of any name: ``run`` sees and gives them by place, named c0, c1 and so on."""
    plain = T.StructType([T.StructField(f"c{n}", f.dataType) for n, f in enumerate(schema.fields)])
    return df.toDF(*(f"c{n}" for n in range(len(df.columns)))).mapInArrow(run, plain).toDF(*schema.names)


def named(columns: list) -> pa.RecordBatch:
    """A batch of columns named as ``mapped`` wants them."""
    return pa.RecordBatch.from_arrays(columns, names=[f"c{n}" for n in range(len(columns))])


def beside(documents: DataFrame, **extra: Column) -> tuple[DataFrame, dict[str, str]]:
    """``documents`` with further columns, and the names that these got, which are new whatever it has."""
    names, out = {}, documents
    for key, value in extra.items():
        names[key] = fresh(out, f"__{key}")
        out = out.withColumn(names[key], value)
    return out, names


def join_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner join where ``right`` has one row a key and in ``weight`` how many rows of ``left`` (of ``total``) have it.

    Keys with more than one in ``HOT`` of all rows, of which there are fewer than ``HOT``, are joined by broadcast; so no
    task of the shuffled join gets more rows of one key.  Keys must not be null.
    """
    limit = max(total // HOT, HOT)
    hot = right.where(F.col(weight) > limit).drop(weight)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.where(F.col(weight) <= limit).drop(weight), on)
    return left.join(F.broadcast(hot), on).unionByName(rest)


def few(df: DataFrame, most: int = FEW) -> bool:
    """Whether ``df`` has at most so many rows."""
    return df.limit(most + 1).count() <= most

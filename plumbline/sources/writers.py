"""Sinks: Parquet behind an audit, JSON lines, CSV tables, manifests, reports.  Tables that change are in ``versions``."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import write_text


def audited_parquet(rows: DataFrame, problems: DataFrame, path: str, files: int | None = None) -> None:
    """Write zstd Parquet, unless the audit found anything (K1)."""
    found = problems.collect()
    if found:
        raise ValueError("; ".join(f"{r.problem}: {r.n}" for r in found))
    (rows.coalesce(files) if files else rows).write.mode("overwrite").option("compression", "zstd").parquet(path)


def sorted_jsonl(rows: DataFrame, path: str, *order: str) -> None:
    """JSON lines with keys in alphabetical order, nulls written as such, rows by ``order`` (K2, K4, K5, K6)."""
    out = rows.orderBy(*order) if order else rows
    out.select(*sorted(rows.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def csv_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One CSV a table."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def file_sha256(spark, path: str) -> DataFrame:
    """(path, sha256) of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def manifest(spark: SparkSession, path: str, inputs: dict[str, str], counts: dict[str, int], settings: dict) -> str:
    """A manifest's JSON, with a hash over itself, in whatever file system the path names."""
    body = {"inputs": inputs, "counts": counts, "settings": settings}
    raw = json.dumps(body, sort_keys=True, separators=(",", ":"))
    write_text(spark, path, json.dumps(body | {"sha256": hashlib.sha256(raw.encode()).hexdigest()}, sort_keys=True, indent=1))
    return raw


def markdown(title: str, tables: dict[str, pd.DataFrame], digits: int = 3) -> str:
    """A report of small tables."""
    show = lambda v: "—" if v is None or v != v else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    parts = [f"# {title}"]
    for name, t in tables.items():
        parts += [f"\n## {name}\n", "| " + " | ".join(t.columns) + " |", "|" + "---|" * len(t.columns)]
        parts += ["| " + " | ".join(map(show, row)) + " |" for row in t.itertuples(index=False)]
    return "\n".join(parts) + "\n"

"""Bootstraps of any number of tasks, with exactly n draws a round.

Tasks are dealt to buckets by a hash.  How many of a round's n draws fall into a bucket follows from a tree over the buckets: at
each node the draws of the whole split binomially into its halves, by a random number that seed, contrast, node and round alone
decide.  So every bucket finds its own number of draws, in all rounds, from the buckets' sizes, and those of all buckets add up
to n; it draws them among its own tasks.  One shuffle brings a bucket's tasks together, some ``BUCKET_TASKS``, in their order; they
are read as a stream of which one bucket's values are held, and a partition passes on one sum a round for each contrast that it has.

Random numbers come from numpy's PCG64, or (``draws="md5"``) from md5 digits, which any SQL engine can repeat; both are seeded by text,
so results do not depend on partitions.  Contrasts without tasks have no result; null differences are no tasks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paired import bootstrap_bounds

BUCKET_TASKS = 4096
#: Draws at a time.
DRAWN = 1 << 21
MD5_DRAWN = 1 << 18
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _digits(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


#: Logarithms of factorials, as far as a table of 16 MB goes.
_FACTORIALS, _TABLE = np.zeros(1), 1 << 21


def _log_factorial(k: np.ndarray) -> np.ndarray:
    global _FACTORIALS
    most = int(k.max())
    if most >= _TABLE:
        return np.frompyfunc(math.lgamma, 1, 1)(k + 1.0).astype(float)
    if most >= len(_FACTORIALS):
        upto = min(_TABLE, 2 * most)
        _FACTORIALS = np.concatenate([_FACTORIALS, [math.lgamma(x + 1.0) for x in range(len(_FACTORIALS), max(upto, most + 1))]])
    return _FACTORIALS[k]


def quantile(draws: int, p: float, u: float) -> int:
    """The binomial's quantile, from its masses added up."""
    if draws == 0 or p <= 0:
        return 0
    if p >= 1:
        return draws
    # masses further from the mean than 12 deviations do not change the sum
    far = 12 * math.sqrt(draws * p * (1 - p)) + 40
    lo, hi = max(0, math.floor(draws * p - far)), min(draws, math.ceil(draws * p + far))
    k = np.arange(lo, hi)
    mass = np.exp(math.lgamma(draws + 1) - _log_factorial(k) - _log_factorial(draws - k) + k * math.log(p) + (draws - k) * math.log1p(-p))
    below = int((np.cumsum(mass) < u).sum())
    return lo + below if below < hi - lo else draws


class Md5:
    def __init__(self, seed: int, contrast: str):
        self.name = f"{seed}:{contrast}"

    def split(self, node: int, draws: np.ndarray, p: float) -> np.ndarray:
        return np.array([quantile(int(d), p, (_digits(f"{self.name}:n{node}:{r}") + 0.5) / 2**32) for r, d in enumerate(draws)], np.int64)

    def sums(self, bucket: int, draws: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.array([self._sum(f"{self.name}:{bucket}:{r}:".encode(), d, values) for r, d in enumerate(draws.tolist())])

    def _sum(self, prefix: bytes, draws: int, values: np.ndarray) -> float:
        total = 0.0
        for lo in range(0, draws, MD5_DRAWN):
            digests = b"".join([hashlib.md5(prefix + b"%d" % j).digest() for j in range(lo, min(draws, lo + MD5_DRAWN))])
            # the first eight digits of each
            total += values[np.frombuffer(digests, ">u4")[::4].astype(np.int64) % len(values)].sum()
        return total


class Pcg:
    def __init__(self, seed: int, contrast: str):
        self.name = f"{seed}:{contrast}"

    def _rng(self, what: str) -> np.random.Generator:
        return np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.sha256(f"{self.name}:{what}".encode()).digest()[:16], "little")))

    def split(self, node: int, draws: np.ndarray, p: float) -> np.ndarray:
        return self._rng(f"n{node}").binomial(draws, min(max(p, 0.0), 1.0))

    def sums(self, bucket: int, draws: np.ndarray, values: np.ndarray) -> np.ndarray:
        rng, out, lo = self._rng(str(bucket)), np.zeros(len(draws)), 0
        while lo < len(draws):
            hi = max(lo + 1, int(np.searchsorted(np.cumsum(draws[lo:]), DRAWN, "right")) + lo)
            upto = np.concatenate([[0.0], np.cumsum(values[rng.integers(0, len(values), int(draws[lo:hi].sum()))])])
            ends = np.cumsum(draws[lo:hi])
            out[lo:hi] = upto[ends] - upto[ends - draws[lo:hi]]
            lo = hi
        return out


def bucket_draws(source: Md5 | Pcg, sizes: np.ndarray, bucket: int, rounds: int) -> np.ndarray:
    """How many of each round's draws fall into a bucket: down the tree over buckets, of which each node splits its draws."""
    lo, hi, node = 0, len(sizes), 1
    upto = np.concatenate([[0], np.cumsum(sizes)])
    draws = np.full(rounds, upto[-1], np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = source.split(node, draws, (upto[mid] - upto[lo]) / max(upto[hi] - upto[lo], 1))
        if bucket < mid:
            draws, hi, node = left, mid, 2 * node
        else:
            draws, lo, node = draws - left, mid, 2 * node + 1
    return draws


def _held(batches):
    """(contrast, bucket, sizes, values) of each bucket, whose rows come one after the other: first its contrast's sizes, then tasks."""
    head, parts = None, []
    for batch in batches:
        sizes, diffs = batch.column("sizes"), batch.column("diff").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.asarray(sizes.is_valid()))
        ends = [*starts.tolist(), batch.num_rows]
        parts.append(diffs[: ends[0]].copy())
        for lo, hi in zip(ends, ends[1:]):
            if head:
                yield *head, np.concatenate(parts)
            head, parts = (batch.column("contrast")[lo].as_py(), batch.column("bucket")[lo].as_py(), np.array(sizes[lo].as_py())), [diffs[lo + 1 : hi].copy()]
    if head:
        yield *head, np.concatenate(parts)


def _drawn(kind, seed: int, rounds: int):
    """A partition's sums of each contrast and round."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for contrast, bucket, sizes, values in _held(batches):
            source = kind(seed, contrast)
            total[contrast] = total.get(contrast, 0.0) + source.sums(bucket, bucket_draws(source, sizes, bucket, rounds), values)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([t.tolist() for t in total.values()], pa.list_(pa.float64()))], names=["contrast", "sums"])

    return run


def resampled_means(differences: DataFrame, rounds: int = 5000, seed: int = 7, task: str = "task_key", buckets: int | None = None, draws: str = "pcg64") -> DataFrame:
    """(contrast, round, mean) of (contrast, task, diff), a row a task."""
    known = differences.where("diff is not null").select(F.col("contrast").cast("string").alias("contrast"), F.col(task).cast("string").alias("task"), F.col("diff").cast("double").alias("diff"))
    if buckets is None:
        most = known.groupBy("contrast").count().agg(F.max("count")).first()[0] or 1
        buckets = -(-most // BUCKET_TASKS)
    dealt = known.withColumn("bucket", (F.conv(F.substring(F.md5("task"), 1, 8), 16, 10).cast("bigint") % buckets).cast("int"))
    # the sizes of a contrast's buckets: one number for thousands of tasks
    counts = dealt.groupBy("contrast", "bucket").agg(F.count("*").alias("n"))
    held_by = F.map_from_entries(F.collect_list(F.struct("bucket", "n")))
    sizes = counts.groupBy("contrast").agg(held_by.alias("m"), F.sum("n").alias("n")).select("contrast", "n", F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.coalesce(F.col("m")[b], F.lit(0))).alias("sizes"))
    # no list of a bucket is made, which an aggregate would hold for many buckets at once: its sizes and then its tasks in order
    heads = counts.join(sizes, "contrast").select("contrast", "bucket", F.lit(None).cast("string").alias("task"), F.lit(None).cast("double").alias("diff"), "sizes")
    rows = heads.unionByName(dealt.withColumn("sizes", F.lit(None).cast(sizes.schema["sizes"].dataType)))
    ordered = rows.repartition("contrast", "bucket").sortWithinPartitions("contrast", "bucket", F.col("sizes").isNull(), "task", "diff")
    spark = differences.sparkSession
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, "4m")
    sums = ordered.select("contrast", "bucket", "diff", "sizes").mapInArrow(_drawn({"md5": Md5, "pcg64": Pcg}[draws], seed, rounds), "contrast string, sums array<double>")
    added = sums.select("contrast", F.posexplode("sums").alias("round", "sum")).groupBy("contrast", "round").agg(F.sum("sum").alias("sum"))
    return added.join(sizes.select("contrast", "n"), "contrast").select("contrast", "round", (F.col("sum") / F.col("n")).alias("mean"))


def intervals(values: DataFrame, rounds: int = 5000, seed: int = 7, method: str = "linear", **how) -> DataFrame:
    """(contrast, n_tasks, effect, ci_low, ci_high) of (contrast, task_key, diff)."""
    means = values.where("diff is not null").groupBy("contrast").agg(F.count("*").alias("n_tasks"), F.avg("diff").alias("effect"))
    return means.join(bootstrap_bounds(resampled_means(values, rounds, seed, **how), method), "contrast")


def figure_cells(rows: DataFrame, tables: dict[str, list[str]], outcomes: list[str], cluster: str = "task_key") -> DataFrame:
    """Every figure table at once: (contrast, table, cell, outcome, task_key, diff, n), the mean of an outcome over a cluster's rows in a cell.

    A table's cell is its keys' values, joined by bars; rows without one of them are in no cell of it.  One pass over the
    rows, which are few columns by then, and one aggregate.
    """
    cells = []
    for name, keys in tables.items():
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()
        cells.append(F.when(known, F.struct(F.lit(name).alias("table"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("cell"))))
    long = rows.select(F.col(cluster).alias("task_key"), *[F.col(o).cast("double").alias(o) for o in outcomes], F.explode(F.array_compact(F.array(*cells))).alias("c"))
    values = long.select("task_key", "c.*", F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("value")) for o in outcomes])).alias("v")).select("task_key", "table", "cell", "v.*")
    means = values.where("value is not null").groupBy("table", "cell", "outcome", "task_key").agg(F.avg("value").alias("diff"), F.count("*").alias("n"))
    return means.withColumn("contrast", F.concat_ws(":", "table", "cell", "outcome"))


def figure_tables(rows: DataFrame, tables: dict[str, list[str]], outcomes: list[str], cluster: str = "task_key", rounds: int = 5000, **how) -> DataFrame:
    """Rates with 95 % intervals over clusters, of every cell of every table: table, cell, outcome, n_tasks, n_rows, mean, ci_low, ci_high."""
    from ..sources.workdir import workdir

    path = workdir(rows.sparkSession)
    cells = figure_cells(rows, tables, outcomes, cluster)
    cells.write.parquet(path)
    cells = rows.sparkSession.read.schema(cells.schema).parquet(path)
    means = cells.groupBy("contrast", "table", "cell", "outcome").agg(F.count("*").alias("n_tasks"), F.sum("n").alias("n_rows"), F.avg("diff").alias("mean"))
    bounds = bootstrap_bounds(resampled_means(cells, rounds, **how), "linear")
    return means.join(bounds, "contrast").drop("contrast")

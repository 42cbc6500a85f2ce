"""A random-intercept logistic model by mean-field variational Bayes.

Fixed effects have the prior N(0, fixed_sd**2), the logarithm v of the intercepts' deviation N(0, log_sd**2), the intercept of a cluster
N(0, exp(2 v)).  The posterior is approximated by independent normal distributions of all of them, which maximise the evidence bound of
the exact likelihood; expectations over a row's linear predictor are Gauss-Hermite sums.

Rows are added up once by cluster and distinct terms (trials and successes).  Then each round is one pass: a cluster finds its
own intercept's best mean and variance for the shared ones, whatever they were before, so no state is kept between rounds;
gradients and curvatures are summed, and the driver takes a natural-gradient step of the fixed effects and solves for v.
A cluster's distinct rows are one row of the table, as in studies where a task is asked under a few conditions.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workdir import workdir
from .models import Fit
from .moments import _complete, _values

_NODES, _WEIGHTS = np.polynomial.hermite_e.hermegauss(24)
_WEIGHTS = _WEIGHTS / _WEIGHTS.sum()


def expectations(mean: np.ndarray, variance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of log(1 + e^z), its first and second derivative, for normal z."""
    z = mean[:, None] + np.sqrt(variance)[:, None] * _NODES
    p = 0.5 * (1 + np.tanh(z / 2))
    return np.logaddexp(0, z) @ _WEIGHTS, p @ _WEIGHTS, (p * (1 - p)) @ _WEIGHTS


def intercepts(x: np.ndarray, n: np.ndarray, hits: np.ndarray, of: np.ndarray, clusters: int, mean: np.ndarray, variance: np.ndarray, precision: float, rounds: int = 60):
    """Each cluster's best mean and variance, and the expectations of its rows."""
    eta, spread = x @ mean, (x * x) @ variance
    m, v = np.zeros(clusters), np.full(clusters, 1 / precision)
    total = lambda w: np.bincount(of, w, clusters)
    for _ in range(rounds):
        _, p, k = expectations(eta + m[of], spread + v[of])
        new = 1 / (precision + total(n * k))
        step = new * (total(hits - n * p) - precision * m)
        step = np.clip(step, -2, 2)
        done = max(np.abs(step).max(initial=0), np.abs(new - v).max(initial=0)) < 1e-9
        m, v = m + step, new
        if done:
            break
    return m, v, expectations(eta + m[of], spread + v[of])


def _pass(p: int, mean: np.ndarray, variance: np.ndarray, precision: float):
    """Sums over a partition's clusters: gradient, curvature, its diagonal with squares, clusters, m m + v, and the bound's parts."""

    def run(batches):
        total = np.zeros(p + p * p + 4)
        for batch in batches:
            held = batch.column("rows")
            clusters, flat = len(batch), held.flatten()
            of = np.repeat(np.arange(clusters), np.diff(held.offsets.to_numpy()))
            x = np.stack([flat.field(f"x{i}").to_numpy(zero_copy_only=False) for i in range(p)], 1)
            n, hits = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n", "hits"))
            m, v, (soft, mu, k) = intercepts(x, n, hits, of, clusters, mean, variance, precision)
            total += np.concatenate([x.T @ (hits - n * mu), ((x * (n * k)[:, None]).T @ x).ravel(), [clusters, float((m * m + v).sum()), float((hits * (x @ mean + m[of]) - n * soft).sum()), float(np.log(v).sum() / 2)]])
        yield pa.RecordBatch.from_arrays([pa.array([t]) for t in total], names=[f"c{i}" for i in range(len(total))])

    return run


def log_deviation(clusters: float, square: float, log_sd: float) -> tuple[float, float]:
    """The best mean and deviation of v for a number of clusters and the sum of their m m + v."""
    a, s = 0.5 * math.log(max(square / max(clusters, 1.0), 1e-6)), 0.1
    for _ in range(500):
        e = square * math.exp(2 * s * s - 2 * a)
        step = (-clusters + e - a / log_sd**2) / (2 * e + 1 / log_sd**2)
        new = 1 / math.sqrt(2 * square * math.exp(2 * s * s - 2 * (a + step)) + 1 / log_sd**2)
        done = abs(step) + abs(new - s) < 1e-12
        a, s = a + step, new
        if done:
            break
    return a, s


def vb_logistic(rows: DataFrame, y: str, terms: list[str], cluster: str, fixed_sd: float = 2.0, log_sd: float = 1.0, rounds: int = 200) -> Fit:
    """Posterior means and, in ``cov``, variances of the fixed effects; extra: log_deviation, its sd, elbo, rounds."""
    p = len(terms)
    rows = _complete(rows, [*terms, y])
    x = [c.alias(f"x{i}") for i, c in enumerate(_values(terms))]
    names = [f"x{i}" for i in range(p)]
    slim = rows.select(F.col(cluster).alias("g"), F.col(f"`{y}`").cast("double").alias("y"), *x).groupBy("g", *names).agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    path = workdir(rows.sparkSession)
    slim.groupBy("g").agg(F.collect_list(F.struct(*names, "n", "hits")).alias("rows")).select("rows").write.parquet(path)
    held = rows.sparkSession.read.parquet(path)
    mean, variance, (a, s) = np.zeros(p), np.full(p, fixed_sd**2 / 100), (0.0, 0.1)
    schema = ", ".join(f"c{i} double" for i in range(p + p * p + 4))
    for n in range(rounds):
        precision = math.exp(2 * s * s - 2 * a)
        got = held.mapInArrow(_pass(p, mean, variance, precision), schema).groupBy().sum().first()
        got = np.array([float(c or 0) for c in got])
        gradient, curvature, (clusters, square, fit, entropy) = got[:p], got[p : p + p * p].reshape(p, p), got[p + p * p :]
        elbo = fit + entropy - clusters * a - 0.5 * square * precision + np.log(variance).sum() / 2 - (mean @ mean + variance.sum()) / (2 * fixed_sd**2) - (a * a + s * s) / (2 * log_sd**2) + math.log(s)
        step = np.linalg.solve(curvature + np.eye(p) / fixed_sd**2, gradient - mean / fixed_sd**2)
        new = 1 / (np.diag(curvature) + 1 / fixed_sd**2)
        a2, s2 = log_deviation(clusters, square, log_sd) if clusters else (a, s)
        done = np.abs(step).max() + np.abs(new - variance).max() + abs(a2 - a) + abs(s2 - s) < 1e-5
        mean, variance, a, s = mean + np.clip(step, -3, 3), new, a2, s2
        if done:
            break
    return Fit(terms, mean, np.diag(variance), rows.count(), int(clusters), {"log_deviation": float(a), "log_deviation_sd": float(s), "elbo": float(elbo), "rounds": n + 1})

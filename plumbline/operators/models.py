"""Regressions from distributed sufficient statistics.

Spark sums products over rows or clusters; the driver solves systems of a few columns.  What reaches the driver is
a p x p matrix for each distinct cluster size at most, whatever the rows.  Conventions: cluster-robust
covariances carry G/(G-1) * (N-1)/(N-K); tests are normal.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .moments import moments


# --- distributions ------------------------------------------------------------------------------------------
def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of chi square, by the incomplete gamma function's series or continued fraction."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-15 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@dataclass
class Fit:
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    clusters: int = 0
    extra: dict = field(default_factory=dict)

    def table(self) -> pd.DataFrame:
        """Coefficients with normal tests and 95 % bounds."""
        se = np.sqrt(np.diag(self.cov))
        z = self.beta / se
        return pd.DataFrame({"term": self.names, "estimate": self.beta, "se": se, "z": z, "p": [two_sided(v) for v in z], "ci_low": self.beta - 1.96 * se, "ci_high": self.beta + 1.96 * se})

    def wald(self, terms: list[str]) -> tuple[float, int, float]:
        """Chi square of a block of terms."""
        at = [self.names.index(t) for t in terms]
        b = self.beta[at]
        stat = float(b @ np.linalg.solve(self.cov[np.ix_(at, at)], b))
        return stat, len(at), chi2_sf(stat, len(at))

    def contrast(self, weights: dict[str, float]) -> dict[str, float]:
        """A linear combination with its delta-method interval."""
        w = np.array([weights.get(n, 0.0) for n in self.names])
        est, se = float(w @ self.beta), float(np.sqrt(w @ self.cov @ w))
        return {"estimate": est, "se": se, "p": two_sided(est / se), "ci_low": est - 1.96 * se, "ci_high": est + 1.96 * se}


def dummies(rows: DataFrame, column: str, levels: list[str], prefix: str | None = None) -> tuple[DataFrame, list[str]]:
    """0/1 columns for all levels but the first; a value that is no level is an error."""
    prefix = prefix or column
    known = F.col(column).isin(*levels)
    out = rows.withColumn(column, F.when(known, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))))
    names = [f"{prefix}[{v}]" for v in levels[1:]]
    return out.select("*", *[F.when(F.col(column) == v, 1.0).otherwise(0.0).alias(n) for v, n in zip(levels[1:], names, strict=True)]), names


def _x(names: list[str]) -> list[Column]:
    return [F.lit(1.0) if n == "intercept" else F.col(f"`{n}`").cast("double") for n in names]


def _complete(rows: DataFrame, names: list[str], *more: str) -> DataFrame:
    need = [F.col(f"`{n}`").isNotNull() for n in [*names, *more] if n != "intercept"]
    out = rows
    for c in need:
        out = out.where(c)
    return out


def _outer_sums(left: list[Column], right: list[Column], weight: Column | None = None) -> list[Column]:
    w = weight if weight is not None else F.lit(1.0)
    return [F.sum(a * b * w) for a in left for b in right]


def _matrix(row, p: int, q: int, at: int = 0) -> np.ndarray:
    return np.array([float(v or 0.0) for v in row[at : at + p * q]]).reshape(p, q)


def gram(rows: DataFrame, y: str, names: list[str]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y and n in one aggregate; nested models reuse it by picking columns."""
    x, t = _x(names), F.col(f"`{y}`").cast("double")
    p = len(names)
    r = _complete(rows, names, y).agg(*[c.alias(f"s{n}") for n, c in enumerate([*_outer_sums(x, [*x, t]), F.sum(t * t), F.count("*")])]).first()
    m = _matrix(r, p, p + 1)
    return m[:, :p], m[:, p], float(r[-2] or 0), int(r[-1])


def ols(rows: DataFrame, y: str, names: list[str], cluster: str | None = None) -> Fit:
    """Least squares with cluster-robust covariance."""
    rows = _complete(rows, names, y)
    xx, xy, yy, n = gram(rows, y, names)
    inv = np.linalg.pinv(xx)
    beta = inv @ xy
    sigma2 = (yy - beta @ xy) / max(n - len(names), 1)
    if cluster is None:
        return Fit(names, beta, sigma2 * inv, n, extra={"sigma2": sigma2})
    x = _x(names)
    u = F.col(f"`{y}`") - sum((float(b) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))
    return _sandwich(rows, names, beta, inv, x, u, cluster, n)


def _sandwich(rows: DataFrame, names: list[str], beta, inv, x: list[Column], u: Column, cluster: str, n: int) -> Fit:
    by = rows.groupBy(cluster).agg(*[F.sum(c * u).alias(f"g{i}") for i, c in enumerate(x)])
    g = [F.col(f"g{i}") for i in range(len(x))]
    r = by.agg(*[c.alias(f"m{i}") for i, c in enumerate([*_outer_sums(g, g), F.count("*")])]).first()
    meat, count = _matrix(r, len(x), len(x)), int(r[-1])
    scale = count / max(count - 1, 1) * (n - 1) / max(n - len(x), 1)
    return Fit(names, beta, inv @ meat @ inv * scale, n, count)


def logistic(rows: DataFrame, y: str, names: list[str], cluster: str | None = None, rounds: int = 25) -> Fit:
    """Binomial GLM by iteratively reweighted sums, with cluster-robust covariance (M9)."""
    rows = _complete(rows, names, y)
    x, t = _x(names), F.col(f"`{y}`").cast("double")
    beta, info, n = np.zeros(len(names)), None, 0
    for _ in range(rounds):
        mu = 1 / (1 + F.exp(-sum((float(b) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))))
        w = mu * (1 - mu)
        r = rows.agg(*[c.alias(f"s{i}") for i, c in enumerate([*_outer_sums(x, x, w), *[F.sum(c * (t - mu)) for c in x], F.count("*")])]).first()
        p = len(names)
        info, score, n = _matrix(r, p, p), _matrix(r, p, 1, p * p).ravel(), int(r[-1])
        step = np.linalg.lstsq(info, score, rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    inv = np.linalg.pinv(info)
    if cluster is None:
        return Fit(names, beta, inv, n)
    mu = 1 / (1 + F.exp(-sum((float(b) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))))
    return _sandwich(rows, names, beta, inv, x, t - mu, cluster, n)


def lmm(rows: DataFrame, y: str, names: list[str], cluster: str) -> Fit:
    """Random-intercept model by profile REML in one variance ratio (M20), with R2 and ICC (M21), from one pass."""
    m = moments(rows, [*names, y], cluster)
    loglik, beta, cov, sigma2, tau2 = m.reml(y, names)
    return Fit(names, beta, cov, m.n, int(m.clusters.sum()), {"sigma2": sigma2, "tau2": tau2, "loglik": loglik, **m.r2(y, names)})


def moderation(rows: DataFrame, y: str, treatment: str, moderator: str, controls: list[str], cluster: str) -> Fit:
    """A treatment by moderator interaction."""
    name = f"{treatment}:{moderator}"
    return lmm(rows.withColumn(name, F.col(f"`{treatment}`") * F.col(f"`{moderator}`")), y, ["intercept", treatment, moderator, name, *controls], cluster)


def gee_logit(rows: DataFrame, y: str, names: list[str], cluster: str, rounds: int = 100) -> Fit:
    """Logistic estimating equations with exchangeable correlation and robust covariance.

    One aggregate by cluster and one over clusters an iteration: the inverse of (1-r)I + rJ is closed.
    """
    rows = _complete(rows, names, y)
    beta, rho = logistic(rows, y, names).beta, 0.0
    x, t, p = _x(names), F.col(f"`{y}`").cast("double"), len(names)
    for _ in range(rounds):
        mu = 1 / (1 + F.exp(-sum((float(b) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))))
        root = F.sqrt(mu * (1 - mu))
        e, z = (t - mu) / root, [root * c for c in x]
        per = rows.groupBy(cluster).agg(F.count("*").alias("n"), F.sum(e).alias("e"), F.sum(e * e).alias("ee"), *[F.sum(c).alias(f"z{i}") for i, c in enumerate(z)], *[F.sum(c * e).alias(f"ze{i}") for i, c in enumerate(z)], *[F.sum(a * b).alias(f"zz{i}") for i, (a, b) in enumerate((a, b) for a in z for b in z)])
        c = F.lit(rho) / (1 + (F.col("n") - 1) * rho)
        u = [F.col(f"ze{i}") - c * F.col(f"z{i}") * F.col("e") for i in range(p)]
        h = [F.col(f"zz{i * p + j}") - c * F.col(f"z{i}") * F.col(f"z{j}") for i in range(p) for j in range(p)]
        parts = [*[F.sum(v) for v in h], *[F.sum(v) for v in u], *_outer_sums(u, u), F.sum(F.col("e") ** 2 - F.col("ee")), F.sum(F.col("n") * (F.col("n") - 1)), F.sum("ee"), F.sum("n"), F.count("*")]
        r = per.agg(*[v.alias(f"s{i}") for i, v in enumerate(parts)]).first()
        hess, score, meat = _matrix(r, p, p), _matrix(r, p, 1, p * p).ravel(), _matrix(r, p, p, p * p + p)
        cross, pairs, square, n, g = (float(v) for v in r[-5:])
        step = np.linalg.solve(hess, score)
        beta = beta + step
        phi = square / (n - p)
        new = cross / phi / max(pairs - 2 * p, 1.0)
        done = np.abs(step).max() < 1e-8 and abs(new - rho) < 1e-8
        rho = new
        if done:
            break
    inv = np.linalg.inv(hess)
    return Fit(names, beta, inv @ meat @ inv, int(n), int(g), {"rho": rho})


def condition_estimates(fit: Fit) -> pd.DataFrame:
    """Log odds and probabilities with 1.96 deviations."""
    sd = np.sqrt(np.diag(fit.cov))
    p = lambda v: 1 / (1 + np.exp(-v))
    return pd.DataFrame({"condition": fit.names, "log_odds": fit.beta, "sd": sd, "probability": p(fit.beta), "low": p(fit.beta - 1.96 * sd), "high": p(fit.beta + 1.96 * sd)})


def registered_contrasts(estimates: pd.DataFrame, contrasts: list[tuple[str, str]]) -> pd.DataFrame:
    """Odds ratios from independent deviations, and the probability that they exceed one."""
    by = estimates.set_index("condition")
    out = []
    for a, b in contrasts:
        d, sd = by.loc[a, "log_odds"] - by.loc[b, "log_odds"], math.hypot(by.loc[a, "sd"], by.loc[b, "sd"])
        out.append({"contrast": f"{a} - {b}", "log_odds": d, "sd": sd, "odds_ratio": math.exp(d), "low": math.exp(d - 1.96 * sd), "high": math.exp(d + 1.96 * sd), "probability_above": normal_cdf(d / sd)})
    return pd.DataFrame(out)


def holm_normal_tests(differences: DataFrame) -> pd.DataFrame:
    """Large-sample normal tests of paired differences with Holm's correction."""
    got = differences.groupBy("contrast").agg(F.count("diff").alias("n"), F.avg("diff").alias("effect"), F.stddev_samp("diff").alias("sd")).toPandas()
    got["p"] = [two_sided(e / (s / math.sqrt(n))) if s and n > 1 else (1.0 if not e else 0.0) for e, s, n in zip(got.effect, got.sd, got.n, strict=True)]
    got = got.sort_values("p").reset_index(drop=True)
    got["holm_p"] = np.maximum.accumulate(np.minimum(1.0, got.p * np.arange(len(got), 0, -1)))
    return got

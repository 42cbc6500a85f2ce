"""Least squares and mixed models from one pass: sums of products by cluster, added up by cluster size.

What a random-intercept model needs of the rows is, for each distinct cluster size, the sum of the clusters' products (P) and of
the outer products of their column sums (S).  One aggregate by cluster and one by size give both for *all* columns, so every
subset of terms, and every response among the columns, is fitted on the driver without another job: the sweep
operator turns a matrix of products into coefficients, residual sum and determinant of any subset.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A pivot of less than this share of its column's own sum is that of a column which the others explain.
ALIASED = 1e-10


def sweep(a: np.ndarray, columns: list[int]) -> tuple[np.ndarray, float, list[int]]:
    """``a`` swept on ``columns``, the logarithm of the determinant of that block, and which columns were swept.

    Of a matrix of products, the swept block is the inverse of its part (with a minus), the other columns become coefficients on it,
    and what is left of the others are residual products.  Columns that those before explain are passed over.
    """
    a, logdet, done = a.astype(float).copy(), 0.0, []
    own = np.diag(a).copy()
    for k in columns:
        d = a[k, k]
        if not d > ALIASED * max(own[k], 1e-300):
            continue
        row = a[k] / d
        column = a[:, k].copy()
        a -= np.outer(column, row)
        a[k], a[:, k] = row, column / d
        a[k, k] = -1 / d
        logdet += math.log(d)
        done.append(k)
    return a, logdet, done


@dataclass
class Moments:
    columns: list[str]
    sizes: np.ndarray  # of a cluster
    clusters: np.ndarray  # how many have this size
    products: np.ndarray  # (sizes, columns, columns): sums of x x' over their rows
    outer: np.ndarray  # (sizes, columns, columns): sums of s s' over them, s being a cluster's column sums

    @property
    def n(self) -> int:
        return int((self.sizes * self.clusters).sum())

    def at(self, names: list[str]) -> list[int]:
        return [self.columns.index(n) for n in names]

    def generalised(self, ratio: float) -> np.ndarray:
        """Products weighted by the inverse covariance of rows whose clusters have this ratio of variances."""
        shrink = ratio / (1 + self.sizes * ratio)
        return self.products.sum(0) - np.einsum("s,sij->ij", shrink, self.outer)

    def _profile(self, y: str, terms: list[str], ratio: float):
        k, t = self.at(terms), self.at([y])[0]
        swept, logdet, done = sweep(self.generalised(ratio), k)
        free = self.n - len(done)
        sigma2 = max(swept[t, t] / free, 1e-300)
        logdets = float((self.clusters * np.log1p(self.sizes * ratio)).sum())
        return -0.5 * (free * math.log(sigma2) + logdets + logdet), swept, sigma2, done

    def reml(self, y: str, terms: list[str]):
        """The ratio of variances with the largest restricted likelihood: loglik, beta, covariance, sigma2, tau2."""
        low, high, golden = -12.0, 6.0, (math.sqrt(5) - 1) / 2
        value = lambda v: self._profile(y, terms, math.exp(v))[0]
        a, b = high - golden * (high - low), low + golden * (high - low)
        fa, fb = value(a), value(b)
        while high - low > 1e-7:
            if fa > fb:
                high, b, fb = b, a, fa
                a = high - golden * (high - low)
                fa = value(a)
            else:
                low, a, fa = a, b, fb
                b = low + golden * (high - low)
                fb = value(b)
        ratio = math.exp((low + high) / 2)
        if self._profile(y, terms, 0.0)[0] >= self._profile(y, terms, ratio)[0]:
            ratio = 0.0
        loglik, swept, sigma2, done = self._profile(y, terms, ratio)
        t, k = self.at([y])[0], self.at(terms)
        beta = np.array([swept[i, t] if i in done else 0.0 for i in k])
        keep = np.array([i in done for i in k])
        cov = np.where(keep[:, None] & keep, -swept[np.ix_(k, k)] * sigma2, 0.0)
        free = self.n - len(done)
        return loglik - 0.5 * free * (1 + math.log(2 * math.pi)), beta, cov, sigma2, ratio * sigma2

    def r2(self, y: str, terms: list[str]) -> dict[str, float]:
        """Shares of variance: of fixed effects, with the clusters', and the correlation within clusters."""
        _, beta, _, sigma2, tau2 = self.reml(y, terms)
        xx = self.products.sum(0)[np.ix_(self.at(terms), self.at(terms))]
        mean = xx[:, terms.index("intercept")] / self.n if "intercept" in terms else np.zeros(len(terms))
        fixed = float(beta @ (xx / self.n - np.outer(mean, mean)) @ beta)
        total = fixed + tau2 + sigma2
        return {"r2_marginal": fixed / total, "r2_conditional": (fixed + tau2) / total, "icc": tau2 / (tau2 + sigma2)}

    def least_squares(self, y: str, terms: list[str]) -> tuple[np.ndarray, np.ndarray, float]:
        """Coefficients, inverse of the products, residual variance."""
        swept, _, done = sweep(self.products.sum(0), self.at(terms))
        t, k = self.at([y])[0], self.at(terms)
        keep = np.array([i in done for i in k])
        beta = np.array([swept[i, t] if i in done else 0.0 for i in k])
        return beta, np.where(keep[:, None] & keep, -swept[np.ix_(k, k)], 0.0), swept[t, t] / max(self.n - len(done), 1)


def _values(columns: list[str]) -> list[Column]:
    return [F.lit(1.0) if c == "intercept" else F.col(f"`{c}`").cast("double") for c in columns]


def _complete(rows: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        if c != "intercept":
            rows = rows.where(F.col(f"`{c}`").isNotNull())
    return rows


def _upper(x: list[Column]) -> list[Column]:
    return [x[i] * x[j] for i in range(len(x)) for j in range(i, len(x))]


def _square(values, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = [float(v or 0.0) for v in values]
    return out + np.triu(out, 1).T


def moments(rows: DataFrame, columns: list[str], cluster: str) -> Moments:
    """One job, over the rows that have all ``columns`` ("intercept" is 1); the driver gets a row for each distinct cluster size."""
    x, p = _values(columns), len(columns)
    pairs = p * (p + 1) // 2
    per = _complete(rows, columns).groupBy(cluster).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(c).alias(f"p{i}") for i, c in enumerate(_upper(x))])
    sums = [F.col(f"s{i}") for i in range(p)]
    got = per.groupBy("n").agg(F.count("*").alias("g"), *[F.sum(f"p{i}").alias(f"p{i}") for i in range(pairs)], *[F.sum(c).alias(f"o{i}") for i, c in enumerate(_upper(sums))]).collect()
    if not got:
        return Moments(columns, np.zeros(0), np.zeros(0), np.zeros((0, p, p)), np.zeros((0, p, p)))
    return Moments(columns, np.array([float(r.n) for r in got]), np.array([float(r.g) for r in got]), np.array([_square(r[2 : 2 + pairs], p) for r in got]), np.array([_square(r[2 + pairs :], p) for r in got]))


def importance(rows: DataFrame, y: str, blocks: dict[str, list[str]], cluster: str) -> pd.DataFrame:
    """Sequential and drop-one change of marginal R2 by block of terms, all from one pass."""
    every = ["intercept", *[t for b in blocks.values() for t in b]]
    m = moments(rows, [*every, y], cluster)
    of = lambda terms: m.r2(y, terms)["r2_marginal"] if len(terms) > 1 else 0.0
    full, out, so_far, before = of(every), [], ["intercept"], 0.0
    for name, terms in blocks.items():
        so_far = [*so_far, *terms]
        now = of(so_far)
        out.append({"block": name, "sequential": now - before, "drop_one": full - of([t for t in every if t not in terms])})
        before = now
    return pd.DataFrame(out)


def mediation(rows: DataFrame, y: str, treatment: str, mediators: list[str], controls: list[str], cluster: str) -> pd.DataFrame:
    """Total and direct effect, paths a and b by mediator, and the indirect share, all from one pass."""
    base = ["intercept", treatment, *controls]
    m = moments(rows, [*base, *mediators, y], cluster)
    total, direct = m.reml(y, base)[1], m.reml(y, [*base, *mediators])[1]
    out = [{"mediator": "all", "total": total[1], "direct": direct[1], "indirect_share": (total[1] - direct[1]) / total[1]}]
    for n, name in enumerate(mediators):
        out.append({"mediator": name, "a": m.reml(name, base)[1][1], "b": direct[len(base) + n]})
    return pd.DataFrame(out)


def ols_by(rows: DataFrame, y: str, terms: list[str], by: str, cluster: str) -> DataFrame:
    """Least squares of every group with cluster-robust errors, in two passes whatever the groups.

    ``by``, then est_<term> and se_<term>.  Coefficients are solved in Python a batch of groups at a time, from sums, so there may
    be as many groups as clusters.
    """
    names, p = [*terms, y], len(terms)
    x = _values(names)
    rows = _complete(rows, names)
    pairs = (p + 1) * (p + 2) // 2
    sums = rows.groupBy(by).agg(F.count("*").cast("double").alias("__n"), *[F.sum(c).alias(f"__p{i}") for i, c in enumerate(_upper(x))])
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}[by]

    def solve(frames):
        for f in frames:
            out = []
            for group, n, *values in f.itertuples(index=False):
                swept, _, done = sweep(_square(values, p + 1), list(range(p)))
                keep = np.array([i in done for i in range(p)])
                inverse = np.where(keep[:, None] & keep, -swept[:p, :p], 0.0)
                out.append([group, n, np.where(keep, swept[:p, p], 0.0).tolist(), inverse.ravel().tolist()])
            yield pd.DataFrame(out, columns=[by, "__n", "__beta", "__inverse"])

    solved = sums.select(by, "__n", *[f"__p{i}" for i in range(pairs)]).mapInPandas(solve, f"`{by}` {kind}, __n double, __beta array<double>, __inverse array<double>")
    # the sandwich: residual sums of clusters, from the groups' coefficients
    per = rows.join(solved.select(by, "__beta"), by)
    u = x[p] - sum((F.col("__beta")[i] * x[i] for i in range(p)), F.lit(0.0))
    score = per.groupBy(by, cluster).agg(*[F.sum(c * u).alias(f"__g{i}") for i, c in enumerate(x[:p])])
    g = [F.col(f"__g{i}") for i in range(p)]
    meat = score.groupBy(by).agg(F.count("*").alias("__k"), *[F.sum(a * b).alias(f"__m{i * p + j}") for i, a in enumerate(g) for j, b in enumerate(g)])
    joined = solved.join(meat, by)
    scale = F.when(F.col("__k") > 1, F.col("__k") / (F.col("__k") - 1)).otherwise(1.0) * (F.col("__n") - 1) / F.greatest(F.col("__n") - p, F.lit(1.0))
    variance = [scale * sum((F.col("__inverse")[i * p + a] * F.col(f"__m{a * p + b}") * F.col("__inverse")[b * p + i] for a in range(p) for b in range(p)), F.lit(0.0)) for i in range(p)]
    return joined.select(by, *[F.col("__beta")[i].alias(f"est_{t}") for i, t in enumerate(terms)], *[F.sqrt(v).alias(f"se_{t}") for v, t in zip(variance, terms, strict=True)])


#: Distinct cluster designs that the driver optimises over; more of them stay on the executors.
DESIGNS = 20_000


def random_slope(rows: DataFrame, y: str, terms: list[str], slope: str, cluster: str) -> dict[str, float]:
    """Heterogeneity of a slope: REML of intercept and slope covariance against the intercept alone.

    Clusters with the same sums of 1, z and z z are one design: their products add up.  One pass sums them, and where the
    designs are few, as in studies that ask each task under the same conditions, all likelihoods are evaluated on the driver;
    otherwise each is one pass over a written table of the designs.
    """
    from ..sources.workdir import workdir

    columns = [*terms, y]
    rows = _complete(rows, [*columns, slope])
    m = moments(rows, columns, cluster)
    p = len(columns)
    x, z = _values(columns), [F.lit(1.0), F.col(f"`{slope}`").cast("double")]
    per = rows.groupBy(cluster).agg(*[F.sum(c).alias(f"d{i}") for i, c in enumerate(_upper(z))], *[F.sum(a * b).alias(f"w{i}") for i, (a, b) in enumerate((a, b) for a in z for b in x)])
    w = [F.col(f"w{i}") for i in range(2 * p)]
    by_design = per.groupBy("d0", "d1", "d2").agg(F.count("*").cast("double").alias("k"), *[F.sum(c).alias(f"q{i}") for i, c in enumerate(_upper(w))])
    path = workdir(rows.sparkSession)
    by_design.write.parquet(path)
    designs = rows.sparkSession.read.schema(by_design.schema).parquet(path)
    triu = np.triu_indices(2 * p)

    def evaluated(frame: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """The logarithm of the determinants, and what the random effects take off the products."""
        d, k = frame[:, :3], frame[:, 3]
        q = np.zeros((len(frame), 2 * p, 2 * p))
        q[:, triu[0], triu[1]] = q[:, triu[1], triu[0]] = frame[:, 4:]
        zz = np.stack([d[:, [0, 1]], d[:, [1, 2]]], 1)
        inner = np.eye(2) + lower.T @ zz @ lower
        weight = lower @ np.linalg.solve(inner, np.broadcast_to(lower.T, inner.shape))
        off = np.einsum("sab,saibj->ij", weight, q.reshape(-1, 2, p, 2, p))
        return np.concatenate([[float((k * np.linalg.slogdet(inner)[1]).sum())], off.ravel()])

    local = np.array([[float(v) for v in r] for r in designs.collect()]) if designs.limit(DESIGNS + 1).count() <= DESIGNS else None

    def sums(lower: np.ndarray) -> np.ndarray:
        if local is not None:
            return evaluated(local, lower)

        def run(frames):
            for f in frames:
                yield pd.DataFrame([evaluated(f.to_numpy(float), lower)])

        schema = ", ".join(f"c{i} double" for i in range(1 + p * p))
        return np.array([float(v) for v in designs.mapInPandas(run, schema).groupBy().sum().first()])

    def deviance(theta: np.ndarray) -> float:
        lower = np.array([[math.exp(theta[0]), 0.0], [theta[1], math.exp(theta[2])]])
        got = sums(lower)
        swept, logdet, done = sweep(m.products.sum(0) - got[1:].reshape(p, p), list(range(p - 1)))
        free = m.n - len(done)
        return free * math.log(max(swept[p - 1, p - 1] / free, 1e-300)) + got[0] + logdet

    best = _simplex(deviance, [np.array(v, float) for v in ([-1, 0, -1], [0, 0, -1], [-1, 0.5, -1], [-1, 0, 0])], 400 if local is not None else 60)
    free = m.n - len(sweep(m.products.sum(0), list(range(p - 1)))[2])
    base = m.reml(y, terms)[0]
    full = -0.5 * best - 0.5 * free * (1 + math.log(2 * math.pi))
    stat = max(0.0, 2 * (full - base))
    return {"loglik_intercept": base, "loglik_slope": full, "lr": stat, "p": math.exp(-stat / 2)}  # chi square of two degrees


def _simplex(f, points: list[np.ndarray], rounds: int) -> float:
    """The least value that a downhill simplex finds."""
    values = [f(v) for v in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < 1e-9:
            break
        mean = np.mean(points[:-1], axis=0)
        at = lambda t: (mean + t * (points[-1] - mean), f(mean + t * (points[-1] - mean)))
        trial = at(-1.0)
        if trial[1] < values[0]:
            trial = min(trial, at(-2.0), key=lambda v: v[1])
        elif trial[1] >= values[-2]:
            trial = min(trial, at(0.5), at(-0.5), key=lambda v: v[1])
        if trial[1] < values[-1]:
            points[-1], values[-1] = trial
        else:
            points = [points[0], *[(q + points[0]) / 2 for q in points[1:]]]
            values = [values[0], *[f(q) for q in points[1:]]]
    return min(values)

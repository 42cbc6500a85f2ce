"""Models from one pass against dense arithmetic on the same rows."""

import math

import numpy as np
import pytest

from plumbline.operators import models, moments, variational


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    g = np.repeat(np.arange(50), rng.integers(2, 8, 50))
    x, z, w = rng.normal(size=(3, len(g)))
    y = 1 + 2 * x - z / 2 + rng.normal(0, 1.5, 50)[g] + rng.normal(0, 0.8, 50)[g] * x + rng.normal(size=len(g))
    b = (rng.random(len(g)) < 1 / (1 + np.exp(-(0.3 + x + rng.normal(0, 1, 50)[g])))).astype(int)
    rows = [(int(k), *map(float, v), int(h)) for k, *v, h in zip(g, x, z, w, y, b, strict=True)]
    df = spark.createDataFrame([*rows, (3, None, 1.0, 1.0, 1.0, 0)], "g int, x double, z double, w double, y double, b int").repartition(4)
    return df, g, {"intercept": np.ones(len(g)), "x": x, "z": z, "w": w, "y": y, "b": b}


def dense_reml(g, X, y, blocks, sigma2):
    V = np.eye(len(g)) * sigma2 + blocks
    Vi = np.linalg.inv(V)
    A = X.T @ Vi @ X
    beta = np.linalg.solve(A, X.T @ Vi @ y)
    r = y - X @ beta
    return -0.5 * ((len(y) - X.shape[1]) * math.log(2 * math.pi) + np.linalg.slogdet(V)[1] + np.linalg.slogdet(A)[1] + r @ Vi @ r), beta


def test_sweep():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 4))
    x = np.column_stack([x, x[:, 0] + x[:, 1], rng.normal(size=30)])
    swept, logdet, done = moments.sweep(x.T @ x, [0, 1, 2, 4])
    assert done == [0, 1, 2]  # the fifth is the sum of two others
    beta = np.linalg.lstsq(x[:, :3], x[:, 5], rcond=None)[0]
    assert swept[:3, 5] == pytest.approx(beta) and swept[5, 5] == pytest.approx(((x[:, 5] - x[:, :3] @ beta) ** 2).sum())
    block = x[:, :3].T @ x[:, :3]
    assert -swept[:3, :3] == pytest.approx(np.linalg.inv(block)) and logdet == pytest.approx(np.linalg.slogdet(block)[1])


def test_mixed_model_of_every_subset(data):
    df, g, c = data
    m = moments.moments(df, ["intercept", "x", "z", "w", "y"], "g")
    assert m.n == len(g) and m.clusters.sum() == 50
    for terms in (["intercept"], ["intercept", "x"], ["intercept", "z", "w"], ["intercept", "x", "z", "w"]):
        X = np.stack([c[t] for t in terms], 1)
        loglik, beta, cov, sigma2, tau2 = m.reml("y", terms)
        same = (g[:, None] == g[None]).astype(float)
        want, b = dense_reml(g, X, c["y"], same * tau2, sigma2)
        assert loglik == pytest.approx(want, abs=1e-6) and beta == pytest.approx(b)
        for s, t in ((1.03, 1), (1, 1.05), (0.97, 1), (1, 0.95)):
            assert dense_reml(g, X, c["y"], same * tau2 * t, sigma2 * s)[0] < loglik
    fit = models.lmm(df, "y", ["intercept", "x", "z"], "g")
    assert fit.extra["loglik"] == pytest.approx(m.reml("y", ["intercept", "x", "z"])[0]) and fit.clusters == 50


def test_importance_is_that_of_single_fits(spark, data):
    df = data[0].where("x is not null")
    blocks = {"a": ["x"], "b": ["z", "w"]}
    jobs = {}
    for name, some in (("one", {"a": ["x"]}), ("three", {"a": ["x"], "b": ["z"], "c": ["w"]})):
        spark.sparkContext.setJobGroup(name, "")
        moments.importance(df, "y", some, "g")
        jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs["one"] == jobs["three"]
    got = moments.importance(df, "y", blocks, "g").set_index("block")
    r2 = lambda *t: models.lmm(df, "y", ["intercept", *t], "g").extra["r2_marginal"]
    full = r2("x", "z", "w")
    assert got.loc["a"].tolist() == pytest.approx([r2("x"), full - r2("z", "w")])
    assert got.loc["b"].tolist() == pytest.approx([full - r2("x"), full - r2("x")])
    path = moments.mediation(df, "y", "x", ["z", "w"], [], "g")
    direct = models.lmm(df, "y", ["intercept", "x", "z", "w"], "g").beta
    assert path.total[0] == pytest.approx(models.lmm(df, "y", ["intercept", "x"], "g").beta[1]) and path.direct[0] == pytest.approx(direct[1])
    assert path.b.tolist()[1:] == pytest.approx(direct[2:].tolist()) and path.a[2] == pytest.approx(models.lmm(df, "w", ["intercept", "x"], "g").beta[1])


def test_least_squares_by_group(data):
    df = data[0].withColumn("k", data[0].g % 3)
    got = {r.k: r for r in moments.ols_by(df, "y", ["intercept", "x"], "k", "g").collect()}
    assert sorted(got) == [0, 1, 2]
    for k, r in got.items():
        fit = models.ols(df.where(f"k = {k}"), "y", ["intercept", "x"], "g")
        assert [r.est_intercept, r.est_x] == pytest.approx(fit.beta.tolist()) and [r.se_intercept, r.se_x] == pytest.approx(np.sqrt(np.diag(fit.cov)).tolist())


@pytest.mark.parametrize("designs", [20_000, 0])
def test_random_slope(data, monkeypatch, designs):
    """The likelihood is the dense one at its best, and neighbours are worse."""
    monkeypatch.setattr(moments, "DESIGNS", designs)
    df, g, c = data
    if not designs:  # each likelihood is a job
        monkeypatch.setattr(moments, "_simplex", lambda f, points, rounds: min(f(p) for p in points[:2]))
    got = moments.random_slope(df, "y", ["intercept", "x"], "x", "g")
    X, same = np.stack([c["intercept"], c["x"]], 1), (g[:, None] == g[None]).astype(float)

    def best(theta):
        lower = np.array([[math.exp(theta[0]), 0], [theta[1], math.exp(theta[2])]])
        blocks = same * (X @ lower @ lower.T @ X.T)
        r = dense_reml(g, X, c["y"], blocks, 1.0)
        V = np.eye(len(g)) + blocks
        Vi = np.linalg.inv(V)
        res = c["y"] - X @ r[1]
        sigma2 = res @ Vi @ res / (len(g) - 2)
        return dense_reml(g, X, c["y"], blocks * sigma2, sigma2)[0]

    if designs:
        grid = max(best((a, b, s)) for a in np.linspace(-0.5, 1, 7) for b in (-0.3, 0, 0.3) for s in np.linspace(-2, 0.3, 7))
        assert grid - 1e-6 <= got["loglik_slope"] < grid + 1 and got["p"] == pytest.approx(math.exp(-got["lr"] / 2))
    else:
        assert got["loglik_slope"] == pytest.approx(max(best((-1, 0, -1)), best((0, 0, -1))), abs=1e-6)


def test_variational_logistic(data):
    """The bound, from its definition with a fine grid, is stationary in every parameter and falls off to all sides."""
    df, g, c = data
    fit = variational.vb_logistic(df, "b", ["intercept", "x"], "g")
    X, y = np.stack([c["intercept"], c["x"]], 1), c["b"]
    t = np.linspace(-9, 9, 4001)
    weight = np.exp(-t * t / 2)
    weight /= weight.sum()

    def elbo(mean, var, m, v, a, s):
        eta, spread = X @ mean + m[g], (X * X) @ var + v[g]
        soft = np.logaddexp(0, eta[:, None] + np.sqrt(spread)[:, None] * t) @ weight
        prior = -(mean @ mean + var.sum()) / 8 - (a * a + s * s) / 2 - len(m) * a - 0.5 * (m * m + v).sum() * math.exp(2 * s * s - 2 * a)
        return (y * eta - soft).sum() + prior + 0.5 * np.log(var).sum() + 0.5 * np.log(v).sum() + math.log(s)

    a, s = fit.extra["log_deviation"], fit.extra["log_deviation_sd"]
    mean, var = fit.beta, np.diag(fit.cov)
    m, v, _ = variational.intercepts(X, np.ones(len(g)), y.astype(float), g, 50, mean, var, math.exp(2 * s * s - 2 * a))
    here = elbo(mean, var, m, v, a, s)
    assert here == pytest.approx(fit.extra["elbo"], abs=1e-3)
    for n in range(2):
        for h in (1e-3, -1e-3):
            e = np.eye(2)[n] * h
            assert elbo(mean + e, var, m, v, a, s) < here + 1e-7 and elbo(mean, var * (1 + 10 * e), m, v, a, s) < here + 1e-7
    for h in (1e-3, -1e-3):
        assert elbo(mean, var, m, v, a + h, s) < here + 1e-7 and elbo(mean, var, m, v, a, s + h) < here + 1e-7
        for k in (0, 17, 49):
            e = np.eye(50)[k] * h
            assert elbo(mean, var, m + e, v, a, s) < here + 1e-7 and elbo(mean, var, m, v * (1 + 10 * e), a, s) < here + 1e-7
    assert 0.5 < fit.beta[1] < 1.6

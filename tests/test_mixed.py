"""Mixed models against dense fits, and tails against tables."""

import math

import numpy as np
import pandas as pd
import pytest

from tidewave.operators import mixed


def test_tails_equal_tables():
    for t, df, p in ((2.228, 10, 0.05), (2.042, 30, 0.05), (4.303, 2, 0.05), (1.812, 10, 0.1), (2.5758, 1e7, 0.01)):
        assert mixed.t_tail(t, df) == pytest.approx(p, abs=2e-4) and mixed.t_quantile(p, df) == pytest.approx(t, abs=1e-3)
    for q, k, df in ((3.877, 3, 10), (3.578, 3, 20), (3.314, 3, 1e9), (3.845, 4, 30), (4.602, 3, 5), (4.654, 5, 10)):
        assert mixed.range_tail(q, k, df) == pytest.approx(0.05, abs=3e-4), (q, k, df)
    assert mixed.range_tail(2.5 * math.sqrt(2), 2, 17) == pytest.approx(mixed.t_tail(2.5, 17), abs=1e-6)  # two means: a t test
    assert mixed.range_tail(0, 3, 9) == 1 and mixed.beta_tail(1.5, 2, 3) == 1


def made(seed, sd_group, n=150):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 12, n)
    kind = rng.integers(0, 3, n)
    day = rng.uniform(0, 5, n)
    y = np.array([1.0, 1.5, 0.8])[kind] + 0.3 * day + rng.normal(size=12)[g] * sd_group + rng.normal(size=n)
    return pd.DataFrame({"g": g, "kind": np.array(["L", "M", "H"])[kind], "day": day, "y": y})


class Dense:
    """REML with the whole covariance matrix; derivatives by differences."""

    def __init__(self, pdf):
        self.x = np.column_stack([*(pdf.kind == k for k in "LMH"), pdf.day]).astype(float)
        self.y, self.j = pdf.y.to_numpy(), (pdf.g.to_numpy()[:, None] == pdf.g.to_numpy()[None, :]).astype(float)
        grid = np.concatenate([[0], np.geomspace(1e-4, 100, 600)])
        ratio = min(grid, key=self.profile)
        for width in (0.05, 0.005, 0.0005, 0.00005):
            ratio = min(ratio * np.exp(np.linspace(-width, width, 41)), key=self.profile)
        self.theta = np.array([self.residual(ratio), ratio * self.residual(ratio)])

    def parts(self, residual, between):
        w = np.linalg.inv(residual * np.eye(len(self.y)) + between * self.j)
        k = np.linalg.inv(self.x.T @ w @ self.x)
        beta = k @ self.x.T @ w @ self.y
        e = self.y - self.x @ beta
        return w, k, beta, float(e @ w @ e)

    def residual(self, ratio):
        return self.parts(1, ratio)[3] / (len(self.y) - 4)

    def likelihood(self, theta):
        w, k, _, r = self.parts(*theta)
        return -0.5 * (-np.linalg.slogdet(w)[1] - np.linalg.slogdet(k)[1] + r)

    def profile(self, ratio):
        s = self.residual(ratio)
        return -self.likelihood((s, ratio * s))

    def contrast(self, c):
        _, k, beta, _ = self.parts(*self.theta)
        v = float(c @ k @ c)
        h = self.theta * 1e-4
        f = lambda i, j: self.likelihood(self.theta + np.array([i, j]) * h)
        information = -np.array([[f(1, 0) - 2 * f(0, 0) + f(-1, 0), (f(1, 1) - f(1, -1) - f(-1, 1) + f(-1, -1)) / 4], [0, f(0, 1) - 2 * f(0, 0) + f(0, -1)]])
        information[1, 0] = information[0, 1]
        information = information / np.outer(h, h)
        of = lambda theta: float(c @ self.parts(*theta)[1] @ c)
        gradient = np.array([(of(self.theta + d) - of(self.theta - d)) / (2 * d.sum()) for d in np.diag(h)])
        return float(c @ beta), math.sqrt(v), 2 * v * v / float(gradient @ np.linalg.inv(information) @ gradient)


def test_many_features_equal_dense_fits(spark):
    a, b, flat = made(1, 0.8), made(2, 2.5), made(3, 0.0)
    pdf = pd.DataFrame({"g": a.g, "kind": a.kind, "day": a.day, "a": a.y, "b": a.y + np.random.default_rng(5).normal(size=12)[a.g] * 3, "flat": np.random.default_rng(7).normal(size=150), "none": np.nan})
    assert len(b) == len(flat) == 150
    df = spark.createDataFrame(pdf).repartition(5)
    models = mixed.fitted(df, "g", ["a", "b", "flat", "none"], "kind", ["L", "M", "H"], ["day"])
    assert set(models) == {"a", "b", "flat"}
    for feature in ("a", "b"):
        dense = Dense(pdf.assign(y=pdf[feature]))
        m = models[feature]
        assert [m.residual, m.ratio * m.residual] == pytest.approx(list(dense.theta), rel=1e-3)
        for c in (np.array([1.0, -1, 0, 0]), np.array([0, 1.0, -1, 0]), np.array([1.0, 0, 0, pdf.day.mean()])):
            assert m.contrast(c) == pytest.approx(dense.contrast(c), rel=5e-3), (feature, c)
    pairs = mixed.pairwise(df, "g", ["a", "b", "flat"], "kind", ["L", "M", "H"], ["day"]).toPandas()
    assert len(pairs) == 9 and (pairs.p_tukey >= pairs.p - 1e-9).all()
    one = pairs[(pairs.feature == "a") & (pairs.a == "L") & (pairs.b == "M")].iloc[0]
    assert one.t == pytest.approx(one.estimate / one.se) and one.p == pytest.approx(mixed.t_tail(one.t, one.df))
    means = mixed.estimated_means(df, "g", ["a", "none"], "kind", ["L", "M", "H"], ["day"]).toPandas()
    assert len(means) == 6 and means[means.feature == "none"]["mean"].isna().all()
    row = means[(means.feature == "a") & (means.condition == "H")].iloc[0]
    assert (row.high - row.low) / 2 == pytest.approx(mixed.t_quantile(0.05, row.df) * row.se)
    if models["flat"].ratio == 0:
        assert pairs[pairs.feature == "flat"].df.tolist() == [146.0] * 3


def test_no_variance_between_groups_and_too_few_rows(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": np.arange(90) % 9, "kind": np.array(["L", "M", "H"])[np.arange(90) % 3], "day": rng.normal(size=90), "y": rng.normal(size=90)})
    pdf["y"] -= pdf.groupby("g").y.transform("mean")  # less alike within groups than chance has it
    m = mixed.fitted(spark.createDataFrame(pdf), "g", ["y"], "kind", ["L", "M", "H"], ["day"])["y"]
    assert m.ratio == 0 and m.contrast(np.array([1.0, -1, 0, 0]))[2] == 86
    few = spark.createDataFrame(pdf.head(4))
    assert mixed.fitted(few, "g", ["y"], "kind", ["L", "M", "H"], ["day"]) == {}
    assert mixed.pairwise(few, "g", ["y"], "kind", ["L", "M", "H"], ["day"]).count() == 0

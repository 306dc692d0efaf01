"""Mixed models with a random intercept, of many features at once, with t tests by Satterthwaite's degrees of freedom.

y ~ condition + covariates + (1 | group). Rows are summed once to a row for each feature and group; all that the
restricted likelihood and its first two derivatives by the ratio of variances need are sums over these, which Spark
works out for all features in one job a step. The driver holds a small matrix for each feature.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ratios of variances that the search begins with, and its steps after that.
RATIOS, STEPS = (0.0, 0.001, 0.01, 0.1, 0.5, 2.0, 10.0, 100.0), 8


def beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, total = 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        numerator = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + numerator * d or 1e-300)
        c = 1 + numerator / c or 1e-300
        total *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (total - 1)


def t_tail(t: float, df: float) -> float:
    """Both tails of Student's t."""
    return beta_tail(df / (df + t * t), df / 2, 0.5)


def t_quantile(p: float, df: float) -> float:
    """What |t| exceeds with probability ``p``."""
    low, high = 0.0, 1.0
    while t_tail(high, df) > p:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if t_tail(middle, df) > p else (low, middle)
    return (low + high) / 2


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(96)
_PHI = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)))


def range_tail(q: float, k: int, df: float) -> float:
    """Probability that the studentised range of ``k`` means exceeds ``q``, by quadrature over the mean's place and the deviation's estimate."""
    if q <= 0:
        return 1.0
    z = 8.0 * _NODES
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * 8.0 * _WEIGHTS

    def within(width: np.ndarray) -> np.ndarray:
        inside = _PHI(z[None, :]) - _PHI(z[None, :] - width[:, None])
        return k * (inside ** (k - 1) * density[None, :]).sum(axis=1)

    if df > 1e5:
        return float(max(0.0, 1 - within(np.array([q]))[0]))
    # the estimate of the deviation, a chi by the root of its degrees of freedom: nearly all of it lies here
    low, high = max(1e-6, 1 - 9 / math.sqrt(2 * df)), 1 + 9 / math.sqrt(2 * df)
    s = (high + low) / 2 + (high - low) / 2 * _NODES
    log = df / 2 * math.log(df / 2) + math.log(2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(min(1.0, max(0.0, 1 - (np.exp(log) * within(q * s) * (high - low) / 2 * _WEIGHTS).sum())))


@dataclass
class Model:
    """Of one feature: rows, coefficients (levels, then covariates), the covariates' means, variances, and what the tests need."""

    n: int
    beta: np.ndarray
    means: np.ndarray
    residual: float
    ratio: float
    inverse: np.ndarray
    slope: np.ndarray
    asymptotic: np.ndarray | None
    rank: int

    def contrast(self, c: np.ndarray) -> tuple[float, float, float]:
        """Estimate, standard error and degrees of freedom of c'beta."""
        own = float(c @ self.inverse @ c)
        variance = max(self.residual * own, 0.0)
        df = float(self.n - self.rank)
        if self.asymptotic is not None and variance > 0:
            gradient = np.array([own, self.residual * float(c @ self.slope @ c)])
            spread = float(gradient @ self.asymptotic @ gradient)
            df = 2 * variance * variance / spread if spread > 0 else df
        return float(c @ self.beta), math.sqrt(variance), df


def group_sums(df: DataFrame, group: str, ys: list[str], condition: str, levels: list[str], covariates: list[str]) -> DataFrame:
    """feature, group, n, ``s`` (sums of y and the regressors) and ``p`` (sums of their products, row by row of the upper triangle): rows that know y and all regressors."""
    xs = [(F.col(condition) == level).cast("double") for level in levels] + [F.col(f"`{c}`").cast("double") for c in covariates]
    known = df.where(F.col(condition).isin(levels))
    long = known.select(F.col(group).alias("group"), F.explode(F.array(*[F.struct(F.lit(y).alias("feature"), F.col(f"`{y}`").cast("double").alias("y")) for y in ys])).alias("f"), *[x.alias(f"x{i + 1}") for i, x in enumerate(xs)])
    names = ["x0", *[f"x{i + 1}" for i in range(len(xs))]]
    long = long.select("group", "f.feature", F.col("f.y").alias("x0"), *names[1:]).dropna(subset=["group", *names])
    long = long.where(" and ".join(f"not isnan({c})" for c in names))
    products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    return long.groupBy("feature", "group").agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in names]).alias("s"), F.array(*products).alias("p"))


class _Sums:
    """M = Z'WZ of a feature at a ratio, with its two derivatives by the ratio, and those of the sum of log(1 + n ratio)."""

    def __init__(self, row, size: int):
        def square(values: list[float]) -> np.ndarray:
            m = np.zeros((size, size))
            m[np.triu_indices(size)] = values
            return m + np.triu(m, 1).T

        self.m, self.m1, self.m2 = (square(row[k]) for k in ("m", "m1", "m2"))
        self.logs, self.n = np.array(row["logs"]), row["n"]
        self.ratio, self.sums = row["ratio"], np.array(row["sums"])

    def solved(self) -> None:
        """Coefficients, residual sum and the criterion (twice the negative log likelihood, profiled) with its derivatives."""
        xx, xy = self.m[1:, 1:], self.m[1:, 0]
        self.k = np.linalg.pinv(xx, hermitian=True)
        self.rank = int(np.linalg.matrix_rank(xx, hermitian=True))
        self.beta = self.k @ xy
        e = np.append(1.0, -self.beta)
        self.r = max(float(e @ self.m @ e), 1e-14 * abs(float(self.m[0, 0])), 1e-100)  # a perfect fit leaves nothing
        v = self.m1[1:] @ e
        self.r1, self.r2 = float(e @ self.m1 @ e), float(e @ self.m2 @ e - 2 * v @ self.k @ v)
        values = np.linalg.eigvalsh(xx)
        a, b = self.k @ self.m1[1:, 1:], self.k @ self.m2[1:, 1:]
        self.l = self.logs + [float(np.log(values[-self.rank :]).sum()), float(np.trace(a)), float(np.trace(b) - np.trace(a @ a))]
        free = max(self.n - self.rank, 1)
        self.criterion = free * math.log(self.r) + self.l[0]
        self.c1 = free * self.r1 / self.r + self.l[1]
        self.c2 = free * (self.r2 / self.r - (self.r1 / self.r) ** 2) + self.l[2]


def _at_ratios(sums: DataFrame, ratios: dict[str, list[float]], size: int) -> list[tuple[str, _Sums]]:
    """The sums of each feature at each of its ratios, in one job; the ratios, a few for each feature, are sent along."""
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sent = sums.sparkSession.createDataFrame([(f, float(r)) for f, own in ratios.items() for r in own], "feature string, ratio double")
    n, r = F.col("n"), F.col("ratio")
    turn: dict[str, Column] = {"m": -r / (1 + n * r), "m1": -1 / ((1 + n * r) * (1 + n * r)), "m2": 2 * n / ((1 + n * r) * (1 + n * r) * (1 + n * r))}
    cells = [F.array(*[F.sum((F.col("p")[i] if k == "m" else F.lit(0.0)) + w * F.col("s")[a] * F.col("s")[b]) for i, (a, b) in enumerate(pairs)]).alias(k) for k, w in turn.items()]
    logs = F.array(F.sum(F.log(1 + n * r)), F.sum(n / (1 + n * r)), -F.sum(n * n / ((1 + n * r) * (1 + n * r)))).alias("logs")
    found = sums.join(F.broadcast(sent), "feature").groupBy("feature", "ratio").agg(*cells, logs, F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(size)]).alias("sums"))
    out = [(row["feature"], _Sums(row, size)) for row in found.where(F.col("n") >= size).collect()]
    for _, s in out:
        s.solved()
    return out


def fitted(df: DataFrame, group: str, ys: list[str], condition: str, levels: list[str], covariates: list[str]) -> dict[str, Model]:
    """REML fits of all of ``ys``; a feature with no more rows than coefficients has none.

    The ratio of variances is searched from a list of starts by Newton's steps on its logarithm, inside the bracket that
    the starts leave; each step is one job for all features.
    """
    size = len(levels) + len(covariates) + 1
    sums = group_sums(df, group, ys, condition, levels, covariates).persist()
    try:
        starts: dict[str, list[_Sums]] = {}
        for f, s in _at_ratios(sums, {y: list(RATIOS) for y in ys}, size):
            if s.n > s.rank:
                starts.setdefault(f, []).append(s)
        best, bracket = {}, {}
        for f, own in starts.items():
            own.sort(key=lambda s: s.ratio)
            i = min(range(len(own)), key=lambda j: own[j].criterion)
            best[f] = own[i]
            bracket[f] = (own[max(i - 1, 0)].ratio, own[i + 1].ratio if i + 1 < len(own) else own[i].ratio * 100)
        moving = {f for f, s in best.items() if s.ratio > 0 or s.c1 < 0}
        for _ in range(STEPS):
            asked = {}
            for f in sorted(moving):
                s, (low, high) = best[f], bracket[f]
                low = max(low, 1e-9)
                slope, curve = s.ratio * s.c1, s.ratio * s.ratio * s.c2 + s.ratio * s.c1
                step = s.ratio * math.exp(-slope / curve) if s.ratio > 0 and curve > 0 and abs(slope / curve) < 50 else 0.0
                asked[f] = [step if low <= step <= high else math.sqrt(low * high)]
            if not asked:
                break
            for f, s in _at_ratios(sums, asked, size):
                old, (low, high) = best[f], bracket[f]
                bracket[f] = (max(low, s.ratio), high) if s.c1 < 0 else (low, min(high, s.ratio))
                if s.criterion <= old.criterion:
                    best[f] = s
                if abs(s.ratio - old.ratio) <= 1e-9 * (s.ratio + old.ratio):
                    moving.discard(f)
    finally:
        sums.unpersist()
    return {f: _model(s, len(levels)) for f, s in best.items()}


def _model(s: _Sums, levels: int) -> Model:
    free = s.n - s.rank
    residual = s.r / free
    asymptotic = None
    if s.ratio > 1e-8:
        # the information on (residual variance, ratio)
        h = np.array([[free / (2 * residual**2), -s.r1 / (2 * residual**2)], [-s.r1 / (2 * residual**2), (s.l[2] + s.r2 / residual) / 2]])
        asymptotic = np.linalg.inv(h) if np.linalg.det(h) > 0 else None
    return Model(s.n, s.beta, s.sums[1 + levels :] / s.n, residual, s.ratio, s.k, -s.k @ s.m1[1:, 1:] @ s.k, asymptotic, s.rank)


def pairwise(df: DataFrame, group: str, ys: list[str], condition: str, levels: list[str], covariates: list[str]) -> DataFrame:
    """feature, a, b, estimate, se, df, t, p, p_tukey: contrasts of all pairs of levels, t tests alone and adjusted by the studentised range.

    A feature that can't be fitted has no rows. Rows are as many as features by pairs.
    """
    rows = []
    for y, m in sorted(fitted(df, group, ys, condition, levels, covariates).items()):
        for i, a in enumerate(levels):
            for j in range(i + 1, len(levels)):
                c = np.zeros(len(m.beta))
                c[i], c[j] = 1, -1
                estimate, se, free = m.contrast(c)
                t = estimate / se if se else None
                rows.append((y, a, levels[j], estimate, se, free, t, None if t is None else t_tail(t, free), None if t is None else range_tail(abs(t) * math.sqrt(2), len(levels), free)))
    return df.sparkSession.createDataFrame(rows, "feature string, a string, b string, estimate double, se double, df double, t double, p double, p_tukey double")


def estimated_means(df: DataFrame, group: str, ys: list[str], condition: str, levels: list[str], covariates: list[str]) -> DataFrame:
    """feature, condition, mean, se, df, low, high: the levels' means at the mean covariates with 95 % intervals, for each of ``ys``.

    A feature that can't be fitted has a row for each level with NULLs. Rows are as many as features by levels.
    """
    models, rows = fitted(df, group, ys, condition, levels, covariates), []
    for y in ys:
        for i, level in enumerate(levels):
            if y not in models:
                rows.append((y, level, *[None] * 5))
                continue
            mean, se, free = models[y].contrast(np.concatenate([np.eye(len(levels))[i], models[y].means]))
            reach = t_quantile(0.05, free) * se
            rows.append((y, level, mean, se, free, mean - reach, mean + reach))
    return df.sparkSession.createDataFrame(rows, "feature string, condition string, mean double, se double, df double, low double, high double")
